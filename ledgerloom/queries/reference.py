"""One query per operator of the report pipeline, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import ratio_udf
from ledgerloom.functions.text import clean_token, normalize_text, simple_normalize
from ledgerloom.operators import dimensions, provider, reports, resolution, rules
from ledgerloom.operators.sequences import numbered
from ledgerloom.plans import jobs, pipeline
from ledgerloom.session import scratch
from ledgerloom.sources import master, workbook
from ledgerloom.tables import table

QUERIES = {}
SQL = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- SQL building blocks

_SP = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def n_sql(x: str) -> str:
    """normalize_text in SQL."""
    folded = f"regexp_replace(lower(coalesce({x}, '')), '{_SP}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g'))"


def s_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{_SP}', ' ', 'g'))"


def c_sql(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '^{_SP}|{_SP}$', '', 'g')"
    return f"case when lower({t}) = 'nan' then '' else {t} end"


def ratio_sql(a: str, b: str) -> str:
    return (
        f"cast(200.0 as double) * list_reduce(list_prepend([0 for x in range(0, length({b}) + 1)], [[x] for x in range(1, length({a}) + 1)]), "
        f"lambda prev, ia: list_reduce(list_prepend([0], [[j] for j in range(1, length({b}) + 1)]), "
        f"lambda cur, j: list_append(cur, case when substring({b}, j[1], 1) = substring({a}, ia[1], 1) then prev[j[1]] + 1 else greatest(prev[j[1] + 1], cur[j[1]]) end)))[length({b}) + 1] "
        f"/ (length({a}) + length({b}))"
    )


def edits_sql(a: str, b: str) -> str:
    """Edit distance in characters (the built-in one counts bytes)."""
    return (
        f"list_reduce(list_prepend([x for x in range(0, length({b}) + 1)], [[x] for x in range(1, length({a}) + 1)]), "
        f"lambda prev, ia: list_reduce(list_prepend([ia[1]], [[j] for j in range(1, length({b}) + 1)]), "
        f"lambda cur, j: list_append(cur, least(prev[j[1] + 1] + 1, cur[j[1]] + 1, prev[j[1]] + case when substring({b}, j[1], 1) = substring({a}, ia[1], 1) then 0 else 1 end))))[length({b}) + 1]"
    )


def cascade_sql(p: str, values: str, entities: str, aliases: str, numeric: bool = True) -> str:
    """Common table expressions of the cascade over ``values(scope, value)``; the last, ``<p>hit``, has what it finds."""
    pairs = f"{p}l v join {aliases} a on a.scope = v.scope and a.k <> ''"
    near = "3 * least(length(v.k), length(a.k)) >= 2 * greatest(length(v.k), length(a.k)) and 5 * levenshtein(v.k, a.k) <= (length(v.k) + length(a.k)) * case when strlen(v.k) = length(v.k) and strlen(a.k) = length(a.k) then 1 when regexp_matches(v.k || a.k, '^[\\x{0}-\\x{7ff}]*$') then 2 else 4 end"
    return f"""
{p}v as materialized (select scope, value, {n_sql('value')} as k from {values}),
{p}e as materialized (select v.scope, v.value, min(e.id) as id from {p}v v join {entities} e on e.scope = v.scope and e.k = v.k where v.k <> '' group by all),
{p}a as materialized (select v.scope, v.value, min(a.id) as id from {p}v v anti join {p}e e on e.scope = v.scope and e.value = v.value join {aliases} a on a.scope = v.scope and a.k = v.k where v.k <> '' group by all),
{p}l as materialized (select * from {p}v v anti join {p}e e on e.scope = v.scope and e.value = v.value anti join {p}a a on a.scope = v.scope and a.value = v.value
  where k <> ''{'' if numeric else " and not regexp_matches(k, '^" + chr(92) + "p{Nd}+$')"}),
{p}t as materialized (select scope, value, min(id) as id, min(d) as d from (
  select *, min(d) over (partition by scope, value) as best from (
    select v.scope, v.value, a.id, {edits_sql('v.k', 'a.k')} as d from {pairs} and length(v.k) <= 6 and length(a.k) <= 6 and abs(length(v.k) - length(a.k)) <= 1) where d <= 1)
  where d = best group by scope, value having count(distinct id) = 1),
{p}f as materialized (select scope, value, min(id) as id, min(score) as score from (
  select *, max(score) over (partition by scope, value) as best from (
    select v.scope, v.value, a.id, {ratio_sql('v.k', 'a.k')} as score from {pairs} and {near} anti join {p}t t on t.scope = v.scope and t.value = v.value) where score >= 80)
  where score = best group by scope, value),
{p}hit as materialized (select scope, value, id, 'exact' as stage, cast(null as double) as score from {p}e union all select scope, value, id, 'alias', null from {p}a
  union all select scope, value, id, 'typo', d from {p}t union all select scope, value, id, 'fuzzy', score from {p}f)"""


_WORDS = "case {x} " + " ".join(f"when '{w}' then '{i}'" for i, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"))) + " end"


def _strip_sql(n: str, b: str) -> str:
    return f"case when {s_sql(b)} <> '' and starts_with({s_sql(n)}, {s_sql(b)}) then trim(substring({s_sql(n)}, length({s_sql(b)}) + 1)) else {s_sql(n)} end"


_KIND_SQL = (("brand", "brand", "dim_brand", "brand_id"), ("governorate_city", "governorate", "dim_governorate", "governorate_id"), ("license_type", "license_type", "dim_licensetype", "licensetype_id"))

CASCADES = f"""
with kw as materialized ({' union all '.join(f"select '{k}' as scope, {raw} as value, min(row_id) as first_row from report_rows where {c_sql(raw)} <> '' group by all" for k, raw, _, _ in _KIND_SQL)}),
ken as materialized ({' union all '.join(f"select '{k}' as scope, {key} as id, {n_sql('canonical_name')} as k from {t} where {key} is not null" for k, _, t, key in _KIND_SQL)}),
kal as materialized (select scope, id, k from ken {' '.join(f"union all select '{k}', a.{key}, {n_sql('a.alias')} from {t}_alias a semi join {t} d on d.{key} = a.{key}" for k, _, t, key in _KIND_SQL[:2])}),
{cascade_sql('k', 'kw', 'ken', 'kal')},
mp as materialized (
  select scope, brand, model, name, coalesce({_WORDS.format(x='(' + _strip_sql('asked', 'name') + ')')}, asked) as value from (
    select b.id as scope, r.brand, r.model, d.name, {c_sql('r.model')} as asked from (select distinct brand, model from report_rows) r join khit b on b.scope = 'brand' and b.value = r.brand
    join (select brand_id, coalesce(any_value(canonical_name), '') as name from dim_brand group by brand_id) d on d.brand_id = b.id) where asked <> ''),
mw as materialized (select distinct scope, value from mp),
men as materialized (select brand_id as scope, model_id as id, {n_sql('canonical_name')} as k from dim_model where brand_id is not null and model_id is not null),
{cascade_sql('m', 'mw', 'men', 'men', numeric=False)}"""

RESOLVED = f"""{CASCADES},
r as (
  select r.row_id, r.governorate as "Governorate", r.license_type as "License Type", r.brand as "Brand", r.model as "Model", r.count_value as "Count",
    r.report_year as "Year", r.report_month as "Month",
    b.brand_id, b.canonical_name as brand_canonical_name, b.country as brand_country,
    m.model_id, m.canonical_name as model_canonical_name, m.motor_type as model_motor_type,
    l.licensetype_id as license_type_id, l.canonical_name as license_type_canonical_name,
    g.governorate_id, g.canonical_name as governorate_canonical_name
  from report_rows r
  left join khit hb on hb.scope = 'brand' and hb.value = r.brand left join dim_brand b on b.brand_id = hb.id
  left join khit hg on hg.scope = 'governorate_city' and hg.value = r.governorate left join dim_governorate g on g.governorate_id = hg.id
  left join khit hl on hl.scope = 'license_type' and hl.value = r.license_type left join dim_licensetype l on l.licensetype_id = hl.id
  left join mp on mp.brand = r.brand and mp.model = r.model left join mhit hm on hm.scope = mp.scope and hm.value = mp.value left join dim_model m on m.model_id = hm.id)
"""

_TABLES = ("report_rows", "dim_brand", "dim_brand_alias", "dim_model", "dim_governorate", "dim_governorate_alias", "dim_licensetype")


def run_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in _TABLES}


def resolved(spark: SparkSession, d: str, *fields: str, attach: bool = True) -> DataFrame:
    """Report rows after the whole cascade (of some fields, if they are named), with ids alone if nothing is to be attached."""
    tables = run_tables(spark, d)
    return pipeline.resolve_all(tables["report_rows"], tables, learn=False, fields=fields or pipeline.FIELDS, attach=attach)[0]


def places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct governorate requests, entities and aliases in the shape of the cascade."""
    values = table(spark, d, "report_rows").where(clean_token(F.col("governorate")) != "").select(F.lit("").alias("scope"), F.col("governorate").alias("value")).distinct()
    entities = table(spark, d, "dim_governorate").select(F.lit("").alias("scope"), F.col("governorate_id").alias("entity_id"), F.col("canonical_name").alias("name"))
    aliases = table(spark, d, "dim_governorate_alias").select(F.lit("").alias("scope"), F.col("governorate_id").alias("entity_id"), "alias", F.col("alias_id").alias("ord"))
    return values, entities, aliases


_VALUES = f"select distinct governorate as value from report_rows where {c_sql('governorate')} <> ''"

# -- sources and sinks


@query("select governorate_id, canonical_name, normalized_name, 'all' as block from dim_governorate")
def scan_skip_header(spark: SparkSession, d: str) -> DataFrame:
    """A workbook with three title rows and a merged block column, written and scanned again (the governorate list has 24 rows at every scale)."""
    rows = [tuple(r) for r in table(spark, d, "dim_governorate").select("governorate_id", "canonical_name", "normalized_name").collect()]
    sheet = [["Report"], [None], ["as of today"], ["block", "governorate_id", "canonical_name", "normalized_name"]]
    sheet += [["all" if i == 0 else None, *r] for i, r in enumerate(rows)]
    merges = [f"A5:A{len(sheet)}"] if len(rows) > 1 else []
    content = workbook.write_workbook([("Sheet1", sheet, merges)])
    files = spark.createDataFrame([("report.xlsx", bytearray(content))], "path string, content binary")
    return workbook.scan(files, ["block", "governorate_id", "canonical_name", "normalized_name"], skip_rows=3).drop("path", "row_no")


@query("""select row_id, last_value(nullif(case when trim(governorate, ' ') = '' then null else governorate end, '') ignore nulls)
  over (partition by file_name order by row_id rows between unbounded preceding and current row) as governorate from report_rows""")
def fill_merged_down(spark: SparkSession, d: str) -> DataFrame:
    return reports.fill_down(table(spark, d, "report_rows"), "governorate", ["file_name"], "row_id").select("row_id", "governorate")


@query("""
select 'brand' as entity_type, brand_id as entity_id, canonical_name, (select count(*) from dim_brand_alias a where a.brand_id = b.brand_id) as n_aliases, cast(null as varchar) as parent_id from dim_brand b
union all select 'model', model_id, canonical_name, 0, brand_id from dim_model
union all select 'license_type', licensetype_id, canonical_name, 0, null from dim_licensetype
union all select 'governorate_city', governorate_id, canonical_name, (select count(*) from dim_governorate_alias a where a.governorate_id = g.governorate_id), null from dim_governorate g""")
def master_dim_build(spark: SparkSession, d: str) -> DataFrame:
    def one(kind: str, name: str, key: str, alias: str | None, parent: str | None) -> DataFrame:
        dim = table(spark, d, name)
        counts = table(spark, d, alias).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n")) if alias else None
        joined = dim.join(counts, F.col(key) == F.col("_k"), "left") if counts is not None else dim.withColumn("n", F.lit(0).cast("bigint"))
        return joined.select(
            F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), "canonical_name", F.coalesce("n", F.lit(0)).alias("n_aliases"),
            (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_id"),
        )

    out = one("brand", "dim_brand", "brand_id", "dim_brand_alias", None)
    for kind in (("model", "dim_model", "model_id", None, "brand_id"), ("license_type", "dim_licensetype", "licensetype_id", None, None), ("governorate_city", "dim_governorate", "governorate_id", "dim_governorate_alias", None)):
        out = out.unionByName(one(*kind))
    return out


@query("select distinct file_name, regexp_matches(lower(file_name), '\\.(xlsx|xlsm|xls)$') as accepted from report_rows union select distinct file_name, regexp_matches(lower(file_name), '\\.(xlsx|xlsm|xls)$') from raw_report_lines")
def file_ext_filter(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "report_rows").select("file_name").unionByName(table(spark, d, "raw_report_lines").select("file_name")).distinct()
    return names.select("file_name", workbook.is_workbook(F.col("file_name")).alias("accepted"))


@query("select distinct brand, model, cast(null as varchar) as reason from report_rows where count_value is null union select distinct brand, model, 'again' from report_rows where license_type is null")
def log_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "report_rows")
    return reports.log_union(rows.where("count_value is null").select("brand", "model"), rows.where("license_type is null").select("brand", "model", F.lit("again").alias("reason")))


_MASTER_SQL = " union all ".join(
    f"select '{k}' as entity_type, {key} as entity_id, canonical_name, normalized_name, {aliases} as aliases, {'brand_id' if k == 'model' else 'null'} as brand_id, {'country' if k == 'brand' else 'null'} as country, {'motor_type' if k == 'model' else 'null'} as motor_type from {t} d"
    for k, t, key, aliases in (
        ("brand", "dim_brand", "brand_id", "(select coalesce(string_agg(distinct alias, '|' order by alias), '') from dim_brand_alias a where a.brand_id = d.brand_id)"), ("model", "dim_model", "model_id", "''"),
        ("license_type", "dim_licensetype", "licensetype_id", "''"), ("governorate_city", "dim_governorate", "governorate_id", "(select coalesce(string_agg(distinct alias, '|' order by alias), '') from dim_governorate_alias a where a.governorate_id = d.governorate_id)"),
    )
)


@query(_MASTER_SQL)
def master_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All master data written as documents and read again."""
    path = scratch(spark)
    kinds = (*pipeline.KINDS, pipeline.MODEL)
    master.save_master(master.master_entities(pipeline.with_alias_tables(run_tables(spark, d)), kinds), path)
    return master.load_master(spark, path, lines=True).withColumn("aliases", F.array_join("aliases", "|"))


@query("select row_id, brand, model, 'no count' as reason from report_rows where count_value is null union all select row_id, brand, null, 'no licence' from report_rows where license_type is null")
def log_append_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Two runs append to a log; it is read again with a record in it that is broken and one that is missing a column."""
    path, rows = scratch(spark), table(spark, d, "report_rows")
    master.write_log(rows.where("count_value is null").select("row_id", "brand", "model", F.lit("no count").alias("reason")), path)
    master.write_log(rows.where("license_type is null").select("row_id", "brand", F.lit("no licence").alias("reason")), path)
    spark.range(1).select(F.lit('{"row_id": 1, "brand": ').alias("value")).write.mode("append").text(path)
    return master.read_log(spark, path, "row_id bigint, brand string, model string, reason string", lines=True)


@query("""select row_id, trim(brand, ' ') as brand, cast(count_value as varchar) as count_value, file_name from (
  select row_id, brand, case when isnan(count_value) then null when count_value = floor(count_value) then cast(cast(count_value as bigint) as varchar) else cast(count_value as varchar) end as count_value, file_name from report_rows)""")
def workbook_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Report rows written as workbooks of 1,000 rows and read again."""
    folder = scratch(spark).removeprefix("file:")
    rows = table(spark, d, "report_rows").select("row_id", "brand", "count_value", "file_name")
    workbook.write_books(rows, folder, rows_per_book=1000)
    back = workbook.scan(workbook.workbook_files(spark, folder), rows.columns)
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), F.trim("brand").alias("brand"), F.regexp_replace("count_value", r"\.0$", "").alias("count_value"), "file_name")


@query("select cast(user_id as varchar) as job_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as at from events group by user_id")
def job_list(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each job (users and their events stand for jobs and their states)."""
    path = scratch(spark)
    states = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("n_rows"))
    states.write.parquet(path)
    return jobs.job_list(spark, path).select("job_id", "status", "at")


_SOURCE = f"select brand_id, any_value(upper(canonical_name)) as canonical_name, any_value({n_sql('canonical_name')}) as normalized_name, any_value('updated') as country, any_value(source_system) as source_system, any_value(updated_at) as updated_at from dim_brand where source_system <> 'registry_master' group by brand_id"


@query(f"""with s as ({_SOURCE} union all select 'NEW' || brand_id, canonical_name, normalized_name, country, source_system, updated_at from dim_brand where country is null),
t as (select * from dim_brand)
select coalesce(s.brand_id, t.brand_id) as brand_id, case when s.brand_id is not null then s.canonical_name else t.canonical_name end as canonical_name,
case when s.brand_id is not null then s.normalized_name else t.normalized_name end as normalized_name, case when s.brand_id is not null then s.country else t.country end as country
from t full outer join s on t.brand_id = s.brand_id""")
def merge_upsert_dim(spark: SparkSession, d: str) -> DataFrame:
    columns = ["brand_id", "canonical_name", "normalized_name", "country"]
    target = table(spark, d, "dim_brand")
    changed = target.where("source_system <> 'registry_master'").select("brand_id", F.upper("canonical_name").alias("canonical_name"), normalize_text(F.col("canonical_name")).alias("normalized_name"), F.lit("updated").alias("country"))
    added = target.where("country is null").select(F.concat(F.lit("NEW"), "brand_id").alias("brand_id"), "canonical_name", "normalized_name", "country")
    return dimensions.merge_upsert(target.select(*columns), changed.unionByName(added), "brand_id")


@query("""with s as (select distinct brand_id, trim(canonical_name, ' ') as alias from dim_brand where brand_id is not null and trim(canonical_name, ' ') <> '')
select brand_id, alias from dim_brand_alias union all select * from s where not exists (select 1 from dim_brand_alias t where t.brand_id = s.brand_id and t.alias = s.alias)""")
def merge_alias_insert_only(spark: SparkSession, d: str) -> DataFrame:
    return dimensions.merge_aliases(table(spark, d, "dim_brand_alias"), table(spark, d, "dim_brand").select("brand_id", F.col("canonical_name").alias("alias")), "brand_id")


_FACT = f"""{RESOLVED},
k as (select * from r where brand_id is not null and model_id is not null and license_type_id is not null and governorate_id is not null
  and lower(license_type_canonical_name) in ('private', 'ملاكي') and "Count" is not null and not isnan("Count") and model_motor_type is not null and brand_country is not null),
f as (select row_number() over (order by row_id) as "Fact_ID", * from k)"""


@query(f"""{_FACT} select "Fact_ID", brand_id as "Brand_ID", model_id as "Model_ID", license_type_id as "LicenseType_ID", governorate_id as "Governorate_ID", "Count" as "Vehicle_Count", make_date("Year", "Month", 1) as "Reporting_Date" from f""")
def fact_build(spark: SparkSession, d: str) -> DataFrame:
    """Fact rows of the whole run."""
    return pipeline.run(run_tables(spark, d), learn=False).facts()[0]


@query(f"""{_FACT} select row_id, 'Count' as "Attribute_Name", case when "Count" = floor("Count") then cast(cast("Count" as bigint) as varchar) else cast("Count" as varchar) end as "Attribute_Value" from f
union all select row_id, 'Year', cast("Year" as varchar) from f where "Year" is not null union all select row_id, 'Governorate', "Governorate" from f where "Governorate" is not null""")
def eav_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return reports.attribute_rows(pipeline.run(run_tables(spark, d), learn=False).kept, "row_id", ["Count", "Year", "Governorate"])


@query(f"""{_FACT} select "Fact_ID", 'Count' as "Attribute_Name", case when "Count" = floor("Count") then cast(cast("Count" as bigint) as varchar) else cast("Count" as varchar) end as "Attribute_Value" from f""")
def fact_attributes(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.run(run_tables(spark, d), learn=False).facts()[1]


@query(f"""{CASCADES} select scope as entity_type, '' as scope, value, id as entity_id, stage, score from khit union all select 'model', scope, value, id, stage, score from mhit""")
def cascade_all_types(spark: SparkSession, d: str) -> DataFrame:
    """What the cascade finds for every distinct brand, governorate, licence type and model (within its brand)."""
    tables = run_tables(spark, d)
    return pipeline.resolve_all(tables["report_rows"], tables, learn=False)[1]


@query(f"""{CASCADES}, h as (select scope as entity_type, '' as scope, value, id, stage, score from khit union all select 'model', scope, value, id, stage, score from mhit)
select entity_type, scope, value, case stage when 'typo' then 'short value one edit away, likely a typo' else 'likeness of medium confidence' end as reason, id as entity_id, score from h where stage = 'typo' or stage = 'fuzzy' and score < 95""")
def low_confidence_log(spark: SparkSession, d: str) -> DataFrame:
    tables = run_tables(spark, d)
    return pipeline.resolve_all(tables["report_rows"], tables, learn=False)[2]


_ALIAS_KINDS = (("brand", "dim_brand_alias", "brand_id"), ("governorate_city", "dim_governorate_alias", "governorate_id"))


@query(f"""{CASCADES}, new as ({' union '.join(f"select '{k}' as entity_type, id as entity_id, {n_sql('value')} as alias from khit anti join {t} a on a.{key} = id and a.alias = {n_sql('value')} where scope = '{k}' and stage in ('typo', 'fuzzy')" for k, t, key in _ALIAS_KINDS)}
  union select 'license_type', id, {n_sql('value')} from khit where scope = 'license_type' and stage in ('typo', 'fuzzy') union select 'model', id, {n_sql('value')} from mhit where stage in ('typo', 'fuzzy'))
{' union all '.join(f"select '{k}' as entity_type, alias_id as alias_id, {key} as entity_id, alias from {t}" for k, t, key in _ALIAS_KINDS)}
{' '.join(f"union all select '{k}', (select max(alias_id) from {t}) + row_number() over (order by entity_id, alias), entity_id, alias from new where entity_type = '{k}'" for k, t, _ in _ALIAS_KINDS)}
union all select entity_type, null, entity_id, alias from new where entity_type in ('license_type', 'model')""")
def alias_learning(spark: SparkSession, d: str) -> DataFrame:
    """The alias tables of all four types after a run."""
    tables = run_tables(spark, d)
    after = pipeline.resolve_all(tables["report_rows"], tables)[3]
    out = None
    for kind in (*pipeline.KINDS, pipeline.MODEL):
        aliases = after[kind.aliases]
        number = F.col("alias_id").cast("bigint") if "alias_id" in aliases.columns else F.lit(None).cast("bigint")
        rows = aliases.select(F.lit(kind.name).alias("entity_type"), number.alias("alias_id"), F.col(kind.key).alias("entity_id"), "alias")
        out = rows if out is None else out.unionByName(rows)
    return out


def _first_letters(requests: DataFrame) -> DataFrame:
    """A provider for the query below: names a value by its first four letters."""
    return requests.withColumns({"matched": F.lit(True), "canonical_name": F.substring("value", 1, 4), "confidence": F.lit(1.0)})


@query(f"""{CASCADES},
q as materialized (select w.value, w.first_row, trim(substring(w.value, 1, 4), ' ') as name, {n_sql('substring(w.value, 1, 4)')} as n from kw w anti join khit h on h.scope = w.scope and h.value = w.value
  where w.scope = 'governorate_city' and {n_sql('w.value')} not in ({', '.join(repr(x) for x in reports.INVALID_NAMES)})),
known as (select k, min(id) as id from ken where scope = 'governorate_city' and k <> '' group by k),
m as materialized (select q.value, known.id from q join known on known.k = q.n),
fresh as materialized (select * from q anti join m on m.value = q.value where n <> ''),
made as (select n, printf('LOC%05d', (select coalesce(max(cast(regexp_extract(governorate_id, '([0-9]+)$', 1) as bigint)), 0) from dim_governorate) + row_number() over (order by min(first_row), n)) as id, arg_min(name, first_row) as name from fresh group by n)
select value, id as entity_id, 'external_match' as stage, g.canonical_name as name from m join dim_governorate g on g.governorate_id = m.id
union all select f.value, made.id, 'created', made.name from fresh f join made on made.n = f.n""")
def external_find_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Governorates the cascade leaves, matched or created by the answers of a provider, with ids that go on from the list's."""
    tables = run_tables(spark, d)
    tables["report_rows"] = tables["report_rows"].withColumns({c: F.lit(None).cast("string") for c in ("brand", "model", "license_type")})
    _, found, _, after = pipeline.resolve_all(tables["report_rows"], tables, ask=_first_letters)
    listed = after["dim_governorate"].select(F.col("governorate_id").alias("entity_id"), F.col("canonical_name").alias("name"))
    return found.where("stage in ('external_match', 'created')").join(listed, "entity_id").select("value", "entity_id", "stage", "name")


def _nation_names(spark: SparkSession, d: str):
    """A provider for the query below: a brand's number, modulo 25, picks a nation."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("_k"), F.trim("n_name").alias("canonical_name"))
    return lambda requests: requests.withColumn("_k", F.regexp_extract("value", r"(\d+)$", 1).cast("bigint") % 25).join(nations, "_k").drop("_k").withColumns({"matched": F.col("canonical_name") != "CHINA", "confidence": F.lit(0.9)})


@query("""select b.brand_id, case when b.country is null or trim(b.country, ' ') = '' then coalesce(n.n_name, b.country) else b.country end as country
from dim_brand b left join (select n_nationkey, trim(n_name, ' ') as n_name from nation where trim(n_name, ' ') <> 'CHINA') n on n.n_nationkey = cast(regexp_extract(b.brand_id, '([0-9]+)$', 1) as bigint) % 25""")
def enrich_apply(spark: SparkSession, d: str) -> DataFrame:
    """Countries that brands lack, filled from the confident answers of a provider."""
    brands = table(spark, d, "dim_brand")
    no_names = spark.createDataFrame([], "scope string, brand_name string")
    return pipeline.enriched(brands, brands.select("brand_id"), "brand_id", "country", no_names, _nation_names(spark, d), 0.7).select("brand_id", "country")


# -- projections


@query("""select governorate as "Governorate", license_type as "License Type", brand as "Brand", model as "Model", count_value as "Count", row_id from report_rows""")
def positional_project(spark: SparkSession, d: str) -> DataFrame:
    return reports.positional_project(table(spark, d, "report_rows"), [2, 3, 4, "model"], ["Governorate", "License Type", "Brand", "Model"], [6], ["Count"], ["row_id"])


@query("""select row_id, date '2025-04-20' as "Reporting_Date", 2025 as "Year", 4 as "Month" from report_rows""")
def report_date_parts(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_report_date(table(spark, d, "report_rows").select("row_id"), date(2025, 4, 20))


@query("select row_id, brand, model, governorate, license_type, count_value from report_rows")
def reorder_extras_last(spark: SparkSession, d: str) -> DataFrame:
    return reports.reorder_last(table(spark, d, "report_rows").select("row_id", "count_value", "brand", "model", "governorate", "license_type"), ["count_value"])


@query(f"""{RESOLVED} select row_id, "Count", "Year", "Month", brand_canonical_name, brand_country, model_canonical_name, model_motor_type, license_type_canonical_name, governorate_canonical_name from r""")
def filtered_projection(spark: SparkSession, d: str) -> DataFrame:
    return reports.filtered_projection(resolved(spark, d))


@query(f"""{RESOLVED} select row_id, brand_id, brand_canonical_name, brand_country, model_id, model_canonical_name, model_motor_type, license_type_id, license_type_canonical_name, governorate_id, governorate_canonical_name from r""")
def resolve_attach_columns(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).drop("Governorate", "License Type", "Brand", "Model", "Count", "Year", "Month")


@query(f"""{RESOLVED} select row_id, brand_id, "Model", model_id from r where model_id is not null""")
def join_composite_model(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).where("model_id is not null").select("row_id", "brand_id", "Model", "model_id")


# -- filters


@query(f"select row_id, model from report_rows where {c_sql('model')} <> ''")
def filter_valid_model(spark: SparkSession, d: str) -> DataFrame:
    return reports.valid_model(table(spark, d, "report_rows"), "model").select("row_id", "model")


@query(f"{RESOLVED} select row_id from r where brand_id is not null and model_id is not null and license_type_id is not null and governorate_id is not null")
def filter_essential_ids(spark: SparkSession, d: str) -> DataFrame:
    return reports.essential_ids(resolved(spark, d, attach=False)).select("row_id")


@query(f"{RESOLVED} select row_id, license_type_id from r where lower(license_type_canonical_name) in ('private', 'ملاكي')")
def filter_private_class(spark: SparkSession, d: str) -> DataFrame:
    return reports.private_only(resolved(spark, d, "license_type")).select("row_id", "license_type_id")


@query("""select row_id, count_value as "Count" from report_rows where count_value is not null and not isnan(count_value)""")
def filter_count_present(spark: SparkSession, d: str) -> DataFrame:
    return reports.count_present(table(spark, d, "report_rows").select("row_id", F.col("count_value").alias("Count")))


@query(f"{RESOLVED} select row_id, brand_country, model_motor_type from r where brand_country is not null and model_motor_type is not null")
def filter_metadata_complete(spark: SparkSession, d: str) -> DataFrame:
    return reports.metadata_complete(resolved(spark, d, "model")).select("row_id", "brand_country", "model_motor_type")


@query(f"""{RESOLVED} select distinct "Brand", "Model", "License Type", "Governorate", 'Unmatched brand or model' as "Reason" from r where brand_id is null or model_id is null""")
def unmatched_review(spark: SparkSession, d: str) -> DataFrame:
    return reports.unmatched_review(resolved(spark, d), ["Brand", "Model", "License Type", "Governorate"])


@query(f"""{RESOLVED}, k as (select * from r where brand_id is not null and model_id is not null)
select distinct brand_canonical_name as brand, model_canonical_name as model, 'brand_country' as missing from k where brand_country is null
union all select distinct brand_canonical_name, model_canonical_name, 'model_motor_type' from k where model_motor_type is null""")
def missing_metadata_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return reports.missing_metadata(resolved(spark, d, "model").where("brand_id is not null and model_id is not null"))


@query("select event_id from events where event_type in ('click', 'view') and coalesce(case when value > 18 then null else value / 20 end, 1.0) >= 0.7")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    confidence = F.when(F.col("value") <= 18, F.col("value") / 20)
    return table(spark, d, "events").where(resolution.confident(F.col("event_type").isin("click", "view"), confidence)).select("event_id")


@query(f"select row_id, governorate from report_rows where {n_sql('governorate')} in ({', '.join(repr(x) for x in reports.INVALID_NAMES)})")
def invalid_row_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").where(reports.invalid_name(F.col("governorate"))).select("row_id", "governorate")


@query(f"with b as (select {n_sql('canonical_name')} as k from dim_brand union select {n_sql('alias')} from dim_brand_alias) select row_id, model from report_rows where {n_sql('model')} <> '' and {n_sql('model')} in (select k from b)")
def brand_in_model_column(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "dim_brand").select(normalize_text(F.col("canonical_name")).alias("k")).union(table(spark, d, "dim_brand_alias").select(normalize_text(F.col("alias")).alias("k"))).distinct()
    rows = table(spark, d, "report_rows").withColumn("_k", normalize_text(F.col("model"))).where("_k <> ''")
    return rows.join(known, F.col("_k") == F.col("k"), "left_semi").select("row_id", "model")


@query("select model_id, motor_type, motor_type in ('Petrol', 'Diesel', 'Electric', 'Hybrid', 'CNG', 'REEV') as listed from dim_model where motor_type is not null")
def motor_type_domain(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.queries.general import MOTOR_TYPES

    return table(spark, d, "dim_model").where("motor_type is not null").select("model_id", "motor_type", F.col("motor_type").isin(*MOTOR_TYPES).alias("listed"))


# -- requests, joins and selections


@query(f"""{RESOLVED}, q as (select row_id, brand_id, {c_sql('"Model"')} as raw_model from r where brand_id is not null)
select brand_id, lower(raw_model) as model_key, arg_min(raw_model, row_id) as raw_model, min(row_id) as first_seen from q where raw_model <> '' group by brand_id, lower(raw_model)""")
def model_requests_distinct(spark: SparkSession, d: str) -> DataFrame:
    asked = resolved(spark, d, "brand").where("brand_id is not null").select("row_id", "brand_id", clean_token(F.col("Model")).alias("raw_model")).where("raw_model <> ''")
    return asked.groupBy("brand_id", F.lower("raw_model").alias("model_key")).agg(F.min_by("raw_model", "row_id").alias("raw_model"), F.min("row_id").alias("first_seen"))


@query(f"with v as ({_VALUES}) select value, min(governorate_id) as entity_id from v join dim_governorate g on {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('canonical_name')} group by value")
def exact_match_join(spark: SparkSession, d: str) -> DataFrame:
    values, entities, _ = places(spark, d)
    return resolution.exact_match(values, entities).select("value", "entity_id")


@query(f"select r.row_id, min(m.model_id) as model_id from report_rows r join (select canonical_name, min(brand_id) as brand_id from dim_brand group by 1) b on b.canonical_name = r.brand join dim_model m on m.brand_id = b.brand_id and {n_sql('r.model')} <> '' and {n_sql('m.canonical_name')} = {n_sql('r.model')} group by r.row_id")
def exact_match_model_in_brand(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "dim_brand").groupBy("canonical_name").agg(F.min("brand_id").alias("scope"))
    rows = table(spark, d, "report_rows").join(brands, F.col("brand") == F.col("canonical_name")).select("row_id", "scope", F.col("model").alias("value"))
    entities = table(spark, d, "dim_model").select(F.col("brand_id").alias("scope"), F.col("model_id").alias("entity_id"), F.col("canonical_name").alias("name"))
    matched = resolution.exact_match(rows.select("scope", "value").distinct(), entities)
    return rows.join(matched, ["scope", "value"]).select("row_id", F.col("entity_id").alias("model_id"))


@query(f"with v as ({_VALUES}) select value, min(governorate_id) as entity_id from v join dim_governorate_alias g on {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('alias')} group by value")
def alias_match_join(spark: SparkSession, d: str) -> DataFrame:
    values, _, aliases = places(spark, d)
    return resolution.alias_match(values, aliases).select("value", "entity_id")


@query("select brand_id, count(*) as n_models from dim_model where brand_id in (select brand_id from dim_brand where country is not null) group by brand_id")
def models_by_brand(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "dim_brand").where("country is not null").select("brand_id")
    return table(spark, d, "dim_model").join(kept, "brand_id", "left_semi").groupBy("brand_id").agg(F.count(F.lit(1)).alias("n_models"))


_TYPO = f"""select t.value, min(entity_id) as entity_id, min(t.d) as distance from (
  select value, entity_id, d, min(d) over (partition by value) as best from (
    select v.value, a.entity_id, {edits_sql('v.k', 'a.k')} as d
    from (select value, {n_sql('value')} as k from v) v join (select distinct governorate_id as entity_id, {n_sql('alias')} as k from dim_governorate_alias) a
    on length(v.k) between 1 and 6 and length(a.k) between 1 and 6 and abs(length(v.k) - length(a.k)) <= 1) where d <= 1) t
where t.d = t.best group by t.value having count(distinct entity_id) = 1"""


@query(f"with v as ({_VALUES}) {_TYPO}")
def typo_match_join(spark: SparkSession, d: str) -> DataFrame:
    values, _, aliases = places(spark, d)
    return resolution.typo_match(values, aliases).select("value", "entity_id", "distance")


_FUZZY = f"""select value, arg_min(entity_id, ord) as entity_id, any_value(score) as score from (
  select *, max(score) over (partition by value) as best from (
    select v.value, a.entity_id, a.ord, {ratio_sql('v.k', 'a.k')} as score
    from (select value, {n_sql('value')} as k from v) v join (select governorate_id as entity_id, alias_id as ord, {n_sql('alias')} as k from dim_governorate_alias) a
    on length(v.k) > 0 and length(a.k) > 0 and 3 * least(length(v.k), length(a.k)) >= 2 * greatest(length(v.k), length(a.k))) where score >= 80)
where score = best group by value"""


@query(f"with v as ({_VALUES}) {_FUZZY}")
def fuzzy_match_join(spark: SparkSession, d: str) -> DataFrame:
    values, _, aliases = places(spark, d)
    return resolution.fuzzy_match(values, aliases).select("value", "entity_id", "score")


@query(f"""with v0 as ({_VALUES}),
e as (select value, min(governorate_id) as entity_id from v0 join dim_governorate g on {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('canonical_name')} group by value),
a as (select value, min(governorate_id) as entity_id from v0 join dim_governorate_alias g on {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('alias')} where value not in (select value from e) group by value),
v as (select value from v0 where value not in (select value from e) and value not in (select value from a)),
t as ({_TYPO}),
f as (select * from ({_FUZZY}) where value not in (select value from t))
select value, entity_id, 'exact' as stage from e union all select value, entity_id, 'alias' from a union all select value, entity_id, 'typo' from t union all select value, entity_id, 'fuzzy' from f
union all select value, null, 'unresolved' from v where value not in (select value from t) and value not in (select value from f)""")
def resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    return resolution.cascade(*places(spark, d)).drop("scope")


@query(f"""with v0 as ({_VALUES}) select value from v0 where value not in (select value from v0 join dim_governorate g on {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('canonical_name')})
and value not in (select value from v0 join dim_governorate_alias g on {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('alias')})""")
def cascade_remainder_anti(spark: SparkSession, d: str) -> DataFrame:
    values, entities, aliases = places(spark, d)
    left = values.join(resolution.exact_match(values, entities), ["scope", "value"], "left_anti")
    return left.join(resolution.alias_match(values, aliases), ["scope", "value"], "left_anti").select("value")


@query("select model_id, m.canonical_name, coalesce(b.canonical_name, '') as brand_name from dim_model m left join dim_brand b using (brand_id)")
def model_with_brand_name(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "dim_brand").select("brand_id", F.col("canonical_name").alias("brand_name"))
    return table(spark, d, "dim_model").join(brands, "brand_id", "left").select("model_id", "canonical_name", F.coalesce("brand_name", F.lit("")).alias("brand_name"))


@query("select d.doc_id, l.subject from documents d left join (select doc_id, arg_max(subject, rater || subject) as subject from doc_labels group by doc_id) l using (doc_id)")
def align_by_index(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "doc_labels").select("doc_id", "subject", F.concat("rater", "subject").alias("given"))
    return resolution.align_answers(table(spark, d, "documents").select("doc_id"), answers, "doc_id", "given")


@query(f"""with k as (select row_id, {s_sql('brand')} as b, {s_sql('model')} as m from report_rows), g as (select b, m, min(row_id) as asked from k group by b, m)
select k.row_id, g.asked from k join g on k.b = g.b and k.m = g.m""")
def dedup_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct request is made once, by its first row, and its answer goes back to all rows that asked."""
    rows = table(spark, d, "report_rows").select("row_id", simple_normalize(F.col("brand")).alias("b"), simple_normalize(F.col("model")).alias("m"))
    asked = rows.groupBy("b", "m").agg(F.min("row_id").alias("asked"))
    return rows.join(asked, ["b", "m"]).select("row_id", "asked")


@query(f"with k as (select row_id, {c_sql('brand')} as brand from report_rows) select brand, min(row_id) as first_seen, row_number() over (order by min(row_id)) as place from k where brand <> '' group by brand")
def distinct_first_seen(spark: SparkSession, d: str) -> DataFrame:
    cleaned = table(spark, d, "report_rows").select("row_id", clean_token(F.col("brand")).alias("brand")).where("brand <> ''")
    return numbered(resolution.first_seen(cleaned, "brand", "row_id"), ["first_seen"], "place")




@query(f"""with q as (select distinct cast(n_nationkey as varchar) as value from nation),
names as (select cast(s_nationkey as varchar) || substring(s_name, 1, 2) as name from supplier union all select cast(r_regionkey as varchar) || substring(r_name, 1, 2) from region)
select value, min(name) as completion from q join names on regexp_extract({n_sql('name')}, '^(\\p{{Nd}}+)\\p{{L}}{{1,3}}$', 1) = value group by value having count(distinct {n_sql('name')}) = 1""")
def numeric_completion_unique(spark: SparkSession, d: str) -> DataFrame:
    """Bare numbers completed by the one known name that has them with one to three letters (numbers and names from the nation tables)."""
    asked = table(spark, d, "nation").select(F.lit("").alias("scope"), F.col("n_nationkey").cast("string").alias("value")).distinct()
    name = lambda t, key, text: table(spark, d, t).select(F.lit("").alias("scope"), F.concat(F.col(key).cast("string"), F.substring(text, 1, 2)).alias("name"))
    return resolution.numeric_completion(asked, name("supplier", "s_nationkey", "s_name").unionByName(name("region", "r_regionkey", "r_name"))).select("value", "completion")


@query("select brand_id, any_value(canonical_name) as canonical_name from dim_brand where country is null or trim(country, ' ') = '' group by brand_id")
def enrich_targets(spark: SparkSession, d: str) -> DataFrame:
    lacking = table(spark, d, "dim_brand").where(F.col("country").isNull() | (F.trim("country") == ""))
    return lacking.select("brand_id", "canonical_name").dropDuplicates(["brand_id"])


@query(f"{RESOLVED} select count(*) as n_rows, count_if(brand_id is not null and model_id is not null and license_type_id is not null and governorate_id is not null) as n_filtered from r")
def row_count_metrics(spark: SparkSession, d: str) -> DataFrame:
    full = F.col("brand_id").isNotNull() & F.col("model_id").isNotNull() & F.col("license_type_id").isNotNull() & F.col("governorate_id").isNotNull()
    return resolved(spark, d, attach=False).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(full).alias("n_filtered"))


@query(f"""{RESOLVED} select 'brand' as field, count_if(brand_id is not null) as n_resolved, count_if(brand_id is null) as n_unresolved from r
union all select 'model', count_if(model_id is not null), count_if(model_id is null) from r union all select 'license_type', count_if(license_type_id is not null), count_if(license_type_id is null) from r
union all select 'governorate', count_if(governorate_id is not null), count_if(governorate_id is null) from r""")
def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    fields = ("brand", "model", "license_type", "governorate")
    wide = resolved(spark, d, attach=False).agg(*[F.count_if(F.col(f"{f}_id").isNotNull()).alias(f) for f in fields], F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).alias("n_resolved"), (F.col("n") - F.col(f)).alias("n_unresolved")) for f in fields]
    return wide.select(F.inline(F.array(*entries)))


@query("""with known as (select brand_id, list(alias order by alias_id) as a from dim_brand_alias group by brand_id), new as (select brand_id, canonical_name as alias from dim_brand)
select k.brand_id, array_to_string(list_concat(k.a, case when n.alias is null or list_contains(k.a, n.alias) then [] else [n.alias] end), '|') as aliases from known k left join new n using (brand_id)""")
def alias_accumulate(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("alias_id", "alias"))), lambda x: x["alias"])
    known = table(spark, d, "dim_brand_alias").groupBy("brand_id").agg(ordered.alias("aliases"))
    learned = table(spark, d, "dim_brand").select("brand_id", F.col("canonical_name").alias("alias"))
    return dimensions.accumulate_aliases(known, learned, "brand_id").select("brand_id", F.array_join("aliases", "|").alias("aliases"))


@query("select brand, (row_number() over (order by min(row_id)) - 1) // 200 as chunk from report_rows where brand is not null group by brand")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    distinct = resolution.first_seen(table(spark, d, "report_rows").where("brand is not null"), "brand", "row_id")
    return numbered(distinct, ["first_seen"], "n", 0).select("brand", F.floor(F.col("n") / 200).alias("chunk"))


@query("select printf('MD%05d', 99990 + row_number() over (order by f, model)) as entity_id, model from (select model, min(row_id) as f from report_rows where model is not null group by model)")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "report_rows").select("model", "row_id")
    return dimensions.surrogate_ids(rows, "model", "row_id", "model", 99_991)


@query("select event_id, event_type as status, row_number() over (order by ts desc, event_id desc) as place from events")
def jobs_ordered(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), "ts")
    return numbered(jobs, [F.col("ts").desc(), F.col("event_id").desc()], "place").drop("ts")


@query(f"""with u as (select distinct {n_sql('brand')} as k, 0 as p from report_rows union all select {n_sql('canonical_name')}, 1 from dim_brand)
select k, case min(p) when 0 then 'created' else 'existing' end as source from u where k <> '' group by k""")
def candidate_union_priority(spark: SparkSession, d: str) -> DataFrame:
    created = table(spark, d, "report_rows").select(normalize_text(F.col("brand")).alias("k"), F.lit(0).alias("p")).distinct()
    existing = table(spark, d, "dim_brand").select(normalize_text(F.col("canonical_name")).alias("k"), F.lit(1).alias("p"))
    return created.unionByName(existing).where("k <> ''").groupBy("k").agg(F.when(F.min("p") == 0, F.lit("created")).otherwise(F.lit("existing")).alias("source"))


_ASKED = f"""select b.brand_id as scope, any_value(b.canonical_name) as brand_name, r.model as value, min(r.row_id) as ord
  from report_rows r join (select canonical_name, min(brand_id) as brand_id from dim_brand group by 1) b on b.canonical_name = r.brand where {c_sql('r.model')} <> '' group by b.brand_id, r.model"""
_MODEL_PAIRS = "(select scope, value, {n} as k from v where not regexp_matches({n}, '^\\p{{Nd}}+$')) v join (select brand_id as scope, model_id as entity_id, cast(substring(model_id, 3) as int) as ord, {a} as k from dim_model) a on v.scope = a.scope"


def _asked_models(spark: SparkSession, d: str) -> DataFrame:
    """Distinct models asked for under a brand's canonical name, with the first row that asked."""
    brands = table(spark, d, "dim_brand").groupBy("canonical_name").agg(F.min("brand_id").alias("scope"))
    rows = table(spark, d, "report_rows").where(clean_token(F.col("model")) != "").join(brands, F.col("brand") == F.col("canonical_name"))
    return rows.groupBy("scope", F.col("model").alias("value")).agg(F.first("canonical_name").alias("brand_name"), F.min("row_id").alias("ord"))


@query(f"""with v0 as ({_ASKED}),
e as (select v0.scope, value, min(model_id) as entity_id from v0 join dim_model m on m.brand_id = v0.scope and {n_sql('value')} <> '' and {n_sql('value')} = {n_sql('canonical_name')} group by v0.scope, value),
v as (select scope, value from v0 where not exists (select 1 from e where e.scope = v0.scope and e.value = v0.value)),
t as (select scope, value, min(entity_id) as entity_id from (
  select *, min(d) over (partition by scope, value) as best from (
    select v.scope, v.value, a.entity_id, {edits_sql('v.k', 'a.k')} as d
    from {_MODEL_PAIRS.format(n=n_sql('value'), a=n_sql('canonical_name'))} and length(v.k) between 1 and 6 and length(a.k) between 1 and 6) where d <= 1)
  where d = best group by scope, value having count(distinct entity_id) = 1),
f as (select scope, value, arg_min(entity_id, ord) as entity_id from (
  select *, max(score) over (partition by scope, value) as best from (
    select v.scope, v.value, a.entity_id, a.ord, {ratio_sql('v.k', 'a.k')} as score
    from {_MODEL_PAIRS.format(n=n_sql('value'), a=n_sql('canonical_name'))} and length(v.k) > 0 and length(a.k) > 0 and 3 * least(length(v.k), length(a.k)) >= 2 * greatest(length(v.k), length(a.k)))
  where score >= 80) where score = best group by scope, value),
f2 as (select * from f where not exists (select 1 from t where t.scope = f.scope and t.value = f.value))
select scope as brand_id, value, entity_id, 'exact' as stage from e union all select scope, value, entity_id, 'typo' from t union all select scope, value, entity_id, 'fuzzy' from f2
union all select scope, value, null, 'unresolved' from v where not exists (select 1 from t where t.scope = v.scope and t.value = v.value) and not exists (select 1 from f2 where f2.scope = v.scope and f2.value = v.value)""")
def model_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The cascade of models within their brands; all-digit models match exactly or not at all."""
    models = table(spark, d, "dim_model").select(F.col("brand_id").alias("scope"), F.col("model_id").alias("entity_id"), F.col("canonical_name").alias("name"))
    aliases = models.select("scope", "entity_id", F.col("name").alias("alias"), F.substring("entity_id", 3, 20).cast("int").alias("ord"))
    return resolution.cascade(_asked_models(spark, d).select("scope", "value"), models, aliases, models=True).withColumnRenamed("scope", "brand_id")


@query(f"""with q as (select *, value as name, {n_sql('value')} as norm from ({_ASKED})),
known as (select m.brand_id as scope, m.model_id as entity_id, m.canonical_name as name, {n_sql('m.canonical_name')} as norm from dim_model m where source_system = 'registry_master'),
a as (select * from q where norm <> ''),
ex as (select a.scope, a.value, min(k.entity_id) as target from a join known k on k.scope = a.scope and k.norm = a.norm group by a.scope, a.value),
rest as (select *, row_number() over (partition by scope, norm order by ord) as rn from a where not exists (select 1 from ex where ex.scope = a.scope and ex.value = a.value)),
mk as (select scope, value, norm, ord, brand_name, {s_sql('name')} as ff, {_strip_sql('name', 'brand_name')} as bf from rest where rn = 1),
kn as (select k.scope, k.entity_id, k.norm, {s_sql('k.name')} as ff, {_strip_sql('k.name', 'b.brand_name')} as bf from known k join (select distinct scope, brand_name from mk) b on b.scope = k.scope),
vm as (select m.scope, m.norm, arg_min(c.norm, c.norm) as target from mk m join mk c on c.scope = m.scope and c.ord < m.ord and ((m.ff <> '' and m.ff = c.ff) or (m.bf <> '' and m.bf = c.ff) or (m.ff <> '' and m.ff = c.bf)) group by m.scope, m.norm),
vk as (select m.scope, m.norm, min(c.entity_id) as target from mk m join kn c on c.scope = m.scope and ((m.ff <> '' and m.ff = c.ff) or (m.bf <> '' and m.bf = c.ff) or (m.ff <> '' and m.ff = c.bf)) group by m.scope, m.norm),
names as (select scope, norm from mk union select scope, norm from known),
co as (select m.scope, m.norm, min(n.norm) as target from mk m join names n on n.scope = m.scope and regexp_matches(m.norm, '^\\p{{Nd}}+$') and regexp_extract(n.norm, '^(\\p{{Nd}}+)\\p{{L}}{{1,3}}$', 1) = m.norm group by m.scope, m.norm having count(distinct n.norm) = 1)
select scope as brand_id, value, 'exists' as stage, target from ex
union all select scope, value, 'created_earlier', norm from rest where rn > 1
union all select m.scope, m.value, case when coalesce(vm.target, vk.target) is not null then 'prefix_variant' when co.target is not null then 'completion' else 'created' end, coalesce(vm.target, vk.target, co.target, m.norm)
from mk m left join vm on vm.scope = m.scope and vm.norm = m.norm left join vk on vk.scope = m.scope and vk.norm = m.norm left join co on co.scope = m.scope and co.norm = m.norm""")
def guarded_creation(spark: SparkSession, d: str) -> DataFrame:
    """Models asked for, held against those of the registry before any is created."""
    known = table(spark, d, "dim_model").where("source_system = 'registry_master'").select(F.col("brand_id").alias("scope"), F.col("model_id").alias("entity_id"), F.col("canonical_name").alias("name"))
    asked = _asked_models(spark, d).withColumn("name", F.col("value"))
    return provider.guarded_creation(asked, known).withColumnRenamed("scope", "brand_id")


# -- scalar functions


@query(f"select doc_id, {n_sql('text')} as normalized from documents")
def normalize_text_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


@query(f"select row_id, {s_sql('brand')} as b, {s_sql('model')} as m, {s_sql('governorate')} as g from report_rows")
def simple_normalize_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").select("row_id", *[simple_normalize(F.col(c)).alias(c[0]) for c in ("brand", "model", "governorate")])


@query(f"select row_id, {_strip_sql('model', 'brand')} as stripped from report_rows")
def strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").select("row_id", resolution.strip_prefix(F.col("model"), F.col("brand")).alias("stripped"))


@query(f"select row_id, coalesce({_WORDS.format(x='(' + _strip_sql('model', 'brand') + ')')}, model) as model, coalesce({_WORDS.format(x='(' + s_sql('''string_split(model, ' ')[-1]''') + ')')}, string_split(model, ' ')[-1]) as last_word from report_rows")
def number_word_to_digit(spark: SparkSession, d: str) -> DataFrame:
    last = F.element_at(F.split("model", " "), -1)
    rows = table(spark, d, "report_rows")
    return rows.select("row_id", resolution.number_word_to_digit(F.col("model"), F.col("brand")).alias("model"), resolution.number_word_to_digit(last, F.lit("")).alias("last_word"))


@query(f"select row_id, regexp_matches({n_sql('model')}, '^\\p{{Nd}}+$') as numeric_model, regexp_matches({n_sql('report_year')}, '^\\p{{Nd}}+$') as numeric_year from (select row_id, model, cast(report_year as varchar) as report_year from report_rows)")
def is_numeric_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").select("row_id", resolution.is_numeric(F.col("model")).alias("numeric_model"), resolution.is_numeric(F.col("report_year").cast("string")).alias("numeric_year"))


@query(f"""select a.model_id as id_1, b.model_id as id_2 from dim_model a join dim_model b on a.brand_id = b.brand_id and a.model_id < b.model_id join dim_brand d on d.brand_id = a.brand_id
where {s_sql('a.canonical_name')} = {s_sql('b.canonical_name')} or ({_strip_sql('a.canonical_name', 'd.canonical_name')}) = {s_sql('b.canonical_name')} or {s_sql('a.canonical_name')} = ({_strip_sql('b.canonical_name', 'd.canonical_name')})""")
def same_model_guard(spark: SparkSession, d: str) -> DataFrame:
    """Model records that are one by their name or their name without the brand's; an equality join on both forms, not a comparison of all pairs."""
    brands = table(spark, d, "dim_brand").select("brand_id", F.col("canonical_name").alias("brand_name"))
    named = table(spark, d, "dim_model").join(brands, "brand_id").select("brand_id", "model_id", simple_normalize(F.col("canonical_name")).alias("full"), resolution.strip_prefix(F.col("canonical_name"), F.col("brand_name")).alias("bare"))
    full = named.select("brand_id", F.col("model_id").alias("id_a"), F.col("full").alias("k"))
    either = named.select("brand_id", F.col("model_id").alias("id_b"), F.explode(F.array_distinct(F.array("full", "bare"))).alias("k"))
    met = full.join(either, ["brand_id", "k"]).where("id_a <> id_b")
    return met.select(F.least("id_a", "id_b").alias("id_1"), F.greatest("id_a", "id_b").alias("id_2")).distinct()


@query("select p_partkey, cast(case when levenshtein(p_name, lower(p_type)) <= 8 then levenshtein(p_name, lower(p_type)) else -1 end as int) as distance from part")
def levenshtein_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type"), 8).alias("distance"))


@query(f"select row_id, case when brand is null or model is null then null when length({n_sql('brand')}) = 0 and length({n_sql('model')}) = 0 then 100.0 when length({n_sql('brand')}) = 0 or length({n_sql('model')}) = 0 then 0.0 else {ratio_sql('b', 'm')} end as score from (select *, {n_sql('brand')} as b, {n_sql('model')} as m from report_rows)")
def fuzzy_ratio_scalar(spark: SparkSession, d: str) -> DataFrame:
    both = F.col("brand").isNotNull() & F.col("model").isNotNull()
    rows = table(spark, d, "report_rows").select("row_id", F.when(both, normalize_text(F.col("brand"))).alias("b"), F.when(both, normalize_text(F.col("model"))).alias("m"))
    return rows.select("row_id", ratio_udf("b", "m").alias("score"))


@query("select row_id, make_date(report_year, report_month, 1) as first_day from report_rows")
def first_of_month(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").select("row_id", F.make_date("report_year", "report_month", F.lit(1)).alias("first_day"))


@query("""select row_id, regexp_extract(file_name, '([^/]*?)(\\.[^./]*)?$', 1) || '-' || strftime(make_date(report_year, report_month, 1), '%Y-%m-%d') || regexp_extract(file_name, '([^/]*?)(\\.[^./]*)?$', 2) as dated from report_rows""")
def dated_filename(spark: SparkSession, d: str) -> DataFrame:
    day = F.make_date("report_year", "report_month", F.lit(1))
    return table(spark, d, "report_rows").select("row_id", workbook.dated_name(F.col("file_name"), day).alias("dated"))


@query(f"select row_id, {c_sql('brand')} as b, {c_sql('model')} as m from report_rows")
def clean_null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").select("row_id", clean_token(F.col("brand")).alias("b"), clean_token(F.col("model")).alias("m"))


@query("select brand_id, string_agg((n - 1) || ': ' || canonical_name, chr(10) order by n) as listing from (select brand_id, canonical_name, row_number() over (partition by brand_id order by model_id) as n from dim_model) group by brand_id")
def prompt_list_format(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lists of a brand's models; a brand's list is one request and so bounded by design."""
    listed = F.sort_array(F.collect_list(F.struct("model_id", "canonical_name")))
    lines = F.transform(listed, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x["canonical_name"]))
    return table(spark, d, "dim_model").groupBy("brand_id").agg(F.array_join(lines, "\n").alias("listing"))


@query("select distinct translate(model, '٠١٢٣٤٥٦٧٨٩', '0123456789') as model from report_rows where model is not null")
def arabic_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_rows").where("model is not null").select(F.translate("model", "٠١٢٣٤٥٦٧٨٩", "0123456789").alias("model")).distinct()


# -- naming rules given as tables


@query(f"""with q as (select distinct brand_id as scope, regexp_extract(canonical_name, '([0-9]+)$', 1) as value from dim_model where brand_id is not null and regexp_matches(canonical_name, '[0-9]$')),
a as (select distinct brand_id, regexp_extract(canonical_name, '([0-9]+)$', 1) as number from dim_model where source_system = 'registry_master' and regexp_matches(canonical_name, '[0-9]$'))
select scope as brand_id, value, a.number is not null as is_model from q left join a on a.brand_id = q.scope and a.number = q.value""")
def standalone_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Bare numbers asked for within a brand, held against a table of the numbers that are models there (here the registry's)."""
    numbered_models = table(spark, d, "dim_model").where(F.col("canonical_name").rlike("[0-9]$")).withColumn("number", F.regexp_extract("canonical_name", "([0-9]+)$", 1))
    asked = numbered_models.where("brand_id is not null").select(F.col("brand_id").alias("scope"), F.col("number").alias("value")).distinct()
    allowed = numbered_models.where("source_system = 'registry_master'").select(F.col("brand_id").alias("scope"), "number")
    return rules.standalone_numbers(asked, allowed).withColumnRenamed("scope", "brand_id")


@query(f"""with n as (select brand_id, model_id, {n_sql('canonical_name')} as k from dim_model where brand_id is not null)
select a.brand_id, a.model_id, arg_max(b.model_id, (length(b.k), -cast(substring(b.model_id, 3) as int))) as parent_id from n a join n b on a.brand_id = b.brand_id and b.k <> '' and starts_with(a.k, b.k || ' ') group by a.brand_id, a.model_id""")
def protected_submodels(spark: SparkSession, d: str) -> DataFrame:
    """Models whose name goes on from that of another model of the brand; they are never folded into it."""
    names = table(spark, d, "dim_model").select(F.col("brand_id").alias("scope"), F.col("model_id").alias("entity_id"), F.col("canonical_name").alias("name"))
    return rules.parents(names).select(F.col("scope").alias("brand_id"), F.col("entity_id").alias("model_id"), "parent_id")


_SUFFIX_WORDS = ("plus", "lite", "gt", "my19", "2022")


@query(f"""with n as (select row_id, {n_sql('model')} as k from report_rows), w as (select unnest([{', '.join(f"'{x}'" for x in _SUFFIX_WORDS)}]) as word)
select row_id, case when regexp_extract(k, '([^ ]+)$', 1) not in (select word from w) then k when contains(k, ' ') then regexp_extract(k, '^(.*) [^ ]+$', 1) end as bare from n""")
def drop_listed_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Model names without a trim or generation at their end; a trim alone is no model."""
    listed = spark.createDataFrame([(w,) for w in _SUFFIX_WORDS], "word string")
    return rules.without_suffixes(table(spark, d, "report_rows").select("row_id", "model"), "model", listed, "bare").select("row_id", "bare")


@query(f"""with o as (select {n_sql('canonical_name')} as k, min(country) as origin from dim_brand where country is not null group by 1)
select brand_id, case when country is null or trim(country, ' ') = '' then coalesce(o.origin, country) else country end as country from dim_brand b left join o on o.k <> '' and o.k = {n_sql('b.canonical_name')}""")
def country_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """Missing countries from a table of the brands' origins (here other records of the same name)."""
    brands = table(spark, d, "dim_brand")
    return rules.countries(brands, brands.select(F.col("canonical_name").alias("brand"), "country")).select("brand_id", "country")


# -- integrity of the loaded star schema


@query("select 'brand_id' as key_name, brand_id as key_value from (select distinct brand_id from fact_vehicles where brand_id is not null) where brand_id not in (select brand_id from dim_brand where brand_id is not null) union all select 'model_id', model_id from (select distinct model_id from fact_vehicles where model_id is not null) where model_id not in (select model_id from dim_model where model_id is not null)")
def integrity_orphans(spark: SparkSession, d: str) -> DataFrame:
    fact = table(spark, d, "fact_vehicles")
    b = dimensions.orphans(fact, table(spark, d, "dim_brand"), "brand_id").select(F.lit("brand_id").alias("key_name"), F.col("brand_id").alias("key_value"))
    m = dimensions.orphans(fact, table(spark, d, "dim_model"), "model_id").select(F.lit("model_id").alias("key_name"), F.col("model_id").alias("key_value"))
    return b.unionByName(m)


@query("select brand_id, alias, count(*) as n from dim_brand_alias group by 1, 2 having count(*) > 1 union all select normalized_name, canonical_name, count(*) from dim_brand group by 1, 2 having count(*) > 1")
def integrity_unique(spark: SparkSession, d: str) -> DataFrame:
    a = dimensions.duplicate_keys(table(spark, d, "dim_brand_alias"), ["brand_id", "alias"])
    b = dimensions.duplicate_keys(table(spark, d, "dim_brand"), ["normalized_name", "canonical_name"])
    return a.union(b.select("normalized_name", "canonical_name", "n"))


for _name in ("normalize_text", "simple_normalize"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
    SQL[_name] = SQL.pop(f"{_name}_query")
