"""Queries p1, p3 and p4 and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import drift, profile, skew
from ledgerloom.session import cut
from ledgerloom.tables import table

MOTOR_TYPES = ("Petrol", "Diesel", "Electric", "Hybrid", "CNG", "REEV")

FACT_CHECKS = (
    profile.Check("vehicle_count", "not isnan(vehicle_count) and vehicle_count between 1 and 20000 and vehicle_count = floor(vehicle_count)"),
    profile.Check(
        "reporting_date",
        "reporting_date = date_trunc('MONTH', reporting_date) and reporting_date >= timestamp_ntz'2019-01-01' and (loaded_at is null or reporting_date <= loaded_at)",
    ),
)
MODEL_CHECKS = (profile.Check("motor_type", "motor_type in (" + ", ".join(f"'{m}'" for m in MOTOR_TYPES) + ")"),)
HEAVY_SHARE = 0.04


# -- p1: schemas that drift between files


def _codes(spark: SparkSession, d: str) -> dict[int, str]:
    """The numbers that stand for licence types; dim_licensetype has six rows at every scale."""
    rows = table(spark, d, "dim_licensetype").select(F.regexp_extract("licensetype_id", r"(\d+)$", 1).cast("int").alias("n"), "canonical_name").collect()
    return {r.n: r.canonical_name for r in rows if r.n is not None}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.footers(table(spark, d, "raw_report_lines")))


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.lifespans(drift.footers(table(spark, d, "raw_report_lines"))).drop("island")


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "raw_report_lines"), codes=_codes(spark, d)).drop("others", "extras")


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table with every field of the files; those outside the alias table are in ``others``, as JSON in the order of their names."""
    whole = drift.consistent_table(table(spark, d, "raw_report_lines"), codes=_codes(spark, d)).drop("extras")
    given = F.array_sort(F.map_entries(F.map_filter("others", lambda _, x: x.isNotNull())))
    return whole.withColumn("others", F.to_json(F.map_from_entries(given)))


_FIELD_CASE = "case " + " ".join("when plain in (" + ", ".join(f"'{s}'" for s in sorted({drift._spelling(h) for h in f.headers})) + f") then '{f.name}'" for f in drift.REPORT_FIELDS) + " when plain = '' then 'other:' || header else 'other:' || plain end"

_P1_FOOTERS = f"""
with lines as (
  select file_id, feed_name, file_month, cast(record_text as json) as j
  from raw_report_lines where json_valid(record_text) and json_type(record_text) = 'OBJECT'),
entries as (
  select file_id, feed_name, file_month, k.key as header,
    case k.type when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'HUGEINT' then 'integer'
      when 'DOUBLE' then 'decimal' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' end as kind
  from lines, json_each(j) k),
counted as (select file_id, feed_name, file_month, header, kind, count(*) as n from entries group by all),
named as (
  select file_id, feed_name, file_month, header, regexp_replace(lower(header), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as plain,
    (list(kind order by n desc, kind) filter (kind is not null))[1] as kind
  from counted group by file_id, feed_name, file_month, header),
files as (
  select feed_name, file_id, file_month, row_number() over (partition by feed_name order by file_month, file_id) as ord
  from (select distinct feed_name, file_id, file_month from raw_report_lines)),
foot as (select f.feed_name, f.ord, f.file_id, n.header, n.kind, {_FIELD_CASE} as field from named n join files f using (file_id))
"""

_P1_FOUND = (
    _P1_FOOTERS
    + """,
gained as (
  select c.feed_name, c.ord, c.file_id, c.field, c.header, c.kind, row_number() over (partition by c.file_id, c.field order by c.header) as rn
  from foot c where c.ord > 1 and not exists (select 1 from foot p where p.feed_name = c.feed_name and p.ord = c.ord - 1 and p.header = c.header)),
lost as (
  select f.file_id, p.field, p.header, p.kind, row_number() over (partition by f.file_id, p.field order by p.header) as rn
  from foot p join files f on f.feed_name = p.feed_name and f.ord = p.ord + 1
  where not exists (select 1 from foot c where c.feed_name = p.feed_name and c.ord = p.ord + 1 and c.header = p.header)),
both_sides as (
  select coalesce(g.file_id, l.file_id) as file_id, g.header as new_header, g.kind as new_kind, l.header as old_header, l.kind as old_kind
  from gained g full outer join lost l on g.file_id = l.file_id and g.field = l.field and g.rn = l.rn)
select file_id, 'renamed' as change_kind, new_header as header from both_sides where new_header is not null and old_header is not null
union all select file_id, 'type_changed', new_header from both_sides where new_header is not null and old_header is not null and new_kind <> old_kind
union all select file_id, 'added', new_header from both_sides where old_header is null
union all select file_id, 'removed', old_header from both_sides where new_header is null
union all select c.file_id, 'type_changed', c.header from foot c join foot p on p.feed_name = c.feed_name and p.ord = c.ord - 1 and p.header = c.header where p.kind <> c.kind
"""
)

_P1_LIFESPANS = (
    _P1_FOOTERS
    + """,
marked as (
  select *, row_number() over (partition by feed_name, field, header, kind order by ord) as k from foot)
select feed_name, field, header, kind, cast(min(ord) as int) as first_ord, cast(max(ord) as int) as last_ord, arg_min(file_id, ord) as first_file, arg_max(file_id, ord) as last_file
from marked group by feed_name, field, header, kind, ord - k
"""
)


def _sql_text(header: str) -> str:
    return f"""json_extract_string(j, '$."{header}"')"""


def _sql_clean(x: str) -> str:
    words = ", ".join(f"'{p}'" for p in drift.PLACEHOLDERS)
    trimmed = f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    return f"case when lower({trimmed}) not in ({words}) then {trimmed} end"


def _p1_unified_sql(others: bool = False) -> str:
    columns = []
    for f in drift.REPORT_FIELDS:
        options = []
        for h in f.headers:
            if f.kind == "coded":
                name = f"""json_extract_string(j, '$."{h}".name')"""
                options.append(_sql_clean(name))
                plain = f"case when not starts_with({_sql_text(h)}, '{{') then {_sql_clean(_sql_text(h))} end"
                options.append(f"coalesce((select canonical_name from dim_licensetype where cast(cast(regexp_extract(licensetype_id, '(\\d+)$', 1) as int) as varchar) = regexp_replace({plain}, '\\.0+$', '')), {plain})")
            else:
                options.append(_sql_clean(_sql_text(h)))
        value = f"coalesce({', '.join(options)})"
        columns.append(f"try_cast({value} as double) as {f.name}" if f.kind == "number" else f"{value} as {f.name}")
    if others:
        columns.append("coalesce(o.others, '{}') as others")
    rest = f"""left join (
  select file_id, line_no, record_text, '{{' || string_agg(to_json(plain) || ':' || to_json(x), ',' order by plain) || '}}' as others from (
    select file_id, line_no, record_text, plain, first(x order by header) as x from (
      select file_id, line_no, record_text, k.key as header, regexp_replace(lower(k.key), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as plain, {_sql_clean("json_extract_string(k.value, '$')")} as x
      from parsed, json_each(j) k) where x is not null and plain not in ({', '.join(f"'{s}'" for f in drift.REPORT_FIELDS for s in sorted({drift._spelling(h) for h in f.headers}))}) group by all)
  group by all) o on o.file_id = p.file_id and o.line_no = p.line_no and o.record_text = p.record_text""" if others else ""
    return f"""
with lines as (
  select distinct file_id, feed_name, file_month, line_no, record_text from raw_report_lines
  where json_valid(record_text) and json_type(record_text) = 'OBJECT'),
parsed as (select *, cast(record_text as json) as j from lines)
select p.file_id, feed_name, file_month, p.line_no, {', '.join(columns)} from parsed p {rest}
"""


# -- p3: column-level data quality profile


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken values and shifted loads, both from the states of one scan of each table."""
    lag = F.timestamp_diff("SECOND", F.col("reporting_date"), F.col("loaded_at"))
    facts = cut(profile.audit_states(table(spark, d, "fact_vehicles"), "load_id", "fact_id", FACT_CHECKS, {"vehicle_count": F.col("vehicle_count"), "reporting_date": lag}))
    models = profile.audit_states(table(spark, d, "dim_model"), None, "model_id", MODEL_CHECKS)
    return profile.broken_rows(facts, "fact_vehicles").unionByName(profile.broken_rows(models, "dim_model")).unionByName(profile.shifts(facts, "fact_vehicles"))


_NUMERIC = {"fact_vehicles": ("fact_id", "vehicle_count", "load_id"), "dim_model": (), "report_rows": ("row_id", "count_value", "report_year", "report_month"), "raw_report_lines": ("file_id", "line_no"), "documents": ("doc_id", "n_chars", "page_id", "revision_id", "parent_revision_id")}
_PARTITION = {"fact_vehicles": "load_id", "dim_model": "source_system", "report_rows": "file_name", "raw_report_lines": "feed_name", "documents": "source"}
#: What a load is in each table: a load, a month's file, or the month in which rows came in.
_LOADS = {"fact_vehicles": "load_id", "dim_model": "date_format(updated_at, 'yyyy-MM')", "report_rows": "file_name", "raw_report_lines": "date_format(received_at, 'yyyy-MM')", "documents": "date_format(revised_at, 'yyyy-MM')"}
_CHECKS = {
    "fact_vehicles": FACT_CHECKS,
    "dim_model": MODEL_CHECKS,
    "report_rows": (profile.Check("count_value", "not isnan(count_value) and count_value between 1 and 20000 and count_value = floor(count_value)"),),
    "raw_report_lines": (profile.Check("record_text", "try_parse_json(record_text) is not null"),),
    "documents": (profile.Check("n_chars", "n_chars = char_length(text)"), profile.Check("lang", "lang in ('en', 'fr', 'de', 'es')")),
}


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the large tables: null rate, broken values, range and exact distinct count; counts and ranges are merged from per-load states."""
    parts = []
    for name, partition in _PARTITION.items():
        df = table(spark, d, name)
        merged = profile.merge_states(profile.partition_states(df, partition, checks=_CHECKS[name]), _NUMERIC[name])
        number = F.col("column_name").isin(*_NUMERIC[name])
        ends = [F.when(number, F.col(e).cast("double")).alias(f"{e}_number") for e in ("low", "high")] + [F.when(~number, F.col(e)).alias(f"{e}_text") for e in ("low", "high")]
        parts.append(
            merged.join(profile.distinct_counts(df), "column_name").select(
                F.lit(name).alias("table_name"), "column_name", "n_rows", "n_null", "n_nan", "n_broken", (F.col("n_null") / F.col("n_rows")).alias("null_rate"), "n_distinct", *ends
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p3_load_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Null and violation counts of every fact column in every load."""
    states = profile.partition_states(table(spark, d, "fact_vehicles"), "load_id", checks=FACT_CHECKS)
    return states.select("partition_key", "column_name", "n_rows", "n_null", "n_nan", "n_broken")


def p3_control_limits(spark: SparkSession, d: str) -> DataFrame:
    """Loads whose null or violation share leaves three deviations of the twelve loads before."""
    states = profile.partition_states(table(spark, d, "fact_vehicles"), "load_id", ["vehicle_count", "reporting_date"], FACT_CHECKS)
    metrics = states.select(F.col("partition_key").cast("bigint").alias("load_id"), "column_name", F.round((F.col("n_null") + F.col("n_broken")) / F.col("n_rows"), 6).alias("bad_share"))
    judged = profile.control_limits(metrics, ["column_name"], "load_id", "bad_share")
    return judged.where("is_anomaly").select("load_id", "column_name", "bad_share")


def p3_table_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of every column of every large table in every load."""
    parts = []
    for name, load in _LOADS.items():
        df = table(spark, d, name)
        states = profile.partition_states(df.withColumn("_load", F.expr(load)), "_load", df.columns, _CHECKS[name])
        parts.append(profile.load_metrics(states, [c for c, t in df.dtypes if t != "string"]).withColumn("table_name", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("table_name", "partition_key", "column_name", "metric", "value")


def p3_table_limits(spark: SparkSession, d: str) -> DataFrame:
    """Loads in which a metric of a column leaves three deviations of the twelve loads before; ``p3_control_limits`` and its SQL test the bad share of two columns."""
    return profile.load_changes(p3_table_metrics(spark, d), ["table_name", "column_name", "metric"])


_COUNT_OK = "not isnan(vehicle_count) and vehicle_count between 1 and 20000 and vehicle_count = floor(vehicle_count)"
_DATE_OK = "reporting_date = date_trunc('month', reporting_date) and reporting_date >= timestamp '2019-01-01' and (loaded_at is null or reporting_date <= loaded_at)"
_MOTOR_OK = MODEL_CHECKS[0].valid
_FACT_COLUMNS = ("fact_id", "brand_id", "model_id", "licensetype_id", "governorate_id", "vehicle_count", "reporting_date", "load_id", "loaded_at")


def _broken_sql(column: str) -> str:
    return {"vehicle_count": f"count_if(vehicle_count is not null and not ({_COUNT_OK}))", "reporting_date": f"count_if(reporting_date is not null and not ({_DATE_OK}))"}.get(column, "0")


#: Columns of each table; those of numbers are in ``_NUMERIC``.
_COLUMNS = {
    "fact_vehicles": _FACT_COLUMNS,
    "dim_model": ("model_id", "brand_id", "canonical_name", "normalized_name", "motor_type", "source_system", "updated_at"),
    "report_rows": ("row_id", "file_name", "governorate", "license_type", "brand", "model", "count_value", "reporting_date", "report_year", "report_month"),
    "raw_report_lines": ("file_id", "feed_name", "file_month", "file_name", "received_at", "line_no", "record_text"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars", "page_id", "title", "revision_id", "parent_revision_id", "revised_at", "editor_name", "edit_comment"),
}
_CHECKS_SQL = {
    ("fact_vehicles", "vehicle_count"): _COUNT_OK, ("fact_vehicles", "reporting_date"): _DATE_OK, ("dim_model", "motor_type"): _MOTOR_OK,
    ("report_rows", "count_value"): _COUNT_OK.replace("vehicle_count", "count_value"), ("raw_report_lines", "record_text"): "json_valid(record_text)",
    ("documents", "n_chars"): "n_chars = length(text)", ("documents", "lang"): "lang in ('en', 'fr', 'de', 'es')",
}


def _profile_sql(t: str, c: str) -> str:
    number, double = c in _NUMERIC[t], c in ("vehicle_count", "count_value")
    ok = _CHECKS_SQL.get((t, c))
    kept = f"case when not isnan({c}) then {c} end" if double else c
    ends = ", ".join(f"{f}(cast({kept} as double)) as {n}_number" if number else f"cast(null as double) as {n}_number" for f, n in (("min", "low"), ("max", "high")))
    texts = ", ".join(f"cast(null as varchar) as {n}_text" if number else f"{f}(cast({c} as varchar)) as {n}_text" for f, n in (("min", "low"), ("max", "high")))
    return (
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, count_if({c} is null) as n_null, {f'count_if(isnan({c}))' if double else '0'} as n_nan, "
        f"{f'count_if({c} is not null and not coalesce({ok}, false))' if ok else '0'} as n_broken, count_if({c} is null) / count(*) as null_rate, count(distinct {c}) as n_distinct, {ends}, {texts} from {t}"
    )


_P3_PROFILE = " union all ".join(_profile_sql(t, c) for t, columns in _COLUMNS.items() for c in columns)

_P3_LOAD_METRICS = " union all ".join(
    f"select cast(load_id as varchar) as partition_key, '{c}' as column_name, count(*) as n_rows, count_if({c} is null) as n_null, {'count_if(isnan(vehicle_count))' if c == 'vehicle_count' else '0'} as n_nan, {_broken_sql(c)} as n_broken from fact_vehicles group by load_id"
    for c in _FACT_COLUMNS
)

_P3_CONTROL = f"""
with m as ({' union all '.join(f"select load_id, '{c}' as column_name, round((count_if({c} is null) + {_broken_sql(c)}) / count(*), 6) as bad_share from fact_vehicles group by load_id" for c in ('vehicle_count', 'reporting_date'))}),
j as (select *, avg(bad_share) over w as mu, stddev_pop(bad_share) over w as sd, count(bad_share) over w as seen from m
  window w as (partition by column_name order by load_id rows between 12 preceding and 1 preceding))
select load_id, column_name, bad_share from j where seen >= 6 and (bad_share < mu - 3 * sd or bad_share > mu + 3 * sd)
"""

_P3_FOUND = f"""
with m as (
  select load_id, avg(case when vehicle_count is null then 1.0 else 0 end) as cn, avg(case when reporting_date is null then 1.0 else 0 end) as dn,
    median(vehicle_count) as cm, median(date_diff('second', reporting_date, loaded_at)) as dm
  from fact_vehicles group by load_id),
a as (
  select avg(case when vehicle_count is null then 1.0 else 0 end) as cn, avg(case when reporting_date is null then 1.0 else 0 end) as dn,
    median(vehicle_count) as cm, median(date_diff('second', reporting_date, loaded_at)) as dm
  from fact_vehicles)
select 'value' as case_kind, 'fact_vehicles' as table_name, 'vehicle_count' as column_name, cast(fact_id as varchar) as row_key from fact_vehicles where vehicle_count is not null and not ({_COUNT_OK})
union all select 'value', 'fact_vehicles', 'reporting_date', cast(fact_id as varchar) from fact_vehicles where reporting_date is not null and not ({_DATE_OK})
union all select 'value', 'dim_model', 'motor_type', model_id from dim_model where motor_type is not null and not ({_MOTOR_OK})
union all select 'shift', 'fact_vehicles', 'vehicle_count', cast(m.load_id as varchar) from m, a
  where m.load_id is not null and (abs(m.cn - a.cn) > 0.15 or coalesce(m.cm > 2 * a.cm or m.cm < a.cm / 2, false))
union all select 'shift', 'fact_vehicles', 'reporting_date', cast(m.load_id as varchar) from m, a
  where m.load_id is not null and (abs(m.dn - a.dn) > 0.15 or coalesce(m.dm > 2 * a.dm or m.dm < a.dm / 2, false))
"""


# -- p4: a few keys holding most records


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "fact_vehicles"), "brand_id", "vehicle_count", HEAVY_SHARE)


def p4_brand_summary(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_summary(table(spark, d, "fact_vehicles"), "brand_id", "vehicle_count").withColumn("total", F.col("total").cast("double"))


_P4_SUMMARY = """
with w as (select brand_id, vehicle_count as v, count(*) as n from fact_vehicles group by all)
select f.brand_id, count(*) as n_rows, count(vehicle_count) as n_values, count(distinct vehicle_count) as n_distinct,
  cast(sum(case when not isnan(vehicle_count) and not isinf(vehicle_count) then cast(vehicle_count as decimal(28, 4)) end) as double) as total,
  median(vehicle_count) as median,
  (select v from w where w.brand_id is not distinct from f.brand_id and v is not null order by n desc, v limit 1) as mode_value,
  count(*) / (select count(*) from fact_vehicles) as row_share
from fact_vehicles f group by f.brand_id
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_lifespans": p1_lifespans,
    "p1_unified": p1_unified,
    "p1_table": p1_table,
    "p3_found": p3_found,
    "p3_profile": p3_profile,
    "p3_load_metrics": p3_load_metrics,
    "p3_control_limits": p3_control_limits,
    "p3_table_metrics": p3_table_metrics,
    "p3_table_limits": p3_table_limits,
    "p4_found": p4_found,
    "p4_brand_summary": p4_brand_summary,
}

SQL = {
    "p1_found": _P1_FOUND,
    "p1_lifespans": _P1_LIFESPANS,
    "p1_unified": _p1_unified_sql(),
    "p1_table": _p1_unified_sql(others=True),
    "p3_found": _P3_FOUND,
    "p3_profile": _P3_PROFILE,
    "p3_load_metrics": _P3_LOAD_METRICS,
    "p3_control_limits": _P3_CONTROL,
    "p4_found": "select brand_id from fact_vehicles where brand_id is not null group by brand_id having count(*) > 0.04 * (select count(*) from fact_vehicles)",
    "p4_brand_summary": _P4_SUMMARY,
}
