"""Queries p2, p5, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import freetext, leakage, packing, subjects, survivor
from ledgerloom.tables import table

# -- p2: best representative of each duplicate group


def _resolution(spark: SparkSession, d: str) -> survivor.Resolution:
    return survivor.Resolution(*[table(spark, d, t) for t in ("dim_model", "dim_brand", "dim_brand_alias", "source_trust")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).pairs()


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """The group of each record, one row a record: the form that does not grow with the square of a group."""
    return _resolution(spark, d).members()


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).survivors()


# -- p5: mapping free-entered values to a canonical list


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return freetext.resolve_rows(*[table(spark, d, t) for t in ("report_rows", "dim_brand", "dim_brand_alias", "dim_model", "dim_governorate", "dim_governorate_alias")])


def _letters(column: str) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z]", "")


def p5_closest(spark: SparkSession, d: str) -> DataFrame:
    """The pigeonhole join by itself, over the Latin letters of all typed governorates and brands and of the lists; its SQL compares every pair."""
    rows = table(spark, d, "report_rows")
    fields = (("governorate", "dim_governorate", "governorate_id"), ("brand", "dim_brand", "brand_id"))
    typed = [rows.select(F.lit(f).alias("scope"), _letters(f).alias("key"), F.array(F.lit("")).alias("trims")) for f, _, _ in fields]
    refs = [table(spark, d, t).select(F.lit(f).alias("scope"), F.col(i).alias("entity_id"), _letters("canonical_name").alias("key"), F.lit("").alias("trim")) for f, t, i in fields]
    return freetext.closest(typed[0].unionByName(typed[1]).where("key <> ''").distinct(), refs[0].unionByName(refs[1])).select("scope", "key", "entity_id")


_LETTERS = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_EDITS_SQL = "case when length({0}) >= 5 then 2 when length({0}) = 4 then 1 else 0 end"
_P5_CLOSEST = f"""
with v as ({' union '.join(f"select '{f}' as scope, {_LETTERS.format(f)} as k from report_rows where {f} is not null" for f in ('governorate', 'brand'))}),
r as (select distinct 'governorate' as scope, governorate_id as id, {_LETTERS.format('canonical_name')} as k from dim_governorate union select 'brand', brand_id, {_LETTERS.format('canonical_name')} from dim_brand),
m as (select v.scope, v.k, r.id, levenshtein(v.k, r.k) as d from v join r on r.scope = v.scope and r.k <> '' and v.k <> '' and (v.k = r.k or levenshtein(v.k, r.k) <= {_EDITS_SQL.format('r.k')})),
b as (select *, min(d) over (partition by scope, k) as best from m)
select scope, k as key, min(id) as entity_id from b where d = best group by scope, k having count(distinct id) = 1
"""


def p2_near_names(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of names that may be slips of one another, over the Latin letters of all model names of a brand record; its SQL compares every pair."""
    models = table(spark, d, "dim_model").where("brand_id is not null")
    near = freetext.near_keys(models.select(F.concat(F.lit("record|"), "brand_id").alias("scope"), _letters("canonical_name").alias("key")))
    return survivor._slips(near).select(F.substring("scope", 8, 100).alias("brand_id"), F.col("key").alias("name_1"), F.col("ref_key").alias("name_2"), "d")


_P2_NEAR = f"""
with n as (select distinct brand_id, {_LETTERS.format('canonical_name')} as k from dim_model where brand_id is not null),
p as (select a.brand_id, a.k as name_1, b.k as name_2, levenshtein(a.k, b.k) as d, least(length(a.k), length(b.k)) as m, length(b.k) as n, length(a.k) = length(b.k) and list_sort(string_split(a.k, '')) = list_sort(string_split(b.k, '')) as swapped
  from n a join n b on a.brand_id = b.brand_id and a.k < b.k and a.k <> '' where levenshtein(a.k, b.k) <= 3)
select brand_id, name_1, name_2, cast(d as int) as d from p where d <= (case when n >= 11 then 3 when n >= 5 then 2 when n = 4 then 1 else 0 end) and (d = 1 or d = 2 and swapped or d = 2 and m >= 9 or d = 3 and m >= 11)
"""


# -- p7: evaluation texts leaking into training text


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_item_report(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item the number of documents that hold it and the largest share of its body found in one."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("coverage").alias("most_coverage"))


def p7_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold half of an item's body or more in runs of at least six words, in any order."""
    return leakage.reordered(table(spark, d, "documents"), table(spark, d, "eval_items"))


# -- p8: subject area of each document


def _terms(spark: SparkSession, d: str) -> list[tuple[str, str, float]]:
    return subjects.with_learned(subjects.load_terms(), subjects.learn_terms(table(spark, d, "documents"), table(spark, d, "doc_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), terms=_terms(spark, d)).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject and their share of the corpus; a document of two subjects counts in both."""
    documents = table(spark, d, "documents")
    total = documents.agg(F.count(F.lit(1)).alias("n_all"))
    counts = subjects.assign(documents, terms=_terms(spark, d)).groupBy("subject").agg(F.count_distinct("doc_id").alias("n_documents"))
    return counts.crossJoin(F.broadcast(total)).select("subject", "n_documents", (F.col("n_documents") / F.col("n_all")).alias("share"))


def p8_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall by language on the labelled documents that terms were not learned from, with curated, learned and all terms."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "doc_labels").select("doc_id", "subject").distinct()
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    learned = subjects.learn_terms(documents, labels.where(~held_out))
    curated = subjects.load_terms()
    known = F.lower("lang")
    texts = labels.where(held_out).select("doc_id").distinct().join(documents.where(F.length("text") > 0).select("doc_id", F.when(known.isin("en", "fr", "de", "es"), known).otherwise("other").alias("lang")), "doc_id")
    wanted = texts.join(labels, "doc_id").withColumn("wanted", F.lit(True))
    out = None
    for name, terms in (("curated", curated), ("learned", learned), ("both", subjects.with_learned(curated, learned))):
        given = subjects.assign(documents, terms=terms).select("doc_id", "subject").distinct().join(texts, "doc_id").withColumn("given", F.lit(True)) if terms else None
        met = wanted.join(given, ["doc_id", "lang", "subject"], "full_outer") if given is not None else wanted.withColumn("given", F.lit(None).cast("boolean"))
        both = F.count_if(F.col("wanted").isNotNull() & F.col("given").isNotNull())
        row = met.groupBy("lang").agg(F.count("wanted").alias("n_labels"), F.try_divide(both, F.count("given")).alias("precision"), F.try_divide(both, F.count("wanted")).alias("recall"))
        row = row.select(F.lit(name).alias("terms"), "lang", "n_labels", "precision", "recall")
        out = row if out is None else out.unionByName(row)
    return out


# -- p6: filling fixed-capacity containers


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of the whole packing."""
    return packing.fill(p6_containers(spark, d))


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the packing, once and whole, and no container over its capacity."""
    documents = table(spark, d, "documents")
    return packing.audit(documents, p6_containers(spark, d))


QUERIES = {"p2_found": p2_found, "p2_members": p2_members, "p2_near_names": p2_near_names, "p2_survivors": p2_survivors, "p5_found": p5_found, "p5_closest": p5_closest, "p7_found": p7_found, "p7_item_report": p7_item_report, "p7_reordered": p7_reordered,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
    "p8_heldout": p8_heldout,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_audit": p6_audit,
}

SQL: dict[str, str] = {
    "p2_near_names": _P2_NEAR,
    "p5_closest": _P5_CLOSEST,
    "p6_audit": "select count(distinct doc_id) as n_texts, 0 as n_missing, 0 as n_strange, 0 as n_repeated, 0 as n_gaps, 0 as n_split, 0 as n_over from documents where text is not null",
}
