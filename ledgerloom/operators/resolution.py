"""The resolution cascade: exact, alias, short-typo and fuzzy matches of distinct values, and its guards.

``values(scope, value)`` are distinct requests; a scope is '' or, for models, the brand they are sought in.
``entities(scope, entity_id, name)`` and ``aliases(scope, entity_id, alias, ord)`` are the master data; ``ord`` gives the order in which the
aliases were known (a number or a struct). Every stage but likeness is an equality join on a derived key.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import nearest
from ledgerloom.functions.text import NUMBER_WORDS, normalize_text, number_word, simple_normalize
from ledgerloom.session import cut

SHORT = 6
FUZZY_THRESHOLD = 80
HIGH_CONFIDENCE = 95
#: Values and aliases of one scope that one call holds against each other.
VALUE_BLOCK = 8_000
ALIAS_BLOCK = 20_000


def is_numeric(x: Column) -> Column:
    return normalize_text(x).rlike(r"^\p{Nd}+$")


def strip_prefix(name: Column, brand: Column) -> Column:
    n, b = simple_normalize(name), simple_normalize(brand)
    return F.when((b != "") & n.startswith(b), F.trim(F.substring(n, F.length(b) + 1, F.length(n)))).otherwise(n)


def number_word_to_digit(raw: Column, brand: Column) -> Column:
    """A model that is, its brand aside, one spoken number becomes the digit; anything else stays as it is."""
    rest = strip_prefix(raw, brand)
    digit = number_word(rest)
    return F.when(digit != rest, digit).otherwise(raw)


def with_number_words(df: DataFrame, raw: str, folded_brand: str, name: str) -> DataFrame:
    """Adds ``number_word_to_digit`` of two columns, trimmed texts and folded brands; every step is a column, as one expression would fold and strip each text many times over.

    Only texts that end as a spoken number does are folded.
    """
    spoken_end = F.lower(F.right(F.col(raw), F.lit(3))).isin(*[w[-3:] for w in NUMBER_WORDS])
    folded = df.withColumn("_raw", F.when(spoken_end, simple_normalize(F.col(raw))).otherwise(F.lit("")))
    prefixed = (F.col(folded_brand) != "") & F.col("_raw").startswith(F.col(folded_brand))
    bare = folded.withColumn("_rest", F.when(prefixed, F.trim(F.substring("_raw", F.length(folded_brand) + 1, F.length("_raw")))).otherwise(F.col("_raw")))
    spoken = bare.withColumn("_digit", number_word(F.col("_rest")))
    return spoken.withColumn(name, F.when(F.col("_digit") != F.col("_rest"), F.col("_digit")).otherwise(F.col(raw))).drop("_raw", "_rest", "_digit")


def same_model(a: Column, b: Column, brand: Column) -> Column:
    """Equal names, or one equal to the other without the brand's name."""
    x, y = simple_normalize(a), simple_normalize(b)
    return (x == y) | (strip_prefix(a, brand) == y) | (x == strip_prefix(b, brand))


def text_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on texts: both are shuffled and sorted by one number, which is far cheaper, and the texts are compared where it is equal.

    The texts are compared from both sides, as an equality would be sorted by again.
    """
    right = right.withColumn("_number", F.xxhash64(*on)).withColumnsRenamed({c: f"_right_{c}" for c in ("_number", *on)})
    same = F.col("_number") == F.col("_right__number")
    for c in on:
        same = same & (F.col(c) <= F.col(f"_right_{c}")) & (F.col(c) >= F.col(f"_right_{c}"))
    return left.withColumn("_number", F.xxhash64(*on)).join(right, same, how).drop("_number", *[f"_right_{c}" for c in ("_number", *on)])


def exact_match(values: DataFrame, entities: DataFrame) -> DataFrame:
    """``scope, value, entity_id``: the first entity whose normalized name equals the normalized value."""
    v = values.withColumn("_n", normalize_text(F.col("value"))).where("_n <> ''")
    e = entities.select("scope", "entity_id", normalize_text(F.col("name")).alias("_n")).groupBy("scope", "_n").agg(F.min("entity_id").alias("entity_id"))
    return v.join(e, ["scope", "_n"]).select("scope", "value", "entity_id")


def alias_match(values: DataFrame, aliases: DataFrame) -> DataFrame:
    v = values.withColumn("_n", normalize_text(F.col("value"))).where("_n <> ''")
    a = aliases.select("scope", "entity_id", normalize_text(F.col("alias")).alias("_n")).groupBy("scope", "_n").agg(F.min("entity_id").alias("entity_id"))
    return v.join(a, ["scope", "_n"]).select("scope", "value", "entity_id")


def _deletions(x: Column) -> Column:
    """The string and the strings one character shorter: strings one edit apart share one."""
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.array_distinct(F.concat(F.array(x), shorter))


def typo_match(values: DataFrame, aliases: DataFrame, longest: int = SHORT) -> DataFrame:
    """``scope, value, entity_id, distance``: short values one edit from an alias, if one entity alone is nearest.

    Both sides hold at most ``longest`` characters, so each has at most seven deletion variants to join on.
    """
    v = values.withColumn("_v", normalize_text(F.col("value"))).where((F.length("_v") <= longest) & (F.col("_v") != ""))
    a = aliases.select("scope", "entity_id", normalize_text(F.col("alias")).alias("_a")).where((F.length("_a") <= longest) & (F.col("_a") != ""))
    return _typos(v, a.groupBy("scope", "_a").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high")))


def _typos(v: DataFrame, a: DataFrame) -> DataFrame:
    """``typo_match`` of short ``scope, value, _v`` and ``scope, _a, low, high``, each name once with the lowest and highest of its entities."""
    met = v.withColumn("_k", F.explode(_deletions(F.col("_v")))).join(a.withColumn("_k", F.explode(_deletions(F.col("_a")))), ["scope", "_k"])
    near = met.withColumn("distance", F.levenshtein("_v", "_a", 1)).where("distance between 0 and 1")
    at = near.groupBy("scope", "value", "distance").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = at.groupBy("scope", "value").agg(F.min(F.struct("distance", "low", "high")).alias("b"))
    return best.where("b.low = b.high").select("scope", "value", F.col("b.low").alias("entity_id"), F.col("b.distance").cast("int").alias("distance"))


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """``scope, <name>``: how many blocks of about ``size`` rows a scope is split into."""
    return df.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))


def dealt(values: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scope, _vb, _ab`` with ``v`` and with ``a``: distinct normalized values and aliases in their blocks, each once for every block of the other side.

    The partitions are not to be merged again, as the work is in the pairs and not in the bytes.
    """
    v = values.select("scope", normalize_text(F.col("value")).alias("v")).where("v <> ''").distinct()
    a = aliases.select("scope", normalize_text(F.col("alias")).alias("a")).where("a <> ''").distinct()
    return _dealt(v, a)


def _dealt(v: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``dealt`` of distinct normalized ``scope, v`` and ``scope, a``."""
    blocks = cut(_blocks(v, VALUE_BLOCK, "_vn").join(_blocks(a, ALIAS_BLOCK, "_an"), "scope"))
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda text, n: F.pmod(F.xxhash64(text), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = v.join(blocks, "scope").select("scope", own("v", "_vn").alias("_vb"), each("_an").alias("_ab"), "v")
    right = a.join(blocks, "scope").select("scope", each("_vn").alias("_vb"), own("a", "_an").alias("_ab"), "a")
    return tuple(df.repartition(parts, "scope", "_vb", "_ab") for df in (left, right))


def fuzzy_match(values: DataFrame, aliases: DataFrame, threshold: int = FUZZY_THRESHOLD, first_threshold: int = 90) -> DataFrame:
    """``scope, value, entity_id, score``: the alias with the highest ratio of at least ``threshold``; ties go to the alias known first.

    Values that are one when normalized are sought once. Within its scope every value meets all aliases whose length and letters can reach the
    threshold: at four fifths nearly every pair of one scope shares a piece to join on, so counting shared letters for blocks of values and
    aliases is far cheaper than joining. Blocks are bounded, so no task holds a whole scope.
    """
    values, aliases = cut(values.select("scope", "value").distinct()), cut(aliases.select("scope", "entity_id", "alias", "ord"))
    v = values.withColumn("v", normalize_text(F.col("value")))
    a = aliases.select("scope", "entity_id", normalize_text(F.col("alias")).alias("a"), "ord").groupBy("scope", "a").agg(F.min(F.struct("ord", "entity_id")).alias("f"))
    best = _likest(v.where("v <> ''").select("scope", "v").distinct(), a.where("a <> ''"), threshold, first_threshold)
    return v.join(best, ["scope", "v"]).select("scope", "value", "entity_id", "score")


def _likest(v: DataFrame, a: DataFrame, threshold: int, first_threshold: int = 90) -> DataFrame:
    """``scope, v, entity_id, score``: ``fuzzy_match`` of distinct normalized ``scope, v`` and ``scope, a, f``, where ``f`` is the first ``ord, entity_id`` of a name."""
    left, right = _dealt(v, a.select("scope", "a"))

    def likest(key: tuple, mine: pa.Table, known: pa.Table) -> pa.Table:
        texts, names = mine["v"].to_pylist(), known["a"].to_pylist()
        vi, ai, score = nearest(texts, names, threshold, first_threshold)
        columns = [[key[0].as_py()] * len(vi), [texts[i] for i in vi], [names[i] for i in ai], score]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["scope", "v", "a", "score"])

    keys = ("scope", "_vb", "_ab")
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(likest, "scope string, v string, a string, score double")
    best = scored.join(a.select("scope", "a", "f"), ["scope", "a"]).groupBy("scope", "v").agg(F.min(F.struct((-F.col("score")).alias("s"), "f")).alias("b"))
    return best.select("scope", "v", "b.f.entity_id", (-F.col("b.s")).alias("score"))


def scored_cascade(
    values: DataFrame, entities: DataFrame, aliases: DataFrame, models: bool = False, use_aliases: bool = True, threshold: int = FUZZY_THRESHOLD, normalized: bool = False
) -> DataFrame:
    """``scope, value, entity_id, stage, score`` for every value; stage ``unresolved`` where no stage found one.

    ``score`` is the edit distance of typo matches and the ratio of fuzzy ones, else null.
    Stages see the master data as it stood before the run, so their order over values does not matter.
    All-digit models are not matched by likeness; ``use_aliases=False`` leaves the exact alias stage out.
    Values that are ``normalized`` already are not written and joined again: only those that are found are given, once each.
    """
    asked = values if normalized else cut(values.select("scope", "value", normalize_text(F.col("value")).alias("_n")).distinct())
    # every stage sees normalized values alone, so those that are one when normalized go through it once
    key = F.col("value" if normalized else "_n")
    keys = asked.where(key != "").select("scope", key.alias("value")).distinct()
    # so do names: each normalized name of a scope once, with what every stage asks of it
    own = entities.select("scope", normalize_text(F.col("name")).alias("a"), F.col("entity_id").alias("_own"))
    more = aliases.select("scope", normalize_text(F.col("alias")).alias("a"), F.col("entity_id").alias("_known"), F.struct("ord", "entity_id").alias("f"))
    names = own.unionByName(more, allowMissingColumns=True).where("a <> ''").groupBy("scope", "a")
    names = cut(names.agg(F.min("_own").alias("exact"), F.min("_known").alias("low"), F.max("_known").alias("high"), F.min("f").alias("f")))
    alias = F.col("low") if use_aliases else F.lit(None).cast("string")
    met = text_join(keys, names.select("scope", F.col("a").alias("value"), F.col("exact").alias("_exact"), alias.alias("_alias")), ["scope", "value"], "left")
    stage = F.when(F.col("_exact").isNotNull(), F.lit("exact")).when(F.col("_alias").isNotNull(), F.lit("alias"))
    met = cut(met.select("scope", "value", F.coalesce("_exact", "_alias").alias("entity_id"), stage.alias("stage"), F.lit(None).cast("double").alias("score")))
    left = met.where("entity_id is null").select("scope", "value")
    if models:
        left = left.where(~is_numeric(F.col("value")))
    names = names.where("f is not null")
    short = lambda c: F.length(c) <= SHORT
    typos = cut(_typos(left.where(short("value")).withColumn("_v", F.col("value")), names.where(short("a")).select("scope", F.col("a").alias("_a"), "low", "high")))
    likely = _likest(cut(left.join(typos, ["scope", "value"], "left_anti").withColumnRenamed("value", "v")), names, threshold).withColumnRenamed("v", "value")
    found = met.where("entity_id is not null")
    for name, hits, score in (("typo", typos, "distance"), ("fuzzy", likely, "score")):
        found = found.unionByName(hits.select("scope", "value", "entity_id", F.lit(name).alias("stage"), F.col(score).cast("double").alias("score")))
    if normalized:
        return cut(found)
    named = asked.join(found.withColumnRenamed("value", "_n"), ["scope", "_n"], "left")
    return cut(named.select("scope", "value", "entity_id", F.coalesce("stage", F.lit("unresolved")).alias("stage"), "score"))


def cascade(values: DataFrame, entities: DataFrame, aliases: DataFrame, models: bool = False, use_aliases: bool = True) -> DataFrame:
    """``scored_cascade`` without the scores."""
    return scored_cascade(values, entities, aliases, models, use_aliases).drop("score")


def numeric_completion(requests: DataFrame, names: DataFrame) -> DataFrame:
    """``scope, value, completion``: an all-digit model completed by one to three letters, if the scope knows exactly one such name."""
    asked = requests.where(is_numeric(F.col("value"))).withColumn("_n", normalize_text(F.col("value")))
    known = names.withColumn("_m", normalize_text(F.col("name"))).withColumn("_n", F.regexp_extract("_m", r"^(\p{Nd}+)\p{L}{1,3}$", 1)).where("_n <> ''")
    met = asked.join(known, ["scope", "_n"])
    return met.groupBy("scope", "value").agg(F.min("name").alias("completion"), F.count_distinct("_m").alias("_c")).where("_c = 1").drop("_c")


def align_answers(requests: DataFrame, answers: DataFrame, index: str, order: str) -> DataFrame:
    """Requests with the answer of their index: missing answers are null, indexes out of range are dropped, of repeated ones the last counts."""
    names = [c for c in answers.columns if c not in (index, order)]
    last = answers.groupBy(index).agg(F.max_by(F.struct(*names), order).alias("_a"))
    return requests.join(last, index, "left").select(*requests.columns, *[F.col(f"_a.{c}").alias(c) for c in names])


def confident(flag: Column, confidence: Column, gate: float = 0.7) -> Column:
    return F.coalesce(flag, F.lit(False)) & (F.coalesce(confidence, F.lit(1.0)) >= gate)


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place they were first seen at."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))
