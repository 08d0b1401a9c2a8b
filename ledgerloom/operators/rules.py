"""Naming rules that are given as tables. Each is an equality join or an expression over a table the caller brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_text
from ledgerloom.operators.resolution import is_numeric


def standalone_numbers(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests ``scope, value`` that are bare numbers, with ``is_model``: whether ``allowed(scope, number)`` lists the number for the scope.

    Numbers are compared by their normalized text. Other requests are left out; repeated ones give a row each.
    """
    listed = allowed.select("scope", normalize_text(F.col("number")).alias("_n")).where("_n <> ''").distinct().withColumn("_listed", F.lit(True))
    asked = requests.where(is_numeric(F.col("value"))).withColumn("_n", normalize_text(F.col("value")))
    return asked.join(listed, ["scope", "_n"], "left").select(*requests.columns, F.col("_listed").isNotNull().alias("is_model"))


def parents(names: DataFrame) -> DataFrame:
    """``scope, entity_id, parent_id``: names that begin with all words of another name of their scope, with the longest such name.

    These are models of their own and must not be folded into the shorter one. Every name meets only the names that are one
    of its own beginnings, by an equality join. Of entities with one name the first id stands.
    """
    words = F.filter(F.split(normalize_text(F.col("name")), " "), lambda w: w != "")
    split = names.where("scope is not null and entity_id is not null").select("scope", "entity_id", words.alias("w"))
    known = split.where(F.size("w") > 0).groupBy("scope", F.array_join("w", " ").alias("start")).agg(F.min("entity_id").alias("parent_id"))
    starts = split.where(F.size("w") > 1).select("scope", "entity_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", 1, n), " ").alias("start")))).alias("s"))
    met = starts.select("scope", "entity_id", "s.*").join(known, ["scope", "start"])
    return met.groupBy("scope", "entity_id").agg(F.max(F.struct("n", "parent_id"))["parent_id"].alias("parent_id"))


def without_suffixes(df: DataFrame, name: str, suffixes: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the normalized name without one listed last word (``suffixes(word)``: trims, engine codes, generations).

    A name that is nothing but a listed word stands for no model: null. Each row asks for its last word only.
    """
    listed = suffixes.select(normalize_text(F.col("word")).alias("_last")).where("_last <> ''").distinct().withColumn("_listed", F.lit(True))
    keyed = df.withColumn("_all", normalize_text(F.col(name))).withColumn("_last", F.regexp_extract("_all", r"([^ ]+)$", 1))
    bare = F.regexp_extract("_all", r"^(.*) [^ ]+$", 1)
    joined = keyed.join(listed, "_last", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_listed").isNull(), F.col("_all")).when(bare != "", bare).alias(out))


def countries(brands: DataFrame, origins: DataFrame) -> DataFrame:
    """Brands with a missing (null or blank) ``country`` filled from ``origins(brand, country)`` by normalized name; of several origins the first counts."""
    known = origins.select(normalize_text(F.col("brand")).alias("_k"), "country").where("_k <> '' and country is not null").groupBy("_k").agg(F.min("country").alias("_origin"))
    joined = brands.withColumn("_k", normalize_text(F.col("canonical_name"))).join(known, "_k", "left")
    missing = F.col("country").isNull() | (F.trim("country") == "")
    return joined.select(*[F.when(missing, F.coalesce("_origin", "country")).otherwise(F.col("country")).alias(c) if c == "country" else F.col(c) for c in brands.columns])
