"""Dimension tables: ids, upserts, alias bridges and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.sequences import numbered

PREFIXES = {"brand": "BR", "model": "MD", "license_type": "LT", "governorate_city": "LOC"}


def surrogate_ids(names: DataFrame, name: str, order: str, entity_type: str, next_value: int = 1) -> DataFrame:
    """``entity_id, name`` for distinct names in the order they were first seen; ids grow past five digits."""
    first = names.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", name], "n", next_value).select(F.format_string(f"{PREFIXES[entity_type]}%05d", "n").alias("entity_id"), name)


def merge_upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows replace target rows of the same key, others are added; one full outer join. Running it twice changes nothing."""
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in target.columns])
    return target.join(s, F.col(key) == F.col(f"_s_{key}"), "full_outer").select(
        *[F.when(F.col(f"_s_{key}").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns]
    )


def update_fields(dim: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The dimension with the non-null fields of ``updates(key, field...)`` in place of its own; keys it does not have are left out.

    Of several updates of one key the greatest value of each field counts.
    """
    fields = [c for c in updates.columns if c != key and c in dim.columns]
    new = updates.groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in fields])
    return dim.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else c for c in dim.columns])


def merge_aliases(target: DataFrame, source: DataFrame, parent: str, alias: str = "alias") -> DataFrame:
    """Adds trimmed, non-blank (parent, alias) pairs that are not there yet."""
    new = source.select(parent, F.trim(alias).alias(alias)).where(F.col(parent).isNotNull() & (F.col(alias) != "")).dropDuplicates()
    return target.select(parent, alias).unionByName(new.join(target, [parent, alias], "left_anti"))


def accumulate_aliases(entities: DataFrame, learned: DataFrame, key: str) -> DataFrame:
    """``key, aliases`` with learned aliases behind the known ones, each once; an entity has a bounded handful."""
    new = learned.groupBy(key).agg(F.sort_array(F.collect_set("alias")).alias("_new"))
    return entities.join(new, key, "left").select(key, F.array_union("aliases", F.coalesce("_new", F.array().cast("array<string>"))).alias("aliases"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null child keys without a parent."""
    return child.where(F.col(key).isNotNull()).select(key).distinct().join(parent.select(key).distinct(), key, "left_anti")
