"""Per-key results when a handful of keys hold most rows.

Rows are first compressed to one row per (key, value) with a frequency. That step combines on the map
side and hashes on key *and* value, so no key, however hot, lands in one task. Counts, sums, distinct
counts, modes and percentiles then follow exactly from the weighted values. Percentiles need an order
within a key; the values of a key are cut into order-preserving magnitude blocks, blocks are
accumulated (a few hundred rows a key), and only the one or two blocks that hold the wanted ranks are
sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut

BLOCKS_PER_OCTAVE = 32


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct (keys, value): ``keys..., _value double, _n bigint``.

    Null keys are a key of their own and a null value is kept with its frequency; NaN equals NaN; -0.0
    equals 0.0. An empty table gives no rows. Further columns of ``df`` are not read.
    """
    picked = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_value"))
    return picked.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))


def _block(value: Column, blocks_per_octave: int) -> Column:
    """An integer that never falls as the value grows; equal values share it. NaN comes after infinity."""
    size = F.floor(F.log2(F.abs(value)) * F.lit(blocks_per_octave)) + F.lit(1100 * blocks_per_octave)
    top = F.lit(2200 * blocks_per_octave)
    return (
        F.when(F.isnan(value), top + F.lit(1))
        .when(value == F.lit(float("inf")), top)
        .when(value == F.lit(float("-inf")), -top)
        .when(value == F.lit(0.0), F.lit(0))
        .when(value < 0, -size)
        .otherwise(size)
        .cast("bigint")
    )


def weighted_medians(weighted: DataFrame, keys: list[str], blocks_per_octave: int = BLOCKS_PER_OCTAVE) -> DataFrame:
    """Exact medians (mean of the two middle values) of ``_value`` weighted by ``_n``: ``keys..., median``.

    Null values do not count; NaN counts as the largest value; a key without values gives no row.
    """
    values = weighted.where(F.col("_value").isNotNull()).withColumn("_block", _block(F.col("_value"), blocks_per_octave))
    blocks = values.groupBy(*keys, "_block").agg(F.sum("_n").alias("_bn"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.select(
        *keys,
        "_block",
        (F.sum("_bn").over(upto) - F.col("_bn")).alias("_before"),
        "_bn",
        F.sum("_bn").over(per_key).alias("_total"),
    )
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    wanted = placed.where(
        ((F.col("_before") < low) & (low <= F.col("_before") + F.col("_bn")))
        | ((F.col("_before") < high) & (high <= F.col("_before") + F.col("_bn")))
    ).select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], F.col("_block").alias("_wb"), "_before", "_total")
    same = [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_wb")]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    inner = values.join(wanted, on).drop("_wb", *[f"_w{i}" for i in range(len(keys))])
    within = Window.partitionBy(*keys, "_block").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inner.withColumn("_after", F.col("_before") + F.sum("_n").over(within)).withColumn("_start", F.col("_after") - F.col("_n"))
    picked = reached.where(
        ((F.col("_start") < low) & (low <= F.col("_after"))) | ((F.col("_start") < high) & (high <= F.col("_after")))
    )
    return picked.groupBy(*keys).agg(((F.min("_value") + F.max("_value")) / 2).alias("median"))


def key_summary(df: DataFrame, key: str, value: str, decimals: int = 4) -> DataFrame:
    """Rows, total, median, distinct values and mode per key, with no task per key.

    Columns: ``key, n_rows, n_values, n_distinct, total, median, mode_value, row_share``. The null key
    is reported as a key. Nulls count in ``n_rows`` only. ``total`` is a decimal with ``decimals`` places
    over the finite values (NaN and infinities are left out of it); the median and the distinct count
    are over all non-null values with NaN as the largest; ties for the mode go to the smallest value.
    """
    weighted = cut(compress(df, [key], value))
    finite = ~F.isnan("_value") & (F.abs(F.col("_value")) < F.lit(float("inf")))
    amount = F.when(finite, F.col("_value").cast(f"decimal(28,{decimals})") * F.col("_n").cast("decimal(10,0)"))
    ranked = F.when(F.col("_value").isNotNull(), F.struct(F.col("_n").alias("n"), (~F.isnan("_value")).cast("int").alias("o"), (-F.col("_value")).alias("v")))
    sums = weighted.groupBy(key).agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_value").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_values"),
        F.count("_value").alias("n_distinct"),
        F.sum(amount).cast(f"decimal(38,{decimals})").alias("total"),
        (-F.max(ranked)["v"]).alias("mode_value"),
    )
    all_rows = sums.agg(F.sum("n_rows").alias("_all"))
    medians = weighted_medians(weighted, [key]).withColumnRenamed(key, "_mk")
    return (
        sums.join(medians, F.col(key).eqNullSafe(F.col("_mk")), "left")
        .crossJoin(F.broadcast(all_rows))  # one row
        .select(key, "n_rows", "n_values", "n_distinct", "total", "median", "mode_value", (F.col("n_rows") / F.col("_all")).alias("row_share"))
    )


def heavy_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The non-null keys that hold more than ``share`` of all rows, from the compressed counts."""
    counts = cut(compress(df, [key], value).groupBy(key).agg(F.sum("_n").alias("_rows")))
    total = counts.agg(F.sum("_rows").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(key).isNotNull() & (F.col("_rows") > F.col("_all") * F.lit(share))).select(key)
