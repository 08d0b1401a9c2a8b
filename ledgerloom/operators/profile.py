"""Column-level quality profiles from declared checks.

Checks are data: a name, a column and a boolean expression that says when a non-null value is of the
right form. All checks and all column metrics of a table compile into one shared aggregate scan that
gives one mergeable state row per partition (a load): counts, null counts, extremes, violations and
HyperLogLog sketches. States of old partitions are kept; a new load adds its own row, and the profile of
the whole table is a merge of states, not a new scan. Anomaly tests compare the metrics of a partition
with the whole table or with the history before it.

Where medians or the broken rows themselves are wanted, the shared scan (``audit_states``) keeps value frequencies: per partition
and checked column one row per value, and one per broken row. These states merge by adding them up, and null shares, medians,
broken rows and shifts all come from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.skew import weighted_medians


@dataclass(frozen=True)
class Check:
    """``valid`` is SQL over the table's columns; it is asked only where ``column`` is not null."""

    column: str
    valid: str

    def broken(self) -> Column:
        return F.col(f"`{self.column}`").isNotNull() & ~F.coalesce(F.expr(self.valid), F.lit(False))


def _metrics(df: DataFrame, columns: Sequence[str], checks: Sequence[Check]) -> list[Column]:
    by_column = {}
    for check in checks:
        by_column.setdefault(check.column, []).append(check)
    out = [F.count(F.lit(1)).alias("n_rows")]
    types = dict(df.dtypes)
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        text = c.cast("string")
        # NaN has its own count and no place in a range
        ordered = F.when(~F.isnan(c), c) if types[name] in ("double", "float") else c
        broken = F.lit(False)
        for check in by_column.get(name, []):
            broken = broken | check.broken()
        out += [
            F.count_if(c.isNull()).alias(f"nulls_{i}"),
            F.min(ordered).cast("string").alias(f"low_{i}"),
            F.max(ordered).cast("string").alias(f"high_{i}"),
            F.count_if(broken).alias(f"broken_{i}"),
            F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(text))).alias(f"hll_{i}"),
        ]
        if types[name] in ("double", "float", "int", "bigint", "smallint", "tinyint"):
            out.append(F.count_if(F.isnan(c.cast("double"))).alias(f"nan_{i}"))
        else:
            out.append(F.lit(0).cast("bigint").alias(f"nan_{i}"))
    return out


def partition_states(df: DataFrame, partition: str | None, columns: Sequence[str] | None = None, checks: Sequence[Check] = ()) -> DataFrame:
    """One scan; long rows ``partition_key, column_name, n_rows, n_null, n_nan, n_broken, low_num, high_num, low, high, hll``.

    Low and high are kept as text for reports and as doubles for merging numbers. A null partition value
    is a partition of its own; an empty table gives no states. Column names may hold any character but a
    backtick. Map, array and variant columns are left out (they have no order).
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType, T.BinaryType))]
    names = [n for n in (columns or names)]
    key = F.col(f"`{partition}`").cast("string") if partition else F.lit(None).cast("string")
    wide = df.groupBy(key.alias("partition_key")).agg(*_metrics(df, names, checks))
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"nulls_{i}").alias("n_null"),
            F.col(f"nan_{i}").alias("n_nan"),
            F.col(f"broken_{i}").alias("n_broken"),
            F.col(f"low_{i}").alias("low"),
            F.col(f"high_{i}").alias("high"),
            F.col(f"hll_{i}").alias("hll"),
        )
        for i, name in enumerate(names)
    ]
    return wide.select("partition_key", "n_rows", F.explode(F.array(*entries)).alias("e")).select("partition_key", "n_rows", "e.column_name", "e.n_null", "e.n_nan", "e.n_broken", "e.low", "e.high", "e.hll")


def merge_states(states: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Table-level profile from partition states; merging merged states gives the same result.

    Columns: ``column_name, n_rows, n_null, n_nan, n_broken, low, high, hll``.
    """
    number = F.col("column_name").isin(*numeric) if numeric else F.lit(False)
    least = F.min(F.when(number, F.col("low").cast("double")))
    most = F.max(F.when(number, F.col("high").cast("double")))
    return states.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.sum("n_nan").alias("n_nan"),
        F.sum("n_broken").alias("n_broken"),
        F.coalesce(least.cast("string"), F.min(F.when(~number, F.col("low")))).alias("low"),
        F.coalesce(most.cast("string"), F.max(F.when(~number, F.col("high")))).alias("high"),
        F.hll_union_agg("hll").alias("hll"),
    )


def load_metrics(states: DataFrame, ranged: Sequence[str]) -> DataFrame:
    """``partition_key, column_name, metric, value``: null, NaN and broken shares, distinct count and, for ``ranged`` columns, both ends of the range.

    Ranged are columns of numbers and times; low and high of texts have no distance and give no metric. Times count in seconds; shares are rounded to six places.
    """
    share = lambda c: F.round(F.col(c) / F.col("n_rows"), 6)
    ends = F.col("column_name").isin(*ranged) if ranged else F.lit(False)
    number = lambda c: F.when(ends, F.coalesce(F.col(c).try_cast("double"), F.unix_seconds(F.col(c).try_cast("timestamp")).cast("double")))
    values = {
        "rows": F.col("n_rows").cast("double"), "null_share": share("n_null"), "nan_share": share("n_nan"), "broken_share": share("n_broken"),
        "distinct": F.hll_sketch_estimate("hll").cast("double"), "low": number("low"), "high": number("high"),
    }
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
    return states.select("partition_key", "column_name", F.inline(entries)).where("value is not null")


def load_changes(metrics: DataFrame, series: Sequence[str] = ("column_name", "metric")) -> DataFrame:
    """The metrics of loads that leave the control limits of the loads before them, in the order of whole numbers or else of texts.

    Rows of no load (a null key) are left out; a difference within rounding is none.
    """
    key = F.col("partition_key")
    placed = metrics.where(key.isNotNull()).withColumn("_at", F.when(key.rlike(r"^\d+$"), F.lpad(key, 20, "0")).otherwise(key))
    judged = control_limits(placed, series, "_at", "value").where("is_anomaly").drop("_at", "is_anomaly")
    slack = F.lit(1e-9) * F.greatest(F.abs("value"), F.lit(1.0))
    return judged.where((F.col("value") < F.col("limit_low") - slack) | (F.col("value") > F.col("limit_high") + slack))


def audit_states(df: DataFrame, partition: str | None, row_key: str, checks: Sequence[Check], numbers: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate scan; ``partition_key, column_name, missing, broken_key, is_broken, value, n``, mergeable by adding ``n`` up.

    A row of the table gives one entry per checked column. Entries of the right form are counted by ``numbers[column]`` (the
    number whose median is wanted, null if none); a broken entry also keeps its ``row_key``, so the cases need no second
    scan, and spreads over the tasks by it, however many there are. Null partitions, keys and numbers are kept; NaN is the largest
    number. Several checks of one column count as one. An empty table or no checks give no states.
    """
    by_column: dict[str, Column] = {}
    for check in checks:
        by_column[check.column] = by_column.get(check.column, F.lit(False)) | check.broken()
    key, numbers = F.col(f"`{row_key}`").cast("string"), numbers or {}
    entries = [
        F.struct(
            F.lit(name).alias("column_name"), F.col(f"`{name}`").isNull().alias("missing"), broken.alias("is_broken"),
            F.when(broken, key).alias("broken_key"), numbers.get(name, F.lit(None)).cast("double").alias("value"),
        )
        for name, broken in by_column.items()
    ]
    part = F.col(f"`{partition}`").cast("string") if partition else F.lit(None).cast("string")
    if not entries:
        empty = "partition_key string, column_name string, missing boolean, is_broken boolean, broken_key string, value double, n bigint"
        return df.sparkSession.createDataFrame([], empty)
    long = df.select(part.alias("partition_key"), F.explode(F.array(*entries)).alias("e")).select("partition_key", "e.*")
    return long.groupBy("partition_key", "column_name", "missing", "is_broken", "broken_key", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_audits(*states: DataFrame) -> DataFrame:
    """The states of several loads as one: rows of the same kind are added up, so a new load is merged without the old rows."""
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more)
    return every.groupBy("partition_key", "column_name", "missing", "is_broken", "broken_key", "value").agg(F.sum("n").alias("n"))


def save_audit(states: DataFrame, path: str) -> None:
    """Writes states in a folder per partition; a load that is written again replaces its own states only."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_key").parquet(path)


def broken_rows(states: DataFrame, table_name: str) -> DataFrame:
    """One row per broken value: ``case_kind='value', table_name, column_name, row_key``."""
    each = states.where("is_broken").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return each.select(F.lit("value").alias("case_kind"), F.lit(table_name).alias("table_name"), "column_name", F.col("broken_key").alias("row_key"))


def shifts(states: DataFrame, table_name: str, null_margin: float = 0.15, median_factor: float = 2.0) -> DataFrame:
    """Partitions whose null share or median leaves the limits set by the whole table: ``case_kind='shift', table_name, column_name, row_key``.

    The whole table's state is the sum of ``audit_states``. A partition is reported once per column when its null share is more than
    ``null_margin`` from the table's, or its median is more than ``median_factor`` times the table's or
    less than the table's divided by it. Columns without any number in a partition have no median there.
    A null partition is not reported, as its rows belong to no load; they count in the whole table.
    """
    summed = states.groupBy(F.col("partition_key").alias("row_key"), "column_name", "missing", F.col("value").alias("_value")).agg(F.sum("n").alias("_n"))
    nulls = F.sum(F.when(F.col("missing"), F.col("_n")).otherwise(0)) / F.sum("_n")
    loads = summed.where("row_key is not null")
    each = loads.groupBy("row_key", "column_name").agg(nulls.alias("null_share"))
    each_median = weighted_medians(loads, ["row_key", "column_name"])
    whole_states = summed.groupBy("column_name", "missing", "_value").agg(F.sum("_n").alias("_n"))
    whole = whole_states.groupBy("column_name").agg(nulls.alias("all_null_share"))
    whole_median = weighted_medians(whole_states, ["column_name"]).withColumnRenamed("median", "all_median")
    return (
        each.join(each_median, ["row_key", "column_name"], "left")
        .join(F.broadcast(whole.join(whole_median, "column_name", "left")), "column_name")  # one row per column
        .where(
            (F.abs(F.col("null_share") - F.col("all_null_share")) > F.lit(null_margin))
            | F.coalesce((F.col("median") > F.col("all_median") * F.lit(median_factor)) | (F.col("median") < F.col("all_median") / F.lit(median_factor)), F.lit(False))
        )
        .select(F.lit("shift").alias("case_kind"), F.lit(table_name).alias("table_name"), "column_name", "row_key")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, n_distinct``: exact numbers of distinct non-null values, all columns from one scan.

    Long texts travel as a digest of 128 bits. Each (column, value) is combined on the map side and hashed over all tasks, so
    neither a column nor a value is one task's work. NaN is one value; a column of nulls has none.
    """
    names = [n for n in (columns or df.columns)]
    values = [F.struct(F.lit(i).alias("c"), F.col(f"`{n}`").cast("string").alias("x")) for i, n in enumerate(names)]
    long = df.select(F.explode(F.array(*values)).alias("e")).select("e.c", F.when(F.length("e.x") > 40, F.md5("e.x")).otherwise(F.col("e.x")).alias("x"))
    counts = long.where("x is not null").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "c int, column_name string")
    return listed.join(counts, "c", "left").select("column_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_distinct"))


def control_limits(metrics: DataFrame, series: Sequence[str], order: str, metric: str, history: int = 12, width: float = 3.0, least: int = 6) -> DataFrame:
    """Test each metric value against mean plus or minus ``width`` deviations of the ``history`` values before it.

    Adds ``limit_low, limit_high, is_anomaly``; with fewer than ``least`` earlier values there is no verdict
    (null). The history of a series is one row per partition of the table, so the window stays small.
    """
    before = Window.partitionBy(*series).orderBy(order).rowsBetween(-history, -1)
    mean, spread, seen = F.avg(metric).over(before), F.stddev_pop(metric).over(before), F.count(metric).over(before)
    known = metrics.withColumn("limit_low", F.when(seen >= least, mean - F.lit(width) * spread)).withColumn("limit_high", F.when(seen >= least, mean + F.lit(width) * spread))
    return known.withColumn("is_anomaly", (F.col(metric) < F.col("limit_low")) | (F.col(metric) > F.col("limit_high")))
