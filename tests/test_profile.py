import random
from statistics import median

from pyspark.sql import functions as F

from ledgerloom.operators import profile

CHECK = profile.Check("x", "not isnan(x) and x between 1 and 10")


def test_states_merge_to_the_whole(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), float(rng.randint(-5, 15))]), f"s{rng.randint(0, 40)}") for i in range(500)]
    df = spark.createDataFrame(data, "id bigint, load string, x double, n_rows string")
    states = profile.partition_states(df, "load", checks=[CHECK])
    merged = {r.column_name: r for r in profile.merge_states(states, ["id", "x"]).withColumn("d", F.hll_sketch_estimate("hll")).collect()}
    whole = {r.column_name: r for r in profile.merge_states(profile.partition_states(df, None, checks=[CHECK]), ["id", "x"]).withColumn("d", F.hll_sketch_estimate("hll")).collect()}
    for c in ("id", "load", "x", "n_rows"):
        assert merged[c][:7] == whole[c][:7]
        assert abs(merged[c].d - len({str(r[("id", "load", "x", "n_rows").index(c)]) for r in data if r[("id", "load", "x", "n_rows").index(c)] is not None})) <= 0.1 * 500
    assert (float(merged["x"].low), float(merged["x"].high)) == (-5.0, 15.0)
    assert merged["x"].n_null == sum(r[2] is None for r in data)
    assert merged["x"].n_nan == sum(r[2] != r[2] for r in data if r[2] is not None)
    assert merged["x"].n_broken == sum(1 for r in data if r[2] is not None and not 1 <= r[2] <= 10)
    assert profile.partition_states(df.limit(0), "load", checks=[CHECK]).count() == 0


def test_broken_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 11.0), (4, 11.0), (None, 0.0)], "id bigint, x double")
    got = sorted((r.column_name, r.row_key or "") for r in profile.broken_rows(profile.audit_states(df, None, "id", [CHECK]), "t").collect())
    assert got == [("x", ""), ("x", "3"), ("x", "4"), ("x", "4")]
    assert profile.broken_rows(profile.audit_states(df, None, "id", []), "t").count() == 0
    assert profile.audit_states(df.limit(0), None, "id", [CHECK]).count() == 0


def shifted(df):
    return profile.shifts(profile.audit_states(df.withColumn("id", F.lit(1)), "load", "id", [CHECK], {"x": F.col("x")}), "t")


def test_shifts_against_brute_force(spark):
    rng = random.Random(2)
    data = []
    for load in range(12):
        scale, hole = (10 if load == 3 else 1), (0.6 if load == 7 else 0.02)
        data += [(load, None if rng.random() < hole else float(rng.randint(1, 20) * scale)) for _ in range(80)]
    data += [(None, 1.0), (99, None)]
    df = spark.createDataFrame(data, "load bigint, x double")
    got = {r.row_key for r in shifted(df).collect()}
    all_null = sum(v is None for _, v in data) / len(data)
    all_median = median(v for _, v in data if v is not None)
    want = set()
    for load in {k for k, _ in data if k is not None}:
        vs = [v for k, v in data if k == load]
        values = [v for v in vs if v is not None]
        off = abs(sum(v is None for v in vs) / len(vs) - all_null) > 0.15
        if off or values and (median(values) > 2 * all_median or median(values) < all_median / 2):
            want.add(str(load))
    assert got == want and "99" in got


def test_states_are_stored_and_a_new_load_is_merged(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"load {i % 4}", rng.choice([None, float("nan"), float(rng.randint(-3, 14) * (9 if i % 4 == 3 else 1))])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, load string, x double")
    audit = lambda part: profile.audit_states(part, "load", "id", [CHECK], {"x": F.col("x")})
    path = str(tmp_path / "states")
    for load in ("load 0", "load 1", "load 2", "load 1"):  # one load comes twice
        profile.save_audit(audit(df.where(F.col("load") == load)), path)
    stored = spark.read.schema(audit(df).schema).parquet(path)
    merged = profile.merge_audits(stored, audit(df.where("load = 'load 3'")))
    key = lambda d: sorted(map(str, d.select("partition_key", "column_name", "missing", "is_broken", "broken_key", "value", "n").collect()))
    assert key(merged) == key(audit(df)) == key(profile.merge_audits(merged))
    for result in (lambda s: profile.broken_rows(s, "t"), lambda s: profile.shifts(s, "t")):
        assert sorted(map(str, result(merged).collect())) == sorted(map(str, result(audit(df)).collect()))


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a" * 50, 1.0, None), ("a" * 50, float("nan"), None), ("a" * 49 + "b", float("nan"), None), (None, None, None)], "s string, x double, y int")
    assert {r.column_name: r.n_distinct for r in profile.distinct_counts(df).collect()} == {"s": 2, "x": 2, "y": 0}


def test_control_limits(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 3) * 0.1) for i in range(12)] + [(12, 9.0)], "t bigint, m double").withColumn("s", F.lit("a"))
    judged = {r.t: r.is_anomaly for r in profile.control_limits(df, ["s"], "t", "m").collect()}
    assert judged[12] is True and judged[0] is None and not any(judged[i] for i in range(6, 12))


def test_changes_of_every_metric_and_column(spark):
    data = [(str(load), float(i + (100 if load == 11 else 0)), "one" if load == 10 else f"s{i}", None if load == 9 and i < 5 else i) for load in range(12) for i in range(10)]
    data.append((None, 1e9, "x", 1))
    df = spark.createDataFrame(data, "load string, x double, s string, y int")
    metrics = profile.load_metrics(profile.partition_states(df, "load", ["x", "s", "y"]), ["x", "y"])
    got = {(r.partition_key, r.column_name, r.metric) for r in profile.load_changes(metrics).collect()}
    assert got == {("11", "x", "low"), ("11", "x", "high"), ("10", "s", "distinct"), ("9", "y", "null_share"), ("9", "y", "distinct"), ("9", "y", "low")}


def test_every_large_table_is_profiled(spark):
    from ledgerloom.queries import general

    d = "/root/testdata/sf0.001"
    rows = general.p3_profile(spark, d).where("table_name = 'documents'").collect()
    assert {r.column_name for r in rows} == set(spark.read.parquet(f"{d}/documents.parquet").columns)
    assert {r.table_name for r in general.p3_table_metrics(spark, d).select("table_name").distinct().collect()} == set(general._PARTITION)


def test_rows_of_no_load_count_in_the_whole_table(spark):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 10.0)] * 2 + [(None, 10.0)] * 20, "load string, x double")
    assert [r.row_key for r in shifted(df).collect()] == ["a"]
