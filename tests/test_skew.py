import math
import random
from collections import Counter, defaultdict
from statistics import median

from ledgerloom.operators import skew

SCHEMA = "k string, v double, _n bigint, total string"


def rows(spark, data):
    return spark.createDataFrame([(k, v, 7, "x") for k, v in data], SCHEMA)


def test_summary_against_brute_force(spark):
    rng = random.Random(5)
    data = [("hot", rng.choice([1.0, 2.0, 2.5, -3.0, 0.0, 1e9, None])) for _ in range(900)] + [(rng.choice("abc"), rng.uniform(-50, 50)) for _ in range(300)] + [(None, 4.0), (None, None)]
    got = {r.k: r for r in skew.key_summary(rows(spark, data), "k", "v").collect()}
    groups = defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        known = [v for v in vs if v is not None]
        r = got[k]
        assert (r.n_rows, r.n_values, r.n_distinct) == (len(vs), len(known), len(set(known)))
        assert math.isclose(r.median, median(known))
        assert math.isclose(float(r.total), sum(known), rel_tol=1e-9, abs_tol=0.1)
        top = max(Counter(known).values())
        assert r.mode_value == min(v for v, n in Counter(known).items() if n == top)
        assert math.isclose(r.row_share, len(vs) / len(data))


def test_nan_infinite_and_nulls(spark):
    data = [("a", float("nan")), ("a", 1.0), ("a", float("inf")), ("b", None), ("c", float("-inf")), ("c", 0.0), ("c", -0.0)]
    got = {r.k: r for r in skew.key_summary(rows(spark, data), "k", "v").collect()}
    assert got["a"].median == float("inf") and float(got["a"].total) == 1.0
    assert got["a"].mode_value == 1.0  # a tie
    assert got["b"].median is None and got["b"].n_values == 0 and got["b"].total is None
    assert got["c"].median == 0.0 and got["c"].n_distinct == 2


def test_blocks_keep_order(spark):
    values = sorted([float("-inf"), -1e300, -7.1, -7.0, -1e-300, 0.0, 5e-324, 1.0, 1.0000001, 2.0, 1e308, float("inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    blocks = [r[0] for r in df.orderBy("v").select(skew._block(df["v"], 32)).collect()]
    assert blocks == sorted(blocks)


def test_heavy_keys_and_empty(spark):
    data = [("a", 1.0)] * 5 + [("b", None)] * 3 + [(None, 2.0)] * 4 + [("c", 1.0)]
    assert {r.k for r in skew.heavy_keys(rows(spark, data), "k", "v", 0.2).collect()} == {"a", "b"}
    empty = spark.createDataFrame([], SCHEMA)
    assert skew.heavy_keys(empty, "k", "v", 0.2).count() == 0
    assert skew.key_summary(empty, "k", "v").count() == 0
