import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.functions import similarity
from ledgerloom.functions.similarity import lcs_length, nearest, ratio
from ledgerloom.functions.text import clean_token, fold, normalize_text
from ledgerloom.operators import dimensions, resolution, sequences
from pyspark.sql import functions as F


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text(max_size=12), st.text(max_size=12))
def test_lcs_and_ratio(a, b):
    assert lcs_length(a, b) == brute_lcs(a, b) == lcs_length(b, a)
    assert (ratio(a, b) == 100.0) == (a == b)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Land-Rover  (UK) ",), (None,), ("تويوتا",), ("nan ",), ("É‏a_ß",)], "x string")
    got = [tuple(r) for r in df.select(normalize_text(F.col("x")), clean_token(F.col("x")), fold(F.col("x"))).collect()]
    assert [g[0] for g in got] == ["land rover uk", "", "تويوتا", "nan", "é a_ß"]
    assert [g[1] for g in got] == ["Land-Rover  (UK)", "", "تويوتا", "", "É‏a_ß"]
    assert got[4][2] == "ea_ß"


def test_unit_cases(spark):
    df = spark.createDataFrame([("MG One", "MG", "1"), ("Onex", "MG", "Onex"), ("MGB", "MG", "MGB"), (None, "MG", None)], "m string, b string, want string")
    assert all(r[0] == r.want for r in df.select(resolution.number_word_to_digit(F.col("m"), F.col("b")), "want").collect())
    assert df.select(resolution.strip_prefix(F.lit("MGB"), F.lit("MG"))).first()[0] == "b"
    assert df.select(resolution.same_model(F.lit("MG 4"), F.lit("4"), F.lit("MG"))).first()[0] is True
    asked = spark.createDataFrame([("", "528"), ("", "4"), ("", "320")], "scope string, value string")
    known = spark.createDataFrame([("", "528i"), ("", "4Runner"), ("", "320i"), ("", "320d")], "scope string, name string")
    assert [tuple(r) for r in resolution.numeric_completion(asked, known).collect()] == [("", "528", "528i")]


@pytest.fixture
def master(spark):
    aliases = spark.createDataFrame([("", "B1", "toyota", 1), ("", "B2", "kea", 2), ("", "B3", "kira", 3), ("", "B4", "hyundai motors", 4), ("", "B5", "hyundai motor", 5)], "scope string, entity_id string, alias string, ord int")
    entities = spark.createDataFrame([("", "B1", "Toyota"), ("", "B2", "Kea"), ("", "B3", "Kira"), ("", "B4", "Hyundai")], "scope string, entity_id string, name string")
    return entities, aliases


def test_cascade_parts_its_input(spark, master):
    values = [("", v) for v in ("TOYOTA", "toyta", "kia", "Hyundai Motors", "hyundaimotors", "zzz", "Hyundai", "toyota", "")]
    got = {r.value: (r.entity_id, r.stage) for r in resolution.cascade(spark.createDataFrame(values + values, "scope string, value string"), *master).collect()}
    assert set(got) == {v for _, v in values}
    assert got["TOYOTA"] == ("B1", "exact") and got["toyta"] == ("B1", "typo") and got["kia"] == ("B3", "fuzzy")  # a tie of typos, then the higher ratio
    assert got["Hyundai Motors"] == ("B4", "alias") and got["hyundaimotors"][1] == "fuzzy" and got["zzz"] == (None, "unresolved") == got[""]


def test_fuzzy_candidates_lose_nothing(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
    values, aliases = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)})
    v = spark.createDataFrame([("", x) for x in values], "scope string, value string")
    a = spark.createDataFrame([("", f"E{i:03d}", x, i) for i, x in enumerate(aliases)], "scope string, entity_id string, alias string, ord int")
    got = {r.value: (r.entity_id, r.score) for r in resolution.fuzzy_match(v, a).collect()}
    want = {}
    for x in values:
        scores = [(ratio(x, y), -i) for i, y in enumerate(aliases)]
        best = max(scores)
        if best[0] >= 80:
            want[x] = (f"E{-best[1]:03d}", best[0])
    assert got == want


@pytest.mark.parametrize("longest", [4, 14, 90, 300])
def test_nearest_is_brute_force(longest):
    rng = random.Random(longest)
    word = lambda: "".join(rng.choice("abcdefgh é\u0627\U0001d4b3") for _ in range(rng.randint(0, longest)))
    names = [word() for _ in range(40)]
    values = [word() for _ in range(20)] + [x[: len(x) // 2] + word()[:2] + x[len(x) // 2 + 1 :] for x in names] + names[:5]
    for threshold, first in ((80, 90), (80, 80), (60, 90), (95, 90)):
        want = set()
        for i, x in enumerate(values):
            scores = [(ratio(x, y), j) for j, y in enumerate(names) if x and y]
            best = max(s for s, _ in scores) if scores else 0
            want |= {(i, j, s) for s, j in scores if s == best >= threshold}
        assert set(zip(*(x.tolist() for x in nearest(values, names, threshold, first)), strict=True)) == want
    assert [len(x) for x in (*nearest([], names, 80), *nearest(values, [], 80))] == [0] * 6


def test_letters_are_counted_for_few_pairs(monkeypatch):
    """Most pairs are settled by one machine word, and nothing is lost by it."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(9, 16)))
    names = [word() for _ in range(300)]
    values = [word() for _ in range(200)] + [x[1:] + "q" for x in names[:50]]
    met, places = [], similarity._places
    monkeypatch.setattr(similarity, "_places", lambda close: met.append(places(close)) or met[-1])
    got = {(i, j) for i, j, _ in zip(*(x.tolist() for x in nearest(values, names, 80)), strict=True)}
    best = [(max(ratio(x, y) for y in names), x) for x in values]
    assert got == {(i, j) for i, (b, x) in enumerate(best) if b >= 80 for j, y in enumerate(names) if ratio(x, y) == b}
    assert sum(len(at[0]) for at in met) < len(values) * len(names) / 20


def test_number_words_are_those_of_the_expression(spark):
    models = ["MG One", "one", "MG one", "Zone", "mg-ten", "MG  Seven", "Onex", "MGEight", "MG THREE", "x six", "", "7", "MG\u00a0Nine"]
    df = spark.createDataFrame([(m, b) for m in models for b in ("MG", "")], "m string, b string").withColumn("f", F.lower("b"))
    got = resolution.with_number_words(df, "m", "f", "v").select("m", "b", "v", resolution.number_word_to_digit(F.col("m"), F.col("b")).alias("want")).collect()
    assert all(r.v == r.want for r in got) and {r.m for r in got if r.v != r.m} == {"MG One", "one", "MG one", "MG  Seven", "MGEight", "MG THREE", "MG\u00a0Nine"}


def test_fuzzy_match_over_blocks(spark, monkeypatch):
    """Many spellings of few names: sought once each, over several blocks of both sides, ties across blocks to the alias known first."""
    monkeypatch.setattr(resolution, "VALUE_BLOCK", 3)
    monkeypatch.setattr(resolution, "ALIAS_BLOCK", 2)
    names = ["corolla cross", "corolla crosa", "corolla crosb", "yaris hatch", "land cruiser"]
    a = spark.createDataFrame([(s, f"{s}{i}", x, i) for s in "xy" for i, x in enumerate(names)], "scope string, entity_id string, alias string, ord int")
    asked = ["corolla crosz", "yaris hatcg", "lnd cruiser", "sunny", "corola cross", "yari hatch", "land cruser", "corolla crozs"]
    values = sorted({("x", form(x) + end) for x in asked for form in (str, str.upper, str.title) for end in ("", ".", " -", "  ")} | {("z", "yaris hatch")})
    got = {(r.scope, r.value): (r.entity_id, r.score) for r in resolution.fuzzy_match(spark.createDataFrame(values, "scope string, value string"), a).collect()}
    want = {}
    for scope, value in values:
        plain = value.lower().strip(" .-")
        best, i = max((ratio(plain, y), -i) for i, y in enumerate(names))
        if scope == "x" and best >= 80:
            want[scope, value] = (f"x{-i}", best)
    assert got == want and len({v for v, _ in want.values()}) == 3
    pairs = resolution.dealt(spark.createDataFrame(values, "scope string, value string"), a)
    assert pairs[0].where("scope = 'x'").select("v").distinct().count() == len(asked)


def test_align_answers(spark):
    requests = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, raw string")
    answers = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (2, 1, None), (7, 1, "z")], "i int, o int, name string")
    assert sorted(tuple(r) for r in resolution.align_answers(requests, answers, "i", "o").collect()) == [(0, "a", "y"), (1, "b", None), (2, "c", None)]


def test_numbers_upserts(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x int")
    assert [r.ordinal for r in sequences.numbered(df, ["x"]).orderBy("x").collect()] == list(range(1, 51))
    assert sequences.numbered(df.limit(0), ["x"]).count() == 0
    target = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    source = spark.createDataFrame([("2", None), ("3", "c")], "k string, v string")
    once = dimensions.merge_upsert(target, source, "k")
    assert sorted(map(tuple, once.collect())) == [("1", "a"), ("2", None), ("3", "c")]
    assert sorted(map(tuple, dimensions.merge_upsert(once, source, "k").collect())) == sorted(map(tuple, once.collect()))
    ids = dimensions.surrogate_ids(spark.createDataFrame([("n", 5), ("m", 1), ("n", 2), (None, 0)], "name string, o int"), "name", "o", "brand", 99_999)
    assert sorted(map(tuple, ids.collect())) == [("BR100000", "n"), ("BR99999", "m")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_text_join_is_the_join_on_texts_even_where_numbers_are_equal(spark, monkeypatch, how):
    left = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("t", "a", 4), (None, "a", 5), ("s", None, 6), ("s", "A", 7)], "scope string, value string, n int")
    right = spark.createDataFrame([("s", "a", "x"), ("t", "a", "y"), (None, "a", "z"), ("s", None, "w"), ("s", "ab", "v")], "scope string, value string, id string")
    rows = lambda df: sorted(df.select("n", "scope", "value", "id").collect(), key=str)
    plain = rows(left.join(right, ["scope", "value"], how))
    assert rows(resolution.text_join(left, right, ["scope", "value"], how)) == plain
    monkeypatch.setattr(resolution.F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    assert rows(resolution.text_join(left, right, ["scope", "value"], how)) == plain


def test_normalized_values_give_what_their_values_give(spark):
    values = spark.createDataFrame([("b", v) for v in ("Corolla", "corolla!", "YARIS", "corola x", "yari", "zzzzzzzz", "--")], "scope string, value string")
    entities = spark.createDataFrame([("b", "M1", "Corolla"), ("b", "M2", "Yaris")], "scope string, entity_id string, name string")
    aliases = entities.select("scope", "entity_id", F.col("name").alias("alias"), F.lit(0).cast("bigint").alias("ord"))
    plain = resolution.scored_cascade(values, entities, aliases, models=True).where("entity_id is not null").withColumn("value", normalize_text(F.col("value"))).distinct()
    short = resolution.scored_cascade(values.withColumn("value", normalize_text(F.col("value"))), entities, aliases, models=True, normalized=True)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, plain.select(*short.columns).collect())) and short.count() == 4
