import random
from collections import Counter, defaultdict

from ledgerloom.llm import packing

SCHEMA = "doc_id bigint, text string, container_id string, n_tokens string, salt string"


def loads(entries):
    out = Counter()
    for length, low, high, each, first in entries:
        for r in range(low, high):
            out[first + (r - low) // each] += max(1, length)
    return out


def test_plan_places_every_item_once_within_capacity():
    rng = random.Random(3)
    for capacity in (10, 64):
        for _ in range(40):
            histogram = {rng.randint(0, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
            entries = packing.plan(histogram, capacity)
            for length, n in histogram.items():
                numbers = sorted(r for t, low, high, _, _ in entries if t == length for r in range(low, high))
                assert numbers == list(range(n))
            used = loads(entries)
            assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
            # no two containers could be poured together
            if len(used) > 1:
                a, b = sorted(used.values())[:2]
                assert a + b > capacity
    assert packing.plan({}, 10) == []


def test_harmonic_counts():
    assert packing.plan({5: 7}, 10) == [(5, 0, 6, 2, 0), (5, 6, 7, 1, 3)]


def test_texts_null_empty_long_repeated(spark):
    texts = ["a b c", None, "", "word " * 5000, "a b c", "x", "word " * 900]
    rows = [(i, t, "c", "n", "s") for i, t in enumerate(texts)] + [(0, "a b c", "c", "n", "s")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece_no, r.n_tokens))
    assert 1 not in pieces and pieces[2] == [(0, 0)] and len(pieces[0]) == 2 and len(pieces[6]) == 1
    long = sorted(pieces[3])
    assert [p for p, _ in long] == [0, 1, 2] and [n for _, n in long[:2]] == [2048, 2048] and sum(n for _, n in long) == 5001
    load = Counter()
    for r in got:
        load[r.container_id] += r.n_tokens
    assert max(load.values()) <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_within_a_common_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 5)
    rows = [(i, "same text", "c", "n", "s") for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=6).collect()
    assert len(got) == 100 and max(Counter(r.container_id for r in got).values()) == 6 // got[0].n_tokens


def test_audit_sees_every_kind_of_fault(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e"), (6, "f")], "doc_id bigint, text string")
    good = [(1, 0, 6, 0), (2, 0, 4, 0), (3, 0, 10, 1), (3, 1, 2, 2), (5, 0, 0, 2), (6, 0, 1, 2)]
    faulty = [(1, 0, 6, 0), (1, 0, 6, 1), (2, 1, 4, 0), (3, 0, 5, 2), (3, 1, 2, 3), (5, 0, 11, 4), (9, 0, 1, 5)]
    audit = lambda rows: tuple(packing.audit(docs, spark.createDataFrame(rows, "doc_id bigint, piece_no int, n_tokens int, container_id bigint"), 10).first())
    assert audit(good) == (5, 0, 0, 0, 0, 0, 0)
    assert audit(faulty) == (5, 1, 1, 1, 1, 1, 1)
