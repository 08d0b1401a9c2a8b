import random

import numpy as np

from ledgerloom.llm import leakage
from ledgerloom.llm.wikitext import word_list

DOCS = "doc_id bigint, text string, item_id string, coverage string"
ITEMS = "item_id bigint, item_text string, doc_id string"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    return sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, q).collect())


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


def item(body):
    return f"Read the passage.\n\n{body}\n\n(A) x  (B) y\nAnswer: A"


def edits(window, text):
    """Least edits between the window and some stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(body, text):
    """'yes' if some window surely holds 15 words with few edits, 'no' if none can, else 'open'."""
    if not any(edits(body[a : a + 15], text) <= 3 for a in range(len(body) - 14)):
        return "no"
    best = "no"
    for a in range(len(body)):
        for b in range(a + 15, len(body) + 1):
            e = edits(body[a:b], text)
            if b - a - e >= 15 and 5 * e <= b - a:
                return "yes"
            if 5 * e <= b - a + e:
                best = "open"
    return best


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    bodies = {i: words(rng, rng.randint(16, 60), vocabulary) for i in range(25)}
    docs = []
    for d in range(120):
        text = words(rng, rng.randint(0, 80), vocabulary)
        if rng.random() < 0.7:
            body = bodies[rng.randrange(25)]
            a = rng.randrange(max(1, len(body) - 20))
            passage = [w for w in body[a : a + rng.randint(8, 25)]]
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(passage))
                kind = rng.random()
                if kind < 0.4:
                    passage[p] = "zz"
                elif kind < 0.7 and len(passage) > 3:
                    passage.pop(p)
                else:
                    passage.insert(p, "yy")
            text[len(text) // 2 : len(text) // 2] = passage
        docs.append((d, " ".join(text)))
    got = set(found(spark, docs, [(i, item(" ".join(b))) for i, b in bodies.items()]))
    verdict = {(d, i): brute(b, t.split()) for d, t in docs for i, b in bodies.items()}
    want = {k for k, v in verdict.items() if v == "yes"}
    assert len(want) > 15 and want - got == set()
    assert all(verdict[k] != "no" for k in got)


def test_markup_shared_bodies_and_edges(spark):
    body = "The quiet harbour of Lira moved nine old barges before winter came and the mayor thanked every tired sailor in town"
    other = "A short body of seven plain words"
    wiki = body.replace("harbour", "[[port|harbour]]").replace("barges", "<b>barges</b><ref>not counted at all</ref>").replace("winter", "win­ter").upper()
    docs = [
        (1, f"{{{{Infobox|a=b}}}} Start. {wiki} End."),
        (2, "<!-- " + body + " -->"),
        (3, "{|\n|-\n| " + " || ".join(body.split()) + "\n|}"),
        (4, " ".join(body.split()[:14])),
        (5, None),
        (6, ""),
        (7, "Read the passage. (A) x (B) y Answer: A " + other),
        (8, "{{quote|text=" + body.replace(" ", "&nbsp;", 5) + "|source=X}}"),
        (9, "filler " * 200_000 + body),
        (2, "<!-- " + body + " -->"),
    ]
    items = [(10, item(body)), (11, item(body)), (12, item(other)), (13, None), (14, ""), (15, "only one part")]
    hits = [(d, i) for d in (1, 2, 2, 3, 8, 9) for i in (10, 11)]
    assert found(spark, docs, items) == sorted(hits)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_tiles_are_greedy_and_disjoint():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3])
    b = np.array([5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 0, 1, 2, 3])
    got = leakage.tiles(a, b)
    assert got[0] == (4, 0, 5) and (0, 6, 4) in got
    for side in (0, 1):
        places = [x for t in got for x in range(t[side], t[side] + t[2])]
        assert len(places) == len(set(places))
    assert leakage.tiles(np.array([1, 2]), b) == []


def test_blocks_of_items(spark):
    rng = random.Random(1)
    bodies = [" ".join(words(rng, 30, [f"v{i}" for i in range(200)])) for _ in range(6)]
    d = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, item(b)) for i, b in enumerate(bodies)], "item_id bigint, item_text string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, q, block_words=50).collect()) == [(i, i) for i in range(6)]


def test_a_passage_beside_heavier_chains(spark):
    body = [f"b{i}" for i in range(130)]
    # every fourth word changed: tiles of three in one heavy chain that never passes
    mangled = [w if i % 4 else f"x{i}" for i, w in enumerate(body)][30:]
    verbatim, filler = body[:16], [f"f{i}" for i in range(40)]
    docs = [(1, verbatim + filler + mangled), (2, mangled + filler + verbatim), (3, mangled + verbatim), (4, mangled), (5, mangled + filler + body[:14])]
    assert found(spark, [(i, " ".join(t)) for i, t in docs], [(1, item(" ".join(body)))]) == [(1, 1), (2, 1), (3, 1)]


def test_a_passage_whose_words_stand_elsewhere_in_longer_runs(spark):
    body = [f"b{i}" for i in range(200)]
    passage = [w for i, w in enumerate(body[:19]) if i not in (4, 9, 14)]
    doc = passage + [f"f{i}" for i in range(60)] + body[:7] + ["y"] * 30 + body[7:13] + ["z"] * 30 + body[13:19]
    assert found(spark, [(1, " ".join(doc))], [(1, item(" ".join(body)))]) == [(1, 1)]


def test_words():
    assert word_list("'''A'''&nbsp;[[b c|D]] {{x|{{y}}}} <ref name=z/>e​f [[Category:No]]") == ["a", "d", "ef"]
    deep = "start " + "{{x|" * 3000 + "gone" + "}}" * 3000 + " end {{ open }} {{ stays"
    assert word_list(deep) == ["start", "end", "stays"] == word_list(deep + " }}" * 0)


def test_edits_that_crowd_one_spot(spark):
    body = [f"b{i}" for i in range(20)]
    docs = []
    for at in range(17):  # four neighbours changed, left out, or four added, at every place
        docs += [(3 * at, body[:at] + [f"x{i}" for i in range(4)] + body[at + 4 :]), (3 * at + 1, body[:at] + body[at + 4 :]), (3 * at + 2, body[:at] + [f"x{i}" for i in range(4)] + body[at:])]
    docs += [(100, body[:7] + ["x"] * 5 + body[12:]), (101, body[:7] + ["x"] * 6 + body[7:])]
    got = found(spark, [(i, " ".join(["f"] * 30 + t + ["g"] * 30)) for i, t in docs], [(1, item(" ".join(body)))])
    assert got == [(i, 1) for i in range(51)]


def test_stands_against_every_alignment():
    rng = random.Random(12)

    def brute(body, text):
        # best score for each start and number of held words, by plain recursion over cells
        best = {}
        for i in range(len(body)):
            for j in range(len(text)):
                cell = {}
                def put(h, v, cell=cell):
                    cell[h] = max(cell.get(h, -99), v)
                if body[i] == text[j]:
                    put(1, 1)
                    for h, v in best.get((i - 1, j - 1), {}).items():
                        put(min(h + 1, 15), v + 1)
                for other in ((i - 1, j - 1), (i - 1, j), (i, j - 1)):
                    for h, v in best.get(other, {}).items():
                        if v > -40:
                            put(h, v - 4)
                if cell.get(15, -99) >= 0:
                    return True
                best[i, j] = cell
        return False

    seen = set()
    for _ in range(150):
        body = [rng.randrange(1, 200) for _ in range(rng.randint(15, 32))]
        text = list(body)
        for _ in range(rng.randint(0, 7)):
            p = rng.randrange(len(text))
            kind = rng.random()
            text[p : p + (kind < 0.7)] = [0] * (kind < 0.35 or kind >= 0.7)
        want = brute(body, text)
        seen.add(want)
        assert leakage.stands(np.array(body), np.array(text)) == want
    assert seen == {True, False}


def test_reordered_passages(spark):
    body = [f"b{i}" for i in range(28)]
    docs = [(1, body[14:] + ["z"] + body[:14]), (2, body[:14]), (3, body[::-1]), (4, body[20:] + body[10:20] + body[:10]), (5, ["q"] * 50 + body[3:9] + ["q"] * 300 + body[12:24]), (6, body[:15]), (7, [])]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, item(" ".join(body)))], "item_id bigint, item_text string")
    assert sorted(r.doc_id for r in leakage.reordered(d, q).collect()) == [1, 4, 5, 6]
    assert sorted(r.doc_id for r in leakage.leaks(d, q).collect()) == [6]


def test_one_very_long_item_does_not_widen_the_index():
    index = leakage.SeedIndex([(i, " ".join(f"w{i} w{j}" for j in range(20))) for i in range(300)] + [(999, " ".join(f"v{j}" for j in range(20_000)))])
    assert index.size_in_bytes() < 12_000_000
