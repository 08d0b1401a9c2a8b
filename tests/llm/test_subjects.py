from ledgerloom.llm import subjects

SCHEMA = "doc_id bigint, text string, subject string, score string, hits string"
TERMS = [("river", "geography", 1.0), ("lake", "geography", 1.0), ("judge", "law", 1.0), ("bar", "law", 0.5), ("bar", "geography", 0.5), ("ski lift", "sport", 1.0)]


def assigned(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA)
    return sorted((r.doc_id, r.subject) for r in subjects.assign(df, terms=TERMS, **kw).collect())


def test_assignment(spark):
    docs = [
        (1, "The river is long. The lake is deep. A judge sat down."),
        (2, "#REDIRECT [[River lake]]"),
        (3, "{{Infobox|name=River}}"),
        (4, None),
        (5, ""),
        (6, "{|\n! river !! lake\n|-\n| a river || b\n|-\n| the judge || c\n|}\n[[Category:Rivers]]\n''This river page is a stub.''"),
        (7, "A bar is a bar by the river. Rivers and barges are other words."),
        (8, "They built a ski lift there. poop poop river river"),
        (9, "Nothing here. Nor there at all. " + "Plain words stand here. " * 50_000 + "The judge."),
        (1, "The river is long. The lake is deep. A judge sat down."),
    ]
    got = assigned(spark, docs)
    assert got == [(1, "geography"), (1, "geography"), (1, "law"), (1, "law"), (6, "geography"), (6, "law"), (7, "geography"), (8, "sport")]
    assert assigned(spark, []) == []


def test_sentences():
    text = "'''X''' is a thing of note. It has parts!\n== Head ==\n* listed words go here.\nlol lol lol\n<!-- hidden words are out. -->{{a|{{b}}}}"
    assert [s.strip(" *") for s in subjects.own_sentences(text)] == ["'''X''' is a thing of note.", "It has parts!", "listed words go here."]


def test_curated_terms():
    rows = subjects.load_terms()
    assert {s for _, s, _ in rows} == {"science", "medicine", "law", "sport", "software", "music", "geography", "economy", "agriculture", "transport"}
    lexicon = subjects.Lexicon(rows)
    shared = (lexicon.weights > 0).sum(axis=1)
    assert all(lexicon.weights[i].max() <= 1 for i in range(len(lexicon.terms))) and shared.min() == 1


def test_terms_are_learned_from_a_bounded_sample(spark):
    docs = [(i, f"The {'trombone' if i % 2 else 'glacier'} is here today. Number {i} also.") for i in range(60)] + [(90, None), (91, "")]
    d = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, "music" if i % 2 else "geography", "r") for i in range(40)] * 2 + [(90, "law", "r"), (None, "law", "r"), (5, None, "r"), (777, "law", "r")], "doc_id bigint, subject string, rater string")
    assert {(t, s) for t, s, _ in subjects.learn_terms(d, labels, least_share=0.6)} == {("trombone", "music"), ("glacier", "geography")}
    assert subjects.learn_terms(d, labels, sample=3) == [] == subjects.learn_terms(d, labels.limit(0)) and len(subjects.learn_terms(d, labels, most=1, least_share=0.6)) == 1
    both = subjects.with_learned([("glacier", "science", 1.0)], [("glacier", "geography", 0.9), ("trombone", "music", 0.9)])
    assert both == [("glacier", "science", 1.0), ("trombone", "music", 0.9)]


def test_more_sentences_than_fit_a_small_number(spark):
    text = "A b c. " * 40_000 + "The river is long."
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = subjects.subject_scores(df, TERMS).collect()
    assert [r.subject for r in got] == ["geography"] and abs(got[0].score - 1 / 40_001) < 1e-9
