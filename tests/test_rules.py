from ledgerloom.operators import rules


def test_rules(spark):
    make = spark.createDataFrame
    asked = make([("B", "320"), ("B", " 320 "), ("B", "99"), ("C", "320"), ("B", "x1"), ("B", None)], "scope string, value string")
    got = sorted((r.scope, r.value, r.is_model) for r in rules.standalone_numbers(asked, make([("B", "320"), ("B", "320"), (None, "1")], "scope string, number string")).collect())
    assert got == [("B", " 320 ", True), ("B", "320", True), ("B", "99", False), ("C", "320", False)]
    names = make([("B", "1", "Alpha"), ("B", "2", "Alpha Plus"), ("B", "3", "ALPHA  plus GT"), ("B", "4", "Alphabet"), ("C", "5", "Alpha X"), ("B", "6", None), ("B", "0", "alpha")], "scope string, entity_id string, name string")
    assert sorted(tuple(r) for r in rules.parents(names).collect()) == [("B", "2", "0"), ("B", "3", "2")]
    df = make([(1, "Alpha GT"), (2, "GT"), (3, "Alpha"), (4, None), (5, "Alpha GT gt")], "id int, name string")
    assert {r.id: r.bare for r in rules.without_suffixes(df, "name", make([("gt",), ("GT",)], "word string"), "bare").collect()} == {1: "alpha", 2: None, 3: "alpha", 4: "", 5: "alpha gt"}
    brands = make([("1", "Alpha", None), ("2", "ALPHA", " "), ("3", "Beta", "Chad"), ("4", None, None)], "brand_id string, canonical_name string, country string")
    filled = rules.countries(brands, make([("alpha", "Peru"), ("beta", "Mali"), ("alpha", None)], "brand string, country string"))
    assert {r.brand_id: r.country for r in filled.collect()} == {"1": "Peru", "2": "Peru", "3": "Chad", "4": None}
