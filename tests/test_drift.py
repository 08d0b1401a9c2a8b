import json
from datetime import date

from ledgerloom.operators import drift

SCHEMA = "file_id bigint, feed_name string, file_month date, line_no int, record_text string, ord string, header string"


def lines(spark, files, feed="f"):
    out = []
    for file_id, (month, records) in files.items():
        for i, r in enumerate(records):
            out.append((file_id, feed, date(2020, month, 1) if month else None, i, r if isinstance(r, str) or r is None else json.dumps(r, ensure_ascii=False), "x", "y"))
    return spark.createDataFrame(out, SCHEMA)


def changes(df):
    return sorted(tuple(r) for r in drift.changes(drift.footers(df)).collect())


def test_each_kind_of_change(spark):
    df = lines(
        spark,
        {
            1: (1, [{"Count": 1, "License Type": "Taxi", "Fuel": "G"}]),
            2: (2, [{"Units": 2, "License Type": "Taxi", "Fuel": "G", "Seats": 4}]),
            3: (3, [{"Units": "3", "License Type": {"code": 1, "name": "Private"}, "Seats": 4.0}]),
            4: (4, [{"العدد": 4.5, "License Type": {"code": 1, "name": "Private"}, "Seats": 4.0}]),
        },
    )
    assert changes(df) == [
        (2, "added", "Seats"),
        (2, "renamed", "Units"),
        (3, "removed", "Fuel"),
        (3, "type_changed", "License Type"),
        (3, "type_changed", "Seats"),
        (3, "type_changed", "Units"),
        (4, "renamed", "العدد"),
        (4, "type_changed", "العدد"),
    ]


def test_bad_lines_order_nulls_and_majority(spark):
    df = lines(
        spark,
        {
            9: (1, [{"Count": 1, "A": None}, '{"Count": ', None, "[1]", "", '"x"']),
            3: (2, [{"A": 1, "Count": None}, {"Count": "n/a"}, {"Count": 5}, {"Count": 6}]),
        },
    )
    assert changes(df) == []


def test_a_field_that_returns_is_added(spark):
    df = lines(spark, {1: (1, [{"Count": 1}]), 2: (2, [{"B": 1}]), 3: (3, [{"Qty": 1, "B": 1}])})
    assert changes(df) == [(2, "added", "B"), (2, "removed", "Count"), (3, "added", "Qty")]
    spans = {(r.header, r.first_ord, r.last_ord) for r in drift.lifespans(drift.footers(df)).collect()}
    assert spans == {("Count", 1, 1), ("B", 2, 3), ("Qty", 3, 3)}


def test_feeds_apart_null_feed_null_month_and_empty(spark):
    df = lines(spark, {1: (None, [{"A": 1}]), 2: (1, [{"B": 1}])}, None).union(lines(spark, {5: (1, [{"C": 1}])}, "g"))
    assert changes(df) == [(2, "added", "B"), (2, "removed", "A")]
    assert changes(spark.createDataFrame([], SCHEMA)) == []


def test_consistent_table(spark):
    df = lines(spark, {1: (1, [{"Count": "7", "License Type": 1, "Brand": " X "}, {"Qty": 8.0, "LIC_TYPE": {"code": 2, "name": "Taxi"}, "Brand": "?"}, {"Units": "n/a"}, "{"])})
    doubled = df.unionByName(df)
    got = sorted((r.line_no, r.count_value, r.license_type, r.brand) for r in drift.consistent_table(doubled, codes={1: "Private"}).collect())
    assert got == [(0, 7.0, "Private", "X"), (1, 8.0, "Taxi", None), (2, None, None, None)]


def test_every_field_comes_out_under_any_spelling(spark):
    df = lines(spark, {1: (1, [{"QTY": 3, "brand": "X", "LICENCE-TYPE": {"code": 2, "name": "Taxi"}, "Seats": 4, "Imported": True, "Remarks": "?"}, {"Qty": 1, "QTY": 2, "licence_type": 1, "fuel": None, "Fuel": "Gas", "--": "a"}, {"Count": 5}])})
    got = {r.line_no: r for r in drift.consistent_table(df, codes={1: "Private"}).collect()}
    assert (got[0].count_value, got[0].brand, got[0].license_type) == (3.0, "X", "Taxi")
    assert (got[1].count_value, got[1].license_type) == (1.0, "Private")
    assert [got[i].others for i in range(3)] == [{"seats": "4", "imported": "true", "remarks": None}, {"fuel": "Gas", "--": "a"}, {}]


def test_all_codes_are_read(spark, tmp_path):
    from ledgerloom.queries import general

    spark.range(1200).selectExpr("concat('LT', id) as licensetype_id", "concat('n', id) as canonical_name").write.parquet(str(tmp_path / "dim_licensetype.parquet"))
    assert len(general._codes(spark, str(tmp_path))) == 1200
