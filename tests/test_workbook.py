import pytest

from ledgerloom.sources import database, workbook


def test_round_trip_with_merges(spark, tmp_path):
    rows = [["title"], [None], ["h1", "h2", "h1"], ["block", 1, "x<&>"], [None, 2.5, None], [None, None, "آخر"]]
    content = workbook.write_workbook([("S", rows, ["A4:A6"]), ("T", [["other"]], [])])
    cells = workbook.read_workbook(content)
    assert [r[0] for r in cells[3:]] == ["block"] * 3 and cells[4][1] == "2.5" and cells[5][2] == "آخر" and cells[3][2] == "x<&>"
    assert workbook.read_workbook(content, sheet=1) == [["other"]]
    assert workbook.read_workbook(content, fill_merged=False)[4][0] is None
    (tmp_path / "a.xlsx").write_bytes(content)
    (tmp_path / "b.txt").write_text("no")
    got = workbook.scan(workbook.workbook_files(spark, str(tmp_path)), ["h1", "h2", "none"], skip_rows=2).orderBy("row_no").collect()
    assert [(r.h1, r.h2, r.none) for r in got] == [("block", "1", None), ("block", "2.5", None), ("block", None, None)]


def test_names():
    assert workbook.filtered_name("X.xlsx") == "X_filtered_private.xlsx"


def test_books_are_written_and_read(spark, tmp_path):
    rows = [(i, f"n & {i}" if i % 3 else None, float("nan") if i == 4 else i / 2, True) for i in range(25)]
    df = spark.createDataFrame(rows, "id bigint, name string, share double, kept boolean").repartition(2)
    folder = str(tmp_path / "books")
    for _ in range(2):
        workbook.write_books(df, folder, rows_per_book=10)
    assert len([f for f in (tmp_path / "books").iterdir() if f.suffix == ".xlsx" and not f.name.startswith(".")]) >= 3
    got = workbook.scan(workbook.workbook_files(spark, folder), ["id", "name", "share"])
    assert sorted((int(r.id), r["name"], r.share) for r in got.collect()) == [(i, n, None if s != s else f"{s}") for i, n, s, _ in rows]
    workbook.write_books(df.limit(0), folder)
    assert workbook.scan(workbook.workbook_files(spark, folder), ["id"]).count() == 0
    with pytest.raises(ValueError):
        workbook.write_books(df, folder, rows_per_book=2_000_000)


def test_database_sink(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    facts = spark.createDataFrame([(1, "B1", 3.0), (2, None, 4.5)], "id bigint, brand string, amount double")
    database.write_table(facts, url, "facts", "overwrite", options=options)
    database.write_table(facts.withColumn("id", facts.id + 10), url, "facts", options=options)
    key = lambda df: sorted(tuple(r) for r in df.select("id", "brand", "amount").fillna("").collect())
    assert key(database.read_table(spark, url, "facts", options=options)) == [(1, "B1", 3.0), (2, "", 4.5), (11, "B1", 3.0), (12, "", 4.5)]
    assert key(database.read_table(spark, url, "facts", "id", (1, 12), 3, options)) == [(1, "B1", 3.0), (2, "", 4.5), (11, "B1", 3.0), (12, "", 4.5)]
    with pytest.raises(ValueError):
        database.write_table(facts, url, "facts", connections=0)
