import json
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Config, load_config
from ledgerloom.operators import dimensions, provider
from ledgerloom.plans import jobs, pipeline
from ledgerloom.queries import reference
from ledgerloom.sources import master
from ledgerloom.streaming import filedrop

ROWS = "row_id bigint, file_name string, governorate string, license_type string, brand string, model string, count_value double, report_year int, report_month int"


def tables(spark):
    make = spark.createDataFrame
    return {
        "report_rows": make([(1, "f", "Cairo", "Private", "Toyota", "Corolla", 3.0, 2024, 5), (2, "f", "القاهرة", "Taxi", "TOYOTA", "Corolla", 4.0, 2024, 5), (3, "f", "Cairo", "private", "toyota", "Yaris", 5.0, 2024, 5), (4, "f", "X", None, None, "nan", None, 2024, 5)], ROWS),
        "dim_brand": make([("B1", "Toyota", "Japan")], "brand_id string, canonical_name string, country string"),
        "dim_brand_alias": make([("B1", "toyta")], "brand_id string, alias string"),
        "dim_model": make([("M1", "B1", "Corolla", "Petrol"), ("M2", "B1", "Yaris", None)], "model_id string, brand_id string, canonical_name string, motor_type string"),
        "dim_governorate": make([("G1", "Cairo")], "governorate_id string, canonical_name string"),
        "dim_governorate_alias": make([("G1", "القاهرة")], "governorate_id string, alias string"),
        "dim_licensetype": make([("L1", "Private"), ("L2", "Taxi")], "licensetype_id string, canonical_name string"),
    }


def test_job(spark, tmp_path):
    t = tables(spark)
    states, out = str(tmp_path / "states"), str(tmp_path / "out")
    assert jobs.run_job(spark, "j1", states, out, date(2024, 5, 20), lambda: pipeline.run(t))
    facts = spark.read.parquet(f"{out}/facts").collect()
    assert [(f.Brand_ID, f.Model_ID, f.Vehicle_Count, str(f.Reporting_Date), f.Fact_ID) for f in facts] == [("B1", "M1", 3.0, "2024-05-01", 1)]
    assert [(r.Fact_ID, r.Attribute_Name, r.Attribute_Value) for r in spark.read.parquet(f"{out}/attributes").collect()] == [(1, "Count", "3")]
    assert spark.read.json(f"{out}/missing_metadata").collect()[0].missing == "model_motor_type"
    assert "brand_id" not in spark.read.parquet(f"{out}/j1/output_filtered_private-2024-05-20").columns
    assert not jobs.run_job(spark, "j2", states, out, date(2024, 5, 20), lambda: 1 / 0)
    got = {r.job_id: r for r in jobs.job_list(spark, states).collect()}
    assert (got["j1"].status, got["j1"].n_rows, got["j1"].n_kept) == ("done", 3, 1) and got["j2"].status == "failed" and "ZeroDivision" in got["j2"].message


def test_jobs_share_facts_and_logs(spark, tmp_path):
    t = tables(spark)
    states, out = str(tmp_path / "states"), str(tmp_path / "out")
    answers = spark.createDataFrame(
        [("brand", "", "Zett", "Zeta"), ("model", "BR00002", "Z 1", "Z One")], "entity_type string, scope string, value string, canonical_name string"
    ).withColumns({"matched": F.lit(True), "confidence": F.lit(0.9)})
    attributes = spark.createDataFrame([("country", "BR00002", "Chad"), ("motor_type", "MD00003", "Hybrid")], "entity_type string, value string, canonical_name string").withColumns({"matched": F.lit(True), "confidence": F.lit(0.9)})
    second = dict(t, report_rows=spark.createDataFrame([(9, "g", "Cairo", "Private", "Zett", "Z 1", 6.0, 2024, 5), (10, "g", "Cairo", "Private", "Toyota", "Corolla", 7.0, 2024, 6)], ROWS))
    build = lambda: pipeline.run(second, provider.static(answers.drop("scope"), ["entity_type", "value"]), provider.static(attributes, ["entity_type", "value"]))
    for job, make in (("j1", lambda: pipeline.run(t)), ("j2", build), ("j2", build)):
        assert jobs.run_job(spark, job, states, out, date(2024, 5, 20), make)
    facts = {(f.Fact_ID, f.Brand_ID, f.Model_ID, f.Vehicle_Count, str(f.Reporting_Date)) for f in spark.read.parquet(f"{out}/facts").collect()}
    # a model created by an answer and its attributes, filled from outside, reach the facts; the month of both jobs has the rows of both
    assert facts == {(1, "B1", "M1", 3.0, "2024-05-01"), (2, "BR00002", "MD00003", 6.0, "2024-05-01"), (3, "B1", "M1", 7.0, "2024-06-01")}
    assert spark.read.parquet(f"{out}/attributes").count() == 3
    assert jobs.next_fact_id(spark, f"{out}/facts", "j3") == 4 and jobs.next_fact_id(spark, f"{out}/facts", "j2") == 2
    assert spark.read.json(f"{out}/missing_metadata").count() == 1
    assert {r.country for r in spark.read.parquet(f"{out}/j2/dimensions/dim_brand").where("brand_id = 'BR00002'").collect()} == {"Chad"}


def test_stream(spark, tmp_path):
    t = tables(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    t["report_rows"].coalesce(1).write.parquet(folder)
    for _ in range(2):
        filedrop.resolve_stream(spark, folder, t["report_rows"].schema, t, out, str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(out).where("model_id is not null").count() == 3
    t["report_rows"].limit(1).coalesce(1).write.mode("append").parquet(folder)
    filedrop.resolve_stream(spark, folder, t["report_rows"].schema, t, out, str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5


def test_providers(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "value string").coalesce(1)
    table = spark.createDataFrame([("a", True, "A", 0.9)], "value string, matched boolean, canonical_name string, confidence double")
    assert [r.canonical_name for r in provider.answers(requests, provider.static(table, ["value"])).collect()] == ["A"]
    tried = []

    def call(batch):
        tried.append(1)
        if len(tried) == 1:
            raise provider.ServerError
        if any(r["value"] == "c" for r in batch):
            raise ValueError("bad request")
        return [{"matched": True, "canonical_name": r["value"].upper()} for r in batch]

    got = provider.answers(requests.orderBy("value"), provider.remote(call, batch=1, pause=0.0)).collect()
    assert {(r.value, r.canonical_name, r.confidence) for r in got} == {("a", "A", 1.0), ("b", "B", 1.0)}
    with pytest.raises(ValueError):
        provider.remote(call, batch=0)


def test_guards(spark):
    known = spark.createDataFrame([("B", "M1", "4Runner"), ("B", "M2", "528i"), ("B", "M3", "Alpha"), ("C", "M9", "99x")], "scope string, entity_id string, name string")
    asked = [("alpha", "Alpha", 1), ("mg alpha", "MG Alpha", 2), ("528", "528", 3), ("4", "4", 4), ("mg 4", "MG 4", 5), ("beta", "Beta", 6), ("BETA", "beta", 7), ("99", "99", 8), ("", "", 9)]
    df = spark.createDataFrame([("B", "MG", *a) for a in asked], "scope string, brand_name string, value string, name string, ord bigint")
    got = {r.value: (r.stage, r.target) for r in provider.guarded_creation(df, known).collect()}
    assert got == {
        "alpha": ("exists", "M3"), "mg alpha": ("prefix_variant", "M3"), "528": ("completion", "528i"), "4": ("created", "4"), "mg 4": ("prefix_variant", "4"),
        "beta": ("created", "beta"), "BETA": ("created_earlier", "beta"), "99": ("created", "99"),
    }


def test_master_and_logs(spark, tmp_path):
    document = {"_metadata": {"next_brand_id": 2}, "brand": {"B1": {"id": "B1", "canonical_name": "Toyota", "normalized_name": "toyota", "aliases": ["toyota", "تويوتا"], "mappings": []}}, "model": {}}
    path = tmp_path / "master.json"
    path.write_text(json.dumps(document))
    rows = master.load_master(spark, str(path)).collect()
    assert [(r.entity_type, r.entity_id, r.aliases) for r in rows] == [("brand", "B1", ["toyota", "تويوتا"])]
    assert master.load_master(spark, str(tmp_path / "none.json")).count() == 0
    log = tmp_path / "log.json"
    log.write_text(json.dumps([{"brand": "x", "model": "1"}]))
    assert [tuple(r) for r in master.read_log(spark, str(log), "brand string, model string").collect()] == [("x", "1")]
    log.write_text("not json")
    assert master.read_log(spark, str(log), "brand string, model string").count() == 0
    assert master.read_log(spark, str(tmp_path / "missing.json"), "brand string").count() == 0


def test_run_sends_values_through_every_stage(spark):
    t = tables(spark)
    make = spark.createDataFrame
    t["report_rows"] = make(
        [
            (1, "f", "Cairo", "Private", "Toyota", "Corolla", 3.0, 2024, 5),
            (2, "f", "Cairoo", "Private", "Toyotaa", "Corola", 4.0, 2024, 5),  # typo, likeness, likeness within the brand
            (3, "f", "Cairo", "Privat", "Tyoota", "Toyota Corolla", 5.0, 2024, 5),
            (4, "f", "Cairo", "Private", "Brand Z", "Z 1", 6.0, 2024, 5),
            (5, "f", "Cairo", "Private", "Brand Z", "Z1", 7.0, 2024, 5),
            (6, "f", "Cairo", "Private", "???", "Corolla", 8.0, 2024, 5),
        ],
        ROWS,
    )
    got = {r.row_id: r for r in pipeline.run(t).resolved.collect()}
    assert [got[i].brand_id for i in range(1, 7)] == ["B1", "B1", "B1", None, None, None]
    assert (got[2].governorate_id, got[2].model_id, got[3].license_type_id, got[3].model_id) == ("G1", "M1", "L1", None)
    assert pipeline.run(t).facts()[0].count() == 2

    answers = make(
        [("brand", "", "Brand Z", True, "Zeta", 0.9), ("brand", "", "???", True, "Toyota", 0.2), ("model", "B1", "Toyota Corolla", True, "Toyota Corolla", 1.0), ("model", "BR00002", "Z 1", True, "Z One", 1.0), ("model", "BR00002", "Z1", True, "z one", 1.0)],
        "entity_type string, scope string, value string, matched boolean, canonical_name string, confidence double",
    )
    outcome = pipeline.run(t, ask=provider.static(answers, ["entity_type", "scope", "value"]))
    got = {r.row_id: r for r in outcome.resolved.collect()}
    assert [got[i].brand_id for i in range(1, 7)] == ["B1", "B1", "B1", "BR00002", "BR00002", None]
    assert [got[i].model_id for i in range(1, 7)] == ["M1", "M1", "M1", "MD00003", "MD00003", None]
    assert {(r.brand_id, r.alias) for r in outcome.dimensions["dim_brand_alias"].collect()} == {("B1", "toyta"), ("B1", "toyotaa"), ("B1", "tyoota"), ("BR00002", "brand z")}
    assert {(r.model_id, r.brand_id, r.canonical_name) for r in outcome.dimensions["dim_model"].collect()} == {("M1", "B1", "Corolla"), ("M2", "B1", "Yaris"), ("MD00003", "BR00002", "z one")}
    assert {(r.entity_type, r.value, r.stage) for r in outcome.found.collect()} >= {("governorate_city", "Cairoo", "typo"), ("model", "Corola", "fuzzy"), ("model", "Toyota Corolla", "prefix_variant")}
    logged = {(r.entity_type, r.value, r.reason.split(" ")[0]) for r in outcome.low_confidence.collect()}
    assert {("governorate_city", "Cairoo", "short"), ("model", "Corola", "likeness"), ("model", "Toyota Corolla", "a"), ("brand", "???", "not")} <= logged
    assert {(r.model_id, r.alias) for r in outcome.dimensions["dim_model_alias"].collect()} >= {("M1", "corola"), ("M1", "toyota corolla"), ("MD00003", "z 1")}


def test_totals_headers_and_brands_are_not_asked_about(spark):
    t = tables(spark)
    t["report_rows"] = spark.createDataFrame([(1, "f", "Grand Total", "x", "Brand", "TOYTA", 1.0, 2024, 5), (2, "f", "Cairo", "Private", "Toyota", "TOYTA", 1.0, 2024, 5), (3, "f", "Cairo", "Private", "Toyota", "77", 1.0, 2024, 5)], ROWS)
    asked = []

    def ask(requests):
        asked.extend((r.phase, r.entity_type, r.value) for r in requests.collect())
        return requests.withColumns({"matched": F.lit(True), "canonical_name": F.col("value"), "confidence": F.lit(1.0)})

    outcome = pipeline.run(t, ask)
    assert {a for a in asked if a[1] != "license_type"} == {("match", "model", "77"), ("identify", "model", "77")}
    assert [r.reason for r in outcome.low_confidence.where("value = '77'").collect()] == ["a new model of a bare number"]


def test_master_is_saved_and_read_again(spark, tmp_path):
    t = pipeline.with_alias_tables(tables(spark))
    path = str(tmp_path / "master")
    entities = master.master_entities(t, (*pipeline.KINDS, pipeline.MODEL))
    for _ in range(2):
        master.save_master(entities, path)
    key = lambda df: sorted(map(str, df.select(*entities.columns).collect()))
    assert key(master.load_master(spark, path, lines=True)) == key(entities) and entities.count() == 6
    assert '"next_brand_id":2' in "".join(r.value for r in spark.read.text(path).collect())
    updated = dimensions.update_fields(t["dim_brand"], spark.createDataFrame([("B1", "Chad"), ("B9", "X")], "brand_id string, country string"), "brand_id")
    assert [tuple(r) for r in updated.collect()] == [("B1", "Toyota", "Chad")]


def test_config():
    assert load_config({}) == Config() and load_config({"LEDGERLOOM_BATCH_SIZE": "50", "LEDGERLOOM_FILTER_PRIVATE": "no", "LEDGERLOOM_MIN_CONFIDENCE": " "}) == Config(batch_size=50, filter_private=False)
    for bad in ({"LEDGERLOOM_BATCH_SIZE": "0"}, {"LEDGERLOOM_FILTER_PRIVATE": "maybe"}, {"LEDGERLOOM_FUZZY_THRESHOLD": "101"}):
        with pytest.raises(ValueError):
            load_config(bad)


def test_queries_that_show_no_aliases_learn_none(spark, monkeypatch):
    def learned(*_):
        raise AssertionError("aliases were learned and numbered for nothing")

    monkeypatch.setattr(pipeline, "_learn", learned)
    monkeypatch.setattr(reference, "run_tables", lambda spark, _: tables(spark))
    for name in ("cascade_all_types", "low_confidence_log", "fact_build", "fact_attributes", "eav_unpivot"):
        assert reference.QUERIES[name](spark, "").columns
    with pytest.raises(AssertionError, match="for nothing"):
        reference.QUERIES["alias_learning"](spark, "")


SHOWN = [
    ("filter_private_class", {"license_type"}, [(1, "L1"), (3, "L1")]),
    ("model_requests_distinct", {"brand"}, [("B1", "corolla", "Corolla", 1), ("B1", "yaris", "Yaris", 3)]),
    ("filter_metadata_complete", {"brand", "B1"}, [(1, "Japan", "Petrol"), (2, "Japan", "Petrol")]),
    ("missing_metadata_unpivot", {"brand", "B1"}, [("Toyota", "Yaris", "model_motor_type")]),
]


@pytest.mark.parametrize(("name", "scopes", "rows"), SHOWN)
def test_queries_seek_only_the_fields_they_show(spark, monkeypatch, name, scopes, rows):
    sought, cascade = set(), pipeline.resolution.scored_cascade

    def seen(values, *rest, **named):
        sought.update(r.scope for r in values.select("scope").distinct().collect())
        return cascade(values, *rest, **named)

    monkeypatch.setattr(reference, "run_tables", lambda spark, _: tables(spark))
    monkeypatch.setattr(pipeline.resolution, "scored_cascade", seen)
    assert sorted(map(tuple, reference.QUERIES[name](spark, "").collect())) == rows and sought == scopes


UNATTACHED = [
    ("row_count_metrics", [(4, 3)]),
    ("filter_essential_ids", [(1,), (2,), (3,)]),
    ("resolution_stats", [("brand", 3, 1), ("governorate", 3, 1), ("license_type", 3, 1), ("model", 3, 1)]),
]


@pytest.mark.parametrize(("name", "rows"), UNATTACHED)
def test_queries_of_ids_attach_nothing_else(spark, monkeypatch, name, rows):
    def attached(*_):
        raise AssertionError("columns of the lists were joined for nothing")

    monkeypatch.setattr(reference, "run_tables", lambda spark, _: tables(spark))
    monkeypatch.setattr(pipeline, "_named", attached)
    assert sorted(map(tuple, reference.QUERIES[name](spark, "").collect())) == rows


def test_filtered_projection_shuffles_rows_for_models_alone(spark, monkeypatch):
    """Few answers are sent to the rows, models are cleaned once grouped; the rows are the same where the answers are too many to send."""
    written, cut = [], pipeline.cut
    monkeypatch.setattr(reference, "run_tables", lambda spark, _: tables(spark))
    monkeypatch.setattr(pipeline, "cut", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = []
    for most in (pipeline.SENT_ROWS, 0):
        monkeypatch.setattr(pipeline, "SENT_ROWS", most)
        df = reference.QUERIES["filtered_projection"](spark, "")
        got.append(sorted(map(str, df.collect())))
        if most:
            assert df._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)") == 3
    assert got[0] == got[1] and len(got[0]) == 4
    pairs = next(p for p in written if "_cleaned" in p and "model" in p)
    below = pairs[pairs.index("Aggregate") :]
    assert "regexp_replace" in pairs and "regexp_replace" not in below[: below.index("LogicalRDD")]


def test_filtered_projection_groups_models_by_brand_id_and_joins_by_number(spark, monkeypatch):
    """A brand spelled in two ways gives a model one row, whether brands are sent to the rows or not; no join of rows sorts by names of models."""
    written, cut = [], pipeline.cut
    monkeypatch.setattr(reference, "run_tables", lambda spark, _: tables(spark))
    monkeypatch.setattr(pipeline, "cut", lambda df: written.append(cut(df)) or written[-1])
    for most in (pipeline.SENT_ROWS, 0):
        monkeypatch.setattr(pipeline, "SENT_ROWS", most)
        df = reference.QUERIES["filtered_projection"](spark, "")
        pairs = next(w for w in reversed(written) if "model" in w.columns)
        assert sorted((r.scope, r.model) for r in pairs.collect()) == [("B1", "Corolla"), ("B1", "Yaris")]
        assert not re.search(r"model#\d+ = ", df._jdf.queryExecution().optimizedPlan().toString())
        assert sorted((r.row_id, r.brand_country, r.model_canonical_name) for r in df.collect()) == [(1, "Japan", "Corolla"), (2, "Japan", "Corolla"), (3, "Japan", "Yaris"), (4, None, None)]
