"""Jobs: one run over one data directory, its outputs under its own folder, its facts and logs in shared tables, its states appended to a table."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.plans.pipeline import Outcome
from ledgerloom.sources import master

STATES = "job_id string, status string, at timestamp, n_rows bigint, n_kept bigint, message string"


def _note(spark: SparkSession, states: str, job_id: str, status: str, n_rows: int | None = None, n_kept: int | None = None, message: str | None = None) -> None:
    spark.createDataFrame([(job_id, status, datetime.now(timezone.utc), n_rows, n_kept, message)], STATES).write.mode("append").parquet(states)


def next_fact_id(spark: SparkSession, facts: str, job_id: str) -> int:
    """One more than the highest id of the facts other jobs have written; the footers of the files hold it."""
    try:
        stored = spark.read.parquet(facts)
    except AnalysisException:
        return 1
    return (stored.where(F.col("job_id") != job_id).agg(F.max("Fact_ID")).first()[0] or 0) + 1


def append_facts(spark: SparkSession, outcome: Outcome, job_id: str, out: str) -> None:
    """Adds a job's facts and attributes to the shared tables, partitioned by month and job.

    Ids go on from the highest one there is. A job that is run again replaces its own rows and no others, so several jobs may
    bring facts of one month. Jobs that write at the same time must not share a fact table: both would take the same ids.
    """
    facts, attributes = outcome.facts(next_fact_id(spark, f"{out}/facts", job_id))
    for name, rows, parts in (("facts", facts, ("job_id", "Reporting_Date")), ("attributes", attributes, ("job_id",))):
        old = f"{out}/{name}/job_id={job_id}"
        master.remove(spark, old)  # months the job no longer has go as well
        rows.withColumn("job_id", F.lit(job_id)).write.mode("append").partitionBy(*parts).parquet(f"{out}/{name}")


def run_job(spark: SparkSession, job_id: str, states: str, out: str, day: date, build: Callable[[], Outcome]) -> bool:
    """Runs a job: processing, then done with its row counts, or failed with the error; true if done.

    Dimensions are written before facts. The review and missing-metadata logs hold each distinct record of all jobs once; the
    low-confidence log is appended to, by job.
    """
    _note(spark, states, job_id, "processing")
    try:
        outcome = build()
        folder = f"{out}/{job_id}"
        stamp = day.strftime("%Y-%m-%d")
        for name, dimension in outcome.dimensions.items():
            dimension.write.mode("overwrite").parquet(f"{folder}/dimensions/{name}")
        outcome.found.write.mode("overwrite").parquet(f"{folder}/found")
        outcome.resolved.write.mode("overwrite").parquet(f"{folder}/output-{stamp}")
        reports.filtered_projection(outcome.kept).write.mode("overwrite").parquet(f"{folder}/output_filtered_private-{stamp}")
        append_facts(spark, outcome, job_id, out)
        for name, log in (("review", outcome.review), ("missing_metadata", outcome.missing_metadata)):
            old = master.read_log(spark, f"{out}/{name}", log.schema, lines=True)
            master.replace_log(reports.log_union(old, log), f"{out}/{name}")
        outcome.low_confidence.write.mode("overwrite").json(f"{out}/low_confidence/job_id={job_id}")
        counts = [spark.read.parquet(f"{folder}/{name}-{stamp}").count() for name in ("output", "output_filtered_private")]
    except Exception:
        _note(spark, states, job_id, "failed", message=traceback.format_exc()[-4000:])
        return False
    _note(spark, states, job_id, "done", *counts)
    return True


def job_list(spark: SparkSession, states: str) -> DataFrame:
    """The latest state of each job, newest first; of states noted at one time the one with more rows counts."""
    noted = spark.read.parquet(states)
    latest = noted.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in noted.columns if c != "job_id"]), F.struct("at", F.coalesce("n_rows", F.lit(-1)))).alias("s"))
    return latest.select("job_id", "s.*").orderBy(F.col("at").desc())
