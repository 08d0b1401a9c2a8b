"""The stage behind the cascade: answers from outside, and the guards before an entity is created.

A provider turns request rows into answer rows. Its answers are written before they are used, so that a lost executor or a
second reader never asks twice. Requests are made once for each distinct value, in batches, inside the partitions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_text, simple_normalize
from ledgerloom.operators.resolution import numeric_completion, strip_prefix
from ledgerloom.session import cut


class ServerError(Exception):
    """A failure on the other side; the only kind that is tried again."""


Call = Callable[[list[dict]], Sequence[dict | None]]
ANSWER = "matched boolean, canonical_name string, confidence double"


def static(answers: DataFrame, keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A provider that looks answers up in a table; requests without an answer are not in the result."""
    return lambda requests: requests.join(answers, list(keys))


def remote(call: Call, batch: int = 200, tries: int = 3, pause: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A provider that sends batches of requests; server errors are tried again after 1, 2, ... pauses, other errors give no answers.

    ``call`` returns one answer (or None) per request, in order.
    """
    if batch <= 0:
        raise ValueError("the batch size must be positive")

    def ask(requests: list[dict]) -> Sequence[dict | None]:
        for attempt in range(tries):
            try:
                answers = call(requests)
                return list(answers)[: len(requests)] + [None] * max(0, len(requests) - len(answers))
            except ServerError:
                if attempt + 1 < tries:
                    time.sleep(pause * (attempt + 1))
            except Exception:
                break
        return [None] * len(requests)

    def provider(requests: DataFrame) -> DataFrame:
        names = requests.columns

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), batch):
                    part = pdf.iloc[lo : lo + batch]
                    answers = ask(part.to_dict("records"))
                    rows = [(*key, a.get("matched"), a.get("canonical_name"), a.get("confidence", 1.0)) for key, a in zip(part.itertuples(index=False, name=None), answers, strict=True) if a is not None]
                    yield pd.DataFrame(rows, columns=[*names, "matched", "canonical_name", "confidence"])

        schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", " + ANSWER
        return requests.mapInPandas(run, schema)

    return provider


def answers(requests: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Written answers of the distinct requests."""
    return cut(provider(requests.dropDuplicates()))


def guarded_creation(identified: DataFrame, known: DataFrame) -> DataFrame:
    """What becomes of identified models: ``scope, value, stage, target``.

    ``identified(scope, brand_name, value, name, ord)`` are named answers in the order ``ord`` (unique in its scope), ``known(scope, entity_id, name)`` the
    models of each brand. Stages: ``exists`` (same normalized name in the brand; target is the first such id), ``created_earlier`` (an earlier
    answer of this run has the name), ``prefix_variant`` (equal to a known model or an earlier new one, the brand's name aside),
    ``completion`` (an all-digit name completed by the one name that adds letters), ``created``. New models are named by their
    normalized name. Every guard is an equality join.
    """
    asked = identified.withColumn("norm", normalize_text(F.col("name"))).where("norm <> ''")
    by_name = known.select("scope", "entity_id", normalize_text(F.col("name")).alias("norm")).groupBy("scope", "norm").agg(F.min("entity_id").alias("entity_id"))
    met = cut(asked.join(by_name, ["scope", "norm"], "left"))
    exists = met.where("entity_id is not null").select("scope", "value", F.lit("exists").alias("stage"), F.col("entity_id").alias("target"))
    new = met.where("entity_id is null").drop("entity_id")
    first = Window.partitionBy("scope", "norm").orderBy("ord")
    ranked = cut(new.withColumn("_r", F.row_number().over(first)))
    earlier = ranked.where("_r > 1").select("scope", "value", F.lit("created_earlier").alias("stage"), F.col("norm").alias("target"))
    makers = ranked.where("_r = 1").withColumn("full", simple_normalize(F.col("name"))).withColumn("bare", strip_prefix(F.col("name"), F.col("brand_name")))

    # candidates: models made in this run before known ones; equal in full, or one bare form equal to the other's full one
    brands = makers.select("scope", "brand_name").distinct()
    existing = known.join(brands, "scope").select("scope", "entity_id", simple_normalize(F.col("name")).alias("full"), strip_prefix(F.col("name"), F.col("brand_name")).alias("bare"))
    candidates = makers.select("scope", F.col("norm").alias("target"), "ord", F.lit(0).alias("p"), "full", "bare").unionByName(
        existing.select("scope", F.col("entity_id").alias("target"), F.lit(-1).cast("bigint").alias("ord"), F.lit(1).alias("p"), "full", "bare")
    )
    full_side = candidates.select("scope", F.col("target").alias("_t"), F.col("ord").alias("_o"), "p", F.explode(F.array(F.struct(F.lit("f").alias("s"), F.col("full").alias("k")), F.struct(F.lit("b").alias("s"), F.col("bare").alias("k")))).alias("c"))
    maker_side = makers.select("scope", "norm", "ord", F.explode(F.array(F.struct(F.lit("f").alias("s"), F.col("full").alias("k")), F.struct(F.lit("b").alias("s"), F.col("bare").alias("k")))).alias("m"))
    joined = maker_side.join(full_side.withColumnRenamed("scope", "_s"), (F.col("scope") == F.col("_s")) & (F.col("m.k") == F.col("c.k")) & (F.col("m.k") != ""))
    variant = joined.where("not (m.s = 'b' and c.s = 'b') and (_o < ord)").groupBy("scope", "norm").agg(F.min(F.struct("p", "_o", "_t"))["_t"].alias("variant"))
    names = makers.select("scope", F.col("norm").alias("name")).unionByName(known.select("scope", "name"))
    completion = numeric_completion(makers.select("scope", F.col("norm").alias("value")), names).select("scope", F.col("value").alias("norm"), normalize_text(F.col("completion")).alias("completion"))
    judged = makers.join(variant, ["scope", "norm"], "left").join(completion, ["scope", "norm"], "left")
    stage = F.when(F.col("variant").isNotNull(), F.lit("prefix_variant")).when(F.col("completion").isNotNull(), F.lit("completion")).otherwise(F.lit("created"))
    made = judged.select("scope", "value", stage.alias("stage"), F.coalesce("variant", "completion", "norm").alias("target"))
    return exists.unionByName(earlier).unionByName(made)
