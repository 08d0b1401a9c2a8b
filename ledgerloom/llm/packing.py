"""Texts packed into containers of a fixed number of tokens.

Harmonic packing: an item whose length lies in (capacity / (k + 1), capacity / k] belongs to class k, and a
container opened for it takes k such items. The classes are kept at full resolution (one per length), so
that the room a class leaves is known exactly and is given to shorter classes, again in fixed counts.
The whole plan follows from the histogram of lengths, which has at most ``capacity`` rows however
large the corpus is; every item then finds its container by arithmetic from its number within its
length, on any worker, without seeing another item.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NUMBERED = 50_000  # items numbered in one task


@lru_cache(maxsize=2)
def _encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sizes(batches: Iterable[pd.DataFrame], vocabulary: Broadcast, pattern: str, capacity: int) -> Iterator[pd.DataFrame]:
    encode = _encoding(vocabulary.value, pattern).encode_ordinary
    for batch in batches:
        ids, numbers, sizes = [], [], []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            n = len(encode(text)) if text else 0
            number = 0
            while True:
                ids.append(doc_id)
                numbers.append(number)
                sizes.append(min(n, capacity))
                n -= capacity
                number += 1
                if n <= 0:
                    break
        yield pd.DataFrame({"doc_id": ids, "piece_no": numbers, "n_tokens": sizes})


def pieces(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, n_tokens``: one piece for each text; a text over the capacity is cut into full pieces and a rest.

    Whole texts are counted, of any length. A null text is no item; an empty text is one of no tokens. The driver reads the vocabulary
    file (a public one, under a megabyte) and sends it along, so that the workers need no such file.
    """
    corpus = documents.select("doc_id", "text").where("text is not null")
    vocabulary = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    return corpus.mapInPandas(lambda batches: _sizes(batches, vocabulary, pattern, capacity), "doc_id bigint, piece_no int, n_tokens int")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the items of each length go: (length, first number, end number, items per container, first container).

    Lengths come from the longest. Items go first to open containers with the least room that holds them,
    each taking as many as fit; the rest open containers of floor(capacity / length) items, their harmonic count.
    The item with number r of an entry goes to container ``first + (r - first number) // items per container``.
    Containers that are alike are kept as one group, so that the plan's size depends on the lengths only.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first container, containers)
    keys: list[int] = []
    entries: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def keep(room: int, first: int, count: int) -> None:
        if count and room > 0:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(keys, room)
            rooms[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        size = max(1, length)
        if size > capacity:
            raise ValueError("an item is longer than a container")
        while left:
            k = bisect.bisect_left(keys, size)
            if k == len(keys):
                break
            room = keys[k]
            groups = rooms.pop(room)
            keys.pop(k)
            each = room // size
            for first, count in groups:
                full = min(count, left // each)
                if full:
                    entries.append((length, at, at + full * each, each, first))
                    keep(room - each * size, first, full)
                    at, left = at + full * each, left - full * each
                if full < count and 0 < left < each:
                    entries.append((length, at, at + left, left, first + full))
                    keep(room - left * size, first + full, 1)
                    at, left, full = at + left, 0, full + 1
                keep(room, first + full, count - full)
            if not left:
                break
        if left:
            each = capacity // size
            full = left // each
            if full:
                entries.append((length, at, at + full * each, each, opened))
                keep(capacity - each * size, opened, full)
                at, left, opened = at + full * each, left - full * each, opened + full
            if left:
                entries.append((length, at, at + left, left, opened))
                keep(capacity - left * size, opened, 1)
                opened += 1
    return entries


def _numbered(items: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``r``, the number of an item within its length, in tasks of about ``NUMBERED`` items however common a length is."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(NUMBERED)))
    salted = items.join(F.broadcast(lengths), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), salts.cast("bigint")))
    counts = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("n_tokens").alias("_t"), F.col("salt").alias("_s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1)
    return ranked.join(offsets, (F.col("n_tokens") == F.col("_t")) & (F.col("salt") == F.col("_s"))).select("doc_id", "piece_no", "n_tokens", (F.col("offset") + F.col("k")).alias("r"))


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, n_tokens, container_id`` for every text.

    No container holds more than ``capacity`` tokens and no text of up to that many is split. Texts
    without tokens are assigned too (they count as one token of room). Repeated rows are items of their own.
    The result is the same on every run. An empty table gives no rows.
    """
    items = cut(pieces(documents, tokenizer, pattern, capacity))
    # at most capacity + 1 rows
    lengths = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.n_tokens: r.n for r in lengths.collect()}
    spark = documents.sparkSession
    known = spark.createDataFrame(sorted(histogram.items()) or [(0, 0)], "n_tokens int, n bigint")
    entries = plan(histogram, capacity)
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, low, high, each, first in entries:
        by_length.setdefault(length, []).append((low, high, each, first))
    schema = "_len int, parts array<struct<low:bigint,high:bigint,each:bigint,first:bigint>>"
    parts = spark.createDataFrame([(k, v) for k, v in by_length.items()], schema)
    placed = _numbered(items, known).join(F.broadcast(parts), F.col("n_tokens") == F.col("_len"))
    part = F.get(F.filter("parts", lambda e: (e["low"] <= F.col("r")) & (F.col("r") < e["high"])), F.lit(0))
    container = part["first"] + F.floor((F.col("r") - part["low"]) / part["each"])
    return placed.select("doc_id", "piece_no", "n_tokens", container.cast("bigint").alias("container_id"))


def audit(documents: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that says whether a packing keeps its promises: ``n_texts, n_missing, n_strange, n_repeated, n_gaps, n_split, n_over``.

    Texts in the packing; texts of the corpus that are not in it, and ids in it that are no text's; pieces that occur more than once; texts whose pieces
    are not numbered from 0 without gaps; texts cut although they, or a piece before the last, are shorter than a container; containers over the capacity.
    """
    texts = documents.where("text is not null").select("doc_id").distinct().withColumn("in_corpus", F.lit(True))
    each = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("m"), F.min("piece_no").alias("low"), F.max("piece_no").alias("high"), F.sum("n_tokens").alias("tokens")
    )
    whole = (F.col("n") > 1) & (F.col("tokens") <= (F.col("n") - 1) * capacity)
    by_text = texts.join(each.withColumn("in_packing", F.lit(True)), "doc_id", "full_outer").agg(
        F.count_if("in_packing").alias("n_texts"), F.count_if(F.col("in_packing").isNull()).alias("n_missing"), F.count_if(F.col("in_corpus").isNull()).alias("n_strange"),
        F.count_if(F.col("n") > F.col("m")).alias("n_repeated"), F.count_if((F.col("low") != 0) | (F.col("high") + 1 != F.col("m"))).alias("n_gaps"), F.count_if(whole).alias("n_split"),
    )
    over = packed.groupBy("container_id").agg(F.sum(F.greatest("n_tokens", F.lit(0))).alias("load")).agg(F.count_if(F.col("load") > capacity).alias("n_over"))
    return by_text.crossJoin(F.broadcast(over))  # one row each


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``n_containers, n_tokens, most_tokens, unused_share`` of a packing."""
    loads = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("load").alias("n_tokens"),
        F.max("load").alias("most_tokens"),
        (F.lit(1.0) - F.sum("load") / (F.count(F.lit(1)) * F.lit(capacity))).alias("unused_share"),
    )
