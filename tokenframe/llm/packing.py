"""Best-fit packing of documents into sequences of a fixed token length.

Method: best-fit decreasing with a segment tree over remaining capacities. A packing depends on piece lengths
alone, and there are no more lengths than tokens in a sequence, so the driver packs the histogram of lengths
(at most `length` rows, whatever the corpus): the tree finds the tightest capacity with an open bin in
logarithmic time, and alike bins are filled together in one step. The plan is a table of rank intervals per
length; every piece finds its place from its rank among the pieces of its length. Ranks are counted in hash
buckets, so a length that a third of all pieces have is ranked in many tasks.

Null and empty texts are one closing token. Documents longer than a sequence are cut from the end into whole
sequences, so only their first piece may be shorter. Null doc_ids and repeated rows are packed like any other
row; very long texts are cut whole, and pieces of equal length, which tie, may take each other's place. Columns other than
doc_id and text, whatever their names, are ignored. No rows give no rows.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, small_batches, table, written

LENGTH, END_ID = 2048, 0
#: Pieces of one hash bucket, about.
BUCKET_ROWS = 100_000
#: Intervals of a plan that are broadcast at most, 48 bytes each; a plan has a few per length.
BROADCAST_ROWS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def token_ids(vocabulary: str):
    """A function from a text to its ids (uint32), as the tokenizers library gives them.

    The vocabulary's rank file, where it lies beside the JSON file, serves texts of characters up to U+024F,
    whose classes are the same in both libraries; other texts go to the tokenizers library itself.
    """
    library: list = []

    def slow(text: str) -> np.ndarray:
        if not library:  # loaded by the first text that needs it
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(vocabulary))
            library[0].no_truncation()
            library[0].no_padding()
        return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
    wide = re.compile("[^\\x00-\\u024f]").search
    return lambda text: slow(text) if wide(text) else fast.encode_to_numpy(text, allowed_special="all")


def piece_bounds(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def cut(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(ship(docs.sparkSession))
    vocabulary = vocabulary or default_vocabulary()

    def pieces(batches):
        encode = token_ids(vocabulary)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((encode(text), end)) if text else end
                raw = ids.astype("<u4", copy=False).tobytes()
                rows += [(doc_id, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(piece_bounds(len(ids), length))]
            ids_, ks, starts, sizes, crcs = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(ks, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


class CapacityTree:
    """A segment tree over remaining capacities; a leaf counts the groups of open bins that have it."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.width
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` with an open bin."""
        at = least + self.width
        if self.counts[at]:
            return least
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at + (not self.counts[2 * at])
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, first rank, end rank, first sequence, pieces in a sequence, offset).

    The piece of rank r in an interval goes to sequence first + (r - rank) // m at offset + (r - rank) % m * length.
    """
    tree, groups, plan, sequences = CapacityTree(capacity), {}, [], 0

    def push(left: int, first: int, n: int) -> None:
        if n and left:
            groups.setdefault(left, []).append((first, n))
            tree.add(left, 1)

    for size in sorted(counts, reverse=True):
        rank, total = 0, counts[size]
        while rank < total:
            left = tree.tightest(size)
            if left is None:
                left, first, bins = capacity, sequences, -(-(total - rank) // (capacity // size))
                sequences += bins
            else:
                first, bins = groups[left].pop()
                tree.add(left, -1)
            m = left // size
            full = min(bins, (total - rank) // m)
            if full:
                plan.append((size, rank, rank + full * m, first, m, capacity - left))
                push(left - m * size, first, full)
                rank, first, bins = rank + full * m, first + full, bins - full
            if bins and rank < total:
                plan.append((size, rank, total, first, m, capacity - left))
                push(left - (total - rank) * size, first, 1)
                rank, first, bins = total, first + 1, bins - 1
            push(left, first, bins)
    return plan


def place(pieces: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = pieces.sparkSession
    buckets = max(1, pieces.count() // bucket_rows)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    intervals = best_fit_decreasing(totals, length)
    plan = spark.createDataFrame(intervals, "length long, first_rank long, end_rank long, first_sequence long, m long, first_offset long")
    if len(intervals) <= BROADCAST_ROWS:  # else a join on the length
        plan = F.broadcast(plan)
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(order)).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    at = F.col("rank") - F.col("first_rank")
    return ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.floor(at / F.col("m"))).alias("sequence_id"), (F.col("first_offset") + at % F.col("m") * ranked["length"]).alias("offset")
    )


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """All pieces of `docs` (doc_id, text) with their sequence and offset."""
    return place(written(cut(docs, vocabulary, length), "pieces"), length)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that are left."""
    return pack(docs)
