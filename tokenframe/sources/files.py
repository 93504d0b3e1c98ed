"""Text and id files, in and out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def text_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(doc_pos, path, text): every file is one document; a list keeps its order."""
    listed = [p for p in paths.split(",") if p] if isinstance(paths, str) else list(paths)
    if not listed:
        return spark.createDataFrame([], "doc_pos long, path string, text string")
    read = spark.read.format("binaryFile").load(listed).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    order = spark.createDataFrame([(i, p.removeprefix("file://")) for i, p in enumerate(listed)], "doc_pos long, path string")
    return order.join(read.dropDuplicates(["path"]), "path", "left").select("doc_pos", "path", F.coalesce("text", F.lit("")).alias("text"))  # empty files aren't scanned


def path_list(text: str) -> list[str]:
    """The paths of a list file: one a line, carriage returns stripped, blank lines skipped."""
    return [x for line in text.split("\n") if (x := line.rstrip("\r")).strip()]


def unpacked(raw: Column) -> Column:
    """Arrays of ids from little-endian unsigned 32-bit integers; a size that four doesn't divide is an error."""

    @F.arrow_udf("array<int>")
    def unpack(raw: pa.Array) -> pa.Array:
        out: list = []
        for b in raw.to_pylist():
            if b is None:
                out.append(None)
                continue
            if len(b) % 4:
                raise ValueError("the size of an id file must be a multiple of 4")
            out.append(np.frombuffer(b, "<u4").astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    return unpack(raw)


def id_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, ids) of files of raw ids."""
    return ship(spark).read.format("binaryFile").load(paths).select("path", unpacked(F.col("content")).alias("ids"))


def _pack(name: str, kind: str = "<u4"):
    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.array(x, kind).tobytes() for x in lists.to_pylist()], pa.binary())

    return pack(F.col(name))


def with_packed_ids(df: DataFrame, ids: str = "ids", out: str = "packed") -> DataFrame:
    """Adds the ids as little-endian unsigned 32-bit integers, one binary a document."""
    ship(df.sparkSession)
    return df.withColumn(out, _pack(ids))


def batch_bytes(docs: list[list[int]]) -> bytes:
    """One ragged batch: document count, n + 1 offsets, all ids; unsigned 32-bit little-endian."""
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype("<u4")
    return np.array([len(docs)], "<u4").tobytes() + offsets.tobytes() + b"".join(np.array(d, "<u4").tobytes() for d in docs)


def read_batch(raw: bytes) -> list[list[int]]:
    """The documents of a ragged batch."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    offsets = np.frombuffer(raw, "<u4", n + 1, 4).astype(np.int64)
    ids = np.frombuffer(raw, "<u4", int(offsets[-1]), 4 * (n + 2))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def write_batches(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", rows: int = 1000) -> None:
    """Ragged batches of about `rows` documents, one binary row each, as Parquet (batch, payload)."""
    ship(encoded.sparkSession)
    n = max(1, encoded.count() // rows)

    def run(key_, table):
        table = table.sort_by(key)
        return pa.table({"batch": pa.array([key_[0].as_py()], pa.int32()), "payload": pa.array([batch_bytes([x or [] for x in table.column(ids).to_pylist()])], pa.binary())})

    keyed = encoded.select(key, ids, F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("batch"))
    keyed.groupBy("batch").applyInArrow(run, "batch int, payload binary").write.parquet(path)
