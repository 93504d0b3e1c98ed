"""Shared helpers of the training-data operators: tables, Arrow chunks, hashed shares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..memory import trim
from ..session import drop_written, read_parquet, ship, small_batches, written

__all__ = ["drop_written", "ship", "small_batches", "trim", "written"]
#: Text bytes that one numpy pass handles at a time; it bounds a worker's memory.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def text_chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Yield (first, last) row bounds so that each slice holds about max_bytes of text, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield at, to
        at = to
    trim()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + length) of all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, zero for empty runs."""
    out = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], dtype=np.float64)
    return out


def hash_share(key, wanted: int, there: int):
    """A condition that a share of rows meets by the hash of `key`: about four times `wanted` of `there`, all if there are fewer.

    It bounds what a sample's exact ranking has to sort, however large the table.
    """
    if there <= 4 * wanted:
        return F.lit(True)
    return share_hash(key) < share_bound(wanted, there)


def share_hash(key):
    """The hash of `key` that hash_share compares, from 0 to 2**40 - 1."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 40))


def share_bound(wanted: int, there: int) -> int:
    """The bound below which a row of hash_share's share has its hash."""
    return 1 << 40 if there <= 4 * wanted else int(4 * wanted / there * (1 << 40))
