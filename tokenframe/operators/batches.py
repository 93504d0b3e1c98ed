"""Packing a stream of documents into bounded batches, first in first out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


#: Documents of a lane, about, where no number of lanes is given; lanes at least.
LANE_ROWS, LEAST_LANES = 65_536, 8


def pack_batches(df: DataFrame, lanes: int | None, max_docs: int, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lane, batch, key, n_bytes): within each lane, in key order, batches of bounded documents and bytes.

    A document beyond max_bytes is a batch of its own, numbered -1. Lanes take the place of concurrent queues: the
    key's remainder by their number, which grows with the documents unless it is given. Null keys are in lane 0.
    """
    ship(df.sparkSession)
    lanes = lanes or max(LEAST_LANES, -(-df.count() // LANE_ROWS))
    sized = df.select(F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(lanes)), F.lit(0)).cast("int").alias("lane"), F.col(key).cast("long").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches):
        lane, batch, docs, held = None, 0, 0, 0
        for part in batches:
            numbers = []
            for own, size in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if own != lane:
                    lane, batch, docs, held = own, 0, 0, 0
                if size > max_bytes:
                    numbers.append(-1)
                    continue
                if docs and (docs == max_docs or held + size > max_bytes):
                    batch, docs, held = batch + 1, 0, 0
                docs, held = docs + 1, held + size
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(numbers, pa.int64()), part.column(1), part.column(2)], ["lane", "batch", key, "n_bytes"])

    ordered = sized.repartition(lanes, "lane").sortWithinPartitions("lane", "key")
    return ordered.mapInArrow(run, f"lane int, batch long, {key} long, n_bytes long")
