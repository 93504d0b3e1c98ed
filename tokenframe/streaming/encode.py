"""Encoding streams: the row-local plan keeps no state, so it runs on streaming DataFrames as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import encode
from ..sources.vocabulary import Vocabulary


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def encode_stream(documents: DataFrame, vocab: Vocabulary, out: str, checkpoint: str) -> StreamingQuery:
    """Encode all documents that are there, and write (doc_id, ids) exactly once as Parquet."""
    encoded = encode(documents, vocab).select("doc_id", "ids")
    return encoded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def token_counts(documents: DataFrame, vocab: Vocabulary, time: str, window: str, late: str) -> DataFrame:
    """Tokens per event-time window, with documents later than `late` dropped."""
    counted = encode(documents, vocab).withColumn("n", F.size("ids"))
    return counted.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
