"""Timed runs of encoding over listed inputs, as metric rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import encode, pretokens_of
from ..sources.files import text_files
from ..sources.vocabulary import Vocabulary

METRICS = "run int, input_index int, path string, n_bytes long, n_tokens long, n_pretokens long, pretoken_ms double, encode_ms double"


def _timed(df: DataFrame):
    began = time.perf_counter()
    row = df.first()
    return row, 1000 * (time.perf_counter() - began)


def encode_metrics(spark: SparkSession, vocab: Vocabulary, paths: list[str], runs: int = 3, warmup: int = 1) -> DataFrame:
    """One row a run; inputs are taken in turn through warm-up and runs, and only runs are reported."""
    rows = []
    for turn in range(warmup + runs):
        at = turn % len(paths)
        docs = text_files(spark, [paths[at]])
        pieces, piece_ms = _timed(docs.select(F.sum(F.size(pretokens_of(vocab, F.col("text")))).alias("n"), F.sum(F.octet_length("text")).alias("b")))
        tokens, encode_ms = _timed(encode(docs, vocab).agg(F.sum(F.size("ids")).alias("n")))
        if turn >= warmup:
            rows.append((turn - warmup, at, paths[at], pieces["b"], tokens["n"], pieces["n"], piece_ms, encode_ms))
    return spark.createDataFrame(rows, METRICS)


def to_csv(metrics: DataFrame) -> str:
    """The rows as CSV text with a header; there are few of them."""
    lines = [",".join(metrics.columns)]
    lines += [",".join(f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) for r in metrics.orderBy("run").collect()]
    return "\n".join(lines) + "\n"
