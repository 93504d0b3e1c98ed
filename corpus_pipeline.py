"""Raw documents to packed training sequences: four stages, each written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents.

Null, empty and letterless texts have no language and go in the first stage; very long texts are read whole by all.
Null and repeated doc_ids lose no text, for rows are known by their texts too; of equal rows one stays. Ties between
near copies go to the smallest doc_id. Empty tables pass through; columns of any name are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenframe.llm import langid, packing, simhash, toxicity
from tokenframe.llm.common import drop_written, table, written

STAGES = [
    ("language_id", langid.keep_known),
    ("toxicity", toxicity.keep_clean),
    ("near_duplicates", simhash.keep_one),
    ("packing", packing.pack_stage),
]

#: Trained models and tokenizers can't be written in SQL; the tests compare every stage with a version of its own, text by text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_written(last)
        last = docs
    return docs
