"""The corpus pipeline against its stages applied by hand."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenframe.llm import langid, packing, registry, toxicity
from tokenframe.llm.common import written

from .test_operators import DOCS, check_packing, components_by_hand, fingerprint_by_hand, odd_documents

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    known = written(stages["language_id"](spark, docs, SF), "a")
    said = langid.predict(docs, langid.train(docs), F.col("doc_id")).collect()
    want = {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SCORE}
    assert known.columns == columns and {r[0] for r in known.select("doc_id").collect()} == want
    assert len(want) > 0.98 * docs.count()

    clean = written(stages["toxicity"](spark, known, SF), "b")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(known, toxicity.train(known, labels), F.col("doc_id")).collect()
    assert clean.columns == columns and {r[0] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in scored if r["score"] < 0.5}

    single = written(stages["near_duplicates"](spark, clean, SF), "c")
    rows = clean.select("doc_id", "text").collect()
    kept = set(components_by_hand([r["doc_id"] for r in rows], [fingerprint_by_hand(r["text"]) for r in rows]))
    assert single.columns == columns and sorted(r[0] for r in single.select("doc_id").collect()) == sorted(kept)

    packed = stages["packing"](spark, single, SF).collect()
    check_packing(packed, single.select("doc_id", "text").collect())
    assert sorted(map(repr, registry.queries()["pipeline"](spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(repr(r) for r in spark.createDataFrame(packed).select("doc_id", "piece", "ids_crc32").collect())


def test_stages_take_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame(odd_documents(), DOCS)
    spark.createDataFrame([(i, i % 2) for i in range(18)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, str(tmp_path)), name)
            assert out.dtypes == docs.dtypes
        assert corpus_pipeline.run(spark, str(tmp_path)).columns == [c.split()[0] for c in packing.PIECES.split(", ")] + ["sequence_id", "offset"]


def test_one_of_each_group_stays(spark, tmp_path):
    odd = spark.createDataFrame(odd_documents(), DOCS)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd, str(tmp_path)).collect()
    rows = odd_documents()
    groups = set(zip(components_by_hand([r[0] for r in rows], [fingerprint_by_hand(r[1]) for r in rows])))
    assert len(out) == len(groups)


def test_null_and_repeated_ids_lose_no_group(spark, tmp_path):
    texts = ["an apple a day keeps the doctor away", "rain falls mainly on the plain in spain", None, "many hands make light work of it"]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0])] + [(5, texts[3]), (5, "all that glitters is not gold at all"), (5, texts[3]), (3, "all that glitters is not gold at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [*rows[:3], rows[4], rows[7]]))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_python_batches_bounded_by_bytes(spark, tmp_path, name):
    from tokenframe.session import BATCH

    spark.createDataFrame([(i, i % 2) for i in range(18)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(odd_documents(), DOCS), str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH
