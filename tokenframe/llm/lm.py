"""Stupid-backoff scores of documents under n-gram counts of the whole corpus, computed relationally.

Method: consecutive documents of a partition make a chunk. A chunk is exploded to n-gram rows (order, gram, times), aggregated within the
chunk, and the rows are exchanged by ranges of the gram's hash, the buckets. A bucket's count table (gram, count) is
the grouped sum over all its rows; the rows are joined with it and take their corpus counts back to their chunk.
There the counts meet the chunk's documents, and the terms are summed per document. A frequent n-gram is one row a
chunk, however many documents hold it, so no key is hot. `ngram_counts` gives the count tables themselves.

Rows travel in columns: all rows of a chunk for a bucket are one value, their sorted hashes as differences, because a
row of Spark's own takes five times the room; see the README for figures. The texts are exchanged once, compressed.
If a lost chunk of texts comes back with other documents than before, which needs an input in no fixed order, that is
an error.

Score of a word: count(n-gram) / count(context) for the longest n-gram that occurs MIN_COUNT times or more,
times BACKOFF for each order given up; the last resort is count(word) / words of the corpus. Counts below MIN_COUNT
of orders from two on aren't sent back, for they are never used. Counts include the document itself and never cross
documents. Words are runs of non-white-space with A-Z lower-cased. n-grams are told apart by 60-bit hashes.

Null and empty texts have no words, a log_score of 0 and a null score. Very long texts are scored whole; a chunk has
one such text at least. Null doc_ids and repeated rows keep a row each and count each time; ties don't occur. An empty
table gives no rows. Columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import segment_sums, ship, table, text_chunks, written

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: Text bytes of a chunk, and of the corpus per hash bucket.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 6 << 20, 24
#: Bits of a hash that are kept.
BITS = 60
SCORED = "doc_id long, n_tokens long, partial double, last_resorts long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words of each text)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts), weights=empty, minlength=len(counts)).astype(np.int64)
        words = words.filter(pa.array(~empty))
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, 42) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64), counts


class Grams:
    """The distinct n-grams of some texts, by order and hash, and each word's place among them."""

    def __init__(self, texts: pa.Array, order: int):
        words, self.counts = tokens(texts)
        n = len(words)
        starts = np.cumsum(self.counts) - self.counts
        self.place = np.arange(n) - np.repeat(starts, self.counts)
        self.keys, self.times, self.at = [], [], []
        gram = words
        for k in range(order):
            ends = np.flatnonzero(self.place >= k)  # positions that end an n-gram of k + 1 words
            if k:
                gram = _mixed(gram[:-1] * _MIX + words[k:] + np.uint64(k))
            distinct, inverse, times = np.unique(gram[ends - k] >> np.uint64(64 - BITS), return_inverse=True, return_counts=True)
            self.keys.append(distinct)
            self.times.append(times.astype(np.uint32))
            at = np.full(n, -1, np.int32)
            at[ends] = inverse
            self.at.append(at)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the hash space that a hash is in; ranges are in the order of hashes."""
    return ((keys >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress well where high bytes are zero."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def _pack(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(raw: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<u8", n, 8).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _chunks(chunk_bytes: int):
    def run(batches):
        """Consecutive rows (doc_id, text) as one row: their ids, and their texts compressed."""
        first = TaskContext.get().partitionId() << 32
        held, size, made = [], 0, 0

        def flush():
            ids = pa.concat_arrays([h.column(0) for h in held])
            texts = pa.concat_arrays([h.column(1).cast(pa.large_string()) for h in held])
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            raw = zstandard.ZstdCompressor(level=1).compress(np.diff(offsets).tobytes() + texts.buffers()[2][: int(offsets[-1])].to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([raw], pa.large_binary()).cast(pa.binary())], ["chunk", "doc_ids", "texts"])

        for batch in batches:
            for a, b in text_chunks(batch.column(1), chunk_bytes):
                held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], ["doc_id", "text"]))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py()
                if size >= chunk_bytes:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return run


def _texts(chunk: pa.Table) -> tuple[pa.Array, pa.Array]:
    """(doc_ids, texts) of the one row of a chunk."""
    ids = chunk.column("doc_ids").combine_chunks().flatten()
    raw = zstandard.ZstdDecompressor().decompress(chunk.column("texts")[0].as_py())
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, len(ids)))))
    return ids, pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)[8 * len(ids) :]).cast(pa.string())


def _explode(order: int, buckets: int):
    def run(key, chunk):
        """A chunk's n-gram rows, those of a bucket in one value."""
        grams = Grams(_texts(chunk)[1], order)
        of = [bucket_of(k, buckets) for k in grams.keys]
        some = np.unique(np.concatenate(of))  # buckets without n-grams of this chunk get no row
        first, last = ([np.searchsorted(b, some, side) for b in of] for side in ("left", "right"))
        out = []
        for j in range(len(some)):
            part = []
            for k in range(order):
                keys, times = (x[first[k][j] : last[k][j]] for x in (grams.keys[k], grams.times[k]))
                part += [_planes(np.diff(keys, prepend=np.uint64(0))), _planes(times)]
            out.append(_pack(part))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "bucket": pa.array(some, pa.int32()), "grams": pa.array(out, pa.binary())})

    return run


def _rows(blocks: list[list[bytes]], k: int) -> pa.Table:
    """The n-gram rows of one order of a bucket: (gram, times)."""
    grams = [np.cumsum(_from_planes(b[2 * k], "<u8"), dtype=np.uint64) for b in blocks]
    return pa.table({"gram": np.concatenate(grams), "times": np.concatenate([_from_planes(b[2 * k + 1], "<u4") for b in blocks]).astype(np.int64)})


def count_table(rows: pa.Table) -> pa.Table:
    """(gram, count) of n-gram rows."""
    return rows.group_by("gram").aggregate([("times", "sum")]).rename_columns(["gram", "count"])


def _join(order: int, least: int):
    def run(rows):
        """The bucket's count table, joined to the rows that it comes from."""
        blocks = [_unpack(x) for x in rows.column("grams").to_pylist()]
        answers = [[] for _ in blocks]
        for k in range(order):
            own = _rows(blocks, k)
            counts = count_table(own)
            each = counts.column("count").take(pc.index_in(own.column("gram"), counts.column("gram").combine_chunks())).to_numpy()
            each = np.where(each >= (least if k else 1), each, 0).astype("<u8")
            ends = np.cumsum([len(b[2 * k]) // 8 for b in blocks])
            for answer, part in zip(answers, np.split(each, ends[:-1])):
                answer.append(_planes(part))
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "counts": pa.array([_pack(a) for a in answers], pa.binary())})

    return run


def _score(order: int, least: int, backoff: float):
    def run(key, chunk, rows):
        ids, texts = _texts(chunk)
        grams = Grams(texts, order)
        blocks = [_unpack(x) for x in rows.sort_by("bucket").column("counts").to_pylist()]
        seen = [np.concatenate([_from_planes(b[k], "<u8") for b in blocks]).astype(np.float64) if blocks else np.zeros(0) for k in range(order)]
        if [len(c) for c in seen] != [len(x) for x in grams.keys]:
            raise RuntimeError("a chunk's documents changed between two reads of the input")
        n = len(grams.place)
        count = [np.where(at >= 0, c[at], 0.0) if len(c) else np.zeros(n) for at, c in zip(grams.at, seen)]
        log, last = np.log(np.maximum(count[0], 1)), np.ones(n)
        for k in range(1, order):
            context = np.concatenate(([1.0], count[k - 1][:-1])) if n else count[k - 1]
            found = count[k] >= least
            lower = np.where(grams.place >= k, log + np.log(backoff), log)
            log = np.where(found, np.log(np.where(found, count[k], 1)) - np.log(np.where(found, context, 1)), lower)
            last[found] = 0
        return pa.table({"doc_id": ids, "n_tokens": pa.array(grams.counts), "partial": pa.array(segment_sums(log, grams.counts)), "last_resorts": pa.array(segment_sums(last, grams.counts).astype(np.int64))})

    return run


def _exploded(docs: DataFrame, order: int, chunk_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(chunks of the documents with words; their n-gram rows by chunk and bucket)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    some = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = some.mapInArrow(_chunks(chunk_bytes), "chunk long, doc_ids array<long>, texts binary")
    return own, own.groupBy("chunk").applyInArrow(_explode(order, buckets), "chunk long, bucket int, grams binary")


def ngram_counts(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(n, gram, count): the count tables of all orders, gram being the n-gram's hash."""
    ship(docs.sparkSession)

    def run(rows):
        blocks = [_unpack(x) for x in rows.column("grams").to_pylist()]
        parts = [count_table(_rows(blocks, k)) for k in range(order)]
        return pa.concat_tables([pa.table({"n": pa.array([k + 1] * len(p), pa.int32()), "gram": pa.array(p.column("gram").to_numpy().view(np.int64)), "count": p.column("count")}) for k, p in enumerate(parts)])

    return _exploded(docs, order, chunk_bytes, bucket_bytes)[1].groupBy("bucket").applyInArrow(run, "n int, gram long, count long")


def score(docs: DataFrame, order: int = ORDER, least: int = MIN_COUNT, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, log_score, score) of every row of `docs` (doc_id, text)."""
    ship(docs.sparkSession)
    own, grams = _exploded(docs, order, chunk_bytes, bucket_bytes)
    counts = grams.groupBy("bucket").applyInArrow(_join(order, least), "chunk long, bucket int, counts binary")
    scored = written(own.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_score(order, least, backoff), SCORED), "scored")
    total = scored.agg(F.sum("n_tokens")).first()[0] or 1
    log = F.col("partial") - F.col("last_resorts") * float(np.log(total))
    some = scored.select("doc_id", "n_tokens", log.alias("log_score"), (log / F.col("n_tokens")).alias("score"))
    none = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return some.unionByName(none.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_score"), F.lit(None).cast("double").alias("score")))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.round("score", 6).alias("score"))


OP7_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos, unnest([NULL] || ws[:-2]) AS prev, unnest(([NULL, NULL] || ws)[:len(ws)]) AS prev2 FROM w WHERE len(ws) > 0
), u AS (SELECT word, count(*) AS c FROM t GROUP BY word),
b AS (SELECT prev, word, count(*) AS c FROM t WHERE pos > 0 GROUP BY prev, word),
g AS (SELECT prev2, prev, word, count(*) AS c FROM t WHERE pos > 1 GROUP BY prev2, prev, word HAVING count(*) >= 2),
n AS (SELECT count(*) AS total FROM t),
s AS (
  SELECT t.rid, count(*) AS n_tokens, avg(CASE WHEN g.c IS NOT NULL THEN ln(g.c) - ln(q.c) ELSE CASE WHEN t.pos > 1 THEN ln(0.4) ELSE 0 END
    + CASE WHEN t.pos = 0 THEN ln(u.c) - ln(total) WHEN b.c >= 2 THEN ln(b.c) - ln(p.c) ELSE ln(0.4) + ln(u.c) - ln(total) END END) AS score
  FROM t JOIN u ON u.word = t.word CROSS JOIN n LEFT JOIN b ON b.prev = t.prev AND b.word = t.word AND t.pos > 0 LEFT JOIN u p ON p.word = t.prev
    LEFT JOIN g ON g.prev2 = t.prev2 AND g.prev = t.prev AND g.word = t.word AND t.pos > 1 LEFT JOIN b q ON q.prev = t.prev2 AND q.word = t.prev
  GROUP BY t.rid
)
SELECT w.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, round(score, 6) AS score FROM w LEFT JOIN s ON s.rid = w.rid
"""
