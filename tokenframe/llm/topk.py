"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Method: vectors are floored to integers. In every index shard each dimension's components are cut into
segments of a quantised impact. Exact scores of a sample of the shard set a bar that k vectors reach. A query takes
the segments of all dimensions by descending impact (its component times the segment's); what a vector that
wasn't read yet can score is at most the sum of every dimension's best unread impact. Once that sum is below
the bar, no unread vector can be a member: that is the proof, and the only reason to stop. The vectors that
were read are the possible members, and are rescored exactly. Where the proof would take more postings than
half the vectors (as for vectors whose components are all alike in size), all vectors are possible members,
and those of many queries are rescored by one exact matrix product.

Index rows and queries are sorted by shard, index rows first: a task builds its shard's index once, as it
streams by, and answers the queries that follow in batches. Index rows are shuffled once; a query goes to every
shard, and returns k rows from each. A shard holds a bounded number of components, so shards grow with the data;
a small table gets more and smaller shards, to keep all cores busy.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
vec_id. Components of any finite size do: where products might not fit, a vector is scored with Python's
integers, and the column score shows the nearest long. Vectors of different lengths have no score with each
other. A query is a row, and every other row is a candidate: rows that repeat a query's id are candidates of it
and, as queries, get k rows of their own. Ties go to smaller vec_id. An empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table, written

SCALE, K = 1024, 10
LEVELS = 32
#: Components of an index shard at most; rows of it at least, where a small table is spread over all cores.
SHARD_COMPONENTS, LEAST_SHARD = 1 << 22, 2048
#: Vectors whose exact scores set the bar, at least, and as a share of a shard. Postings read for a vector of the shard
#: beyond which a matrix product over all of them costs less.
SAMPLE, SAMPLE_SHARE, WORTH = 1024, 16, 0.5
#: Queries that are answered at once; products of a matrix that is held at a time, about.
BATCH, HELD = 256, 1 << 23
#: Components up to this size are held as integers of 32 bits; larger ones make a vector wide.
NARROW = (1 << 31) - 1
FOUND = "query long, query_id long, vec_id long, score long, wide binary"
_LONG = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(1024 * x) of any finite x."""
    scaled = SCALE * x
    return math.floor(scaled) if math.isfinite(scaled) else SCALE * int(x)


def _packed(batches):
    for batch in batches:
        keep, dims, out, wide = [], [], [], []
        column = batch.column(2)
        for at, vec_id in enumerate(batch.column(1).to_pylist()):
            values = column[at].values
            if vec_id is None or values is None or not len(values) or values.null_count:
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            big = bool((np.abs(x) > NARROW // SCALE).any())
            keep.append(at)
            dims.append(len(x))
            wide.append(big)
            out.append(x.astype("<f8").tobytes() if big else np.floor(SCALE * x).astype("<i4").tobytes())
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_()), pa.array(out, pa.binary()), rows.column(3)], ["row", "vec_id", "dim", "wide", "packed", "is_query"])


def integers(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(row, vec_id, dim, wide, packed, is_query): the usable vectors; packed as 32-bit integers, or doubles where wide."""
    ship(vectors.sparkSession)
    inputs = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    return inputs.mapInArrow(_packed, "row long, vec_id long, dim int, wide boolean, packed binary, is_query boolean")


class ImpactIndex:
    """One shard: per dimension, segments of descending component. Rows are known by their numbers; ids break ties."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, levels: int = LEVELS):
        self.ids, self.numbers = ids, rows
        n, dims = matrix.shape
        self.largest = int(np.abs(matrix).max(initial=0))
        self.matrix = matrix
        self.exactly = matrix.astype(np.float64)  # integers of up to 32 bits
        places, values, starts, ends, dim_of, low, high = [], [], [], [], [], [], []
        at = 0
        for d in range(dims):
            column = matrix[:, d].astype(np.int64)
            least, most = int(column.min()), int(column.max())
            level = (column - least) * levels // (most - least + 1)
            order = np.argsort(level.astype(np.int16), kind="stable").astype(np.int32)
            ordered = column[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(level[order])) + 1, [n]))
            places.append(order)
            values.append(ordered)
            low.append(np.minimum.reduceat(ordered, cuts[:-1]))
            high.append(np.maximum.reduceat(ordered, cuts[:-1]))
            starts.append(at + cuts[:-1])
            ends.append(at + cuts[1:])
            dim_of.append(np.full(len(cuts) - 1, d))
            at += n
        self.places, self.values = np.concatenate(places), np.concatenate(values)
        self.starts, self.ends, self.dim_of, self.low, self.high = (np.concatenate(x) for x in (starts, ends, dim_of, low, high))
        self.first = np.searchsorted(self.dim_of, np.arange(dims))
        self.sample = np.arange(0, n, max(1, min(n // SAMPLE, SAMPLE_SHARE)))

    def possible(self, query: np.ndarray, own: int, bar: int) -> np.ndarray | None:
        """The vectors that may score `bar` or more, by the proof; None if reading them isn't worth it."""
        weight = query[self.dim_of]
        best = np.maximum(weight * self.low, weight * self.high)
        # what a dimension can still give once a segment is read: its next best segment
        by_dim = np.lexsort((-best, self.dim_of))
        after = np.append(best[by_dim][1:], 0)
        ends_dim = np.append(self.dim_of[by_dim][1:] != self.dim_of[by_dim][:-1], True)
        drop = np.empty_like(best)
        drop[by_dim] = np.where(ends_dim, 0, best[by_dim] - after)
        order = np.lexsort((self.dim_of, -best))
        rest = int(best[by_dim][np.append(True, ends_dim[:-1])].sum()) - np.cumsum(drop[order])
        stop = int(np.searchsorted(-rest, -bar, "right"))  # from here on, vectors that weren't read stay below the bar
        if stop >= len(order) or int((self.ends - self.starts)[order[: stop + 1]].sum()) > WORTH * len(self.ids):
            return None
        seen = np.zeros(len(self.ids), bool)
        for a, b in zip(self.starts[order[: stop + 1]].tolist(), self.ends[order[: stop + 1]].tolist()):
            seen[self.places[a:b]] = True
        return np.flatnonzero(seen & (self.numbers != own))

    def bars(self, queries: np.ndarray, owns: np.ndarray, k: int = K) -> list[int]:
        """For each query the k-th best score among a sample of other vectors; so many reach it."""
        scored = self.scores(queries, self.sample)
        scored[owns[:, None] == self.numbers[self.sample][None, :]] = np.iinfo(np.int64).min
        return np.partition(scored, scored.shape[1] - k)[:, scored.shape[1] - k].tolist() if scored.shape[1] >= k else [np.iinfo(np.int64).min] * len(queries)

    def scores(self, queries: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Exact scores (queries by vectors) as 64-bit integers."""
        bound = queries.shape[1] * self.largest * int(np.abs(queries).max(initial=0))
        if bound < 1 << 53:  # every partial sum is an integer that a double holds
            return (queries.astype(np.float64) @ self.exactly[rows].T).astype(np.int64)
        return queries @ self.matrix[rows].T.astype(np.int64)

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int = K):
        """For each query row its (places, scores) of the k best other vectors, ties to smaller ids."""
        out: list = [None] * len(queries)
        whole_ = []
        bars = self.bars(queries, owns, k)
        for i, (query, own, bar) in enumerate(zip(queries, owns.tolist(), bars)):
            rows = self.possible(query, own, bar)
            if rows is None:
                whole_.append(i)
            else:
                out[i] = self._top(rows, self.scores(query[None], rows)[0], k)
        step = max(1, HELD // max(1, len(self.ids)))
        for at in range(0, len(whole_), step):
            some = whole_[at : at + step]
            for i, scored in zip(some, self.scores(queries[some])):
                rows = np.flatnonzero(scored >= bars[i])
                rows = rows[self.numbers[rows] != owns[i]]
                out[i] = self._top(rows, scored[rows], k)
        return out

    def _top(self, rows, scores, k):
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[top], scores[top]


def _sortable(score: int) -> bytes | None:
    """Bytes in the order of scores beyond a long; none are needed for others."""
    if -_LONG <= score <= _LONG:
        return None
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


class Shard:
    """The vectors of one dimension in one shard, collected as they stream by, and then asked."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.parts, self.wide, self.index, self.some = dim, k, [], [], None, False

    def add(self, rows, ids, wide, packed) -> None:
        self.some = True
        self.wide += [(row, i, [whole(x) for x in np.frombuffer(p, "<f8").tolist()]) for row, i, w, p in zip(rows, ids, wide, packed) if w]
        own = [j for j, w in enumerate(wide) if not w]
        if own:
            self.parts.append((np.array([rows[j] for j in own], np.int64), np.array([ids[j] for j in own], np.int64), np.frombuffer(b"".join(packed[j] for j in own), "<i4").reshape(-1, self.dim)))

    def ask(self, rows, ids, wide, packed):
        """(query, query_id, vec_id, score, wide) columns for queries that are rows themselves."""
        if self.index is None and self.parts:
            self.index = ImpactIndex(*(np.concatenate(x) for x in zip(*self.parts)))
            self.parts.clear()
        found = []
        queries = [[whole(x) for x in np.frombuffer(p, "<f8").tolist()] if w else None for w, p in zip(wide, packed)]
        plain = []
        if self.index:
            plain = [j for j, w in enumerate(wide) if not w]
            matrix = np.frombuffer(b"".join(packed[j] for j in plain), "<i4").reshape(-1, self.dim).astype(np.int64)
            if len(plain) and self.dim * self.index.largest * int(np.abs(matrix).max(initial=0)) > _LONG // 4:
                plain = []
        narrow = {j: x for j, x in zip(plain, self.index.search(matrix, np.array([rows[j] for j in plain], np.int64), self.k))} if plain else {}
        for j in range(len(rows)):
            best: list = []
            if j in narrow:
                places, scores = narrow[j]
                best = list(zip(scores.tolist(), self.index.ids[places].tolist()))
            if j not in narrow or self.wide:
                query = queries[j] or np.frombuffer(packed[j], "<i4").tolist()
                others = list(self.wide)
                if self.index is not None and j not in narrow:
                    others += zip(self.index.numbers.tolist(), self.index.ids.tolist(), self.index.matrix.tolist())
                best += [(sum(a * b for a, b in zip(query, v)), i) for row, i, v in others if row != rows[j]]
            best.sort(key=lambda x: (-x[0], x[1]))
            found += [(rows[j], ids[j], i, max(-_LONG, min(_LONG, s)), _sortable(s)) for s, i in best[: self.k]]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary() if c == 4 else pa.int64()) for c in range(5)], ["query", "query_id", "vec_id", "score", "wide"])


def _answer(k: int):
    def run(batches):
        shard = at = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))  # shard, dim, asks
            columns = [batch.column(c).to_pylist() for c in range(3, 7)]
            first = 0
            while first < len(keys):
                last = first + 1
                while last < len(keys) and keys[last] == keys[first] and last - first < BATCH:
                    last += 1
                if keys[first][:2] != at:
                    at, shard = keys[first][:2], Shard(keys[first][1], k)
                part = [c[first:last] for c in columns]
                if not keys[first][2]:
                    shard.add(*part)
                elif shard.some:
                    yield shard.ask(*part)
                first = last

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard_components: int = SHARD_COMPONENTS, least_shard: int = LEAST_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` selects, its k best among all other rows."""
    packed = written(integers(vectors, is_query), "vectors")
    rows, longest = (x or 1 for x in packed.agg(F.count("*"), F.max("dim")).first())
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-rows * longest // shard_components), min(2 * cores, -(-rows // least_shard)))
    held = ("dim", "asks", "row", "vec_id", "wide", "packed")
    index = packed.withColumn("asks", F.lit(False)).select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), *held)
    queries = packed.where("is_query").withColumn("asks", F.lit(True)).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *held)
    together = index.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "asks", "row")
    found = together.mapInArrow(_answer(k), FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last(F.when(F.col("score") > 0, F.col("wide"))), F.desc_nulls_first("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
