"""SimHash near-duplicates: fingerprints linked within a Hamming radius through vantage-point trees.

Method: every document gets a 64-bit fingerprint of its word shingles. The bits are cut into blocks, one more than
the radius, so linked fingerprints are equal in one block at least: each distinct fingerprint goes once a block to
the shard of its block's value, which is a fixed number of copies however many fingerprints there are. A value of
a block that very many fingerprints share is cut further by a vantage-point tree over Hamming distance, built from
a bounded sample; a fingerprint whose ball of the radius crosses a boundary also visits the other side, so every
linked pair still meets. Within a shard a local vantage-point tree, pruned by the triangle bounds, goes down to
small leaves, where pairs are compared. Shards return spanning forests (never all pairs); components come from
alternating star contractions over written tables. The sample shapes the shards only: results are exact for any.

Null, empty and word-less texts have fingerprint zero and are linked like any other; very long texts are read
whole. Rows with a null doc_id keep a row each and take the smallest non-null doc_id of their component (null if
there is none); repeated rows stay, an empty table gives none. Ties don't occur. Columns other than doc_id and text,
whatever their names, are ignored. No key is hot: a fingerprint that very many documents share is joined in copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import spread_join
from .common import drop_written, ship, small_batches, table, written

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints of one block value from which a tree cuts it, about; fingerprints in the sample that shapes the trees,
#: and of one value in it, at least, for a tree. There are SAMPLE_ROWS / LEAST_SAMPLE trees a block at most.
SHARD_ROWS, SAMPLE_ROWS, LEAST_SAMPLE = 32_768, 1 << 20, 64
LEAF = 96


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> bytes:
    """The eight bytes of a text's fingerprint, highest bit first."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return b"\0" * 8
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist())])
    n = len(raw) // 8
    ones = np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        ones += np.unpackbits(bits[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(batches):
    for batch in batches:
        raw = b"".join(fingerprint(x) for x in batch.column(1).to_pylist())
        fps = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps)], ["doc_id", *batch.schema.names[2:], "fp"])


def with_fingerprints(docs: DataFrame, *keep) -> DataFrame:
    """(doc_id, the kept long columns, fp long) for every row."""
    small_batches(ship(docs.sparkSession))
    inputs = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    return inputs.mapInArrow(_fingerprints, inputs.drop("text").schema.add("fp", "long"))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, depth: int):
    """Nested (vantage, limit, inner, outer); None at the leaves. Inner: distance <= limit."""
    if depth == 0 or len(sample) < 8:
        return None
    step = max(1, len(sample) // 8)
    best = max(sample[::step][:8], key=lambda v: float(np.var(_distance(sample, v))))
    d = _distance(sample, best)
    limit = int(np.median(d))
    if not (d > limit).any():
        limit -= 1
    inside = d <= limit
    if inside.all() or not inside.any():
        return None
    return int(best), limit, build_tree(sample[inside], depth - 1), build_tree(sample[~inside], depth - 1)


def _split(fps, homes, visitors, vantage, limit, radius):
    """Index arrays of (inner homes, inner visitors, outer homes, outer visitors).

    A linked pair on two sides is found by its inner member's visit to the outer side.
    """
    v = np.uint64(vantage)
    dh, dv = _distance(fps[homes], v).astype(np.int64), _distance(fps[visitors], v).astype(np.int64)
    inside = dh <= limit
    crossing = homes[inside & (dh > limit - radius)]
    return homes[inside], visitors[dv <= limit + radius], homes[~inside], np.concatenate((visitors[dv > limit - radius], crossing))


def route(fps: np.ndarray, tree, radius: int = RADIUS):
    """(shard, index, visits) arrays: each row's home shard, and the shards that it visits."""
    out, shards = [], [0]

    def down(node, homes, visitors):
        if node is None:
            shard = shards[0]
            shards[0] += 1
            for rows, visits in ((homes, False), (visitors, True)):
                out.append((np.full(len(rows), shard, np.int32), rows, np.full(len(rows), visits)))
            return
        ih, iv, oh, ov = _split(fps, homes, visitors, node[0], node[1], radius)
        down(node[2], ih, iv)
        down(node[3], oh, ov)

    down(tree, np.arange(len(fps)), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _contract(a: np.ndarray, b: np.ndarray):
    """A star forest (member, smallest member) with the same components."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def links(fps: np.ndarray, visits: np.ndarray, radius: int = RADIUS):
    """A spanning forest of the links among home rows and between visitors and home rows, as two arrays."""
    found, pending, count = [], [], [0]

    def flush():
        if pending:
            a, b = np.concatenate([x for x, _ in pending]), np.concatenate([y for _, y in pending])
            found[:] = [_contract(np.concatenate([a] + [x for x, _ in found]), np.concatenate([b] + [y for _, y in found]))]
            pending.clear()
            count[0] = 0

    def compare(left, right, same):
        for at in range(0, len(left), 2048):
            block = left[at : at + 2048]
            for to in range(at if same else 0, len(right), 2048):
                other = right[to : to + 2048]
                i, j = np.nonzero(_distance(fps[block][:, None], fps[other][None, :]) <= radius)
                if same and to == at:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    pending.append((block[i], other[j]))
                    count[0] += len(i)
                    if count[0] > 1_000_000:
                        flush()

    def down(homes, visitors):
        if not len(homes):
            return
        if len(homes) > LEAF:
            node = build_tree(fps[homes[:: max(1, len(homes) // 512)]], 1)
            if node:
                ih, iv, oh, ov = _split(fps, homes, visitors, node[0], node[1], radius)
                if len(ih) and len(oh):
                    down(ih, iv)
                    down(oh, ov)
                    return
        compare(homes, homes, True)
        compare(visitors, homes, False)

    rows = np.arange(len(fps))
    down(rows[~visits], rows[visits])
    flush()
    a, b = found[0] if found else (rows[:0], rows[:0])
    return fps[a], fps[b]


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of each block of a fingerprint."""
    ends = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def block_value(fps: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return (fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


def build_trees(sample: np.ndarray, there: int, radius: int, shard_rows: int) -> list[dict[int, tuple]]:
    """For each block, the trees of the values that more than `shard_rows` of `there` fingerprints seem to have."""
    share = len(sample) / max(1, there)
    out = []
    for shift, bits in blocks(radius):
        own = {}
        values, counts = np.unique(block_value(sample, shift, bits), return_counts=True)
        for value, count in zip(values.tolist(), counts.tolist()):
            depth = int(np.ceil(np.log2(max(1.0, count / share / shard_rows))))
            if depth and count >= min(LEAST_SAMPLE, there):
                own[value] = build_tree(sample[block_value(sample, shift, bits) == np.uint64(value)], depth)
        out.append({v: t for v, t in own.items() if t})
    return out


def routed(fps: np.ndarray, trees: list[dict[int, tuple]], radius: int = RADIUS):
    """(place, fingerprint, visits) arrays: a place is a block, a value of it, and a leaf of the value's tree."""
    places, rows, visits = [], [], []
    for k, (shift, bits) in enumerate(blocks(radius)):
        values = block_value(fps, shift, bits)
        base = np.uint64(k << 60) | values << np.uint64(20)
        cut = np.isin(values, np.array(sorted(trees[k]), np.uint64)) if trees[k] else np.zeros(len(fps), bool)
        places.append(base[~cut])
        rows.append(fps[~cut])
        visits.append(np.zeros(int((~cut).sum()), bool))
        for value in np.unique(values[cut]).tolist():
            own = fps[values == np.uint64(value)]
            leaf, index, visiting = route(own, trees[k][value], radius)
            places.append((np.uint64(k << 60 | value << 20) + leaf.astype(np.uint64)))
            rows.append(own[index])
            visits.append(visiting)
    return np.concatenate(places), np.concatenate(rows), np.concatenate(visits)


def close_pairs(places: np.ndarray, fps: np.ndarray, visits: np.ndarray, radius: int = RADIUS):
    """A spanning forest of the links within each place, as two arrays."""
    order = np.argsort(places, kind="stable")
    places, fps, visits = places[order], fps[order], visits[order]
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    sizes = np.diff(np.append(starts, len(places)))
    found = [(fps[:0], fps[:0])]
    small = np.repeat(sizes <= LEAF, sizes)
    few = np.flatnonzero(small)
    for step in range(1, int(sizes[sizes <= LEAF].max(initial=0))):  # all small places at once: each row with the one `step` further on
        a = few[few + step < len(places)]
        a = a[places[a] == places[a + step]]
        b = a + step
        near = (_distance(fps[a], fps[b]) <= radius) & ~(visits[a] & visits[b])
        found.append((fps[a[near]], fps[b[near]]))
        few = a
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        found.append(links(fps[start : start + size], visits[start : start + size], radius))
    a, b = (np.concatenate(x) for x in zip(*found))
    return _contract(a, b) if len(a) else (a, b)


def _forest(radius: int):
    def run(shard: pa.Table) -> pa.Table:
        places, fps = (shard.column(c).to_numpy().view(np.uint64) for c in ("place", "fp"))
        a, b = close_pairs(places, fps, shard.column("visits").to_numpy(zero_copy_only=False).astype(bool), radius)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.table({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return run


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node that isn't its component's smallest, with that smallest, by alternating star contraction.

    Every round is written to the shared folder; the driver sees one checksum a round.
    """
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check[0] == 0 or check == before:
            return edges
        before = check
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "large-star")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        after = written(small, "small-star")
        drop_written(edges)
        drop_written(large)
        edges = after


def rooted(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, rep, uses, root), written: every distinct fingerprint, its smallest doc_id, its rows and its component's smallest fingerprint."""
    spark = fps.sparkSession
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("uses")), "distinct")
    n = distinct.count()
    trees = [{} for _ in blocks(radius)]
    if n > shard_rows:
        sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).select("fp").limit(2 * SAMPLE_ROWS).toArrow()
        trees = build_trees(sample.column("fp").to_numpy().view(np.uint64), n, radius, shard_rows)
    sent = spark.sparkContext.broadcast(trees)
    shards = max(1, -(-n * (radius + 1) // shard_rows))

    def run(batches):
        for batch in batches:
            place, fp, visits = routed(batch.column(0).to_numpy().view(np.uint64), sent.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(visits)], ["place", "fp", "visits"])

    places = distinct.select("fp").mapInArrow(run, "place long, fp long, visits boolean").withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    edges = places.groupBy("shard").applyInArrow(_forest(radius), "u long, v long")
    root = stars(edges)
    named = distinct.join(root.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").select("fp", "rep", "uses", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    drop_written(distinct, root)
    return named


def components(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for a written table of (doc_id, fp)."""
    named = rooted(fps, radius, shard_rows)
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return spread_join(fps, named.join(lowest, "root").select("fp", "component_id", "uses"), "fp", "uses")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text)."""
    fps = written(with_fingerprints(docs), "fingerprints")
    return components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Bytes of keys of rows that go, up to which they are sent to every task instead of moving the texts to them.
SENT_BYTES = 32 << 20


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of every component, that of the smallest doc_id (a null one only where there is no other).

    A row is known by its doc_id and 128 bits of hashes of its text, so null and repeated ids lose no component. Null,
    empty and word-less texts are one component; of equal rows one stays; ties of a component's smallest doc_id go by
    these hashes. Very long texts are read whole; an empty table stays empty. All columns stay, whatever their names.
    """
    ship(spark)
    key = {"__id": F.col("doc_id").cast("long"), "__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(SEED), "text")}
    fps = written(with_fingerprints(docs, *(key[k].alias(k) for k in ("__h1", "__h2"))), "fingerprints")
    same = written(fps.groupBy("fp", "doc_id", "__h1", "__h2").agg(F.count("*").alias("n")), "same")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    named = rooted(fps)
    first = same.groupBy("fp").agg(F.min(row).alias("row"), F.count("*").alias("rows"))
    whose = first.join(named, "fp").groupBy("root").agg(F.min("row").alias("best"))
    best = named.join(whose, "root").join(first.select("fp", "rows"), "fp").select("fp", "best", "rows")
    marked = spread_join(same, best, "fp", "rows").select(row.alias("row"), "best", "n")
    marked = marked.select("row.*", (F.col("row") == F.col("best")).alias("stays"), "n")
    gone = written(marked.where(~F.col("stays") | (F.col("n") > 1)), "gone")
    drop_written(fps, same, named)
    keyed = docs.withColumns(key)
    known = lambda t: keyed["__id"].eqNullSafe(t["id"]) & (keyed["__h1"] == t["h1"]) & (keyed["__h2"] == t["h2"])
    some, repeated = gone.agg(F.count("*"), F.count_if("stays")).first()
    joined = F.broadcast if 64 * some <= SENT_BYTES else lambda t: t.hint("shuffle_hash")
    out = keyed.join(joined(gone.select("id", "h1", "h2")), known(gone), "left_anti")
    if repeated:  # of rows that are equal, and stay, one does
        twice = gone.where("stays").select("id", "h1", "h2")
        out = out.unionByName(keyed.join(joined(twice), known(twice), "left_semi").dropDuplicates(list(key)))
    return out.drop(*key)
