"""Encoding DataFrames of texts, in two physical plans.

The row-local plan has no shuffle, and streams. Plain texts of a vocabulary that the upstream encoder provably
serves go to it whole (operators.library); others are cut in the JVM, and each Arrow batch's distinct pre-tokens
are merged in Python. The deduplicating plan merges each distinct pre-token of the whole input once, at the price
of written codes and three shuffles of the distinct pre-tokens of chunks; it pays only where merging is dear.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import nfc
from ..functions.patterns import PASSES, Family, _python
from ..functions.pretokens import pretokens
from ..functions.skew import spread_join
from ..memory import by_slices, trim, whole
from ..session import drop_written, ship, small_batches, written
from ..sources.vocabulary import Vocabulary, literal_pattern
from . import library
from .merge import Merger, Sent, gathered, low_bar, merger


def pretokens_of(vocab: Vocabulary, text: Column) -> Column:
    """A text's pre-tokens under a vocabulary: literals, normalization between them, the family's passes."""
    if vocab.sentence_piece:
        pattern = literal_pattern(vocab)
        compiled = re.compile(f"({pattern})") if pattern else None

        @F.arrow_udf("array<string>")
        def segments(texts: pa.Array) -> pa.Array:
            out = []
            for t in texts.to_pylist():
                parts = None if t is None else compiled.split(t) if compiled else [t]
                out.append(parts and [p if i % 2 else low_bar(p) for i, p in enumerate(parts) if p])
            return pa.array(out, pa.list_(pa.string()))

        return segments(text)
    if vocab.nfc:
        text = nfc(text, literal_pattern(vocab) or None)
    return pretokens(text, vocab.family, sorted(vocab.added))


def merged(vocab: Vocabulary, pieces: Column, spark) -> Column:
    """Arrays of pre-tokens to arrays of ids."""
    sent = Sent(ship(spark), vocab)

    @F.arrow_udf("array<int>")
    def merge(lists: pa.Array) -> pa.Array:
        return merger(sent).lists(lists)

    return merge(pieces)


def _pieces(vocab: Vocabulary, text: Column, spark) -> Column:
    """Texts to arrays of ids under a sentence-piece vocabulary."""
    sent, pattern = Sent(ship(spark), vocab), literal_pattern(vocab)
    compiled = re.compile(f"({pattern})") if pattern else None

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return merger(sent).texts(texts, compiled)

    return run(text)


_engines: dict[str, library.Engine] = {}


def ids_of(vocab: Vocabulary, text: Column, spark) -> Column:
    """Texts to arrays of ids."""
    if vocab.sentence_piece:
        return _pieces(vocab, text, spark)
    if not library.usable(vocab):
        return merged(vocab, pretokens_of(vocab, text), spark)
    sent, plain = Sent(ship(spark), vocab), library.takes(text)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        if sent.id not in _engines:
            _engines.clear()
            _engines[sent.id] = library.Engine(sent.vocab.value)
        none, engine = np.zeros(0, np.int32), _engines[sent.id]

        def some(own: pa.Array, cut: pa.Array) -> pa.Array:
            rows = [none if t is None else engine.ids(t) for t in own.to_pylist()]
            if cut.null_count < len(cut):
                lists = merger(sent).lists(cut)
                ends, flat = np.asarray(lists.offsets), lists.values.to_numpy()
                for i in np.flatnonzero(np.asarray(cut.is_valid())).tolist():
                    rows[i] = flat[ends[i] : ends[i + 1]]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            mask = pa.array(np.asarray(own.is_null()) & np.asarray(cut.is_null()))
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *rows])), mask=mask)

        return by_slices(some, pa.list_(pa.int32()), texts, pieces)

    return run(F.when(plain, text), pretokens_of(vocab, F.when(~plain, text)))


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of `text`: no shuffle, any number of rows, batch or stream. Null gives null.

    Sentence-piece vocabularies are encoded row by row like all others; there is no reason to refuse many rows.
    """
    return df.withColumn(out, ids_of(vocab, F.col(text), df.sparkSession))


#: Pre-tokens of a chunk of the deduplicating plan, about.
CODED = 1 << 20


def _coded(batches):
    """Chunks of documents: their keys, pre-tokens a document (-1 for null), places in the chunk's distinct pre-tokens, and these."""
    from pyspark import TaskContext

    chunk, held = TaskContext.get().partitionId() << 32, 0
    known: dict[str, int] = {}
    keys, sizes, codes = [], [], []

    def row() -> pa.RecordBatch:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        places = np.concatenate(codes).astype(np.uint16 if len(known) <= 1 << 16 else np.int32)
        columns = [pa.array([chunk], pa.int64()), one(pa.concat_arrays(keys)), one(pa.concat_arrays(sizes)), pa.array([places.tobytes()], pa.binary()), one(pa.array(list(known), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "keys", "sizes", "codes", "words"])

    for batch in batches:
        pieces = whole(batch.column(1))
        coded = pieces.flatten().dictionary_encode()
        place = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int32)
        codes.append(place[coded.indices.to_numpy()])
        sizes.append(pieces.value_lengths().fill_null(-1))
        keys.append(whole(batch.column(0)))
        held += len(coded)
        if held >= CODED:
            yield row()
            chunk, held = chunk + 1, 0
            known.clear()
            keys, sizes, codes = [], [], []
            trim()
    if keys:
        yield row()


def _uncoded(sizes: pa.Array, codes: pa.Array, parts: pa.Array) -> pa.Array:
    """The ids of every document of chunks, from the ids of the chunks' distinct pre-tokens."""
    out = []
    for size, code, part in zip(*map(whole, (sizes, codes, parts))):
        counts = size.values.to_numpy()
        some = int(np.maximum(counts, 0).sum()) > 0
        at, ids = (part.values.field(0).to_numpy(), part.values.field(1)) if some else (np.zeros(0, np.int64), pa.array([], pa.list_(pa.int32())))
        place = np.empty(len(at), np.int64)  # of each distinct pre-token among the parts
        place[at] = np.arange(len(at))
        piece = place[np.frombuffer(code.as_py(), np.uint16 if len(at) <= 1 << 16 else np.int32)]
        starts = np.asarray(ids.offsets)[:-1].astype(np.int64)
        out.append(gathered(ids.values.to_numpy(), starts, ids.value_lengths().to_numpy(), piece, np.maximum(counts, 0), pa.array(counts < 0)))
    offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32())))
    trim()
    return lists


def encode_deduplicated(df: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) by merging each distinct pre-token once; keys may be null and repeat. Null texts give null.

    Chunks of documents are coded by their own distinct pre-tokens and written. Only those distinct ones are shuffled,
    with their chunk; common ones are joined in copies, so none of them is a hot key.
    """
    kind = df.schema[key].dataType.simpleString()
    small_batches(ship(df.sparkSession))
    rows = df.select(F.col(key).alias("__key"), pretokens_of(vocab, F.col(text)).alias("__pieces"))
    coded = written(rows.mapInArrow(_coded, f"chunk long, keys array<{kind}>, sizes array<int>, codes binary, words array<string>"), "coded")
    pieces = coded.select("chunk", F.posexplode("words").alias("at", "piece"))
    distinct = pieces.groupBy("piece").agg(F.count("*").alias("__n"))
    ids = distinct.select("piece", "__n", F.get(F.array(merged(vocab, F.array("piece"), df.sparkSession)), 0).alias("piece_ids"))
    parts = spread_join(pieces, ids, "piece", "__n").groupBy("chunk").agg(F.collect_list(F.struct("at", "piece_ids")).alias("parts"))
    chunks = coded.select("chunk", "keys", "sizes", "codes").join(parts, "chunk", "left")
    rejoined = F.arrow_udf(_uncoded, "array<array<int>>")("sizes", "codes", "parts")  # its batches end at so many bytes; mapInArrow's don't
    return chunks.select("keys", rejoined.alias("ids")).select(F.explode(F.arrays_zip("keys", "ids")).alias("x")).select(F.col("x.keys").alias(key), "x.ids")


def explain_pretokens(df: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, piece, byte_start, byte_len, is_added): every pre-token with its span in the normalized text.

    Starts are summed row by row, without a shuffle; repeated and null keys keep their rows apart.
    """
    ship(df.sparkSession)

    @F.arrow_udf("array<bigint>")
    def starts(sizes: pa.Array) -> pa.Array:
        flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(flat) - flat
        lengths = np.asarray(sizes.value_lengths().fill_null(0)).astype(np.int64)
        first = np.concatenate((before, [0]))[np.minimum(np.cumsum(lengths) - lengths, len(before))]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(before - np.repeat(first, lengths)))

    rows = df.select(key, pretokens_of(vocab, F.col(text)).alias("__pieces"))
    rows = rows.withColumn("__starts", starts(F.transform("__pieces", lambda p: F.octet_length(p))))
    flat = rows.select(key, F.posexplode(F.arrays_zip("__pieces", "__starts")).alias("pos", "x"))
    return flat.select(key, "pos", F.col("x.__pieces").alias("piece"), F.octet_length("x.__pieces").cast("long").alias("byte_len"), F.col("x.__starts").alias("byte_start"), F.col("x.__pieces").isin(sorted(vocab.added)).alias("is_added"))


def tokens_flat(encoded: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, pos, token_id), one row per token."""
    return encoded.select(key, F.posexplode(ids).alias("pos", "token_id"))


def batch_offsets(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", per_block: int = 65_536) -> DataFrame:
    """(doc_pos, offset): running token counts in key order (nulls first), n + 1 rows beginning with 0.

    Sizes are written once, in sampled ranges of the key; sums before each range, one row a range, are added to
    running sums within it. Rows that share a key may be in several ranges, so no task holds all documents.
    """
    sizes = written(encoded.select(F.col(key).alias("k"), F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n")), "sizes")
    blocks = max(1, -(-sizes.count() // per_block))
    order = (F.asc_nulls_first("k"), "n", "row")
    ranged = sizes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    placed = written(ranged.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"), "n"), "ranges")
    drop_written(sizes)
    totals = placed.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("token0"))
    within = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.join(starts, "block").select((F.col("row0") + F.count("*").over(within)).alias("doc_pos"), (F.col("token0") + F.sum("n").over(within)).alias("offset"))
    zero = encoded.sparkSession.range(1).select(F.lit(0).cast("long").alias("doc_pos"), F.lit(0).cast("long").alias("offset"))
    return zero.unionByName(ends)


# -- bytes that may be malformed UTF-8

_MARK = 0xF0000  # stands for a malformed byte: a private-use character, of no letter, digit or space class
_spans: list[tuple[int, int]] = []  # of malformed bytes, in the document that is being read


def _span(error: UnicodeDecodeError) -> tuple[str, int]:
    _spans.append((error.start, error.end))
    return "", error.end


codecs.register_error("tokenframe.spans", _span)


def _lenient(raw: bytes) -> tuple[str, list[int], list[int]]:
    """The characters of a document, with marks for malformed lead bytes and without orphan continuation bytes.

    Then the places among these characters of all malformed leads, and of what each orphan belongs to (-1 at the start).
    """
    _spans.clear()
    text = raw.decode("utf-8", "tokenframe.spans")
    if not _spans:
        return text, [], []
    parts, leads, orphans, at, before = [], [], [], 0, 0
    for start, end in [*_spans, (len(raw), len(raw))]:
        parts.append(raw[before:start].decode("utf-8"))
        at += len(parts[-1])
        for b in raw[start:end]:
            if b & 0xC0 == 0x80:
                orphans.append(at - 1)
            else:
                leads.append(at)
                parts.append(chr(_MARK + b))
                at += 1
        before = end
    return "".join(parts), leads, orphans


def encode_bytes(df: DataFrame, vocab: Vocabulary, raw: str = "bytes", out: str = "ids") -> DataFrame:
    """Adds the ids of BINARY documents that may be malformed.

    A malformed lead byte is a character of its own; orphan continuation bytes go to the pre-token before
    them, and are dropped at a document's start. A sentence-piece vocabulary turns them into byte tokens.
    Where texts must be normalized, malformed documents are an error.
    """
    sent = Sent(ship(df.sparkSession), vocab)
    literal, kind, in_words = literal_pattern(vocab), pa.list_(pa.int32()), not (vocab.sentence_piece or vocab.nfc)

    @F.arrow_udf("array<int>")
    def run(documents: pa.Array) -> pa.Array:
        own = merger(sent)
        if in_words:  # distinct pre-tokens are merged once
            return by_slices(lambda some: own.rows([None if d is None else _bytes_words(own.vocab, literal, d) for d in some.to_pylist()]), kind, documents)
        return by_slices(lambda some: pa.array([None if d is None else bytes_ids(own, literal, d) for d in some.to_pylist()], kind), kind, documents)

    text = F.col(raw).cast("string")
    valid = F.is_valid_utf8(text)  # these are texts like any other; only malformed ones are read byte by byte
    return df.withColumn(out, F.coalesce(ids_of(vocab, F.when(valid, text), df.sparkSession), run(F.when(~valid, F.col(raw)))))


_passes: dict[Family, tuple] = {}


def bytes_ids(own: Merger, literal: str, raw: bytes) -> list[int]:
    """The ids of one document of bytes."""
    vocab = own.vocab
    if vocab.nfc:
        from ..functions.normalize import nfc_between

        raw = nfc_between(raw.decode("utf-8"), re.compile(f"({literal})") if literal else None).encode("utf-8")
    if vocab.sentence_piece:
        return _piece_bytes_ids(own, literal, raw)
    return [i for w in _bytes_words(vocab, literal, raw) for i in ([w] if isinstance(w, int) else own.piece(w))]


def _bytes_words(vocab: Vocabulary, literal: str, raw: bytes) -> list[str | bytes | int]:
    """A document of bytes cut: pre-tokens as text, those with malformed bytes as bytes, literals as ids."""
    if vocab.family not in _passes:
        _passes[vocab.family] = tuple(map(_python, PASSES[vocab.family]))
    text, leads, orphans = _lenient(raw)
    out: list[str | bytes | int] = []
    sizes: list[int] = []
    for i, part in enumerate(re.split(f"({literal})", text) if literal else [text]):
        if i % 2:
            out.append(vocab.added[part])
            sizes.append(len(part))
            continue
        pieces = [part] if part else []
        for p in _passes[vocab.family]:
            pieces = p.findall(pieces[0]) if len(pieces) == 1 else [m for piece in pieces for m in p.findall(piece)]
        out += pieces
        sizes += map(len, pieces)
    if leads or orphans:
        ends, escaped = list(accumulate(sizes)), raw.decode("utf-8", "surrogateescape")
        for k in {bisect_right(ends, at) for at in leads + orphans if at >= 0}:
            if not isinstance(out[k], int):  # orphans after a literal go with it
                a, b = ends[k] - sizes[k], ends[k]
                out[k] = escaped[a + bisect_left(orphans, a) : b + bisect_left(orphans, b)].encode("utf-8", "surrogateescape")
    return out


def _piece_bytes_ids(own: Merger, literal: str, raw: bytes) -> list[int]:
    text = raw.decode("utf-8", "surrogateescape")
    vocab, out = own.vocab, []
    for i, part in enumerate(re.split(f"({literal})", text) if literal else [text]):
        if i % 2:
            out.append(vocab.added[part])
            continue
        first: list[int] = []
        for c in low_bar(part):
            data = c.encode("utf-8", "surrogateescape")
            token = vocab.model_ids.get(data)
            first += [token] if token is not None else [vocab.byte_ids[b] for b in data]
        out += own.heap(first)
    return out
