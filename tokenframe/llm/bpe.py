"""Byte-pair encoding and decoding for vocabularies with word ends, by a pair occurrence index.

Method: the distinct words of a partition's chunk become one long array of symbols, linked to their
neighbours. An index maps every adjacent pair with a merge rank to all its positions. Active ranks are
applied in ascending order, each to all its positions at once; the pairs that a merge creates are added to
the lists of their own ranks, and positions whose pair has changed meanwhile fall out when their rank comes.
Words are encoded once per chunk and kept for the following chunks.

A merge may only be applied everywhere at once if it can't create a pair of a lower or the same rank; this
is checked for every vocabulary when it is loaded, and a vocabulary that fails is merged one position at a time.

Null and empty texts have no ids; decoding no ids gives the empty text. Null doc_ids and repeated rows keep
a row each; an empty table gives none. Ties of rank go to the leftmost pair. Columns other than doc_id and text, whatever
their names, are ignored. Very long texts and words are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, ship, table, text_chunks

#: Words that a worker remembers between chunks; beyond it, it starts afresh.
KEPT_WORDS = 400_000
#: Text bytes of a chunk; every chunk pays once for each rank that is active in it.
CHUNK = 8 << 20
_CONTRACTIONS = ["'" + x for x in "s t re ve m ll d".split()]
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _class(categories: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] in categories)


class WordEncoder:
    """A vocabulary of the kind of word_bpe_49k: NFC, lower case, words and ends of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder") or model.get("unk_token"):
            raise ValueError("a BPE vocabulary with an end-of-word suffix, without decoder and unknown token, is asked for")
        self.path, self.suffix, vocab = path, model["end_of_word_suffix"], model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.added.items()}}
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])]
        self.left, self.right, self.product = (np.array(x, np.int64) for x in zip(*pairs))
        self.base = int(max(self.tokens)) + 1
        keys = self.left * self.base + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        made: dict[int, int] = {}
        for rank, product in enumerate(self.product.tolist()):
            made.setdefault(product, rank)
        self.at_once = all(made.get(x, -1) < rank for rank, (a, b, _) in enumerate(pairs) for x in (a, b))
        latest: dict[int, int] = {}
        for rank, product in enumerate(self.product.tolist()):
            latest[product] = rank
        self.at_once = self.at_once and all(latest.get(x, -1) < rank for rank, (a, b, _) in enumerate(pairs) for x in (a, b))
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letter, number, space = _class("L"), _class("N"), "\\t-\\r\\x20\\x85\\xa0"
        self.words = re.compile(f"{'|'.join(_CONTRACTIONS)}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.wide = re.compile("[^\\x00-\\u017f]").search
        self._library = None

    # -- text to words

    def library(self):
        """The tokenizers library's normalizer and pre-tokenizer, for characters beyond U+017F."""
        if self._library is None:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.path)
            codes = {c: b for b, c in enumerate(_byte_letters())}
            self._library = lambda text: [bytes(map(codes.__getitem__, w)) for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]
        return self._library

    def split(self, text: str) -> list:
        """A text's words: str or UTF-8 bytes, and int for added tokens, which come before everything else."""
        if self.literal and "<|" in text and len(parts := self.literal.split(text)) > 1:
            return [w for part in parts for w in ([self.added[part]] if part in self.added else self.split(part))]
        if text.isascii():
            return self.words.findall(text.lower())
        if self.wide(text):
            return self.library()(text)
        return self.words.findall(unicodedata.normalize("NFC", text).lower())

    # -- words to ids

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or -1."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of non-empty words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbol = self.inner[raw]
        symbol[ends] = self.last[raw[ends]]
        n = len(raw)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[ends - sizes + 1] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}

        def add(positions: np.ndarray) -> list[int]:
            """Enter the pairs that begin at these positions; the ranks that weren't active before."""
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            found = rank >= 0
            rank, positions = rank[found], positions[found]
            if not len(rank):
                return []
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            new = []
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts) if len(cuts) else [positions]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    new.append(r)
            return new

        active = add(np.flatnonzero(after >= 0))
        heapq.heapify(active)
        left, right, product = self.left.tolist(), self.right.tolist(), self.product.tolist()
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = left[rank], right[rank]
            at = at[alive[at] & (symbol[at] == a)]
            to = after[at]
            fits = (to >= 0) & (symbol[to] == b)
            at, to = at[fits], to[fits]
            if a == b and len(at) > 1:  # overlapping pairs of one run: leftmost first, every second one
                follows = np.zeros(len(at), bool)
                follows[1:] = to[:-1] == at[1:]
                starts = np.maximum.accumulate(np.where(follows, -1, np.arange(len(at))))
                keep = (np.arange(len(at)) - starts) % 2 == 0
                at, to = at[keep], to[keep]
            if not self.at_once and len(at) > 1:
                heapq.heappush(active, rank)
                index[rank] = [at[1:]]
                at, to = at[:1], to[:1]
            if not len(at):
                continue
            symbol[at] = product[rank]
            alive[to] = False
            beyond = after[to]
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            previous = before[at]
            changed = np.concatenate((previous[previous >= 0], at[inside]))
            if len(changed):
                for r in add(changed if len(at) == 1 else np.unique(changed)):
                    heapq.heappush(active, r)
        word = np.repeat(np.arange(len(words)), sizes)[alive]
        return symbol[alive], np.bincount(word, minlength=len(words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class ChunkEncoder:
    """Encodes chunks of texts, and keeps the words that it has met."""

    def __init__(self, path: str):
        self.of = encoder(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.ids, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of all texts."""
        if len(self.known) > KEPT_WORDS:
            self.clear()
        known, split = self.known, self.of.split
        at, lengths, fresh = [], [], []
        for text in texts:
            words = split(text) if text else []
            lengths.append(len(words))
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    fresh.append(w)
                at.append(k)
        if fresh:
            plain = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else w for w in fresh if not isinstance(w, int)]
            ids, counts = self.of.merge(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(plain) < len(fresh):
                added = np.array([isinstance(w, int) for w in fresh])
                all_counts = np.ones(len(fresh), np.int64)
                all_counts[~added] = counts
                all_ids = np.zeros(int(all_counts.sum()), np.int64)
                where = np.repeat(added, all_counts)
                all_ids[where] = [w for w in fresh if isinstance(w, int)]
                all_ids[~where] = ids
                ids, counts = all_ids, all_counts
            self.ids = [np.concatenate((*self.ids, ids))]
            self.counts = [np.concatenate((*self.counts, counts))]
        counts = self.counts[0]
        starts = np.cumsum(counts) - counts
        words = np.array(at, np.int64)
        sizes = counts[words]
        text_of = np.repeat(np.arange(len(texts)), lengths)
        return self.ids[0][ranges(starts[words], sizes)].astype("<u4"), np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)


def decode(of: WordEncoder, ids) -> str:
    """The text of some ids, as the library gives it for a vocabulary without decoder: tokens joined by spaces."""
    return " ".join(map(of.tokens.__getitem__, ids.tolist()))


def _rows(path: str, columns):
    """A mapInArrow function: `columns(encoder, ids)` for each text, after its doc_id."""

    def run(batches):
        chunk = ChunkEncoder(path)
        for batch in batches:
            texts = batch.column(1)
            for first, last in text_chunks(texts, CHUNK):
                ids, counts = chunk.encode(texts[first:last].to_pylist())
                ends = np.cumsum(counts)
                yield columns(chunk.of, batch.column(0)[first:last], [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())])

    return run


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of `docs` (doc_id, text)."""
    ship(docs.sparkSession)

    def columns(of, doc_id, each):
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32), np.concatenate([*each, np.zeros(0, "<u4")]).astype(np.int32))
        return pa.RecordBatch.from_arrays([doc_id, lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows(vocabulary or default_vocabulary(), columns), "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of `encoded` (doc_id, ids); null ids give the empty text, unknown ids an error."""
    ship(encoded.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        of = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(of, np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document, the digests of its ids and of the text decoded from those ids."""
    ship(docs.sparkSession)

    def columns(of, doc_id, each):
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array([len(x) for x in each], pa.int64()), pa.array([digest(x.tobytes()) for x in each], pa.string()), pa.array([digest(decode(of, x).encode()) for x in each], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows(vocabulary or default_vocabulary(), columns), ENCODED)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
