"""Decoding arrays of ids to bytes or text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..memory import by_slices
from ..session import ship
from ..sources.vocabulary import LOW_BAR, Vocabulary
from .merge import Sent

_BYTE = re.compile(rb"<0x([0-9A-F]{2})>")


class Decoder:
    """Bytes and text of ids; an unknown id is an error."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.bytes = list(map(vocab.tokens.get, range(vocab.size)))
        self.fallback: dict[int, int] = {i: b for b, i in enumerate(vocab.byte_ids)} if vocab.sentence_piece else {}
        self.shown = [None if t is None else t.replace(LOW_BAR.encode(), b" ") for t in self.bytes] if vocab.sentence_piece else self.bytes
        self.single = [bytes((self.fallback[i],)) if i in self.fallback else t for i, t in enumerate(self.shown)]
        self.is_byte = np.isin(np.arange(vocab.size), list(self.fallback))
        self.is_known = np.array([t is not None for t in self.single], bool)

    def _checked(self, ids) -> np.ndarray:
        ids = np.asarray(ids, np.int64)
        inside = (ids >= 0) & (ids < len(self.single))
        known = inside & self.is_known[np.where(inside, ids, 0)] if len(self.single) else inside
        if not known.all():
            raise ValueError(f"id {ids[~known][0]} isn't in the vocabulary")
        return ids

    def _joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.single.__getitem__, ids.tolist()))

    def raw(self, ids) -> bytes:
        return self._joined(self._checked(ids))

    def text(self, ids, errors: str = "strict") -> str:
        ids = self._checked(ids)
        if not self.fallback:
            return self._joined(ids).decode("utf-8", errors)
        of_bytes = self.is_byte[ids]
        if not of_bytes.any():
            return self._joined(ids).decode("utf-8", errors)
        out: list[str] = []
        edges = np.flatnonzero(np.diff(of_bytes)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
            part = self._joined(ids[a:b])
            try:
                out.append(part.decode("utf-8", "strict" if of_bytes[a] else errors))
            except UnicodeDecodeError:  # one replacement for every byte of a malformed run
                if not of_bytes[a]:
                    raise
                out.append("�" * len(part))
        return "".join(out)


def _udf(df: DataFrame, vocab: Vocabulary, kind: str, arrow: pa.DataType, what):
    sent = Sent(ship(df.sparkSession), vocab)
    made: dict[int, Decoder] = {}

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        if 0 not in made:
            made[0] = Decoder(sent.vocab.value)

        def some(own: pa.Array) -> pa.Array:
            if own.values.null_count:  # a null id is an error like any other unknown one
                return pa.array([None if x is None else what(made[0], [-1 if i is None else i for i in x]) for x in own.to_pylist()], arrow)
            flat, ends, valid = own.values.to_numpy(), np.asarray(own.offsets).tolist(), np.asarray(own.is_valid()).tolist()
            return pa.array([what(made[0], flat[a:b]) if there else None for a, b, there in zip(ends, ends[1:], valid)], arrow)

        return by_slices(some, arrow, lists)

    return run


def _kept(vocab: Vocabulary, ids: str, skip_special: bool):
    if not skip_special:
        return F.col(ids)
    special = F.array(*map(F.lit, sorted(vocab.special))) if vocab.special else F.array().cast("array<int>")
    return F.filter(ids, lambda i: ~F.array_contains(special, i))


def decode_bytes(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "bytes", skip_special: bool = False) -> DataFrame:
    """Adds the raw bytes of `ids`. Null gives null, no ids the empty string."""
    return df.withColumn(out, _udf(df, vocab, "binary", pa.binary(), lambda d, x: d.raw(x))(_kept(vocab, ids, skip_special)))


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "text", errors: str = "strict", skip_special: bool = False) -> DataFrame:
    """Adds the text of `ids`. Malformed UTF-8 is an error, or with errors="replace" U+FFFD."""
    return df.withColumn(out, _udf(df, vocab, "string", pa.string(), lambda d, x: d.text(x, errors))(_kept(vocab, ids, skip_special)))
