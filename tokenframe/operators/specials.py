"""Special tokens around encoded documents, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.vocabulary import Vocabulary


def _ids(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def add_bos_eos(ids: Column, vocab: Vocabulary, bos: bool = True, eos: bool = True) -> Column:
    """The ids between the vocabulary's opening and closing ids, where it has any."""
    return F.concat(_ids(vocab.bos_ids if bos else ()), ids, _ids(vocab.eos() if eos else ()))


def framed(ids: Column, before=(), after=(), limit: int | None = None) -> Column:
    """Fixed ids around a document's own, cut to a limit where there is one."""
    whole = F.concat(_ids(before), ids, _ids(after))
    return whole if limit is None else F.slice(whole, 1, limit)


def attention_mask(ids: Column) -> Column:
    """A one for every id."""
    return F.transform(ids, lambda _: F.lit(1))
