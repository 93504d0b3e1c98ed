"""Pre-tokenization as Column expressions: literals first, then the family's passes, all in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import PASSES, Family

_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}])")


def _quoted(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def split_literals(text: Column, literals: list[str]) -> Column:
    """The text cut before and after every literal, longest first; pieces are literals or texts between them."""
    if not literals:
        return F.filter(F.array(text), lambda x: x != "")
    either = "|".join(_quoted(x) for x in sorted(literals, key=lambda x: (-len(x), x)))
    return F.filter(F.split(text, f"(?={either})|(?<={either})", -1), lambda x: x != "")


def cut(text: Column, family: Family) -> Column:
    """The pre-tokens of a text without literals."""
    first, *rest = PASSES[family]
    pieces = F.regexp_extract_all(text, F.lit(first), F.lit(0))
    for pattern in rest:
        pieces = F.flatten(F.transform(pieces, _extract(pattern)))
    return pieces


def _extract(pattern: str):
    return lambda piece: F.regexp_extract_all(piece, F.lit(pattern), F.lit(0))


def pretokens(text: Column, family: Family, literals: list[str]) -> Column:
    """All pre-tokens in order; a literal is one of them. Null gives null, the empty text an empty array."""
    whole = cut(text, family)
    if not literals:
        return whole
    parts = F.transform(split_literals(text, literals), lambda s: F.when(s.isin(literals), F.array(s)).otherwise(cut(s, family)))
    some = F.lit(False)
    for start in sorted({x[:2] for x in literals}):
        some = some | text.contains(start)
    return F.when(text.isNull(), F.lit(None)).when(some, F.flatten(parts)).otherwise(whole)
