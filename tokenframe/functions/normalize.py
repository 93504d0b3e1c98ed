"""Normalization: NFC between literals, behind a JVM test that spares ASCII texts the trip to Python."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Marks and composing characters younger than the upstream library's character data (hexadecimal ranges). To it
#: they are unassigned: nothing is reordered or composed across them, whatever this Python's data says.
_YOUNG = "897 1acf-1add 1ae0-1aeb 105d2 105da 10d69-10d6d 10efa-10efb 11382 11384 1138b 11390 113b8 113bb 113c2 113c9 113ce-113d0 11930 11935 1611e-16120 16129 16d63 16d67 1e5ee-1e5ef 1e6e3 1e6e6 1e6ee-1e6ef 1e6f5"
BARRIERS = re.compile("([" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _YOUNG.split()) + "])")


def composed(text: str) -> str:
    """NFC of the stretches between barriers."""
    if BARRIERS.search(text):
        return "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(BARRIERS.split(text)))
    return unicodedata.normalize("NFC", text)


def nfc_between(text: str, literal: re.Pattern | None) -> str:
    """NFC of every part between literals; literals themselves are left alone, whatever follows them."""
    if unicodedata.is_normalized("NFC", text):
        return text
    if literal is None:
        return composed(text)
    return "".join(p if i % 2 else composed(p) for i, p in enumerate(literal.split(text)))


def nfc(text: Column, literals: str | None = None) -> Column:
    """The text in NFC; `literals` is a pattern of texts that are kept as they are."""
    compiled = re.compile(f"({literals})") if literals else None

    @F.arrow_udf("string")
    def normalize(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else nfc_between(t, compiled) for t in texts.to_pylist()], pa.string())

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(normalize(text))


def is_nfc(text: Column) -> Column:
    """Whether a text is in NFC already."""

    @F.arrow_udf("boolean")
    def check(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.is_normalized("NFC", t) for t in texts.to_pylist()], pa.bool_())

    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lit(True)).otherwise(check(text))
