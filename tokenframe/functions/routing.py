"""Content and size classes of texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_multilingual(text: Column) -> Column:
    """Whether over one byte in 64 begins a non-ASCII character outside U+2000 to U+207F."""
    return F.regexp_count(text, F.lit(r"[^\x{0}-\x{7F}\x{2000}-\x{207F}]")) * 64 > F.octet_length(text)


def size_class(n_bytes: Column) -> Column:
    """The least power of two that holds the bytes and 1024 more, 4096 at least; exact up to 2**31."""
    n = n_bytes.cast("long") + 1024
    # the position of the highest bit of n - 1 gives the exponent without floating point
    exponent = F.length(F.bin(F.greatest(n - 1, F.lit(4095).cast("long"))))
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))
