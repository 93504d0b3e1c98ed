"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, named: DataFrame, key: str, uses: str, per: int = 1 << 20) -> DataFrame:
    """`rows` left-joined with `named`, whose keys are unique and whose column `uses` counts the rows of a key.

    A key of more than `per` rows is joined in copies, one for so many rows. Only these keys are broadcast; there
    is at most one for `per` rows.
    """
    copies = F.ceil(F.col(uses) / per).cast("int")
    hot = named.where(F.col(uses) > per).select(key, copies.alias("__copies"))
    salted = rows.withColumn("__at", F.monotonically_increasing_id()).join(F.broadcast(hot), key, "left")
    salted = salted.withColumn("__salt", F.coalesce(F.pmod("__at", "__copies"), F.lit(0)).cast("int"))
    copied = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(uses)
    return salted.join(copied, [key, "__salt"], "left").drop("__at", "__copies", "__salt")
