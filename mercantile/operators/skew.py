"""Joins in which a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small

#: Rows of a key above which it is dealt over several tasks.
HOT_ROWS = 4096


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], *, by: Column, limit: int | None = None, hint: str | None = None) -> DataFrame:
    """The inner join on columns ``on``. A key with more than ``limit`` rows of ``right`` is dealt by
    ``by`` over one task for each ``limit`` of them, and its rows of ``left`` go to all of those. Both
    sides are read twice, so hand over written tables. ``hint`` names the join's strategy. Null keys meet nothing."""
    limit = limit or HOT_ROWS
    parts = F.ceil(F.count("*") / limit).cast("int").alias("__parts")
    hot = right.groupBy(*on).agg(parts).where("__parts > 1")
    if hot.isEmpty():
        return (left.hint(hint) if hint else left).join(right, on)
    hot = broadcast_if_small(hot)
    many = F.coalesce("__parts", F.lit(1))
    spread = right.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(by), many).cast("int")).drop("__parts")
    copied = left.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__parts")
    return (copied.hint(hint) if hint else copied).join(spread, [*on, "__part"]).drop("__part")
