"""Places of rows in an order over a whole table, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.storage import broadcast_if_small

from .textops import materialise


def places(rows: DataFrame, order: list[Column], *, by: str | None = None, name: str = "place") -> DataFrame:
    """``rows`` and ``name``: the place of each, from 0, among those equal in ``by`` (null is a value
    like others; default: all rows), in ``order``. Ties take places as they come, so name enough
    columns for them not to matter.

    Rows are dealt by ranges of ``by``, ``order`` and their place in the input, so that equal
    rows too are split over tasks; each range is sorted in its task and written. A row's place is its
    number there, moved by the rows of its group in the ranges before: one sum for each range and
    group is all that is put in order.
    """
    group = [F.lit(0).alias("__by") if by is None else F.col(f"`{by}`").alias("__by")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select("*", *group).withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col("__by").asc_nulls_first(), *order, F.col("__tie")]
    dealt = own.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__tie")
    dealt = materialise(dealt).withColumn("__range", F.shiftright("__at", 33))
    runs = dealt.groupBy("__range", "__by").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    moved = materialise(runs.select(F.col("__range").alias("__r"), F.col("__by").alias("__b"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__move")))
    found = dealt.join(broadcast_if_small(moved), (F.col("__range") == F.col("__r")) & F.col("__by").eqNullSafe(F.col("__b")))
    return found.withColumn(name, F.col("__at") + F.col("__move")).drop("__by", "__at", "__range", "__r", "__b", "__move")
