"""The best sources by several aims at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Different values of trust up to which each is a level.
MOST_LEVELS = 128
#: Offers of a task, about.
TASK_ROWS = 250_000
#: Parts that the offers of one product, trust and quantity are dealt to before they meet.
PARTS = 64


def skyline(offers: DataFrame, *, product: str, cost: str, trust: str, quantity: str, supplier: str) -> DataFrame:
    """(product, cost, trust, quantity, supplier): for each product the offers that no other one beats,
    that is, none costs no more, is trusted no less and serves no smaller quantity, and is better in one of these.
    Of offers equal in all three the smallest supplier stands. Nulls in any of them are left out.

    Nothing is compared in pairs, and no offer is copied. Offers are first reduced to the cheapest of each product, trust and
    quantity, in parts, so a product of any number of offers is a grid. By falling quantity, then falling trust, all that may
    beat an offer come before it; running minima, one for each level of trust (there are few, which is checked), tell
    what the cheapest of those that are trusted as much costs. Tasks are as many as the offers ask for, so what
    one sorts does not grow with the table.
    """
    known = offers.select(F.col(product).alias("product"), F.col(cost).alias("cost"), F.col(trust).alias("trust"), F.col(quantity).alias("quantity"), F.col(supplier).alias("supplier")).dropna()
    counted = known.groupBy("trust").agg(F.count("*").alias("n")).limit(MOST_LEVELS + 1).collect()
    if len(counted) > MOST_LEVELS:
        raise ValueError("trust must have few levels: round it first")
    levels, tasks = sorted(r["trust"] for r in counted), max(1, -(-sum(r["n"] for r in counted) // TASK_ROWS))
    cheapest = F.min(F.struct("cost", "supplier"))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("supplier"), F.lit(PARTS))).repartition(tasks, "product", "trust", "quantity", "part")
    few = dealt.groupBy("product", "trust", "quantity", "part").agg(cheapest.alias("best")).select("product", "trust", "quantity", "best.*")
    cells = few.repartition(tasks, "product").groupBy("product", "trust", "quantity").agg(cheapest.alias("best"))
    along = Window.partitionBy("product").orderBy(F.col("quantity").desc(), F.col("trust").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kind = known.schema["trust"].dataType
    beaten = F.lit(None).cast(known.schema["cost"].dataType)
    for level in levels:
        at = F.lit(level).cast(kind)
        beaten = F.when(F.col("trust") == at, F.min(F.when(F.col("trust") >= at, F.col("best.cost"))).over(along)).otherwise(beaten)
    kept = cells.withColumn("beaten", beaten).where(F.col("beaten").isNull() | (F.col("best.cost") < F.col("beaten")))
    return kept.select("product", "best.cost", "trust", "quantity", "best.supplier")
