"""Supplier checks, trust and scores; customs codes; ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import SMALL_ROWS, broadcast_if_small, materialise

#: Customs headings with the words that speak for them, as SQL rows (code, title, word, weight).
CODE_ROWS = """
('7318.15', 'screws and bolts', 'bolt', 3), ('7318.15', 'screws and bolts', 'screw', 3), ('7318.15', 'screws and bolts', 'steel', 1),
('8483.90', 'gears', 'gear', 3), ('8483.90', 'gears', 'steel', 1), ('7117.19', 'imitation jewellery', 'ring', 3),
('7117.19', 'imitation jewellery', 'red', 1), ('8479.89', 'machines', 'widget', 2), ('8479.89', 'machines', 'gadget', 2),
('8419.50', 'heat exchangers', 'hot', 1), ('8418.69', 'cooling units', 'cold', 1)
"""
CODES_SQL = f"select * from (values {CODE_ROWS}) as t(code, title, word, weight)"


def codes(spark: SparkSession) -> DataFrame:
    return spark.sql(CODES_SQL)


def sums_before(values: DataFrame, column: str, n: str) -> DataFrame:
    """(column, before): the sum of ``n`` over all smaller values. ``values`` has a row a value and is on disk.

    Up to ``SMALL_ROWS`` values are put in order by one task. Beyond, they are dealt by ranges, summed
    within their range and moved by the sums of the ranges before: one row a range meets in one task.
    """
    if values.count() <= SMALL_ROWS:
        upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        return values.select(column, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias("before"))
    dealt = materialise(values.repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("__part").agg(F.sum(n).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__moved"))
    own = Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("__own", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return within.join(F.broadcast(moved), "__part").select(column, (F.col("__own") + F.col("__moved")).alias("before"))


def percent_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the percent rank of ``column`` over the whole table; nulls get null.

    A window without partitions would move the table into one task. Here the different values are
    counted, with partial sums, so that a value of most rows is one row; those are put in order, and
    rows take the rank of their value by a join.
    """
    known = rows.where(F.col(column).isNotNull())
    values = materialise(known.groupBy(column).agg(F.count("*").alias("__n")))
    total = values.agg(F.sum("__n")).first()[0] or 0
    ranked = sums_before(values, column, "__n").select(F.col(column).alias("__v"), "before")
    share = F.col("before").cast("double") / F.lit(float(total - 1)) if total > 1 else F.lit(0.0)
    done = rows.join(broadcast_if_small(materialise(ranked)), F.col(column) == F.col("__v"), "left")
    return done.withColumn(name, F.when(F.col("__v").isNotNull(), share)).drop("__v", "before")


def supplier_facts(suppliers: DataFrame, lines: DataFrame) -> DataFrame:
    """Per supplier: lines, returned share of the quantity, parts offered and balance."""
    quantity = F.col("l_quantity").cast("decimal(12,2)")
    per = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").alias("n_lines"),
        F.sum(quantity).cast("double").alias("quantity"),
        F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0)).cast("double").alias("returned"),
    )
    found = suppliers.select("s_suppkey", "s_nationkey", "s_acctbal").join(per, "s_suppkey", "left")
    return found.select("s_suppkey", "s_nationkey", "s_acctbal", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.try_divide("returned", "quantity").alias("returned_share"))


def verified(facts: DataFrame, *, min_lines: int, max_returned: float) -> DataFrame:
    """Rule columns, and trust: 40 points for enough lines, 35 for few returns, 25 for a balance."""
    enough, few, solvent = F.col("n_lines") >= min_lines, F.coalesce(F.col("returned_share") <= max_returned, F.lit(False)), F.coalesce(F.col("s_acctbal") >= 0, F.lit(False))
    points = F.when(enough, 40).otherwise(0) + F.when(few, 35).otherwise(0) + F.when(solvent, 25).otherwise(0)
    return facts.select("s_suppkey", enough.alias("enough_lines"), few.alias("few_returns"), solvent.alias("solvent"), points.alias("trust"), (enough & few & solvent).alias("verified"))


def supplier_score(facts: DataFrame) -> DataFrame:
    """Half the share not returned, half the percent rank of the number of lines."""
    ranked = percent_ranks(facts, "n_lines", "volume_rank")
    return ranked.select("s_suppkey", "returned_share", "volume_rank", ((F.lit(1.0) - F.coalesce("returned_share", F.lit(1.0))) * 0.5 + F.col("volume_rank") * 0.5).alias("score"))


def suggest_codes(products: DataFrame, headings: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """The heading whose words weigh most in a product's text (ties: the smaller code), or null.

    ``headings`` is broadcast if it is small; a product's words are aggregated by product.
    """
    words = products.select(id_col, F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"))).alias("word"))
    scores = words.join(broadcast_if_small(headings), "word").groupBy(id_col, "code").agg(F.sum("weight").alias("points"))
    best = scores.groupBy(id_col).agg(F.min(F.struct((-F.col("points")).alias("p"), "code")).alias("best"))
    return products.select(id_col).join(best, id_col, "left").select(id_col, F.col("best.code").alias("code"), (-F.col("best.p")).cast("long").alias("points"))
