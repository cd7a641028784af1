"""Landed cost, margins, exchange rates and the choice of a source.

All formulas are this project's own definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Country, duty, VAT and shipping a unit, as SQL rows. Made-up rates: override them.
PROFILE_ROWS = """
('TR', 0.20, 0.20, 4.50), ('DE', 0.04, 0.19, 5.20), ('NL', 0.04, 0.21, 5.00), ('GB', 0.05, 0.20, 5.80),
('AE', 0.05, 0.05, 6.10), ('US', 0.08, 0.00, 7.40), ('PL', 0.04, 0.23, 4.90), ('RO', 0.04, 0.19, 4.70)
"""
COUNTRIES = ["TR", "DE", "NL", "GB", "AE", "US", "PL", "RO"]
#: Rows of rates that each product may meet.
MOST_COUNTRIES = 300
#: Rates a user has set; nulls leave the profile's.
OVERRIDE_ROWS = "('TR', 0.10, null, null), ('US', null, 0.07, 6.00), ('PL', 0.00, 0.08, 3.00)"
_RATES = "select country, cast(duty as double) duty, cast(vat as double) vat, cast(ship as double) ship from (values {}) as t(country, duty, vat, ship)"
PROFILES_SQL, OVERRIDES_SQL = _RATES.format(PROFILE_ROWS), _RATES.format(OVERRIDE_ROWS)


def profiles(spark: SparkSession) -> DataFrame:
    """Eight countries, of fixed size; safe to broadcast."""
    return spark.sql(PROFILES_SQL)


def overridden(rates: DataFrame, own: DataFrame) -> DataFrame:
    """Rates, with those that a user has set in place of the profile's."""
    mine = own.select("country", *[F.col(c).alias(f"own_{c}") for c in ("duty", "vat", "ship")])
    return rates.join(mine, "country", "left").select("country", *[F.coalesce(f"own_{c}", c).alias(c) for c in ("duty", "vat", "ship")])


def landed(price: Column, duty: Column, vat: Column, ship: Column) -> Column:
    """Cost of a unit in the target country: (price + ship) x (1 + duty) x (1 + vat)."""
    return (price + ship) * (F.lit(1.0) + duty) * (F.lit(1.0) + vat)


def vat_margin(sale: Column, cost: Column, vat: Column) -> Column:
    """Share of the sale price without VAT that is left after the cost; null for a sale of 0."""
    return F.try_divide(F.try_divide(sale, F.lit(1.0) + vat) - cost, F.try_divide(sale, F.lit(1.0) + vat))


def best_source(offers: DataFrame, *, by: list[str], cost: str, tiebreak: list[str], carry: list[str] = ()) -> DataFrame:
    """The offer of least cost of each group; ties go to the least ``tiebreak``.

    A minimum over structs: Spark reduces within tasks before the shuffle, so a product with
    any number of offers costs one row a task, where a ranking would shuffle every offer.
    """
    one = offers.groupBy(*by).agg(F.min(F.struct(cost, *tiebreak, *carry)).alias("best"))
    return one.select(*by, *[F.col(f"best.{c}").alias(c) for c in (cost, *tiebreak, *carry)])


def cheapest_per_origin(offers: DataFrame, *, product: str, origin: str, price: str, supplier: str) -> DataFrame:
    """As landed cost only depends on price and origin, and grows with the price, an origin's
    cheapest offer is all that any target country needs."""
    return best_source(offers, by=[product, origin], cost=price, tiebreak=[supplier])


def landed_best(offers: DataFrame, rates: DataFrame, *, product: str, origin: str, price: str, supplier: str) -> DataFrame:
    """The cheapest landed supplier of each product for each target country; goods from the
    target itself bear no duty. ``rates`` has a row a country, checked to be at most ``MOST_COUNTRIES``."""
    if rates.limit(MOST_COUNTRIES + 1).count() > MOST_COUNTRIES:
        raise ValueError("rates must have a row a country")
    few = cheapest_per_origin(offers, product=product, origin=origin, price=price, supplier=supplier)
    every = few.crossJoin(F.broadcast(rates))  # at most countries x countries rows a product
    duty = F.when(F.col(origin) == F.col("country"), F.lit(0.0)).otherwise(F.col("duty"))
    cost = every.withColumn("landed", landed(F.col(price), duty, F.col("vat"), F.col("ship")))
    return best_source(cost, by=[product, "country"], cost="landed", tiebreak=[supplier])


def price_chain(prices: DataFrame, *, product: str, at: str, price: str) -> DataFrame:
    """Each product's price steps: one row for each time it was priced (the least price then),
    with the price before and the change."""
    steps = prices.groupBy(product, at).agg(F.min(price).alias("price"))
    before = F.lag("price").over(Window.partitionBy(product).orderBy(at))
    return steps.select(product, at, "price", before.alias("before")).withColumn("change", F.col("price") - F.col("before"))


def quantity_tiers(prices: DataFrame, *, product: str, quantity: str, price: str, edges: list[float]) -> DataFrame:
    """Least unit price of each product for each tier of quantity (tier i: from edges[i] on)."""
    tier = F.lit(0)
    for i, edge in enumerate(edges):
        tier = F.when(F.col(quantity) >= edge, F.lit(i)).otherwise(tier)
    return prices.withColumn("tier", tier).groupBy(product, "tier").agg(F.min(price).alias("unit_price"), F.count("*").alias("n_prices"))


def asof_join(left: DataFrame, right: DataFrame, *, by: str, left_at: str, right_at: str, value: str, bucket_seconds: int = 86_400) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before it, of the same ``by``.

    Time is cut into buckets, so a task holds one key's bucket, not a key's whole history. A
    bucket's first rows take what the buckets before carried over: the last value of each
    bucket, carried along the few buckets of a key. Of several right rows at one time the
    largest value counts; null times and values are never taken.
    """

    def bucket(c: str) -> Column:
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000)).cast("long")

    names = left.columns
    rates = right.where(F.col(right_at).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(right_at).alias("__at")).agg(F.max(value).alias("__v"))
    asked = left.select(F.struct(*names).alias("__row"), F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(None).cast(rates.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__left"))
    every = rates.select(F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), "__by", "__at", "__v", F.lit(0).alias("__left")).unionByName(asked).withColumn("__bucket", bucket("__at"))
    within = Window.partitionBy("__by", "__bucket").orderBy("__at", "__left").rowsBetween(Window.unboundedPreceding, 0)
    near = every.withColumn("__near", F.last("__v", ignorenulls=True).over(within)).where("__left = 1")
    lasts = every.groupBy("__by", "__bucket").agg(F.max_by("__v", F.when(F.col("__left") == 0, F.col("__at"))).alias("__last"))
    along = Window.partitionBy("__by").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("__by", "__bucket", F.last("__last", ignorenulls=True).over(along).alias("__carried"))
    out = near.join(carried, ["__by", "__bucket"], "left")
    return out.select("__row.*", F.coalesce("__near", "__carried").alias(f"asof_{value}"))
