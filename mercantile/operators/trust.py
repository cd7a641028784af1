"""Trust in suppliers from what their customers keep and return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .skew import dealt_join

#: Trust is in millionths, so that sums are whole numbers and hang on no order.
ONE = 1_000_000


def dealings(lines: DataFrame, *, supplier: str, customer: str, quantity: str, returned: str) -> DataFrame:
    """(supplier, customer, kept, returned) of order lines; ``returned`` is SQL for a line that came back."""
    known = lines.where(F.col(supplier).isNotNull() & F.col(customer).isNotNull() & (F.col(quantity) > 0))
    back, n = F.coalesce(F.expr(returned), F.lit(False)), F.col(quantity).cast("long")
    return known.groupBy(F.col(supplier).alias("supplier"), F.col(customer).alias("customer")).agg(F.sum(F.when(back, 0).otherwise(n)).alias("kept"), F.sum(F.when(back, n).otherwise(0)).alias("returned"))


def mutual_trust(pairs: DataFrame, *, rounds: int = 3) -> DataFrame:
    """(supplier, trust) of ``dealings``, after a fixed number of rounds, from 0 to ``ONE``.

    A supplier's trust is the share of its goods that is kept, weighted by how reliable its customers
    are; a customer is as reliable as its returns agree with the trust in those it bought from. So
    a customer that returns what everybody keeps counts for less. All begin as reliable. A supplier of
    few goods is drawn to the share of all suppliers, by as many goods as the average one has: the prior
    is fitted, and there are no thresholds. Each half round is a join and an aggregation with partial
    sums; suppliers and customers of many pairs are dealt over tasks.
    """
    pairs = materialise(pairs)
    weights = materialise(pairs.select("customer", F.lit(ONE).cast("long").alias("weight")).distinct())
    trusted = pairs.select("supplier", F.lit(0).cast("long").alias("trust")).limit(0)
    wide = "decimal(38,0)"
    for _ in range(rounds):
        met = dealt_join(weights, pairs, ["customer"], by=F.col("supplier"))
        kept, gone = (F.sum((F.col(c) * F.col("weight")).cast(wide)) for c in ("kept", "returned"))
        sums = materialise(met.groupBy("supplier").agg(kept.cast(wide).alias("kept"), (kept + gone).cast(wide).alias("every")))
        n, k, e = sums.agg(F.count("*"), F.sum("kept").cast("string"), F.sum("every").cast("string")).first()
        if not n or not int(e):
            return trusted
        # as many goods as the average supplier has, kept at the rate of all
        prior_every, prior_kept = int(e) // n, int(k) // n
        share = F.expr(f"((kept + {prior_kept}BD) * {ONE}BD) div (every + {prior_every}BD)")
        trusted = materialise(sums.select("supplier", share.cast("long").alias("trust")))
        seen = dealt_join(trusted, pairs, ["supplier"], by=F.col("customer"))
        agreed = F.sum((F.col("kept") * F.col("trust") + F.col("returned") * (ONE - F.col("trust"))).cast(wide)).cast(wide)
        per = seen.groupBy("customer").agg(agreed.alias("agreed"), F.sum((F.col("kept") + F.col("returned")).cast(wide)).cast(wide).alias("every"))
        weights = materialise(per.select("customer", F.expr("agreed div every").cast("long").alias("weight")))
    return trusted


def mutual_trust_sql(pairs: str, rounds: int = 3) -> str:
    """SQL of the same rounds over a table (supplier, customer, kept, returned)."""
    parts = [f"p as ({pairs})", f"w0 as (select distinct customer, cast({ONE} as hugeint) as weight from p)"]
    for i in range(rounds):
        parts.append(f"m{i} as (select supplier, sum(kept * weight) as kept, sum((kept + returned) * weight) as every from p join w{i} using (customer) group by supplier)")
        parts.append(f"a{i} as (select sum(kept) // count(*) as kept, sum(every) // count(*) as every from m{i})")
        parts.append(f"t{i} as (select supplier, ((m.kept + a.kept) * {ONE}) // (m.every + a.every) as trust from m{i} m cross join a{i} a)")
        parts.append(f"w{i + 1} as (select customer, sum(kept * trust + returned * ({ONE} - trust)) // sum(kept + returned) as weight from p join t{i} using (supplier) group by customer)")
    return f"with {', '.join(parts)} select supplier, cast(trust as bigint) as trust from t{rounds - 1}"
