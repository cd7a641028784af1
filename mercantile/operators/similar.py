"""The same product under different titles: a join of sets by weighted similarity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialise
from .skew import dealt_join

#: Sets that meet by a key above which one more token joins the key, and tokens of a key at most.
HOT_TOKEN, KEY_TOKENS = 256, 3


@dataclass(frozen=True)
class Matches:
    """``members`` (id, rep): each row and the first row of its group with the same tokens.
    ``pairs`` (a, b, shared, total): representatives of different groups that are similar, with the
    weights of what they share and of all their tokens."""

    members: DataFrame
    pairs: DataFrame


def title_tokens(title: Column) -> Column:
    """The different runs of letters, digits and # of a lower-cased title."""
    return F.array_distinct(F.filter(F.split(title, r"[^\p{L}\p{N}#]+"), lambda x: x != ""))


def weighed(sets: DataFrame) -> DataFrame:
    """(rep, group, token, df, w, rest, total) of sets (rep, group, tokens): a token in few sets weighs
    more, by one for each halving of its share; ``rest`` is the weight of it and all commoner ones."""
    each = materialise(sets.select("rep", "group", F.explode("tokens").alias("token")))
    held = each.groupBy("token").agg(F.count("*").alias("df"))
    n = sets.count()
    known = dealt_join(held, each, ["token"], by=F.col("rep"))
    w = F.length(F.bin(F.expr(f"{n} div df"))).cast("long")
    along = Window.partitionBy("rep").orderBy(F.col("df").desc(), F.col("token").desc())
    rest = F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("w", w).select("rep", "group", "token", "df", "w", rest.alias("rest"), F.sum("w").over(Window.partitionBy("rep")).alias("total"))


def longer_keys(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """``rows`` (rep, group, total, body, key, at, held), whose key ends at place ``at`` of the body and weighs
    ``held``, with each key of one more token that may be the next that is shared, or ``""`` where the key may be all.
    ``most``: what a set can share whose first shared tokens are the key; ``short``: enough for sets that weigh no less."""
    num, den = least
    enough = F.col("total") * num
    later = F.transform("body", lambda x, i: F.struct(x["token"].alias("token"), i.alias("at"), (F.col("held") + x["rest"]).alias("most"), (F.col("held") + x["w"]).alias("held")))
    later = F.filter(later, lambda x: (x["at"] > F.col("at")) & (x["most"] * den >= enough))
    alone = F.struct(F.lit("").alias("token"), F.size("body").alias("at"), F.col("held").alias("most"), F.col("held").alias("held"))
    ends = F.filter(F.array(alone), lambda x: (F.size("key") > 0) & (x["most"] * den >= enough))
    more = rows.select("rep", "group", "total", "body", "key", F.explode(F.concat(ends, later)).alias("x"))
    return more.select("rep", "group", "total", "body", F.concat("key", F.array("x.token")).alias("key"), "x.at", "x.held", "x.most", (F.col("x.most") * (num + den) >= enough * 2).alias("short"))


def keyed_sets(bodies: DataFrame, least: tuple[int, int], hot: int) -> DataFrame:
    """The sets with the keys by which they meet: a token, and more of them while a key is crowded."""
    rows = bodies.select("*", F.array().cast("array<string>").alias("key"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("held"))
    done = []
    for _ in range(KEY_TOKENS - 1):
        rows = materialise(longer_keys(rows, least))
        crowded = rows.where("element_at(key, -1) <> ''").groupBy("key").agg(F.count("*").alias("k"), F.count_if("short").alias("s")).where(f"k > {hot} and s > 0").select("key")
        crowded = materialise(crowded)
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        crowded = broadcast_if_small(crowded)
        done.append(rows.join(crowded, "key", "left_anti"))
        rows = rows.join(crowded, "key", "left_semi")
    return reduce(DataFrame.unionByName, [*done, longer_keys(rows, least)])


def similar_sets(rows: DataFrame, *, id_col: str, group: str, tokens: str, least: tuple[int, int] = (7, 10), hot: int | None = None) -> Matches:
    """Pairs of token sets of different groups whose weighted Jaccard similarity is ``least`` (a
    fraction) or more.

    Rows of a group with equal sets are one, named by the smallest id. Tokens are put in order of
    rarity. If two sets are similar, what they share weighs at least that fraction of each, so the
    rarest token that they share is among the first of both: those before the rest weighs too little
    (the prefix; of the set that weighs less or, of equal weights, has the smaller id, a shorter one, as what two sets share must weigh that
    fraction of all that they hold). Sets meet by tokens of their prefixes only, and are dropped there if their weights
    differ too much or if what can still follow the token is too little (its position). A token
    by which more than ``hot`` sets meet is joined with a second one: the next that the two share, which
    the same reasoning bounds, or none if the first alone may do; then with a third. Keys that still are hot are dealt
    over tasks. Pairs are verified by all their tokens. Weights are whole numbers, so nothing is rounded.

    Rows without id, group or tokens are in no pair; each is its own representative.
    """
    num, den = least
    hot = hot or HOT_TOKEN
    own = rows.select(F.col(id_col).alias("id"), F.col(group).alias("group"), F.array_sort(F.array_distinct(F.filter(F.col(tokens), lambda x: x.isNotNull()))).alias("tokens"))
    own = materialise(own)
    usable = "id is not null and `group` is not null and size(tokens) > 0"
    sets = materialise(own.where(usable).groupBy("group", "tokens").agg(F.min("id").alias("rep")))
    named = own.join(sets, ["group", "tokens"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    bodies = weighed(sets).groupBy("rep").agg(F.first("group").alias("group"), F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("df", "token", "w", "rest"))).alias("body"))
    keyed = materialise(keyed_sets(materialise(bodies), least, hot))
    # of two sets, the lighter meets the other by its short prefix
    light = keyed.where("short").select("key", *[F.col(c).alias(f"{c}_l") for c in ("rep", "group", "total", "most")], F.transform("body", lambda x: x["token"]).alias("names"))
    heavy = keyed.select("key", *[F.col(c).alias(f"{c}_h") for c in ("rep", "group", "total", "most")], F.transform("body", lambda x: F.struct(x["token"].alias("token"), x["w"].alias("w"))).alias("body"))
    shared = F.aggregate(F.filter("body", lambda x: F.array_contains("names", x["token"])), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    both = F.col("total_l") + F.col("total_h")
    ordered = (F.col("total_l") < F.col("total_h")) | ((F.col("total_l") == F.col("total_h")) & (F.col("rep_l") < F.col("rep_h")))
    near = (F.col("group_l") != F.col("group_h")) & ordered & (F.col("total_l") * den >= F.col("total_h") * num) & (F.least("most_l", "most_h") * (num + den) >= both * num)
    # files of keys are small for their rows, so the join is a shuffle whatever their size
    met = dealt_join(light, heavy, ["key"], by=F.col("rep_h"), hint="merge").where(near)
    turned = F.col("group_l") > F.col("group_h")
    a, b = (F.when(turned, F.col(f"rep_{x}")).otherwise(F.col(f"rep_{y}")) for x, y in ("hl", "lh"))
    found = met.select(a.alias("a"), b.alias("b"), shared.alias("shared"), both.alias("both")).where(F.col("shared") * (num + den) >= F.col("both") * num)
    pairs = found.distinct().select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("total"))
    return Matches(named, pairs)
