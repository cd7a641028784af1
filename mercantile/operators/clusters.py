"""Matching of the same product across offers, and clusters of what matches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import broadcast_if_small, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing changes. Groups are
    only reduced to their minimum, with partial aggregation, and joined back; no group of
    neighbours is gathered. Each round is written to the shared folder. Self links and null
    ends are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e)
    before = None
    while True:
        # large star: larger neighbours of each node go to the smallest of it and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of each node, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialise(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def price_clusters(offers: DataFrame, *, id_col: str, keys: list[str], price: str, tolerance: float) -> DataFrame:
    """(id, cluster_id): offers that agree in ``keys`` and whose prices form a chain of steps of
    ``tolerance`` at most; the smallest id of a chain names it.

    In one dimension chains are runs without a wider gap, so no offers are paired. Prices of one
    cell of the tolerance's width are near each other; cells are reduced to their least and
    largest prices within tasks, and only cells are put in order, not the offers of a product.
    Offers with a null id, key or price are clusters of their own.
    """
    cell = F.floor(F.col(price) / F.lit(tolerance)).cast("long")
    known = F.lit(True)
    for c in (id_col, *keys, price):
        known = known & F.col(c).isNotNull()
    own = offers.select(id_col, *keys, F.when(known, cell).alias("cell"), F.col(price).alias("__price"))
    cells = own.where("cell is not null").groupBy(*keys, "cell").agg(F.min("__price").alias("lo"), F.max("__price").alias("hi"), F.min(id_col).alias("first"))
    along = Window.partitionBy(*keys).orderBy("cell")
    fresh = F.when(F.col("lo") - F.lag("hi").over(along) <= tolerance, 0).otherwise(1)
    runs = cells.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    named = runs.withColumn("cluster_id", F.min("first").over(Window.partitionBy(*keys, "run"))).select(*keys, "cell", "cluster_id")
    return own.join(named, [*keys, "cell"], "left").select(id_col, F.coalesce("cluster_id", id_col).alias("cluster_id"))


def exact_clusters(rows: DataFrame, *, id_col: str, keys: list[str]) -> DataFrame:
    """(cluster_id, n_members): groups of two or more rows that are equal in ``keys``.

    An aggregation with partial sums: a group of any size is a running minimum and a count. Strings are
    grouped by their SHA-256, so that long ones aren't shuffled.
    """
    kinds = dict(rows.dtypes)
    short = [F.sha2(F.col(k), 256).alias(k) if kinds[k] == "string" else F.col(k) for k in keys]
    return rows.select(id_col, *short).groupBy(*keys).agg(F.min(id_col).alias("cluster_id"), F.count("*").alias("n_members")).where("n_members > 1").select("cluster_id", "n_members")


#: Keys by which a fingerprint is looked up, and the share of pairs that are compared.
MOST_KEYS, MOST_SHARE = 2000, 0.05


@dataclass(frozen=True)
class Blocks:
    """Cuts of a fingerprint into blocks of bits, (lowest bit, width, radius) each: two fingerprints
    within the distance agree in one block but for ``radius`` bits at most."""

    cuts: tuple[tuple[int, int, int], ...]

    @property
    def keys(self) -> int:
        """How many keys a fingerprint is looked up by."""
        return sum(comb(w, k) for _, w, r in self.cuts for k in range(r + 1))

    @property
    def share(self) -> float:
        """Of pairs of random fingerprints, those that meet."""
        return sum(sum(comb(w, k) for k in range(r + 1)) / 2**w for _, w, r in self.cuts)


def blocks(width: int, distance: int, rows: int) -> Blocks:
    """A cut that makes few keys and candidates for so many fingerprints: at most ``MOST_KEYS`` a
    fingerprint, and of those cuts rather one by which at most ``MOST_SHARE`` of pairs meet.

    If radii and one for each block add up to more than the distance, no two fingerprints within it
    can differ by more than its radius in every block. Few wide blocks have many neighbouring keys but
    few chance meetings, many narrow ones the reverse, so the best cut hangs on the number of rows.
    """
    best = None
    for m in range(1, min(width, distance + 1) + 1):
        edges = [width * i // m for i in range(m + 1)]
        # distance + 1 is dealt out over the blocks, wider ones first
        order = sorted(range(m), key=lambda i: edges[i] - edges[i + 1])
        radii = [(distance + 1) // m - 1] * m
        for i in order[: (distance + 1) % m]:
            radii[i] += 1
        cut = Blocks(tuple((edges[i], edges[i + 1] - edges[i], radii[i]) for i in range(m)))
        price = cut.keys > MOST_KEYS, cut.share > MOST_SHARE, rows * cut.keys + rows * rows * cut.share / 2
        if best is None or price < best[0]:
            best = price, cut
    return best[1]


def flips(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits of which at most ``radius`` are set."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


#: Fingerprints of either side that a task compares, about.
LEFT_PRINTS, RIGHT_PRINTS = 1 << 15, 1 << 17
#: Fingerprints that are looked up at once, and candidates of them that are held, unless one alone has more.
AT_ONCE, MOST_HELD = 512, 1 << 22
#: Bits of a block up to which its keys are looked up in a table.
TABLE_BITS = 20


def meetings(xa: np.ndarray, xb: np.ndarray, distance: int, cut: Blocks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in xa, place in xb, bits) of the pairs within the distance, once each; all of one place
    in ``xa`` come together. Each block of ``xa`` looks up all near keys among those of ``xb``."""
    U = np.uint64
    if len(xb) <= cut.keys:
        cut = Blocks(((0, 0, 0),))  # one key that all have: fewer comparisons than lookups

    def key(x: np.ndarray, at: int, w: int) -> np.ndarray:
        return x >> U(at) & U((1 << w) - 1)

    index = []
    for at, w, r in cut.cuts:
        own = key(xb, at, w)
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange((1 << w) + 1, dtype=U)) if w <= TABLE_BITS else None
        index.append((order, own[order], edges, np.array(flips(w, r), U)))

    def some(lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, seen = xa[lo:hi], []
        for (at, w, _), (_, known, edges, flip) in zip(cut.cuts, index, strict=True):
            asked = (key(a, at, w)[:, None] ^ flip).ravel()
            first, end = (edges[asked], edges[asked + U(1)]) if edges is not None else (np.searchsorted(known, asked, side) for side in ("left", "right"))
            hit = np.flatnonzero(end > first)
            seen.append((hit // len(flip), first[hit], (end - first)[hit]))
        if hi - lo > 1 and sum(int(n.sum()) for _, _, n in seen) > MOST_HELD:
            yield from some(lo, (lo + hi) // 2)
            yield from some((lo + hi) // 2, hi)
            return
        found = []
        for k, ((place, first, n), (order, *_)) in enumerate(zip(seen, index, strict=True)):
            i = np.repeat(place, n)
            j = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(i))]
            far = np.bitwise_count(a[i] ^ xb[j])
            near = far <= distance
            i, j, far = i[near], j[near], far[near]
            # a pair counts in the first block that agrees
            met = np.zeros(len(i), bool)
            for at, w, r in cut.cuts[:k]:
                met |= np.bitwise_count(key(a[i] ^ xb[j], at, w)) <= r
            found.append((i[~met] + lo, j[~met], far[~met].astype(np.int32)))
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))

    for lo in range(0, len(xa), AT_ONCE):
        yield from some(lo, min(lo + AT_ONCE, len(xa)))


def nearest(i: np.ndarray, far: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` nearest of each i, the least ``rank`` of equally near ones."""
    order = np.lexsort((rank, far, i))
    along = i[order]
    starts = np.flatnonzero(np.diff(along, prepend=-1))
    return order[np.arange(len(along)) - np.repeat(starts, np.diff(starts, append=len(along))) < most]


def _met(left: DataFrame, right: DataFrame, on: list[str], distance: int, cut: Blocks, *, most: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of both sides, with columns x_a and x_b, whose fingerprints are within the distance, once
    each, and their ``distance``. Both sides are dealt by their fingerprints into slices of bounded
    size, and each pair of slices meets in a task (``meetings``). With ``most``, of each pair of slices only
    that many nearest of each row of ``left``, the least ``order`` of the right first. ``left`` holds a
    fingerprint once."""
    own = [c for c in left.columns if c not in on]
    other = [c for c in right.columns if c not in on]

    def sliced(side: DataFrame, name: str, size: int) -> DataFrame:
        return side.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    parts = broadcast_if_small(sliced(left, "__na", LEFT_PRINTS).join(sliced(right, "__nb", RIGHT_PRINTS), on))

    def dealt(side: DataFrame, x: str, mine: str, theirs: str) -> DataFrame:
        part = F.pmod(F.xxhash64(x), F.col(f"__n{mine}")).cast("int").alias(f"__{mine}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"__n{theirs}") - 1)).alias(f"__{theirs}")
        return side.join(parts, on).select(*side.columns, part, every)

    both = dealt(left, "x_a", "a", "b").unionByName(dealt(right, "x_b", "b", "a"), allowMissingColumns=True)
    schema = T.StructType([*(left.schema[c] for c in (*on, *own)), *(right.schema[c] for c in other), T.StructField("distance", T.IntegerType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b = (table.filter(pc.is_valid(table.column(x))) for x in ("x_a", "x_b"))
        if not len(a) or not len(b):
            return
        bits = [t.column(x).to_numpy().astype(np.int64).view(np.uint64) for t, x in ((a, "x_a"), (b, "x_b"))]
        rank = None if most is None else pc.rank(b.column(order).combine_chunks(), tiebreaker="dense").to_numpy()
        a, b = a.select([*on, *own]), b.select(other)
        for i, j, far in meetings(*bits, distance, cut):
            if most is not None:
                few = nearest(i, far, rank[j], most)
                i, j, far = i[few], j[few], far[few]
            met = pa.Table.from_arrays([*a.take(i).columns, *b.take(j).columns, pa.chunked_array([pa.array(far)])], names=schema.fieldNames())
            yield from met.combine_chunks().to_batches()

    return both.groupBy(*on, "__a", "__b").applyInArrow(compare, schema)


def one_each(rows: DataFrame, id_col: str, bits: str, by: str | None) -> DataFrame:
    """(by, x, rep, n): the different fingerprints, their smallest id and their number of rows."""
    own = rows.select(F.col(id_col).alias("id"), F.col(bits).alias("x"), (F.lit(0) if by is None else F.col(by)).alias("by"))
    return materialise(own.where("x is not null and `by` is not null").groupBy("by", "x").agg(F.min("id").alias("rep"), F.count("*").alias("n")))


def hamming_pairs(rows: DataFrame, *, id_col: str, bits: str, by: str | None, distance: int, width: int = 64, cut: Blocks | None = None) -> DataFrame:
    """(a, b, n_a, n_b, distance): pairs of different fingerprints at most ``distance`` bits apart.

    Equal fingerprints of a ``by`` group count as one, named by their smallest id, with the
    number of rows. The rest meet by blocks of bits (``blocks``): one side looks up all keys near
    its own, so candidates are few.
    """
    one = one_each(rows, id_col, bits, by)
    cut = cut or blocks(width, distance, one.count())
    left, right = (one.select("by", *[F.col(c).alias(f"{c}_{s}") for c in ("x", "rep", "n")]) for s in "ab")
    met = _met(left, right, ["by"], distance, cut).where("rep_a < rep_b")
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "n_a", "n_b", "distance")


def nearest_hashes(queries: DataFrame, index: DataFrame, *, id_col: str, bits: str, distance: int, k: int, by: str | None = None, width: int = 64) -> DataFrame:
    """(query, place, id, distance): for each query fingerprint, itself left out, the ``k`` nearest ids
    of the index within ``distance`` bits; ties go to the smaller id. Equal fingerprints of the index
    are found as one, by their smallest id or, if that is the query, by their largest.

    For image search, ``index`` are hashes of product images and ``queries`` those of the asked ones.
    """
    asked = queries.select(F.col(id_col).alias("query"), F.col(bits).alias("x_a"), (F.lit(0) if by is None else F.col(by)).alias("by")).where("x_a is not null and `by` is not null")
    own = index.select(F.col(id_col).alias("id"), F.col(bits).alias("x_b"), (F.lit(0) if by is None else F.col(by)).alias("by")).where("x_b is not null and `by` is not null")
    two = own.groupBy("by", "x_b").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    two = materialise(two)
    prints = asked.select("by", "x_a").distinct()
    # one more than asked: the query itself may be among them
    met = _met(materialise(prints), two, ["by"], distance, blocks(width, distance, two.count()), most=k + 1, order="lo")
    few = met.groupBy("by", "x_a").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", F.col("lo").alias("id"), "hi"))), 1, k + 1).alias("found"))
    every = asked.join(few, ["by", "x_a"]).select("query", F.explode("found").alias("f")).select("query", "f.distance", F.when(F.col("f.id") != F.col("query"), F.col("f.id")).when(F.col("f.hi") != F.col("query"), F.col("f.hi")).alias("id"))
    ranked = every.where("id is not null").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")))
    return ranked.where(F.col("place") <= k).select("query", "place", "id", "distance")
