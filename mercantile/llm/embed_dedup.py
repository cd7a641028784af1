"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits space by random hyperplanes, level after level; a vector near a hyperplane
goes to both sides (spill), so a close pair is seldom parted. Thresholds come from a bounded
sample of ``SAMPLE_ROWS`` vectors: of places about its median, the one with the least sampled
vectors near, and below the nodes that the sample fills the mean of the last filled one above. A
node whose vectors are nearly all near every threshold (a dense group) is not split further. A label's trees are as deep as its number of vectors asks for, so leaves keep their
size at any scale, and there are as many trees as that depth needs for ``RECALL``: a pair at the
least cosine is parted at a level with the probability ``PARTED``, so it meets in one of t trees
with 1 - (1 - (1 - PARTED) ** depth) ** t. Every vector is indexed.

Vectors meet only within a label and a leaf. A leaf above ``CELL_ROWS`` (a dense group) is dealt
as pairs of blocks, so no task gathers a group of unbounded size. Cosines are computed in double
precision within a task. A pair that meets in several leaves is counted only in the first of
them, which both vectors' lists of leaves tell, so pairs are never shuffled: a leaf gives each
vector's number of links and one link to its local component. Equal vectors of a label are one
row with a count until the end.

Vectors that are null, of zero length or norm, or hold null or non-finite components, and
vectors without a label, link with nothing. Vectors of different lengths link with nothing
(the length belongs to the leaf). Rows with a null vec_id: n_links 0, component null, kept true.
Each row gives one row. Rows that repeat a vec_id are one vector and get one result; if they
differ, the one of the smallest label, then vector hash, stands for them. Of several vectors the
smallest vec_id names a component, so there are no ties. An empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercantile.operators.clusters import components

from .textops import materialise

COSINE = 0.98
LEAF_ROWS = 48
CELL_ROWS = 1024
#: How far spill reaches, as a share of the distance of two unit vectors of the least cosine in
#: one dimension of many, and the share of a node's vectors up to which it may spill.
SPILL, MOST_SPILL = 0.5, 0.3
#: Quantiles of a node's projections that may be its threshold.
CUTS = np.linspace(0.3, 0.7, 17)
#: Probability that a pair of the least cosine is parted at a level: projections of deviation 1
#: differ by 0.2 on average at cosine 0.98, and the spill reaches 0.1 on both sides.
PARTED = 0.0134
RECALL = 0.98
SAMPLE_ROWS = 16_384
#: Sampled vectors from which a node has a threshold of its own, and from which they may show a dense group.
NODE_ROWS, FEW_ROWS = 32, 8
#: Labels up to which their depths are broadcast.
BROADCAST_LABELS = 100_000
MAX_DEPTH = 40


def trees_for(depth: int) -> int:
    return 1 if depth == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - PARTED) ** depth))


class Tree:
    """Hyperplanes by level and node."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, cosine: float):
        self.seed, self.dims = seed, sample.shape[1]
        self.margin = SPILL * math.sqrt(2 * max(0.0, 1 - cosine) / max(1, self.dims))
        #: thresholds of nodes that the sample fills, and mean and margin of those that it last fills;
        #: without a margin such a node is not split
        self.nodes: dict[tuple[int, int], float] = {}
        self.ends: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
        groups = {0: sample}
        for level in range(depth + 1):
            below = {}
            for node, x in groups.items():
                p = x @ self.plane(level, node)
                cuts = np.quantile(p, CUTS) if len(p) else np.zeros(1)
                near = (np.abs(p[:, None] - cuts) < self.margin).mean(0) if len(p) else np.zeros(1)
                cut = float(cuts[np.argmin(near)])
                if len(x) >= FEW_ROWS and near.min() > MOST_SPILL:
                    self.ends[level, node] = x.mean(0), 0.0
                elif level == depth or len(x) < NODE_ROWS:
                    self.ends[level, node] = x.mean(0) if len(x) else np.zeros(self.dims), self.margin
                else:
                    self.nodes[level, node] = cut
                    below[2 * node], below[2 * node + 1] = x[p < cut], x[p >= cut]
            groups = below

    def plane(self, level: int, node: int) -> np.ndarray:
        v = np.random.default_rng([self.seed, level, node]).normal(size=self.dims)
        return v / np.linalg.norm(v)

    def split(self, level: int, node: int, plane: np.ndarray) -> tuple[float, float]:
        if (level, node) in self.nodes:
            return self.nodes[level, node], self.margin
        up, above = level, node
        while (up, above) not in self.ends:
            up, above = up - 1, above >> 1
        mean, margin = self.ends[up, above]
        return float(mean @ plane), margin

    def leaves(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of the rows."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            row, node = row[order], node[order]
            cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(node) else [0]
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                k, own = int(node[a]), row[a:b]
                plane = self.plane(level, k)
                at, margin = self.split(level, k, plane)
                if not margin:
                    out.append((own, np.full(len(own), 2 * k)))
                    continue
                p = x[own] @ plane - at
                for side, go in ((0, p < margin), (1, p >= -margin)):
                    out.append((own[go], np.full(int(go.sum()), 2 * k + side)))
            row, node = (np.concatenate([o[i] for o in out]) if out else row for i in (0, 1))
        return row, node


def clean(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): vectors that can link. Floats stay floats until they are compared."""
    kind = vectors.select(F.col(f"`{embedding}`")).schema[0].dataType
    v = F.col(f"`{embedding}`").cast("array<float>" if kind == T.ArrayType(T.FloatType(), kind.containsNull) else "array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308d) and exists(v, x -> x <> 0)")
    return rows


def unit(batch_column: pa.Array) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(batch_column), -1) if len(batch_column) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def compare(keys, table: pa.Table, cosine: float) -> pa.Table:
    """Links within a cell: block i against block j of a leaf. Gives vec_id, n (links found
    here and in no earlier leaf) and root (the smallest vec_id linked here, over paths)."""
    leaf, i, j = keys[2].as_py(), keys[3].as_py(), keys[4].as_py()
    vec = table.column("rep").to_numpy()
    order = np.argsort(vec, kind="stable")
    vec = vec[order]
    copies = table.column("copies").to_numpy()[order]
    block = table.column("block").to_numpy()[order]
    x = unit(table.column("v").combine_chunks())[order]
    lists = table.column("leaves").combine_chunks()
    flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    width = int(np.diff(off).max()) if len(vec) else 0
    seen = np.full((len(vec), width), -1, np.int64)
    for r, o in enumerate(order.tolist()):
        own = flat[off[o] : off[o + 1]]
        seen[r, : len(own)] = own
    seen = np.where(seen < leaf, seen, -1)  # only earlier leaves matter
    n, root = np.zeros(len(vec), np.int64), np.arange(len(vec))
    for lo in range(0, len(vec), 256):
        a, b = np.nonzero(x[lo : lo + 256] @ x[lo:].T >= cosine - 1e-12)
        a, b = a + lo, b + lo
        keep = a < b
        if i != j:
            keep &= block[a] != block[b]
        a, b = a[keep], b[keep]
        # the exact sum for pairs at the edge
        c = np.einsum("ij,ij->i", x[a], x[b])
        a, b = a[c >= cosine], b[c >= cosine]
        new = np.ones(len(a), bool)
        for k in range(0, len(a), 20_000):
            s, t = seen[a[k : k + 20_000]], seen[b[k : k + 20_000]]
            both = np.zeros(len(s), bool)
            for col in range(width):
                both |= ((s[:, col : col + 1] == t) & (t >= 0)).any(1)
            new[k : k + 20_000] = ~both
        np.add.at(n, a[new], copies[b[new]])
        np.add.at(n, b[new], copies[a[new]])
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            root = find(root)
    some = (n > 0) | (root != np.arange(len(vec)))
    return pa.table({"rep": vec[some], "n": n[some], "root": vec[root[some]]})


def route(full: DataFrame, forest, schema: T.StructType, cosine: float) -> DataFrame:
    """``full`` with the leaves of each vector: tree << 48 | leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            deep = batch.column(4).to_numpy()
            for d, depth in sorted(set(zip(size.tolist(), deep.tolist(), strict=True))):
                own = batch.filter(pa.array((size == d) & (deep == depth)))
                x = unit(own.column(2))
                planted = forest.value.get(d)
                rows, leaves = [np.arange(len(own))] if not depth else [], [np.zeros(len(own), np.int64)] if not depth else []
                for t in range(trees_for(depth) if depth else 0):
                    tree = planted[t] if planted else Tree(np.zeros((0, d)), 0, t, cosine)
                    row, leaf = tree.leaves(x, depth)
                    rows.append(row)
                    leaves.append(np.int64(t) << 48 | leaf)
                row, leaf = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaf, row))
                off = np.searchsorted(row[order], np.arange(len(own) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(4)), pa.ListArray.from_arrays(pa.array(off), pa.array(leaf[order]))], names=schema.fieldNames())

    return full.mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = clean(vectors, vec_id, embedding, label)
    keyed = rows.select("vec_id", "label", "v", F.sha2(F.to_json("v").cast("binary"), 256).alias("same"))
    # one vector for each id; equal vectors of a label count once, and the smallest id stands for them
    one = keyed.groupBy("vec_id").agg(F.min(F.struct("label", "same")).alias("own")).select("vec_id", "own.label", "own.same")
    one = materialise(one)
    reps = materialise(one.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    named = reps.withColumnRenamed("rep", "vec_id")
    full = keyed.join(named, ["vec_id", "label", "same"]).dropDuplicates(["vec_id"])
    counts = materialise(reps.groupBy("label").agg(F.count("*").alias("n")))
    told = counts.agg(F.count("*").alias("labels"), F.max("n").alias("most")).first()

    def deep(n) -> F.Column:
        return F.greatest(F.lit(0), F.least(F.ceil(F.log2(n / leaf_rows)), F.lit(MAX_DEPTH))).cast("int")

    depths = counts.select("label", deep(F.col("n")).alias("depth"))
    if told["labels"] <= BROADCAST_LABELS:
        depths = F.broadcast(depths)
    full = materialise(full.join(depths, "label").select(F.col("vec_id").alias("rep"), "label", "v", "copies", "depth"))
    most = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, (told["most"] or 0) / leaf_rows)))))
    sample = full.where("depth > 0").select("rep", "v", F.size("v").alias("d")).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).toArrow()
    sizes, column = sample.column("d").to_numpy(), sample.column("v").combine_chunks()
    forests = {d: [Tree(unit(column.filter(pa.array(sizes == d))), most, t, cosine) for t in range(trees_for(most))] for d in np.unique(sizes).tolist()}
    schema = T.StructType([full.schema[c] for c in ("rep", "label", "v", "copies")] + [T.StructField("leaves", T.ArrayType(T.LongType()))])
    routed = materialise(route(full, spark.sparkContext.broadcast(forests), schema, cosine))
    spots = routed.select("*", F.size("v").alias("dims"), F.explode("leaves").alias("leaf"))
    large = spots.groupBy("label", "dims", "leaf").agg(F.count("*").alias("rows")).where(f"rows > {cell_rows}")
    large = materialise(large.withColumn("blocks", F.ceil(F.col("rows") / cell_rows).cast("int")))
    if large.isEmpty():
        cells = spots.withColumn("blocks", F.lit(1))
    else:
        cells = spots.join(large, ["label", "dims", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("label", "dims", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "copies", "block", "leaves", "v")
    links = cells.groupBy("label", "dims", "leaf", "i", "j").applyInArrow(lambda k, t: compare(k, t, cosine), T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("root", T.LongType())]))
    links = materialise(links)
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(links, "rep", "root").select(F.col("node").alias("rep"), "component")
    per = materialise(reps.join(counted, "rep", "left").join(found, "rep", "left").select("label", "same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = one.join(per, ["label", "same"]).select(F.col("vec_id").alias("id"), "n_links", "component_id")
    out = vectors.select(F.col(f"`{vec_id}`").alias("vec_id")).join(linked, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
