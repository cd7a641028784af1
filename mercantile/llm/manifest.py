"""A Merkle manifest of a dataset: digests of rows, a tree for each source, a tree over the sources.

A leaf is the SHA-256 of a row's columns, each as ``-`` (null) or its length in bytes, ``:`` and
its value. In each tree every three consecutive nodes become their parent, the SHA-256 of their
digests as hex text, level by level from below until one node is left: the subroot of a source.
Subroots, in the order of their sources (null first, by bytes), give the root in the same way.

Each level is a table on disk. From the top down, the nodes of a level are joined with their
parents; a node's proof is its own siblings before what its parent inherited. A row can then be
checked alone: folding its digest with its proof must give the root.

Rows take their places within a source by ranges (``ranks.places``), so a source that holds most
rows is dealt like any other; joins are by parent, which has three children at most. Texts are
read once and never shuffled. All of it is DataFrame functions.

Repeated rows are leaves each; rows that share source and doc_id stand in the order of their
digests; rows without a doc_id come first in their source. Null and empty texts differ, very long
texts are hashed whole, further columns do not count. An empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercantile.storage import broadcast_if_small

from .ranks import places
from .textops import materialise

#: The columns of a leaf, in their order, and the nodes of a run.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN = 3
PROOF = "array<struct<at:int,siblings:array<string>>>"


def digest(*columns: Column) -> Column:
    """SHA-256, as hex digits, of columns in their own lengths."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The levels of trees, from below: (tree, pos, n, digest, kids), with n nodes in the tree's level
    and the digests that a node was made of. ``leaves``: (tree, pos, n, digest), on disk."""
    levels = [leaves.withColumn("kids", F.lit(None).cast("array<string>"))]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.floor(F.col("pos") / FAN).cast("long")
        few = levels[-1].where("n > 1").groupBy("tree", run.alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids"))
        kids = F.col("kids.digest")
        made = few.select("tree", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.sha2(joined(kids), 256).alias("digest"), kids.alias("kids"))
        levels.append(materialise(made))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    found = None
    for level in levels:
        own = level.where("n = 1").select("tree", "digest")
        found = own if found is None else found.unionByName(own)
    return found


def push(levels: list[DataFrame], given: DataFrame) -> DataFrame:
    """The lowest level with (proof, carried). ``given`` (of, proof, carried) has for each tree the
    proof that its top begins with, and what all its nodes carry. A proof is a list of (at,
    siblings): the node's place in its run, and the digests of the others."""
    above = None
    for level in reversed(levels):
        # a top is the only node of its tree here, so this join is by trees, not by rows
        own = level.where("n = 1").join(given, F.col("tree").eqNullSafe(F.col("of"))).select(*level.columns, "proof", "carried")
        if above is not None:
            parent = above.select(F.col("tree").alias("of"), F.col("pos").alias("up"), F.col("kids").alias("run"), F.col("proof").alias("inherited"), "carried")
            met = level.where("n > 1").join(parent, F.col("tree").eqNullSafe(F.col("of")) & (F.floor(F.col("pos") / FAN).cast("long") == F.col("up")))
            at = F.pmod("pos", F.lit(FAN)).cast("int")
            # a node that is alone in its run has no siblings, but is hashed all the same
            step = F.struct(at.alias("at"), F.filter("run", lambda x, i: i != F.pmod("pos", F.lit(FAN)).cast("int")).alias("siblings"))
            own = own.unionByName(met.select(*level.columns, F.concat(F.array(step), "inherited").alias("proof"), "carried"))
        above = own if level is levels[0] else materialise(own)
    return above


def folded(start: Column, proof: Column) -> Column:
    """The root that a digest and its proof lead to."""

    def step(d: Column, x: Column) -> Column:
        at, others = x["at"], x["siblings"]
        return F.sha2(joined(F.concat(F.slice(others, 1, at), F.array(d), F.slice(others, at + 1, F.size(others) - at))), 256)

    return F.aggregate(proof, start, step)


def manifest(docs: DataFrame, *, columns: list[str] = COLUMNS, source: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: what ``keep`` names, leaf, subroot, root and proof."""
    keep = keep or {order: F.col(f"`{order}`")}
    own = docs.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("kept"), F.col(f"`{source}`").alias("tree"), F.col(f"`{order}`").alias("__order"), digest(*[F.col(f"`{c}`") for c in columns]).alias("digest"))
    placed = materialise(places(own, [F.col("__order").asc_nulls_first(), F.col("digest")], by="tree", name="pos").drop("__order"))
    sizes = placed.groupBy(F.col("tree").alias("of")).agg((F.max("pos") + 1).alias("n"))
    leaves = placed.join(broadcast_if_small(materialise(sizes)), F.col("tree").eqNullSafe(F.col("of"))).drop("of")
    levels = grow(materialise(leaves))
    upper = materialise(places(tops(levels), [F.col("tree").asc_nulls_first()], name="pos"))
    over = grow(upper.select(F.lit(0).alias("tree"), "pos", F.lit(upper.count()).alias("n"), "digest"))
    root = tops(over).select(F.col("tree").alias("of"), F.array().cast(PROOF).alias("proof"), F.col("digest").alias("carried"))
    proofs = push(over, root).select("pos", "proof", F.struct(F.col("digest").alias("subroot"), F.col("carried").alias("root")).alias("carried"))
    given = materialise(upper.select(F.col("tree").alias("of"), "pos").join(proofs, "pos").drop("pos"))
    return push(levels, given).select("kept.*", F.col("digest").alias("leaf"), "carried.subroot", "carried.root", "proof")


def query(spark, sf_dir: str) -> DataFrame:
    """Where 2 divides crc32(doc_id), a row's text is tampered with: its line ends are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    other = digest(*[touched if c == "text" else F.col(c) for c in COLUMNS])
    made = manifest(docs, keep={"doc_id": F.col("doc_id"), "seen": other})
    proof = F.sha2(F.aggregate("proof", F.lit(""), lambda a, x: F.concat(a, joined(x["siblings"]))), 256)
    again = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("seen"), F.col("proof")).alias("folded_root"))
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))
