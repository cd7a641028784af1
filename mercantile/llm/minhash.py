"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is the set of its runs of five words (of all its words, where it has fewer), each
with the weight 1 + floor(log2(its count)), so that a line repeated without end does not drown
the rest. Each element's weight gives it as many unit cells; darts fall on a cell as a Poisson process
along the rank axis, derived from a hash of element and cell alone, so equal elements of two
documents see the same darts. Only darts below a rank that is inverse to the document's
weight are thrown, about k ln k + 3k a document whatever its length; each dart lands in one
of k coordinates, and the earliest of each makes the signature. Two signatures agree in a
coordinate with the probability of their weighted Jaccard similarity.

Bands of the signature are joined. Copies (equal word sequences) are first reduced to one
representative by an aggregation. Within a band, documents are paired with a few pivots, not
with each other; the pairs are verified by the exact weighted Jaccard similarity and joined
to classes. Then, in bands that still hold more than one class, every document is compared with
those of other classes, so no link between bandmates that would join two classes is lost. Such
a band is dealt out as pairs of blocks of bounded rows and bytes; a task counts the common
elements of two blocks with matrix products and gives one link a document, never its pairs. Joins
by band deal a band of many documents over several tasks.

Copies are told by 128 bits of a digest of their words, shingles by 64-bit digests of theirs. Words
are as in the decontamination. Null texts and texts without words link with nothing and
are classes of their own. Rows with a null doc_id are left out of classes: class_id null, kept
true. Repeated rows are copies of each other and get the same class. Where one doc_id has several
texts, each row gets the class of its own text's copies, and the text of the smallest digest
stands for the id in links. Very long texts are read whole; ties go to the smaller id; an empty
table has no rows. Columns other than the two named do not count and are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercantile.operators.clusters import components

from .textops import U, Words, hot_join, hot_limit, lists, map_text, materialise, mix, windows

SHINGLE = 5
SIMILARITY = 0.8
K, ROWS = 100, 5
PIVOTS = 3
#: Blocks of a band that still holds several classes: about so many documents, and bytes of their cells.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Columns of the matrices that count common cells.
COLUMNS = 4096


def elements(byte: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words; document and hash of each cell, by document: a shingle's n-th occurrence in its
    document, for n a power of two."""
    w = Words(byte, off, hashes=False)
    h = w.digest()
    n = np.diff(w.off)
    many = np.where(n >= size, n - size + 1, 0)
    sh = windows(h, size)
    first = np.repeat(w.off[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc = [np.repeat(np.arange(len(n)), many)]
    val = [sh[first]]
    for k in range(1, size):
        own = np.flatnonzero(n == k)
        if len(own):
            each = h[w.off[own][:, None] + np.arange(k)]
            out = np.full(len(own), k, U)
            for j in range(k):
                out = mix(out * U(0x9FB21C651E98DF25) + each[:, j])
            doc.append(own)
            val.append(out)
    doc, val = np.concatenate(doc), np.concatenate(val)
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    same = np.zeros(len(val), bool)
    same[1:] = (val[1:] == val[:-1]) & (doc[1:] == doc[:-1])
    if same.any():
        at = np.arange(len(val))
        nth = at - np.maximum.accumulate(np.where(same, 0, at))
        val = np.where(nth > 0, mix(val + nth.astype(U) * U(0xA24BAED4963EE407)), val)
        keep = (nth + 1 & nth) == 0
        doc, val = doc[keep], val[keep]
    return w, doc, val


def signatures(doc: np.ndarray, cell: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """(docs, k) of uint64: rank bits and dart hash of the earliest dart of each coordinate."""
    none = np.iinfo(U).max
    sig = np.full(docs * k, none, U)
    weight = np.bincount(doc, minlength=docs)
    top = (k * np.log(k) + 3 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        live = todo[doc]
        d, c = doc[live], cell[live]
        t = np.zeros(len(d))
        done, m = 0, 2
        while len(d):
            n = np.arange(done, done + m).astype(U)
            h = mix(c[:, None] + (n + U(1)) * U(0xD1342543DE82EF95))
            rank = t[:, None] + np.cumsum(-np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53), 1)
            hit = rank < top[d][:, None]
            row, col = np.nonzero(hit)
            dart = mix(h[row, col] ^ U(0x5851F42D4C957F2D))
            value = rank[row, col].astype(np.float32).view(np.uint32).astype(U) << U(32) | (dart & U(0xFFFFFFFF))
            np.minimum.at(sig, d[row] * k + ((dart >> U(32)) % U(k)).astype(np.int64), value)
            go = hit[:, -1]
            d, c, t = d[go], c[go], rank[go, -1]
            done, m = done + m, min(2 * m, 256)
        todo &= (sig.reshape(docs, k) == none).any(1)
        top = top * 2
    return sig.reshape(docs, k)


def profile(docs: DataFrame, doc_id: str, text: str, k: int, rows: int) -> DataFrame:
    """(doc_id, copy_a, copy_b, bands): 128 bits of a digest of the word sequence, null without words."""

    def make():
        def fn(byte, off):
            w, doc, cell = elements(byte, off)
            n = np.diff(w.off)
            sig = signatures(doc, cell, len(n), k)
            bands = np.stack([windows(sig[:, b : b + rows].ravel(), rows)[::rows] + U(b) for b in range(0, k, rows)], 1) if len(n) else np.zeros((0, k // rows), U)
            copy = w.copies()
            empty = n == 0
            per = np.where(empty, 0, k // rows)
            return [pa.array(copy[:, 0].copy(), mask=empty), pa.array(copy[:, 1].copy(), mask=empty), lists(mix(bands[~empty]).view(np.int64).ravel(), per, pa.int64())]

        return fn

    out = T.StructType([T.StructField("copy_a", T.LongType()), T.StructField("copy_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return map_text(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"], out, make)


def cells_of(docs: DataFrame) -> DataFrame:
    """(doc_id, cells): the sorted cells as binary."""

    def make():
        def fn(byte, off):
            w, doc, cell = elements(byte, off)
            cell = cell[np.lexsort((cell, doc))]
            at = np.searchsorted(doc, np.arange(len(off)))
            raw = cell.astype("<u8").tobytes()
            return [*(pa.array(w.copies()[:, i].copy()) for i in (0, 1)), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())]

        return fn

    own = [T.StructField("copy_a", T.LongType()), T.StructField("copy_b", T.LongType()), T.StructField("cells", T.BinaryType())]
    return map_text(docs, "text", ["doc_id"], T.StructType(own), make)


def first_text(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a doc_id: of its texts, the one of the smallest digest."""
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct("copy_a", "copy_b")).alias("x")).select("doc_id", "x.*")


def verified(pairs: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is at least that asked for."""
    both = pairs.join(cells.select(F.col("doc_id").alias("a"), F.col("cells").alias("x")), "a").join(cells.select(F.col("doc_id").alias("b"), F.col("cells").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), "<u8")
                y = np.frombuffer(batch.column(3)[i].as_buffer(), "<u8")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                j = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[j] == y).sum())
                ok[i] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def across(keys, table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): links between documents of different classes in two blocks of a band, reduced to
    one for each document (to the smallest it reaches here)."""
    table = table.sort_by("doc_id")
    ids, c, block = (table.column(x).to_numpy() for x in ("doc_id", "c", "block"))
    parts = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("cells").combine_chunks()]
    size = np.array([len(x) for x in parts])
    _, at = np.unique(np.concatenate(parts), return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, row = at[order], np.repeat(np.arange(len(parts)), size)[order]
    common = np.zeros((len(parts), len(parts)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        x, y = np.searchsorted(at, (lo, lo + COLUMNS))
        m = np.zeros((len(parts), COLUMNS), np.float32)
        m[row[x:y], at[x:y] - lo] = 1
        common += m @ m.T
    near = np.triu(common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9, 1)
    a, b = np.nonzero(near)
    keep = (c[a] != c[b]) & ((block[a] != block[b]) | (keys[1].as_py() == keys[2].as_py()))
    a, b = a[keep], b[keep]
    root = np.arange(len(parts))
    while not (root[a] == root[b]).all():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not (root[root] == root).all():
            root = root[root]
    some = root != np.arange(len(parts))
    return pa.table({"a": ids[root[some]], "b": ids[some]})


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, k: int = K, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest doc_id of its class), kept
    (doc_id = class_id)."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    seen = materialise(profile(docs, "doc_id", "text", k, rows))
    known = seen.where("doc_id is not null and copy_a is not null")
    copies = materialise(known.groupBy("copy_a", "copy_b").agg(F.min("doc_id").alias("rep")))
    bands = known.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = first_text(bands, "bands").select("doc_id", F.explode("bands").alias("band"))
    # bands of one document go; the others get a few pivots each
    order = [F.struct(F.lit(0).alias("h"), "doc_id")] + [F.struct(F.xxhash64("doc_id", F.lit(i)).alias("h"), "doc_id") for i in range(1, PIVOTS)]
    pivots = materialise(bands.groupBy("band").agg(F.count("*").alias("n"), *[F.min(x).alias(f"p{i}") for i, x in enumerate(order)]).where("n > 1").select("band", "n", F.array_distinct(F.array(*[f"p{i}.doc_id" for i in range(PIVOTS)])).alias("pivots")))
    limit, by = hot_limit(pivots, "n"), F.xxhash64("doc_id")
    shared = materialise(hot_join(bands, pivots, "band", "n", by, limit).select("band", "doc_id", "pivots"))
    star = shared.select("doc_id", F.explode("pivots").alias("p")).where("doc_id <> p").select(F.least("doc_id", "p").alias("a"), F.greatest("doc_id", "p").alias("b")).distinct()
    star = materialise(star)
    involved = shared.select("doc_id").distinct()
    cells = materialise(cells_of(docs.join(involved.hint("shuffle_hash"), "doc_id", "left_semi")).transform(first_text, "cells"))
    links = materialise(verified(star, cells, similarity))
    found = materialise(components(links))
    label = found.select(F.col("node").alias("doc_id"), "component")
    marked = shared.select("band", "doc_id").join(label, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    open_bands = materialise(marked.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "n"))
    rest = materialise(hot_join(marked, open_bands, "band", "n", by, limit).join(cells.select("doc_id", F.octet_length("cells").alias("bytes")), "doc_id"))
    blocks = rest.groupBy("band").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = hot_join(rest, materialise(blocks), "band", "n", by, limit).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).join(cells, "doc_id")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "c", "block", "cells")
    more = materialise(dealt.groupBy("band", "i", "j").applyInArrow(lambda k, t: across(k, t, similarity), links.select(F.col("a"), F.col("b")).schema))
    if not more.isEmpty():
        found = materialise(components(links.unionByName(more)))
    label = found.select(F.col("node").alias("rep"), "component")
    classes = materialise(copies.join(label, "rep", "left").select("copy_a", "copy_b", F.coalesce("component", "rep").alias("class_id")))
    out = seen.select("doc_id", "copy_a", "copy_b").join(classes, ["copy_a", "copy_b"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
