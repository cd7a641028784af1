"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first 4, 5 and 6 bytes, hashed into 2**20 buckets;
a document has a term or not. Further terms say that a bucket makes up at least one in 256, 64
or 16 of the document's words, as many stems tell only where they are frequent. Pairwise factors let two terms count for more (or less)
together than apart, as an insult and the mention of a group do.

The model is fitted on a sample of at most ``max_train_rows`` labelled rows, the first by a
hash of doc_id, so that the fit is bounded whatever the corpus. Rows whose crc32(doc_id as
text) mod 5 is 0 are never learnt from. Within the sample Spark counts the terms by label
and keeps at most the ``max_terms`` most telling ones, and none whose log-likelihood ratio chance
would bring up among so many terms. Terms that tell nothing by themselves but much together are
found by counting every pair of terms that at least ``PAIR_DOCS`` documents of the sample, and one in
``PAIR_SHARE``, hold: those stay whose joint table tells more than both do alone, beyond chance (at most ``max_terms``, the most
telling). Pairs are dealt over tasks in slices of a fixed number of counters, so the terms may be as many
as they are. The driver gets the numbers of terms with their counts and the sample's occurrences of
those that stay. Every document is scored, from its whole text, in Spark tasks.

Null and empty texts have no terms and get the score of the bias alone. With no labelled
row of both kinds, the score of all is the share of toxic labels (0 without labels). A null
doc_id is held out and not learnt from. Repeated rows give repeated results; a doc_id labelled
more than once has the largest label, and each of its texts is learnt from. Very long texts are
scored whole, an empty table gives no rows. Terms that tell equally much are taken by their
numbers. Columns of ``keep`` that are named as results are replaced by them.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U, Words, lists, map_text, materialise, span_hash, spread

BITS = 20
STEMS = (4, 5, 6)
RATES = (256, 64, 16)
LEVELS = 1 + len(RATES)
MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 2048
#: Documents of the sample that must hold a term, and lack it, for its pairs to be counted: so many, and one in so many.
PAIR_DOCS, PAIR_SHARE = 50, 200
#: Pairs that one task counts.
CELLS = 1 << 23
#: Bytes of dealt terms that a task holds before it sends them.
SENT = 1 << 21
FACTORS = 4
ROUNDS = 150
#: Weight decay, for the pairs that tell by chance among those that are kept.
L2 = 3e-3


def terms(byte: np.ndarray, off: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the distinct terms; only those marked in ``known``, if given.

    A term is level << BITS | bucket. Level 0 says that the bucket occurs, level i that it
    makes up at least one in RATES[i - 1] of the words."""
    w = Words(byte, off)
    doc = w.doc()
    size = w.end - w.start
    base = None if known is None else known.reshape(LEVELS, -1).any(0)
    pairs = []
    for k in (0, *STEMS):
        pick = slice(None) if not k else size > k
        s = w.start[pick]
        h = w.hash if not k else span_hash(w.prefix, s, s + k)
        b = ((h ^ U(k * 0x517CC1B727220A95 % (1 << 64))) * U(0x9E3779B97F4A7C15) >> U(64 - BITS)).astype(np.int64)
        d = doc[pick]
        if base is not None:
            ok = base[b]
            b, d = b[ok], d[ok]
        pairs.append(d << BITS | b)
    pairs, count = np.unique(np.concatenate(pairs), return_counts=True)
    d, b = pairs >> BITS, pairs & ((1 << BITS) - 1)
    words = np.diff(w.off)[d]
    dense = [count * rate >= words for rate in RATES]
    d = np.concatenate([d, *[d[x] for x in dense]])
    b = np.concatenate([b, *[b[x] | i << BITS for i, x in enumerate(dense, 1)]])
    if known is not None:
        ok = known[b]
        d, b = d[ok], b[ok]
    order = np.argsort(d, kind="stable")
    return d[order], b[order]


def featurise(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def make():
        def fn(byte, off):
            d, b = terms(byte, off)
            return [lists(b, np.bincount(d, minlength=len(off) - 1), pa.int32())]

        return fn

    return map_text(docs, text, keep, T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType()))]), make)


class Model:
    """score = sigmoid(bias + sum of w + half the pairwise products of factors v)."""

    def __init__(self, bias: float, bucket: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.bucket, self.w, self.v = bias, bucket, w, v

    def lookup(self) -> np.ndarray:
        at = np.full(LEVELS << BITS, -1, np.int32)
        at[self.bucket] = np.arange(len(self.bucket))
        return at

    @staticmethod
    def raw(bias, w, v, doc, at, n):
        linear = np.bincount(doc, w[at], n)
        s = np.stack([np.bincount(doc, v[at, f], n) for f in range(v.shape[1])], 1)
        q = np.stack([np.bincount(doc, v[at, f] ** 2, n) for f in range(v.shape[1])], 1)
        return bias + linear + 0.5 * (s * s - q).sum(1), s

    def score(self, doc, at, n) -> np.ndarray:
        z, _ = self.raw(self.bias, self.w, self.v, doc, at, n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(doc: np.ndarray, at: np.ndarray, label: np.ndarray, bucket: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, l2: float = L2) -> Model:
    """Adam over all rows of the sample. at: index of each occurrence in ``bucket``."""
    n, m = len(label), len(bucket)
    share = min(max(label.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(m), np.random.default_rng(7).normal(0, 0.05, (m, factors))]
    if not 0 < label.sum() < n:
        return Model(float(theta[0][0]), bucket, theta[1], theta[2] * 0)
    first, second = [x * 0 for x in theta], [x * 0 for x in theta]
    for t in range(1, rounds + 1):
        z, s = Model.raw(theta[0][0], theta[1], theta[2], doc, at, n)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / n
        per = g[doc]
        gw = np.bincount(at, per, m)
        gv = np.stack([np.bincount(at, per * (s[doc, f] - theta[2][at, f]), m) for f in range(factors)], 1)
        for k, grad in enumerate([np.array([g.sum()]), gw + l2 * theta[1], gv + l2 * theta[2]]):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            theta[k] = theta[k] - 0.1 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[0][0]), bucket, theta[1], theta[2])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _surprise(k: F.Column, c: F.Column, p: int, n: int) -> F.Column:
    """Twice the log-likelihood ratio of k toxic among c documents with a term, p among n in all."""
    rate = p / n if n else 0.0
    cells = [(k, c * rate), (c - k, c * (1 - rate)), (p - k, (n - c) * rate), (n - c - p + k, (n - c) * (1 - rate))]
    return 2 * sum((F.when(seen > 0, seen * F.ln(seen / due)).otherwise(0.0) for seen, due in cells), F.lit(0.0))


def _ratio(k: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log-likelihood ratio of k toxic among n documents against the rate of all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log(x / (n * r)), 0.0) for x, r in ((k, rate), (n - k, 1 - rate))]
    return 2 * (parts[0] + parts[1])


def packed(rank: np.ndarray) -> bytes:
    """Ascending numbers by their steps, equal bytes of all together, compressed."""
    steps = np.diff(rank, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4)
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(steps.T).tobytes(), asbytes=True)


def unpacked(raw, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.Codec("zstd", compression_level=1).decompress(raw, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<i4").ravel().astype(np.int64))


def joint_gain(n: int, bad: int, count: tuple[np.ndarray, np.ndarray], toxic: tuple[np.ndarray, np.ndarray], n11: np.ndarray, k11: np.ndarray) -> np.ndarray:
    """What pairs tell beyond both of their terms: of ``n`` documents, ``bad`` toxic, ``count`` and
    ``toxic`` with each term, n11 and k11 with both."""
    rate = bad / n
    alone = sum(_ratio(t, c, rate) + _ratio(bad - t, n - c, rate) for c, t in zip(count, toxic, strict=True))
    n10, k10, n01, k01 = count[0] - n11, toxic[0] - k11, count[1] - n11, toxic[1] - k11
    return _ratio(k11, n11, rate) + _ratio(k10, n10, rate) + _ratio(k01, n01, rate) + _ratio(bad - k11 - k10 - k01, n - n11 - n10 - n01, rate) - alone


def joint_terms(found: DataFrame, counts: DataFrame, n: int, bad: int, most: int, cells: int | None = None) -> np.ndarray:
    """Terms of pairs that tell more together than apart. ``found``: (__y, terms) of the sample; ``counts``:
    (b, c, k), documents and toxic ones with each term."""
    cells = cells or CELLS
    few = max(PAIR_DOCS, n // PAIR_SHARE)
    common = counts.where((F.col("b") < 1 << BITS) & F.col("c").between(few, n - few)).select("b", "c", "k").toArrow()
    # frequent terms first: most of a document's terms are in the first few slices, and few are sent to the others
    common = common.sort_by([("c", "descending"), ("b", "ascending")])
    term, count, toxic = (common.column(x).to_numpy().astype(np.int64) for x in ("b", "c", "k"))
    by = np.argsort(term)
    ordered = term[by]
    v = len(term)
    if v < 2 or not 0 < bad < n:
        return np.zeros(0, np.int64)
    # pair (i, j) of the i-th and a later term is start[i] + j - i - 1
    many = v - 1 - np.arange(v)
    start = np.cumsum(many) - many
    part = start // cells
    least = 2 * math.log(v * v / 2) + 10

    def pieces(batches):
        """(part, y, own, size, ranks): of each document and slice, the ranks of its terms from the slice's
        first one on, and how many of them lie in the slice."""
        for batch in batches:
            for y, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = held.values.to_numpy().astype(np.int64) if held.is_valid else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(ordered, t), v - 1)
                rank = np.sort(by[at[ordered[at] == t]])
                # where the terms of each slice begin, and the end of all; a document without common terms has the end only
                edges = [*np.flatnonzero(np.diff(part[rank], prepend=-1)).tolist(), len(rank)]
                for lo, hi in pairwise(edges):
                    if lo + 1 < len(rank):
                        yield int(part[rank[lo]]), y, hi - lo, len(rank) - lo, packed(rank[lo:])

    def deal(batches):
        held, size = [], 0
        for piece in pieces(batches):
            held.append(piece)
            size += len(piece[4]) + 32
            if size > SENT:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["part", "y", "own", "size", "ranks"])

    def test(key, table):
        lo, hi = np.searchsorted(part, (key[0].as_py(), key[0].as_py() + 1))
        base, size = start[lo], int(many[lo:hi].sum())
        n11, k11 = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for y, own, held, raw in (row for b in table.select(["y", "own", "size", "ranks"]).to_batches() for row in zip(*b.columns, strict=True)):
            y, own, rank = y.as_py(), own.as_py(), unpacked(raw.as_buffer(), held.as_py())
            later = len(rank) - 1 - np.arange(own)
            step = max(1, (1 << 20) // len(rank))
            for x in range(0, own, step):
                # a document holds a pair once, so no counter is named twice
                i, m = np.arange(x, min(own, x + step)), later[x : x + step]
                cell = np.repeat(start[rank[i]] - base - rank[i] - 1, m) + rank[spread(i + 1, m)]
                n11[cell] += 1
                if y:
                    k11[cell] += 1
        gain: dict[int, float] = {}
        for i in range(lo, hi):
            own = slice(int(start[i] - base), int(start[i] - base + many[i]))
            g = joint_gain(n, bad, (np.full(many[i], count[i]), count[i + 1 :]), (np.full(many[i], toxic[i]), toxic[i + 1 :]), n11[own], k11[own])
            for j in np.flatnonzero(g > least).tolist():
                for t in (i, i + 1 + j):
                    gain[t] = max(gain.get(t, 0.0), float(g[j]))
        return pa.table({"term": pa.array([int(term[t]) for t in gain], pa.int64()), "gain": pa.array(list(gain.values()), pa.float64())})

    dealt = found.select(F.col("__y").cast("int").alias("y"), "terms").mapInArrow(deal, "part int, y int, own int, size int, ranks binary")
    told = dealt.groupBy("part").applyInArrow(test, "term long, gain double").groupBy("term").agg(F.max("gain").alias("gain"))
    return np.array(sorted(r["term"] for r in told.orderBy(F.desc("gain"), "term").limit(most).collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train_rows: int = MAX_TRAIN_ROWS, max_terms: int = MAX_TERMS) -> Model:
    rows = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label)).alias("__y"))
    sample = rows.orderBy(F.xxhash64("__id"), "__id").limit(max_train_rows)
    ids = docs.join(F.broadcast(sample), docs[doc_id] == sample["__id"]).select("__id", "__y", F.col(f"`{text}`").alias("__t"))
    # an id may have many rows; those of the sample's first ids are taken, up to the bound
    ids = ids.orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__t")).limit(max_train_rows) if ids.count() > max_train_rows else ids
    found = materialise(featurise(ids, "__t", ["__id", "__y"]))
    totals = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("__y"), F.lit(0)).alias("p")).first()
    n, p = totals["n"], totals["p"]
    counts = materialise(found.select("__y", F.explode("terms").alias("b")).groupBy("b").agg(F.count("*").alias("c"), F.sum("__y").alias("k")).where("c >= 2"))
    least = 2 * np.log(max(counts.count(), 1))
    telling = counts.withColumn("g", _surprise(F.col("k"), F.col("c"), p, n)).where(F.col("g") > least).orderBy(F.desc("g"), "b").limit(max_terms)
    chosen = np.union1d(np.array([r["b"] for r in telling.collect()], np.int64), joint_terms(found, counts, n, p, max_terms))
    kept = F.array_intersect("terms", F.lit(chosen.tolist()).cast("array<int>"))
    got = found.select(F.col("__y").cast("double").alias("y"), kept.alias("t")).toArrow()
    t = got.column("t").combine_chunks()
    at = np.searchsorted(chosen, t.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(t.offsets.to_numpy())) if n else np.zeros(0, np.int32)
    return fit(doc, at, got.column("y").to_numpy(), chosen)


def toxicity(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row for each document: ``keep`` (default doc_id), score (0 to 1), predicted (score >= 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id=doc_id, text=text, label=label))

    def make():
        m = model.value
        at = m.lookup()
        known = at >= 0

        def fn(byte, off):
            d, b = terms(byte, off, known)
            s = m.score(d, at[b], len(off) - 1)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return fn

    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_text(docs, text, keep or [doc_id], out, make)


def query(spark, sf_dir: str) -> DataFrame:
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
