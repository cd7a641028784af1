"""Importance resampling: documents drawn by how much more likely their words are in a target.

Features of a text are its runs of 1 to ``n`` consecutive words, counted in buckets of their
CRC32. A bucket's gain is the log of its smoothed share in the target over that in the corpus; a
document's weight is the sum of the gains of its features. Weights are perturbed by Gumbel noise
from a hash of the id, and the highest are drawn, which is drawing by weight without replacement.

Within a task, the words of a chunk of documents are numbered, and suffixes of the number
sequence are ordered by their next ``n`` words, up to the document's end. Neighbours in that order
that share k words (the common prefix) belong to one run of the same k-gram, so each different
k-gram of a chunk is hashed once, and its bucket goes back to all the places of its run. Each
document keeps its buckets with counts, on disk, so texts are read once: totals are sums over that
table, by task first, and scores are read off it. Only the gains, one number a bucket, are broadcast.
The draw ranks narrow rows by ranges (``ranks.places``).

Null and empty texts have no features and weight 0. Very long texts are counted whole. Repeated rows
are drawn each on its own; ties go to the smaller id, then fewer features, then any. A null id hashes
as the empty text and comes last among ties. An empty target gives gains from its smoothing alone; an
empty corpus gives no rows. Columns of ``keep`` that are named as results are replaced by them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import places
from .textops import Words, lists, map_text, materialise

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, "2024", 20, 10
#: Bytes of text whose suffixes are ordered together.
CHUNK = 4 << 20
OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def suffixes(number: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a sequence in the order of their next ``n`` numbers, and how many of those each
    shares with the place before it. ``room``: how far it is from each place to its document's end,
    which is less than any number."""
    at, rank, known = np.arange(len(number)), number + 1, 1
    while known < n:
        inside = room > known
        ahead = np.zeros(len(number), np.int64)
        ahead[inside] = rank[at[inside] + known]
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)
        rank, known = rank + 1, 2 * known
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(len(number), np.int64), np.ones(max(0, len(number) - 1), bool)
    for k in range(n):
        a, b = order[:-1], order[1:]
        same &= (room[a] > k) & (room[b] > k)
        same[same] = number[a[same] + k] == number[b[same] + k]
        shared[1:] += same
    return order, shared


def gram_buckets(byte: np.ndarray, off: np.ndarray, n: int, buckets: int) -> list[pa.Array]:
    w = Words(byte, off, hashes=False)
    number, kinds = w.numbered()
    size, doc = np.diff(w.off), w.doc()
    room = w.off[1:][doc] - np.arange(len(number))
    order, shared = suffixes(number, room, n)
    found = []
    for k in range(1, n + 1):
        long = room[order] >= k
        first = (shared < k)[long]
        at = order[long]
        own = [zlib.crc32(b" ".join([kinds[x] for x in g])) % buckets for g in number[at[first][:, None] + np.arange(k)].tolist()]
        if own:
            found.append(doc[at] * buckets + np.array(own)[np.cumsum(first) - 1])
    key, many = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    per = np.bincount(key // buckets, minlength=len(size))
    features = np.bincount(key // buckets, many, len(size)).astype(np.int64)
    return [pa.array(size, pa.int64()), pa.array(features), lists(key % buckets, per, pa.int32()), lists(many, per, pa.int64())]


def counted(docs: DataFrame, keep: list[str], text: str, n: int, buckets: int) -> DataFrame:
    """``keep``, n_words, n_features, and the buckets of a text's features with their counts."""
    return map_text(docs, text, keep, OUT, lambda: lambda byte, off: gram_buckets(byte, off, n, buckets), CHUNK)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's end."""
    return column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def totals(seen: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket: summed in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(held, flat(batch.column(0))[0], flat(batch.column(1))[0])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], names=["bucket", "n"])

    few = seen.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[few.column("bucket").to_numpy()] = few.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths of nats, floors."""
    s, t, smooth = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + smooth) / ((s + 1) * (t.sum() + smooth)))).astype(np.int64)


def importance(docs: DataFrame, target: DataFrame, *, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", n: int = N, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: ``keep`` (default ``doc_id``), n_features, weight, score and rank: 1, 2, ...
    for the ``percent`` of the documents of ``least_words`` or more that are drawn, else null."""
    keep = [c for c in keep or [doc_id] if c not in ("n_features", "weight", "score", "rank")]
    own = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    src = docs.select(*own, F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    seen = materialise(counted(src, [f"__k{i}" for i in range(len(keep))] + ["__id"], "__text", n, buckets))
    gain = gains(totals(seen, buckets), totals(counted(target, [], text, n, buckets), buckets))

    @F.arrow_udf("long")
    def weigh(held: pa.Array, counts: pa.Array) -> pa.Array:
        (bucket, end), (many, _) = flat(held), flat(counts)
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(gain[bucket] * many)])[np.concatenate([[0], end])]))

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = seen.withColumn("weight", weigh("buckets", "counts")).drop("buckets", "counts").withColumn("score", F.col("weight") + noise)
    scored = materialise(scored)
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    placed = places(enough, [F.col("score").desc(), F.col("__id").asc_nulls_last(), F.col("n_features").asc()], name="__place")
    ranked = placed.withColumn("rank", F.when(F.col("__place") < drawn, F.col("__place") + 1)).drop("__place")
    every = ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return every.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance(docs, target)
