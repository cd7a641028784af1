"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary: the target model counts the documents marked as
target, the background model all others. The models are matched: the background's counts are
scaled to the target's number of words, so that smoothing weighs the same in both, and a document
is scored by counts without its own. The score of a document is the mean over its words of the
target model's loss minus the background model's loss, in nats; the lower, the more the document
resembles the target.

Counts are exact and whole: every word and bigram of every document counts and scores, however
rare. Documents are dealt into blocks of about ``BLOCK`` bytes, as many as the corpus needs. A
block counts its distinct words and bigrams and sends each range of keys to one task, which sums
them over all blocks and answers each block with the sums of its own keys, in their order. So a
block holds all it needs to score its documents, and nothing is gathered or broadcast: what a
task holds hangs on the size of a block, and what is sent grows with the corpus. The block is a
hash of the row, so that counting and scoring see the same rows; only rows equal in all columns
meet in one.

The probability of a word is ``lam * c(prev, word) / c(prev) + (1 - lam) * flat`` with
``flat = (c(word) + 1) / (N + V + 1)``, with V distinct words of the corpus; where the word before
is unseen by the model or absent, it is ``flat``. Hashes of 63 bits stand for words and bigrams.

Null and empty texts have no words: losses and score 0. Without target documents, or without
others, that model is uniform. A null target mark counts as not target. Rows are scored each on its
own, repeated ones too, each of which still counts for the others. Very long texts are scored
whole, an empty table gives no rows, and ties do not arise. Columns of ``keep`` that are named as
results are replaced by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U, Words, chunks, mix

#: Bytes of text that are counted and scored together.
BLOCK = 16 << 20
LAMBDA = 0.6
#: Columns of what blocks send and get back.
SENT = ["part", "block", "n", "own_words", "words", "key", "own", "total"]
ANSWERED = ["part", "block", "n", "kinds", "own_words", "words", "own", "total"]


def keys(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each word, of each bigram by its second word, and whether that has a first one."""
    h = w.digest()
    inner = np.ones(len(h), bool)
    inner[w.off[:-1][np.diff(w.off) > 0]] = False
    prev = np.concatenate([h[:1], h[:-1]])
    two = mix(prev * U(0x9FB21C651E98DF25) + h) & ~U(1)
    return (h | U(1)).view(np.int64), two.view(np.int64), inner


OUT = T.StructType([T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))])


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes, compressed with equal places of all together."""
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True) if len(x) else b""


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(pa.Codec("zstd", compression_level=1).decompress(raw, 8 * n, asbytes=True), np.uint8).reshape(8, n).T).view(np.int64).ravel()


def places(spark: SparkSession, n: int) -> list[int]:
    """Numbers that Spark's hash deals one to each of ``n`` partitions."""
    got = spark.range(30 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).toArrow()
    found: dict[int, int] = {}
    for i, at in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        found.setdefault(at, i)
    return sorted(found.values())


def block_keys(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a block: keys of words, keys of bigrams by their second word, whether that
    has a first one, the number of words of each row, and the row of each word."""
    parts = []
    for column in table.column(text).chunks:
        for _, _, byte, off in chunks(column):
            w = Words(byte, off, hashes=False)
            parts.append((*keys(w), np.diff(w.off)))
    one, two, inner, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return one, two, inner, n, np.repeat(np.arange(len(n)), n)


def own_counts(doc: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each entry's document holds what the entry is."""
    pair = doc.astype(np.int64) << 32 | of
    _, inverse, many = np.unique(pair, return_inverse=True, return_counts=True)
    return many[inverse]


def lm_scores(docs: DataFrame, *, keep: list[str] | None = None, text: str = "text", target: str = "target", lam: float = LAMBDA, block: int = BLOCK) -> DataFrame:
    """One row for each document: ``keep`` (default doc_id), n_tokens, target_loss, background_loss, score."""
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    size = docs.agg(F.sum(F.octet_length(f"`{text}`")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = places(spark, n_blocks)
    keep = [c for c in keep if c not in OUT.fieldNames()]
    body = text if text in keep else "__text"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`").alias(body)]), F.coalesce(F.col(target).cast("boolean"), F.lit(False)).alias("__target"))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    at = F.pmod(F.xxhash64(*hashed), F.lit(len(ids))).cast("int")
    dealt = rows.withColumn("__block", F.element_at(F.lit(ids).cast("array<bigint>"), at + 1)).repartition(n_blocks, "__block")
    schema = T.StructType([rows.schema[c] for c in keep] + list(OUT))
    ends = np.array([(k << 64) // n_blocks for k in range(1, n_blocks)], np.uint64)

    def ranges(key: np.ndarray) -> np.ndarray:
        """Where each range of keys starts, and the end, in sorted keys."""
        return np.concatenate([[0], np.searchsorted(key.view(U), ends), [len(key)]])

    def counts(table: pa.Table) -> pa.Table:
        one, two, inner, n, doc = block_keys(table, body)
        mark = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column("__target").chunks]).astype(bool)[doc]
        key, inverse = np.unique(np.concatenate([one, two[inner]]).view(U), return_inverse=True)
        total = np.bincount(inverse, minlength=len(key))
        own = np.bincount(inverse[np.concatenate([mark, mark[inner]])], minlength=len(key))
        cut = ranges(key)
        parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        step = np.diff(key, prepend=U(0))
        # ranges begin anew: their first key is sent whole
        first = cut[:-1][cut[:-1] < len(key)]
        step[first] = key[first]
        words = [0] * len(parts), [0] * len(parts)
        words[0][0], words[1][0] = int(mark.sum()), len(one)
        data = [pa.array(range(len(parts)), pa.int32()), pa.array([table.column("__block")[0].as_py()] * len(parts), pa.int64()), pa.array([b - a for a, b in parts], pa.int64()), *(pa.array(w, pa.int64()) for w in words)]
        return pa.Table.from_arrays([*data, *(pa.array([pack(x[a:b]) for a, b in parts], pa.binary()) for x in (step, own, total))], names=SENT)

    def sums(table: pa.Table) -> pa.Table:
        """The sums over all blocks of each key of a range, for each block in the order of its own keys."""
        n = table.column("n").to_numpy()
        raw = {c: table.column(c).to_pylist() for c in ("key", "own", "total")}
        key = np.concatenate([np.cumsum(unpack(x, k).view(U)) for x, k in zip(raw["key"], n.tolist(), strict=True)])
        key, inverse = np.unique(key, return_inverse=True)
        back, cut = [], np.concatenate([[0], np.cumsum(n)]).tolist()
        for c in ("own", "total"):
            each = np.concatenate([unpack(x, k) for x, k in zip(raw[c], n.tolist(), strict=True)])
            # whole numbers below 2**53 in doubles
            all_blocks = np.bincount(inverse, each, len(key)).astype(np.int64)[inverse]
            back.append(pa.array([pack(all_blocks[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()))
        kinds = int((key & U(1)).sum())
        fixed = [pa.array([x] * len(n), pa.int64()) for x in (kinds, *(int(table.column(c).to_numpy().sum()) for c in ("own_words", "words")))]
        return pa.Table.from_arrays([table.column("part").combine_chunks(), table.column("block").combine_chunks(), table.column("n").combine_chunks(), *fixed, *back], names=ANSWERED)

    def scores(table: pa.Table, answers: pa.Table) -> pa.Table:
        one, two, inner, n, doc = block_keys(table, body)
        key, inverse = np.unique(np.concatenate([one, two]).view(U), return_inverse=True)
        known_key = np.zeros(len(key), bool)  # a row's first word has a bigram's key, which nobody counted
        known_key[inverse[: len(one)]] = known_key[inverse[len(one) :][inner]] = True
        place = np.flatnonzero(known_key)
        answers = answers.sort_by("part")
        sent = answers.column("n").to_numpy()
        if len(sent) != n_blocks or not np.array_equal(sent, np.diff(ranges(key[place]))):
            raise RuntimeError("the rows of a block were not the same when they were counted and scored")
        kinds, *words = (int(answers.column(c).to_numpy().sum()) for c in ("kinds", "own_words", "words"))
        i, j = inverse[: len(one)], inverse[len(one) :]
        mark = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column("__target").chunks]).astype(bool)
        known = {}
        for name in ("own", "total"):
            c = np.zeros(len(key))
            c[place] = np.concatenate([unpack(x, k) for x, k in zip(answers.column(name).to_pylist(), sent.tolist(), strict=True)])
            known[name] = c
        marked, every = words
        ratio = marked / (every - marked) if marked and every > marked else 1.0
        mine, mine_two = own_counts(doc, i), np.zeros(len(j), np.int64)
        mine_two[inner] = own_counts(doc[inner], j[inner])
        before = np.maximum(np.arange(len(i)) - 1, 0)  # place of the word before
        loss = []
        for own, c, size, scale in ((mark, known["own"], marked, 1.0), (~mark, known["total"] - known["own"], every - marked, ratio)):
            without = own[doc]
            one_count = (c[i] - np.where(without, mine, 0)) * scale
            flat = (one_count + 1.0) / ((size - np.where(own, n, 0)) * scale + kinds + 1)[doc]
            # the word before lies in the same document, where there is one
            first = (c[i[before]] - np.where(without, mine[before], 0)) * scale
            pair = (c[j] - np.where(without, mine_two, 0)) * scale
            p = np.where(inner & (first > 0), lam * pair / np.maximum(first, 1e-9) + (1 - lam) * flat, flat)
            loss.append(np.bincount(doc, -np.log(p), len(n)) / np.maximum(n, 1))
        return pa.Table.from_arrays([*(table.column(c) for c in keep), *map(pa.array, (n, *loss, loss[0] - loss[1]))], names=schema.fieldNames())

    sent = dealt.groupBy("__block").applyInArrow(counts, "part int, block long, n long, own_words long, words long, key binary, own binary, total binary")
    summed = sent.repartition(n_blocks, "part").groupBy("part").applyInArrow(sums, "part int, block long, n long, kinds long, own_words long, words long, own binary, total binary")
    return dealt.groupBy("__block").cogroup(summed.repartition(n_blocks, "block").groupBy("block")).applyInArrow(scores, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("target"))
    # a shuffled hash join at every size: labels grow with the corpus
    marked = docs.join(good.hint("shuffle_hash"), docs["doc_id"] == good["id"], "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    return lm_scores(marked)
