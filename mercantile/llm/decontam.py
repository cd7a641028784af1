"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of the benchmark items (an item of fewer
words is one pattern). Blocks are two words long. A shift table tells how far a window may
move when a block is seen at its end; blocks of no pattern allow the longest shift, so most
words are never looked up. Where the shift is 0, the block at the window's end and the one at
its start select a bucket of patterns, and their words are compared directly, byte by byte. The
cursors of many stretches of text move together, as NumPy arrays, inside Spark tasks; documents
are never shuffled, nor do they meet a second time unless the benchmark is larger than what is
broadcast at once. What several such rounds find in a document is merged in one sort of its spans.

Null and empty texts have no words and give a row with zeros. Rows are independent of each
other: repeated rows give repeated results, and rows without an id keep theirs. Very long texts
are searched whole. Items of equal windows all count; the windows of items without an id are hit
like others, but those items cannot be named. Items without words have no windows. An empty benchmark gives no hits, an empty table no
rows. Columns of ``keep`` that are named as results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import Words, lists, map_text, materialise, mix, spread, windows

WINDOW = 10
STRETCH = 256
#: Bytes of items of one machine, and of those that are broadcast together (15 times as much in memory).
BLOCK_BYTES, ROUND_BYTES = 4 << 20, 16 << 20
#: Pairs of a window and a pattern that are compared at once.
PAIRS = 1 << 18
U = np.uint64

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


class Machine:
    """Shift table and buckets for the patterns of ``n`` words among the words of some items.

    A pattern is the place of its first word; of equal windows the first is the pattern, and
    ``owners`` has the items of each, from ``owner_at[i]`` to ``owner_at[i + 1]``."""

    def __init__(self, n: int, words: Words, first: np.ndarray, item: np.ndarray):
        self.n, self.block = n, min(2, n)
        self.low, self.start, self.end, self.hash = words.low, words.start, words.end, words.hash
        whole = windows(self.hash, n)[first]
        order = np.lexsort((item, whole))
        first, item, whole = first[order], item[order], whole[order]
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        # a window that only has the hash of the one before is a pattern of its own
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        new |= ~self.same(words, first, first[lead])
        at = np.flatnonzero(new)
        self.first, group = first[at], np.cumsum(new) - 1
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])])
        self.owners = item[fresh]
        self.owner_at = np.searchsorted(group[fresh], np.arange(len(at) + 1))
        h = self.hash[self.first[:, None] + np.arange(n)]
        keys = np.stack([self.key(h[:, j : j + self.block]) for j in range(n - self.block + 1)], 1)
        shift = np.broadcast_to(np.arange(n - self.block, -1, -1), keys.shape).ravel()
        order = np.lexsort((shift, keys.ravel()))
        flat = keys.ravel()[order]
        once = np.concatenate([[True], flat[1:] != flat[:-1]])
        self.keys, self.shift = flat[once], shift[order][once]
        # buckets: patterns by their first and last blocks
        ends = mix(keys[:, 0] * U(0xD6E8FEB86659FD93) ^ keys[:, -1])
        self.bucket = np.argsort(ends, kind="stable")
        self.ends = ends[self.bucket]

    @staticmethod
    def key(h: np.ndarray) -> np.ndarray:
        return mix(h[:, 0] * U(3)) if h.shape[1] == 1 else mix(h[:, 0] * U(0x9FB21C651E98DF25) + h[:, 1])

    def same(self, words: Words, start: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the n words from ``start`` on are those from ``other`` on among the items, byte by byte."""
        ok = np.ones(len(start), bool)
        for j in range(self.n):
            live = np.flatnonzero(ok)
            a, b = start[live] + j, other[live] + j
            size = words.end[a] - words.start[a]
            ok[live] = alike = size == self.end[b] - self.start[b]
            live, a, b, size = live[alike], a[alike], b[alike], size[alike]
            unlike = words.low[spread(words.start[a], size)] != self.low[spread(self.start[b], size)]
            ok[np.repeat(live, size)[unlike]] = False
        return ok

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences that do not cross documents."""
        n, b = self.n, self.block
        h = words.hash
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = self.key(np.stack([h[: len(h) - b + 1], h[b - 1 :]], 1) if b == 2 else h[:, None])
        # stretches: runs of up to STRETCH window starts in a document
        lo, hi = words.off[:-1], words.off[1:] - n + 1
        pieces = np.maximum(0, -((lo - hi) // STRETCH))
        at = np.repeat(lo, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(at + STRETCH, np.repeat(hi, pieces)) + (n - b)
        cur = at + (n - b)
        found: list[np.ndarray] = []
        far = n - b + 1
        while len(cur):
            i = np.minimum(np.searchsorted(self.keys, k := key[cur]), len(self.keys) - 1)
            step = np.where(self.keys[i] == k, self.shift[i], far)
            found.append(cur[step == 0] - (n - b))
            cur = cur + np.maximum(step, 1)
            live = cur < end
            cur, end = cur[live], end[live]
        start = np.concatenate(found) if found else np.zeros(0, np.int64)
        ends = mix(key[start] * U(0xD6E8FEB86659FD93) ^ key[start + n - b])
        left = np.searchsorted(self.ends, ends)
        many = np.searchsorted(self.ends, ends, "right") - left
        starts, patterns = [start[:0]], [start[:0]]
        # so many windows at once that their buckets hold about PAIRS patterns
        total = np.cumsum(many)
        cut = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, PAIRS), "right"), len(start)))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own, pattern = np.repeat(start[x:y], many[x:y]), self.bucket[spread(left[x:y], many[x:y])]
            for j in range(n):
                ok = h[own + j] == self.hash[self.first[pattern] + j]
                own, pattern = own[ok], pattern[ok]
            ok = self.same(words, own, self.first[pattern])
            starts.append(own[ok])
            patterns.append(pattern[ok])
        return np.concatenate(starts), np.concatenate(patterns)


class Items:
    """Machines over some items, one for each length of windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        raw = [(text or "").encode() for _, text in items]
        self.ids = np.array([i for i, _ in items], object)
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        size = np.diff(words.off)
        self.machines = []
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero(np.minimum(size, window) == n)
            many = size[own] - n + 1
            self.machines.append(Machine(n, words, spread(words.off[:-1][own], many), np.repeat(own, many)))


def spans_of(hit: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel()


def scan(made: list[Items], byte: np.ndarray, off: np.ndarray) -> list:
    words = Words(byte, off)
    total, docs = len(words.start), len(off) - 1
    cover = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(docs)]
    for own in made:
        for m in own.machines:
            start, pattern = m.search(words)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + m.n, -1)
            doc = np.searchsorted(words.off, start, "right") - 1
            doc, pattern = np.unique(np.stack([doc, pattern]), axis=1)
            many = m.owner_at[pattern + 1] - m.owner_at[pattern]
            names = own.ids[m.owners[spread(m.owner_at[pattern], many)]]
            for d, x in zip(np.repeat(doc, many).tolist(), names.tolist(), strict=True):
                if x is not None:
                    items[d].add(x)
    hit = np.cumsum(cover[:-1]) > 0
    summed = np.concatenate([[0], np.cumsum(hit)])
    n_hit = summed[words.off[1:]] - summed[words.off[:-1]]
    spans: list[list[int]] = [[]] * docs
    for d in np.flatnonzero(n_hit).tolist():
        spans[d] = spans_of(hit[words.off[d] : words.off[d + 1]]).tolist()
    return [pa.array(np.diff(words.off)), pa.array(n_hit), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(n_hit > 0)]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, n_words, spans, items) as (row, ``OUT``): the spans that several rounds have found, in
    order, those that meet as one. One sort and one running maximum for all spans of a batch."""
    for batch in batches:
        row, n_words, spans, items = batch.columns
        flat = spans.flatten().to_numpy().reshape(-1, 2)
        doc = np.repeat(np.arange(len(batch)), spans.value_lengths().to_numpy() // 2)
        order = np.lexsort((flat[:, 0], doc))
        doc, start, end = doc[order], flat[order, 0], flat[order, 1]
        # documents stand one behind the other, so ends of one never reach the next
        base = doc * (int(end.max(initial=0)) + 2)
        reach = np.maximum.accumulate(end + base) if len(end) else end
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] + base[1:] > reach[:-1])
        at = np.flatnonzero(fresh)
        stop = (reach - base)[np.append(at[1:], len(doc)) - 1] if len(at) else at
        n_hit = np.bincount(doc[at], stop - start[at], len(batch)).astype(np.int64)
        merged = lists(np.stack([start[at], stop], 1).ravel(), 2 * np.bincount(doc[at], minlength=len(batch)), pa.int64())
        yield pa.RecordBatch.from_arrays([row, n_words, pa.array(n_hit), merged, items, pa.array(n_hit > 0)], names=[batch.schema.names[0], *OUT.fieldNames()])


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row for each document: ``keep`` (default doc_id), n_words, n_hit, hit_spans (first
    word and end of each run of hit words, flat), items (ids as sorted strings), contaminated.

    Items are read in blocks of about ``block_bytes``, each a machine of its own; those of up to
    ``round_bytes`` together are broadcast, and a task holds each chunk of documents against all
    of them. A larger benchmark takes several rounds over the documents, whose rows are numbered
    and written first; what the rounds find is merged by these numbers.
    """
    keep = [c for c in keep or ["doc_id"] if c not in OUT.fieldNames()]
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, rounds = max(1, -(-size // block_bytes)), max(1, -(-size // round_bytes))
    at = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))

    def found(rows: DataFrame, own: list[int], columns: list[str]) -> DataFrame:
        texts: dict[int, list[tuple[str | None, str]]] = {b: [] for b in own}
        for r in bench.withColumn("at", at).where(F.col("at").isin(own)).toLocalIterator():
            texts[r["at"]].append((r["item"], r["text"]))
        made = [spark.sparkContext.broadcast(Items(texts.pop(b), window)) for b in own]

        def make():
            items = [m.value for m in made]
            return lambda byte, off: scan(items, byte, off)

        return map_text(rows, text, columns, OUT, make)

    if rounds == 1:
        return found(docs, list(range(blocks)), keep)
    row = "__row"
    while row in docs.columns:
        row += "_"
    kept = materialise(docs.select(*{c: F.col(f"`{c}`") for c in [*keep, text]}.values(), F.monotonically_increasing_id().alias(row)))
    parts = [found(kept, list(range(r, blocks, rounds)), [row]) for r in range(rounds)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    one = every.groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = one.mapInArrow(joined, T.StructType([one.schema[row], *OUT]))
    return kept.select(*[F.col(f"`{c}`") for c in keep], row).join(merged, row).drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
