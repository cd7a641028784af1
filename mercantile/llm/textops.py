"""Vectorised text helpers that run inside Spark tasks, and a few DataFrame helpers.

Texts arrive as Arrow batches. They are viewed as one byte buffer with offsets and worked
on in chunks of whole documents of about 1 MB, so that memory stays bounded by the chunk (or
by one document, where that is longer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercantile.storage import materialise, shared_dir

__all__ = ["Words", "buffers", "chunks", "hot_join", "hot_limit", "lists", "map_text", "materialise", "mix", "prefix_hash", "shared_dir", "span_hash", "spread", "windows"]

CHUNK = 1 << 20
#: Keys are hot that hold more rows than this, and than one in HOT_SHARE of all rows.
HOT_ROWS, HOT_SHARE = 256, 10_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


class Powers:
    """Powers of BASE modulo 2**64, and of its inverse, made as long as needed."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, U)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up[:n], cls.down[:n]


#: Random values of the 256 byte values; symbol 0 counts as well, so that lengths differ.
BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser, as the low bits of the polynomial are weak."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span. values: uint64."""
    up, _ = Powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = Powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    byte = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return byte, off


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    byte, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, byte[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


#: Lower-cased byte of a word, or 0: words are runs of digits, ASCII letters and all bytes from 0x80.
WORD = np.zeros(256, np.uint8)
WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD[0x80:] = np.arange(0x80, 0x100)


class Words:
    """Words of a chunk of documents: ``low`` (lower-cased bytes, 0 between words), ``start`` and
    ``end`` (byte positions), ``hash`` and ``off`` (the first word of each document, and the end)."""

    def __init__(self, byte: np.ndarray, off: np.ndarray, hashes: bool = True):
        self.low = low = WORD[byte]
        word = low != 0
        first, last = word.copy(), word.copy()
        inner = word[1:] & word[:-1]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(byte))]
        inner[cut - 1] = False
        first[1:] &= ~inner
        last[:-1] &= ~inner
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, off)
        if hashes:
            self.prefix = prefix_hash(BYTE_VALUES[low])
            self.hash = span_hash(self.prefix, self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, the same for equal words only, and the words by number."""
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(self.end - self.start)])), pa.py_buffer(self.low[self.low != 0])]).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def digest(self) -> np.ndarray:
        """64 bits of each word by a hash that is no polynomial: repetitive words of one
        length, which agree in ``hash``, differ here."""
        number, kinds = self.numbered()
        return np.array([xxhash.xxh3_64_intdigest(x) for x in kinds], U)[number] if kinds else np.zeros(0, U)

    def copies(self) -> np.ndarray:
        """128 bits (two of int64) of each document's words, each followed by a 0."""
        size = self.end - self.start
        word = np.repeat(np.arange(len(size)), size)
        joined = np.zeros(len(word) + len(size), np.uint8)
        joined[np.arange(len(word)) + word] = self.low[self.low != 0]
        at = (np.concatenate([[0], np.cumsum(size + 1)])[self.off]).tolist()
        raw = b"".join(hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False))
        return np.frombuffer(raw, np.int64).reshape(-1, 2)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive values."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for i in range(n):
        out = out * U(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    return mix(out)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the runs of the given sizes, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, type=kind))


def map_text(df: DataFrame, text: str, keep: list[str], out: T.StructType, make: Callable[[], Callable[[np.ndarray, np.ndarray], list]], chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``df``: its ``keep`` columns and the columns ``out``.

    ``make()`` runs once in a task; what it returns takes bytes and offsets of a chunk of
    documents and gives the arrays of ``out``. Columns of ``keep`` named as in ``out`` go.
    """
    keep = [c for c in keep if c not in out.fieldNames()]
    # a text that is kept is not sent twice
    at = keep.index(text) if text in keep else len(keep)
    src = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`").alias("__text")]))
    schema = T.StructType([src.schema[c] for c in keep] + list(out))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for lo, hi, byte, off in chunks(batch.column(at), chunk):
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *fn(byte, off)], names=names)

    return src.mapInArrow(run, schema)


def hot_limit(counted: DataFrame, n: str) -> int:
    """The rows above which a key is hot. ``n``: how many rows each key has. At most HOT_SHARE keys
    can be hot."""
    return max(HOT_ROWS, -(-(counted.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE))


def hot_join(rows: DataFrame, one: DataFrame, key: str, n: str, by: Column, limit: int, counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row a key and in ``n`` how many of ``rows``
    have it. Hot keys are dealt by ``by`` over one task for each ``limit`` rows, to all of which
    their row of ``one`` goes; the list of hot keys is broadcast. ``counted`` (default ``one``) has
    ``key`` and ``n`` of all keys of ``rows``, as a left join needs."""
    parts = F.ceil(F.col(n) / limit).cast("long")
    hot = (one if counted is None else counted).where(F.col(n) > limit).select(key, parts.alias("__parts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(by, F.coalesce("__parts", F.lit(1))).cast("long")).drop("__parts")
    right = one.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(n)
    return left.join(right, [key, "__part"], how).drop("__part")
