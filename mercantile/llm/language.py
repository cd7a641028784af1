"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone, so all tasks agree
without sharing anything. Letters are lower-cased; whatever lies between them counts as one space.
Three consecutive symbols are bound into one vector: the product of their letter vectors, the
first rotated by two places and the second by one. A text is the bundle (sum) of its three-grams,
a language the bundle of its texts. A document gets the language whose prototype has the largest
cosine with its own vector; the score is that cosine, at least 0.

Bundles are linear, so a task counts the different three-grams of a chunk, makes each one's vector
once and multiplies: counts by language when prototypes are learnt, counts by document when
documents are compared. Tasks send one vector a language, summed as whole numbers; a prototype
takes a language's texts by their length, less the mean of all prototypes, as what languages share
tells nothing. The prototypes are broadcast: ``MOST_LANGUAGES`` bounds them.

A null text or one without letters is ``und`` with score 0, and so is any text if nothing was learnt.
Empty languages are values like others; null ones teach nothing. Very long texts are read whole.
Ties go to the smaller language. Repeated rows are judged alike; an empty table has no rows. Columns
of ``keep`` that are named as results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import buffers, chunks, map_text

SIZE, GRAM, SEED = 1024, 3, 77
#: Prototypes are broadcast, ``SIZE`` numbers of 4 bytes each.
MOST_LANGUAGES = 8192
#: Documents times three-grams that are counted in one matrix.
CELLS = 1 << 22
#: Code points with a number in LETTER, in their order; 0 is the space between letters.
LETTER = np.full(0x110000, -1, np.int32)
VECTORS: list[np.ndarray] = [np.random.default_rng([SEED, 0x20]).integers(0, 2, SIZE, np.int8) * 2 - 1]
SPACE = 0


def learn_letters(points: np.ndarray) -> None:
    """Numbers and vectors for the code points that this process has not met."""
    for p in points[LETTER[points] < 0].tolist():
        c = chr(p)
        low = ord(c.lower()) if len(c.lower()) == 1 else p
        if not c.isalpha():
            LETTER[p] = SPACE
        elif LETTER[low] > 0:
            LETTER[p] = LETTER[low]
        else:
            LETTER[p] = LETTER[low] = len(VECTORS)
            VECTORS.append(np.random.default_rng([SEED, low]).integers(0, 2, SIZE, np.int8) * 2 - 1)


def symbols(byte: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, with one space before, between and after the words of each text, and the
    text of each. Texts without letters have none."""
    points = np.frombuffer(byte.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    start = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])[off]
    learn_letters(np.flatnonzero(np.bincount(points, minlength=1)))
    s = LETTER[points]
    text = np.repeat(np.arange(len(off) - 1), np.diff(start))
    letter = s > 0
    # a space goes before each first letter of a word, and after each text's last
    head = letter.copy()
    head[1:] &= ~(letter[:-1] & (text[1:] == text[:-1]))
    s, text, head = s[letter], text[letter], head[letter]
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
    n = 1 + head + last
    at = np.cumsum(n) - 1 - last
    out = np.full(int(n.sum()), SPACE, np.int64)
    out[at] = s
    return out, np.repeat(text, n)


def grams(s: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different three-grams (rows of letter numbers), which of them stands at each place, and
    the text of each place."""
    inside = text[2:] == text[:-2]
    used = np.unique(s)
    own = np.searchsorted(used, s)
    code = ((own[:-2] * len(used) + own[1:-1]) * len(used) + own[2:])[inside]
    if len(used) <= 128:
        seen = np.bincount(code, minlength=1) > 0
        kinds, which = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
    else:
        kinds, which = np.unique(code, return_inverse=True)
    three = np.stack([used[kinds // len(used) ** 2], used[kinds // len(used) % len(used)], used[kinds % len(used)]], 1)
    return three, which, text[2:][inside]


def bound(three: np.ndarray) -> np.ndarray:
    """The vectors of three-grams."""
    used, own = np.unique(three, return_inverse=True)
    v = np.stack([VECTORS[x] for x in used.tolist()]) if len(used) else np.zeros((0, SIZE), np.int8)
    own = own.reshape(three.shape)
    return (np.roll(v, 2, 1)[own[:, 0]] * np.roll(v, 1, 1)[own[:, 1]] * v[own[:, 2]]).astype(np.float32)


def bundles(three: np.ndarray, which: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the vectors of each row's three-grams. ``row`` ascends."""
    out = np.zeros((rows, SIZE), np.float32)
    v = bound(three)
    step = max(1, CELLS // max(1, len(three)))
    for lo in range(0, rows, step):
        hi = min(rows, lo + step)
        a, b = np.searchsorted(row, (lo, hi))
        # only the columns that occur here
        here = np.bincount(which[a:b], minlength=len(three)) > 0
        col = np.cumsum(here) - 1
        many = np.bincount((row[a:b] - lo) * int(here.sum()) + col[which[a:b]], minlength=(hi - lo) * int(here.sum()))
        out[lo:hi] = many.reshape(hi - lo, -1).astype(np.float32) @ v[here]
    return out


def prototypes(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and a unit vector each."""
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi, byte, off in chunks(batch.column(1)):
                coded = batch.column(0).slice(lo, hi - lo).dictionary_encode()
                names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                three, which, row = grams(*symbols(byte, off))
                row = of[row]
                by = np.argsort(row, kind="stable")
                for name, v in zip(names, bundles(three, which[by], row[by], len(names)), strict=True):
                    if v.any():
                        held[name] = held.get(name, 0) + v.astype(np.int64)
        for name, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * SIZE), pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(v)], names=["lang", "at", "value"])

    summed = known.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    few = summed.limit(MOST_LANGUAGES * SIZE + 1).toArrow()
    if len(few) > MOST_LANGUAGES * SIZE:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names, of = np.unique(np.array(few.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    p = np.zeros((len(names), SIZE))
    p[of, few.column("at").to_numpy()] = few.column("value").to_numpy()
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    if len(names) > 1:
        p -= p.mean(0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    return names.tolist(), p.astype(np.float32)


def languages(docs: DataFrame, learn_from: Column, *, keep: list[str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each document: ``keep`` (default doc_id), lang_pred and score. Learns from the
    rows where ``learn_from`` holds."""
    names, p = prototypes(docs.where(learn_from), text=text, lang=lang)

    def make():
        kinds = pa.array(names or ["und"])

        def fn(byte, off):
            three, which, row = grams(*symbols(byte, off))
            b = bundles(three, which, row, len(off) - 1)
            size = np.linalg.norm(b, axis=1)
            some = np.bincount(row, minlength=len(off) - 1) > 0
            if not names:
                some[:] = False
            cos = (b @ p.T) / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(b), 1))
            best = cos.argmax(1)
            score = np.clip(cos[np.arange(len(b)), best], 0, 1).astype(np.float64)
            label = kinds.take(pa.array(best))
            return [pa.array([x if ok else "und" for x, ok in zip(label.to_pylist(), some.tolist(), strict=True)]), pa.array(np.where(some, score, 0.0))]

        return fn

    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_text(docs, text, keep or ["doc_id"], out, make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return languages(docs.withColumn("held_out", held_out), ~F.col("held_out"), keep=["doc_id", "held_out"])
