"""Removal of repeated substrings by suffix arrays over shards.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier (in a
document of a smaller id, or earlier in the same one). Shuffling all suffixes of a corpus
would multiply it, so the work is narrowed first without losing any repeat:

1. Anchors: every ``LENGTH``-byte window chooses, of the 32-byte strings in it, the one of the
   least hash (the first of equals) as its anchor, so equal windows choose equal anchors at equal
   places. About one position in 35 is one. The context of an anchor is all bytes of the windows
   that chose it, so each window belongs to one context.
2. Anchors meet by hash. Of equal contexts the first stays, and the others are repeats whole.
   Contexts of one anchor that differ are candidates. Tasks reduce equal contexts before the
   shuffle, and an anchor with many contexts in one task is declared hot.
3. Candidates' bytes are cut from the documents and dealt to shards by anchor. Each shard makes
   its suffix array by induced sorting and the permuted common prefixes, and marks every
   ``LENGTH``-byte string but the first of equal ones. Strings of hot anchors are keyed one by
   one instead (two 64-bit hashes), reduced within tasks, so that no task gathers all contexts of
   a hot anchor.
4. The marked intervals are joined to the documents by id. Cutting and marking read the same
   shuffled texts, which are sent once.

Texts are UTF-8 bytes; null counts as empty. doc_id tells documents apart; rows that repeat a
doc_id must repeat its text, and give equal results (with other texts under one id, which bytes
count as earlier is not defined, but no row is lost). A null doc_id neither removes nor loses
bytes. Texts shorter than ``LENGTH`` keep all bytes, very long ones are worked on whole by one
task (up to 2 GiB, what a Spark string holds). Ties do not arise: places are distinct. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import permuted_prefixes, suffix_array
from .textops import BYTE_VALUES, U, buffers, chunks, materialise, mix, prefix_hash, span_hash

LENGTH = 100
GRAM = 32
#: Anchors that a task holds before it reduces and sends them, and strings of hot ones, of which many are made of one document.
FLUSH, FLUSH_STRINGS = 1 << 19, 1 << 17
#: Different contexts of an anchor in one flush, or in one shard, that make it hot.
HOT_FLUSH, HOT = 64, 1024
SHARD_BYTES = 1 << 20

# kinds of rows
ANCHOR, REPEAT, HOT_ANCHOR, HOT_MARK = 0, 1, 2, 3
SHARD, SINGLE = 4, 5
#: ``span`` is the first byte << 32 | the number of bytes.
NAMES = ["key", "kind", "ctx", "doc_id", "span"]
FIELDS = "key long, kind byte, ctx long, doc_id long, span long"


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | (stop.astype(np.int64) - start)


def bounds(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = span >> 32
    return start, start + (span & 0xFFFFFFFF)


def slide(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """op over each n consecutive values (len(x) - n + 1 of them)."""
    k = 1
    while 2 * k <= n:
        x = op(x[:-k], x[k:])
        k *= 2
    return op(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(byte: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hashes of the anchors, hashes and bounds of their contexts, and documents."""
    n, w = len(byte), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(U), none.view(U), none, none, none
    prefix = prefix_hash(BYTE_VALUES[byte])
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    # the least hash of each window, and its first place
    chosen = slide(h & ~U(0xFFFFFFFF) | at.astype(U), w, np.minimum) & U(0xFFFFFFFF)
    edge = np.zeros(n + 1, np.int8)
    big = np.diff(off) >= length
    np.add.at(edge, off[:-1][big], 1)
    np.add.at(edge, off[1:][big] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[: len(chosen)], dtype=np.int8) > 0)  # ends in its document
    if not len(window):
        return none.view(U), none.view(U), none, none, none
    chosen = chosen[window].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    a, lo = chosen[first], window[first]
    hi = window[np.append(first[1:], len(window)) - 1] + length
    ctx = span_hash(prefix, lo, hi) ^ mix((a - lo).astype(U) + U(1))
    return h[a], ctx, lo, hi, np.searchsorted(off, a, "right") - 1


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Rows of kind REPEAT for the unions of overlapping intervals, under keys that deal them out."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    run = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) if len(doc) else doc
    far = np.maximum.accumulate(run << 34 | stop) if len(doc) else stop
    new = np.ones(len(doc), bool)
    new[1:] = (run[1:] << 34 | start[1:]) > far[:-1]
    first = np.flatnonzero(new)
    stop = (far[np.concatenate([first[1:], [len(doc)]]) - 1] & ((1 << 34) - 1)) if len(doc) else stop
    doc, start = doc[first], start[first]
    key = mix(doc.astype(np.int64).view(U) * U(31) + start.view(U)).view(np.int64)
    return [key, np.full(len(doc), REPEAT, np.int8), np.zeros(len(doc), np.int64), doc, spans(start, stop)]


def firsts(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key, context and place: which are first, and which are later repeats
    (not the same place again)."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return fresh, ~fresh & ((doc != doc[lead]) | (span != span[lead]))


class Sender:
    """Gathers rows (key, context, document, span), reduces those of equal key and context to the
    first, and sends them. Rows that are no first become repeats, which are dealt out evenly."""

    def __init__(self, hot: int | None, most: int):
        self.parts: list[list[np.ndarray]] = []
        self.size, self.hot, self.most = 0, hot, most

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(list(cols))
        self.size += len(cols[0])
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, ctx, doc, span = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((span, doc, ctx, key))
        key, ctx, doc, span = (x[order] for x in (key, ctx, doc, span))
        fresh, again = firsts(key, ctx, doc, span)
        repeats = merged(doc[again], *bounds(span[again]))
        key, ctx, doc, span = (x[fresh] for x in (key, ctx, doc, span))
        kind = np.full(len(key), ANCHOR, np.int8)
        marks = key[:0]
        if self.hot:
            own, many = np.unique(key, return_counts=True)
            marks = own[many >= self.hot]
            if len(marks):
                kind[np.isin(key, marks)] = HOT_ANCHOR
        key = np.where(kind == HOT_ANCHOR, mix(key.view(U) ^ mix(ctx.view(U))).view(np.int64), key)
        z = np.zeros(len(marks), np.int64)
        told = [marks, np.full(len(marks), HOT_MARK, np.int8), z, z, z]
        for part in ([key, kind, ctx, doc, span], told, repeats):
            for i in range(0, len(part[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in part], names=NAMES)


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(HOT_FLUSH, FLUSH)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, byte, off in chunks(batch.column(1)):
                h, ctx, begin, end, doc = anchors(byte, off, length, gram)
                top = off[doc]
                yield from out.add(h.view(np.int64), ctx.view(np.int64), ids[lo:hi][doc], spans(begin - top, end - top))
        yield from out.flush()

    return docs.mapInArrow(run, FIELDS)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key == key[-1], True))
        if cut or (held and held[-1].column(0)[0].as_py() != key[0]):
            head = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(head)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def meet(rows: DataFrame) -> DataFrame:
    """Repeats pass; of equal contexts all but the first become repeats; the first ones become
    candidates, to be compared in shards (SHARD) or string by string (SINGLE), if their anchor
    has several contexts. A key has at most HOT_FLUSH rows from each flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches):
            key, kind, ctx, doc, span = (table.column(i).to_numpy() for i in range(len(NAMES)))
            mark = kind == HOT_MARK
            marked = np.isin(key, np.unique(key[mark])) if mark.any() else mark
            passed = kind == REPEAT
            live = ~mark & ~passed
            k, kd, c, d, p, m = (x[live] for x in (key, kind, ctx, doc, span, marked))
            fresh, again = firsts(k, c, d, p)
            uniq, gid = np.unique(k, return_inverse=True)
            many = np.bincount(gid[fresh], minlength=len(uniq))[gid] if len(k) else gid
            single = fresh & ((kd == HOT_ANCHOR) | m | (many > HOT))
            shard = fresh & ~single & (many > 1)
            parts = [merged(np.concatenate([doc[passed], d[again]]), *bounds(np.concatenate([span[passed], p[again]])))]
            for which, name in ((single, SINGLE), (shard, SHARD)):
                parts.append([k[which], np.full(int(which.sum()), name, np.int8), c[which], d[which], p[which]])
            for part in parts:
                if len(part[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=NAMES)

    return rows.repartition("key").sortWithinPartitions("key", "ctx", "doc_id", "span").mapInArrow(run, FIELDS)


def cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of SHARD candidates, and a row for each string of SINGLE ones."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "kind", "span")).alias("asked"))
    # a left join, so that the shuffled texts are the same ones as those of the last step
    both = docs.join(asked.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "asked")
    other = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    names = [*NAMES, "bytes"]

    def single(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = batch.column(1).to_numpy()
        kind = pa.array(np.where(kind == REPEAT, REPEAT, SINGLE).astype(np.int8))
        return pa.RecordBatch.from_arrays([batch.column(0), kind, *batch.columns[2:], pa.nulls(len(batch), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(None, FLUSH_STRINGS)
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            if not len(batch):
                continue
            asked = batch.column(2)
            flat, of = asked.flatten(), asked.offsets.to_numpy() - asked.offsets[0].as_py()
            key, kind, span = (flat.field(i).to_numpy() for i in range(3))
            doc = np.repeat(batch.column(0).to_numpy(), np.diff(of))
            start, stop = bounds(span)
            pick = kind == SINGLE
            for i in np.unique(np.searchsorted(of, np.flatnonzero(pick), "right") - 1).tolist():
                own = np.flatnonzero(pick[of[i] : of[i + 1]]) + of[i]
                byte = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                p, q = prefix_hash(BYTE_VALUES[byte]), prefix_hash(other[byte])
                here = np.unique(np.concatenate([np.arange(a, b - length + 1) for a, b in zip(start[own], stop[own], strict=True)]))
                hashes = (span_hash(x, here, here + length).view(np.int64) for x in (p, q))
                for x in out.add(*hashes, np.full(len(here), doc[own[0]]), spans(here, here + length)):
                    yield single(x)
            text, off = buffers(batch.column(1))
            pick = np.flatnonzero(kind == SHARD)
            top = np.repeat(off[:-1], np.diff(of))[pick]
            view = memoryview(text)
            pieces = pa.array([view[a:b] for a, b in zip((top + start[pick]).tolist(), (top + stop[pick]).tolist(), strict=True)], pa.binary())
            if len(pick):
                z = np.zeros(len(pick), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(kind[pick]), pa.array(z), pa.array(doc[pick]), pa.array(span[pick]), pieces], names=names)
        for x in out.flush():
            yield single(x)

    return both.mapInArrow(run, FIELDS + ", bytes binary")


def shard_repeats(doc: np.ndarray, start: np.ndarray, pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Merged intervals of the strings of a shard that are not the first of equal ones."""
    raw = b"".join(pieces)
    size = np.array([len(x) for x in pieces])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    t = np.ones(at[-1] + 1, np.uint16)  # 1 between the pieces, 0 at the end
    pos = np.arange(len(raw)) + np.repeat(np.arange(len(pieces)), size)
    t[pos] = np.frombuffer(raw, np.uint8).astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258, first=2)
    shared = permuted_prefixes(t, sa, length, first=2)
    piece = np.repeat(np.arange(len(pieces) + 1), np.append(size + 1, 1))[sa]
    piece = np.minimum(piece, len(pieces) - 1)
    offset = sa - at[piece]
    full = size[piece] - offset >= length
    # runs of equal strings: shared[...] with the suffix before reaches the length
    same = (shared[sa] >= length) & full
    run = np.cumsum(~same)
    live = full & (same | np.concatenate([same[1:], [False]]))
    run, d, s = run[live], doc[piece[live]], start[piece[live]] + offset[live]
    order = np.lexsort((s, d, run))
    run, d, s = run[order], d[order], s[order]
    _, again = firsts(run, np.zeros(len(run), np.int64), d, s)
    return merged(d[again], s[again], s[again] + length)


def settle(rows: DataFrame, length: int) -> DataFrame:
    """Repeats (doc_id, span) from what ``cut`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(part[i]) for i in (3, 4)], names=["doc_id", "span"])

        pieces: list[bytes] = []
        doc: list[np.ndarray] = []
        start: list[np.ndarray] = []
        held = 0
        for table in by_key(batches):
            key, kind, ctx, d, span = (table.column(i).to_numpy() for i in range(len(NAMES)))
            passed, one = kind == REPEAT, np.flatnonzero(kind == SINGLE)
            _, again = firsts(key[one], ctx[one], d[one], span[one])
            again = one[again]
            yield from send(merged(np.concatenate([d[passed], d[again]]), *bounds(np.concatenate([span[passed], span[again]]))))
            # a table holds whole keys, in order; shards end between keys
            own = np.flatnonzero(kind == SHARD)
            key = key[own]
            blobs = table.column(len(NAMES)).combine_chunks().take(pa.array(own)).to_pylist()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                pieces += blobs[x:y]
                doc.append(d[own[x:y]])
                start.append(span[own[x:y]] >> 32)
                held += sum(map(len, blobs[x:y]))
                if held >= SHARD_BYTES:
                    yield from send(shard_repeats(np.concatenate(doc), np.concatenate(start), pieces, length))
                    pieces, doc, start, held = [], [], [], 0
        if pieces:
            yield from send(shard_repeats(np.concatenate(doc), np.concatenate(start), pieces, length))

    return rows.repartition("key").sortWithinPartitions("key", "ctx", "doc_id", "span").mapInArrow(run, "doc_id long, span long")


def kept_bytes(docs: DataFrame) -> DataFrame:
    """What stays of the texts of ``docs`` (doc_id, text, spans) without their spans."""
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            start, stop = bounds(batch.column(2).flatten().to_numpy())
            cols: list[list] = [[], [], [], []]
            for i in range(len(batch)):
                text = batch.column(1)[i].as_buffer()
                a, b = start[at[i] : at[i + 1]], stop[at[i] : at[i + 1]]
                n, runs, gone, digest = len(text), [], 0, hashlib.sha256()
                view, last = memoryview(text), 0
                if len(a):
                    s, e = bounds(merged(np.zeros(len(a), np.int64), a, b)[-1])
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        digest.update(view[last:x])
                        runs += [x, y]
                        gone += y - x
                        last = y
                digest.update(view[last:])
                for col, v in zip(cols, (n, gone, runs, digest.hexdigest()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3])], names=names)

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept_sha256 string")


def repeated_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, spans (flat starts and ends of the
    removed runs of bytes), kept_sha256."""
    # without a needless alias, which would keep Spark from seeing that the two shuffles of texts are one
    own = F.col(f"`{doc_id}`") if doc_id == "doc_id" and (doc_id, "bigint") in docs.dtypes else F.col(f"`{doc_id}`").cast("long").alias("doc_id")
    docs = docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    none = F.array().cast("array<bigint>")
    found = materialise(meet(find_anchors(known, length, gram)))
    more = settle(cut(known, found.where(F.col("kind").isin(SHARD, SINGLE)), length), length)
    repeats = found.where(F.col("kind") == REPEAT).select("doc_id", "span").unionByName(more)
    by_doc = repeats.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    both = known.join(by_doc.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return kept_bytes(both.unionByName(docs.where("doc_id is null").select("doc_id", "text", none.alias("spans"))))


def query(spark, sf_dir: str) -> DataFrame:
    found = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.expr("cast(size(spans) div 2 as bigint)").alias("n_spans"), "kept_sha256")
