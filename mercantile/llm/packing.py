"""Packing by concatenate and cut.

Pass one tokenizes all documents, writes their ids (two bytes each, four for a vocabulary that
needs them) to the shared folder, with the running number of ids before each document within its
partition, and sums each partition. Prefix sums over the partition totals give every document its
place in one long sequence of ids. Pass two cuts it into windows: a document that crosses a
boundary is cut into pieces, one record for each. No text or id is shuffled; only the partition
totals are, one row for each input partition, and only the last sequence is padded.

A document is its ids and then the end id 1; null and empty texts are the end id alone. Repeated
rows are packed again, rows with a null doc_id too. The order is that of the input's partitions,
so ties do not arise. Very long texts are cut into as many pieces as they need; a task holds one
text at a time, beside a chunk of short ones. An empty table gives no pieces. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U, chunks, materialise, prefix_hash, span_hash, spread

LENGTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a task keeps; beyond it, it forgets them.
MEMO = 400_000
#: Input partitions with rows up to which their totals (16 bytes each) are broadcast; beyond it they are joined.
BROADCAST_PARTS = 1 << 20
#: How the tokenizer files that ``Encoder`` splits by itself normalise and split texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is
    printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of many texts, equal to those of the tokenizer file.

    Texts of characters below U+0250 are split into words, single digits and runs of other
    characters with NumPy; the ids of each distinct word come from the tokenizer's model and are
    kept in a memo. Words are found in it by a hash, and compared with what it holds character by
    character. Texts with other characters, controls, special tokens or a word whose hash another
    word has go to the tokenizer whole, as do all texts where the file is not a lower-casing
    byte-level BPE of the fixed splitting rule.
    """

    LIMIT = 0x250
    CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, path: str, memo: int = MEMO):
        import unicodedata

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.limit = memo
        told = json.loads(Path(path).read_text())
        first, *_ = (told["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.known = told["model"]["type"] == "BPE" and (told["normalizer"] or {}).get("normalizers") == NORMALIZER and first is not None and first.get("pattern") == {"Regex": SPLIT}
        self.kind = np.zeros(self.LIMIT, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 not here
        self.lower = np.arange(self.LIMIT, dtype=np.uint16)
        for c in range(self.LIMIT):
            x, major = chr(c).lower(), unicodedata.category(chr(c))[0]
            if c in (0x09, 0x0A, 0x0D, 0x20):
                continue
            if c < 0x20 or 0x7F <= c <= 0xA0 or c == 0xAD or len(x) != 1 or ord(x) >= self.LIMIT:
                self.kind[c] = 4
                continue
            self.kind[c] = {"L": 1, "N": 2}.get(major, 3)
            self.lower[c] = ord(x)
        self.values = np.random.default_rng(5).integers(1, 1 << 63, self.LIMIT, dtype=np.uint64)
        self.shown = str.maketrans(byte_characters())
        self.forget()

    def forget(self) -> None:
        """Empties the memo: sorted keys of words; where the ids and characters of each are, and how many."""
        self.keys, self.at = np.zeros(0, U), np.zeros((0, 4), np.int64)
        self.ids, self.letters = np.zeros(0, self.width), np.zeros(0, np.uint16)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))]

    def split(self, code: np.ndarray, at: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased characters, and starts and ends of the words of the texts that are not slow."""
        kind = self.kind[np.where(code < self.LIMIT, code, 0)]
        if slow.any():
            kind = np.where(np.repeat(slow, np.diff(at)), 0, kind)
        low = self.lower[np.where(kind == 0, 0x20, np.minimum(code, self.LIMIT - 1))]
        # a new word where the kind changes, at each digit, at each document
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[at[:-1][np.diff(at) > 0]] = True
        for q in np.flatnonzero((low == 0x27) & new & (kind == 3)).tolist():
            end = at[np.searchsorted(at, q, "right")]
            after = "".join(map(chr, low[q + 1 : min(q + 3, end)]))
            for c in self.CONTRACTIONS:
                if after.startswith(c):
                    new[q + 1] = False
                    stop = q + 1 + len(c)
                    if len(c) == 2:
                        new[q + 2] = False
                    if stop < end:
                        new[stop] = True
                    break
        stops = np.append(np.flatnonzero(new), len(new))
        live = kind[stops[:-1]] != 0
        return low, stops[:-1][live], stops[1:][live]

    def encode(self, byte: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id after each text, and the number of ids of each text."""
        raw = byte.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        odd = (code >= self.LIMIT) | (self.kind[np.where(code < self.LIMIT, code, 0)] == 4)
        odd_sum = np.concatenate([[0], np.cumsum(odd)])
        slow = (odd_sum[at[1:]] > odd_sum[at[:-1]]) | (not self.known)
        if any(s.encode() in raw for s in self.special):
            slow |= np.array([any(s in t for s in self.special) for t in texts], bool)
        low, start, end = self.split(code, at, slow)
        word_doc = np.searchsorted(at, start, "right") - 1
        key = span_hash(prefix_hash(self.values[low]), start, end)
        distinct, pick, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot = self.slots(distinct, low, start[pick], end[pick])
        first, count, letter, size = self.at[slot[inverse]].T
        # a word that only has the hash of the one in the memo sends its text to the tokenizer
        other = size != end - start
        same = np.flatnonzero(~other)
        unlike = low[spread(start[same], size[same])] != self.letters[spread(letter[same], size[same])]
        if unlike.any():
            other[np.repeat(same, size[same])[unlike]] = True
        if other.any():
            slow[word_doc[other]] = True
            fast = ~slow[word_doc]
            word_doc, first, count = word_doc[fast], first[fast], count[fast]
        per_doc = np.bincount(word_doc, count, len(texts)).astype(np.int64)
        slow_ids = dict(zip(np.flatnonzero(slow).tolist(), self.whole([texts[i] for i in np.flatnonzero(slow)]), strict=True)) if slow.any() else {}
        for i, x in slow_ids.items():
            per_doc[i] = len(x)
        total = per_doc + 1
        ends = np.cumsum(total)
        out = np.full(int(ends[-1]) if len(ends) else 0, END_ID, self.width)
        # each word's ids go after the words before it and the end ids of the documents before its own
        fast = np.where(slow, 0, per_doc)
        before = (ends - total) - (np.cumsum(fast) - fast)
        many = int(count.sum())
        target = np.arange(many) + np.repeat(before[word_doc], count)
        out[target] = self.ids[spread(first, count)]
        for i, x in slow_ids.items():
            out[ends[i] - total[i] : ends[i] - 1] = x
        if len(self.keys) > self.limit:
            self.forget()
        return out, total

    def slots(self, distinct: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the words in the memo; those it lacks are tokenized and put in."""
        place = np.searchsorted(self.keys, distinct)
        missing = np.ones(len(distinct), bool)
        if len(self.keys):
            missing = self.keys[np.minimum(place, len(self.keys) - 1)] != distinct
        if missing.any():
            a, size = start[missing], (end - start)[missing]
            text = low.astype("<u2").tobytes().decode("utf-16-le")
            ids = [self.word(text[i:j]) for i, j in zip(a.tolist(), (a + size).tolist(), strict=True)]
            count = np.array([len(x) for x in ids], np.int64)
            first = len(self.ids) + np.cumsum(count) - count
            letter = len(self.letters) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], self.width)])
            self.letters = np.concatenate([self.letters, low[spread(a, size)]])
            self.at = np.insert(self.at, place[missing], np.stack([first, count, letter, size], 1), axis=0)
            self.keys = np.insert(self.keys, place[missing], distinct[missing])
        return np.searchsorted(self.keys, distinct)


def tokenize(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """(doc_id, part, before, n, ids): ids as little-endian unsigned numbers of two or four bytes."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, before, part = Encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, byte, off in chunks(batch.column(1)):
                ids, n = encoder.encode(byte, off)
                at = np.concatenate([[0], np.cumsum(n)])
                raw, size = ids.tobytes(), ids.itemsize
                blob = pa.array([raw[size * a : size * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + at[:-1]), pa.array(n), blob], names=schema.fieldNames())
                before += int(at[-1])

    return src.mapInArrow(run, schema)


PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and the ids as an array of ints, if asked for."""
    tokens = materialise(tokenize(docs, doc_id, text, path or vocabulary_path()))
    totals = materialise(tokens.groupBy("part").agg(F.sum("n").alias("total")))
    # one row for each partition: a running sum over them
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= BROADCAST_PARTS:
        base = F.broadcast(base)
    placed = tokens.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    schema = T.StructType([tokens.schema["doc_id"], *PIECES, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            blobs = batch.column(3)
            rows, starts, sizes, crcs, ids_out = [], [], [], [], []
            for i, (a, k) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
                blob = blobs[i].as_buffer()
                ids = np.frombuffer(blob, f"<u{len(blob) // k}").astype("<u4")
                s = 0
                while s < k:
                    size = min(k - s, length - (a + s) % length)
                    own = ids[s : s + size]
                    rows.append(i)
                    starts.append(s)
                    sizes.append(size)
                    crcs.append(zlib.crc32(own))
                    if with_ids:
                        ids_out.append(own.astype(np.int32))
                    s += size
            rows = np.array(rows, np.int64)
            place = at[rows] + np.array(starts, np.int64)
            cols = [batch.column(0).take(pa.array(rows)), *(pa.array(np.asarray(x, np.int64)) for x in (starts, sizes, crcs, n[rows], place // length, place % length))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []), names=schema.fieldNames())

    return placed.mapInArrow(cut, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
