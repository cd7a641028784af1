"""Secret scans with DataFrame functions only.

Two ways find spans (code points, end exclusive) in the whole text:

- patterns, leftmost and not overlapping per kind: ``assign`` (a named key, then = or :, then a
  value of 6+ characters), ``access`` (AKIA and upper-case letters or digits, 20+ in all) and
  ``hex`` (24+ lower-case hex digits). Positions come from the lengths of the pieces between
  the matches, summed in blocks.
- entropy: candidate strings of 20+ characters of the base64 alphabet slide a window of 20
  characters. The window's counts of characters are kept, one character in and one out, and with
  them the sum of c log c, hence the Shannon entropy. Windows have classes of characters: one of
  hex digits of one case alone, with a digit and a letter among them, is measured against the hex
  threshold, all others against that of base64. A candidate with a window that reaches its class's
  threshold is a secret. The allow-list suppresses candidates that are UUIDs, names or paths of
  words as a whole, and windows that touch an example word or a sequence; the rest of such a
  candidate counts. Only strings with both letters and digits count, so words never do.

Null and empty texts have no spans. Rows are independent; repeated rows repeat results, and an
empty table gives no rows. Work is linear in the length of texts and candidates, however long.
Spans that start at one place stand in the order of their kinds, then of their ends. Other columns
stay; one named as the new column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run that is long enough is the only kind of match that stays, so shorter ones are not made.
LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A word of a name: of one case or capitalised, and capitalised words of 3 or more letters after it.
NAME = r"(?:[A-Z]{1,15}(?![a-z])|[A-Z]?[a-z]{1,15})(?:[A-Z][a-z]{2,15})*+"
#: What a whole run may be. Words have at most 15 letters, and digits only at their end, so that
#: runs without separators, as long as a window, are no paths.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^/?[a-z]{1,15}[0-9]{0,4}(?:/[a-z]{1,15}[0-9]{0,4})*+/?$",
    rf"^{NAME}(?:[_-]{NAME})*+[_-]?[0-9]{{1,4}}$",
)
#: What no window may touch: the well-known key of manuals, examples, sequences.
PHRASES = r"(?i)wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|example|sample|dummy|placeholder|changeme|lorem|0?123456789|abcdefgh"
SPAN = "struct<start:bigint,stop:bigint,kind:int>"
#: Characters of the pieces that a text is taken apart into before spans are cut out of it.
PIECE = 1024


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _running(lens: Column) -> Column:
    """Running sums of an array of longs, in blocks of 256 so that long arrays stay cheap."""
    zero = F.array(F.lit(0).cast("long"))

    def grow(acc, v):
        return F.concat(acc, F.array(F.element_at(acc, -1) + v))

    def moved(inner: Column) -> Column:
        base = F.aggregate(F.transform(inner, lambda x: F.element_at(x, -1)), zero, grow)
        return F.flatten(F.zip_with(inner, F.slice(base, F.lit(1), F.size(inner)), lambda x, o: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda y: y + o)))

    def summed(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 256).cast("int"))
        inner = F.transform(starts, lambda b: F.aggregate(F.slice(own, b * 256 + 1, F.lit(256)), zero, grow))
        return F.when(F.size(own) > 0, _bind(inner, moved)).otherwise(F.array().cast("array<bigint>"))

    return _bind(lens, summed)


def _lengths(x: Column) -> Column:
    return F.transform(x, lambda s: F.length(s).cast("long"))


def _spans(text: Column, pattern: str, kind: int, good: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches that are good. Their ends come from the pieces between them."""

    def found(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = _running(F.zip_with(_lengths(pieces), _lengths(hits), lambda a, b: a + b))
        spans = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("stop"), F.lit(kind).alias("kind"), (F.lit(True) if good is None else good(h)).alias("good")))
        kept = F.filter(spans, lambda s: s["good"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))).cast(f"array<{SPAN}>")

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _put(counts: Column, at: Column, value: Column) -> Column:
    """``counts`` with another value at a place from 1 on."""
    return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(value), F.slice(counts, at + 1, F.lit(len(ALPHABET))))


def _entropies(s: Column, window: int = WINDOW) -> Column:
    """(base64, hex): largest Shannon entropies in bits over all windows of a string, and over
    those of hex digits with a letter and a digit. The counts move by one character in and one
    out, and with them the sum of c log2 c. A step looks at the window that the one before left."""
    codes = F.transform(F.split(s, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    # what leaves the window as each character enters; 0 while it fills
    moves = _bind(codes, lambda own: F.arrays_zip(own.alias("into"), F.slice(F.concat(F.array_repeat(F.lit(0), window), own), F.lit(1), F.size(own)).alias("out")))
    zero = F.lit(0)
    start = F.struct(F.array_repeat(zero, len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), zero.alias("n"), zero.alias("digits"), zero.alias("low"), zero.alias("up"), F.lit(0.0).alias("base64"), F.lit(0.0).alias("hex"))
    #: What the sum grows by where a count grows from 0, 1, ... (and the last 0 for none).
    gain = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(window + 1)])

    def digit(code: Column) -> Column:
        return code.between(53, 62)

    def looked(acc: Column) -> tuple[Column, Column]:
        bits = F.when(acc["n"] >= window, F.lit(math.log2(window)) - acc["sum"] / window).otherwise(F.lit(0.0))
        of_hex = (F.greatest(acc["low"], acc["up"]) >= window) & acc["digits"].between(1, window - 1)
        return F.greatest(acc["base64"], bits), F.when(of_hex, F.greatest(acc["hex"], bits)).otherwise(acc["hex"])

    def step(acc: Column, m: Column) -> Column:
        into, out, counts = m["into"], m["out"], acc["counts"]
        had = F.element_at(counts, into) - (into == out).cast("int")
        less = F.when(out > 0, _put(counts, out, F.element_at(counts, F.greatest(out, F.lit(1))) - 1)).otherwise(counts)
        loss = F.when(out > 0, F.element_at(gain, F.element_at(counts, F.greatest(out, F.lit(1))))).otherwise(F.lit(0.0))
        base64, hexed = looked(acc)
        return F.struct(
            _put(less, into, had + 1).alias("counts"),
            (acc["sum"] - loss + F.element_at(gain, had + 1)).alias("sum"),
            (acc["n"] + 1).alias("n"),
            (acc["digits"] + digit(into).cast("int") - digit(out).cast("int")).alias("digits"),
            F.when(digit(into) | into.between(27, 32), acc["low"] + 1).otherwise(zero).alias("low"),
            F.when(digit(into) | into.between(1, 6), acc["up"] + 1).otherwise(zero).alias("up"),
            base64.alias("base64"),
            hexed.alias("hex"),
        )

    return F.aggregate(moves, start, step, lambda acc: F.struct(looked(acc)[0].alias("base64"), looked(acc)[1].alias("hex")))


def _allowed(s: Column) -> Column:
    found = F.lit(False)
    for pattern in ALLOWED:
        found = found | s.rlike(pattern)
    return found


def _random(s: Column) -> Column:
    """Whether a window of a piece reaches its class's entropy."""
    found = F.exists(F.array(_entropies(s)), lambda e: (e["base64"] >= THRESHOLDS["base64"]) | (e["hex"] >= THRESHOLDS["hex"]))
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~_allowed(s), found).otherwise(F.lit(False))


def _secret(s: Column) -> Column:
    """Whether a candidate is a secret by its entropy: a piece between phrases of the allow-list is."""
    pieces = F.filter(F.split(s, PHRASES, -1), lambda p: F.length(p) >= WINDOW)
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~_allowed(s), F.exists(pieces, _random)).otherwise(F.lit(False))


def scan(docs: DataFrame, text: str = "text", column: str = "spans") -> DataFrame:
    """``docs`` with a column of all spans (start, stop, kind as an index in KINDS), sorted by
    start, then kind, then stop. A column of that name is replaced."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    low = F.lower(t)
    none = F.array().cast(f"array<{SPAN}>")
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        named = named | F.contains(low, F.lit(word))
    parts = [
        F.when(named, _spans(t, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6)).otherwise(none),
        F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1, lambda h: F.length(h) >= 20)).otherwise(none),
        F.when(t.rlike(LONG_HEX), _spans(t, LONG_HEX, 2)).otherwise(none),
        F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, 3, _secret)).otherwise(none),
    ]
    order = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return docs.withColumn(column, F.array_sort(order))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each union of overlapping spans of the text replaced by ``mask``. Texts
    without spans, null ones too, stay as they are."""
    spans = "__spans"
    while spans in docs.columns:
        spans += "_"
    seen = scan(docs, text, spans)
    t = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    start = F.struct(F.array().cast("array<struct<from:bigint,size:bigint>>").alias("gaps"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("from"), (s["start"] - acc["at"]).alias("size"))
        # a span that touches the one before, but starts at its end, gets a mask of its own
        gaps = F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"])
        return F.struct(gaps.alias("gaps"), F.greatest(acc["at"], s["stop"]).alias("at"))

    def last(acc: Column) -> Column:
        return F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("from"), (F.length(t) - acc["at"]).alias("size"))))

    def part(own: Column, gap: Column) -> Column:
        """Of the pieces, only those that a gap touches are put together."""
        first = F.floor(gap["from"] / PIECE).cast("int")
        near = F.slice(own, first + 1, F.floor((gap["from"] + gap["size"]) / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(near, ""), (gap["from"] - first * PIECE + 1).cast("int"), gap["size"].cast("int"))

    gaps = F.aggregate(F.col(spans), start, step, last)
    done = _bind(pieces, lambda own: F.array_join(F.transform(gaps, lambda g: part(own, g)), mask))
    return seen.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).drop(spans)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def counted(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [counted(k) for k in range(3)]
    return seen.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
