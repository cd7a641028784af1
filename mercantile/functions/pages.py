"""Column expressions over product pages, links and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE = r"<title>([^<]*)</title>"
LANG = r'<html lang="([a-z-]+)"'
HOST = r"^https?://([^/?#]+)"
PATH = r"^https?://[^/?#]+([^?#]*)"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, text in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


def title(html: Column) -> Column:
    return unescape(F.regexp_extract(html, TITLE, 1))


def lang(html: Column) -> Column:
    return F.regexp_extract(html, LANG, 1)


def occurrences(text: Column, part: str) -> Column:
    """How often a fixed string stands in a text, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def parameter(url: Column, name: str) -> Column:
    """A parameter of the query part, or null."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def sign_bits(vector: Column) -> Column:
    """A 64-bit fingerprint: bit i tells whether component i is positive."""
    one = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(one, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
