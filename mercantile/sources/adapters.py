"""Market adapters over captured pages, their registry, and searches over many markets.

Pages are captured elsewhere and arrive as a table (market, url, html). An adapter says how a
market writes title, price and seller; it is a declaration, turned into column expressions,
so a market's pages are read, filtered and parsed by one Spark scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import lowered, turkish_lower

OFFER = ["market", "url", "lang", "title", "price", "currency", "seller"]


@dataclass(frozen=True)
class Adapter:
    """Patterns have one group each. ``comma`` tells that the market writes 1.234,56."""

    market: str
    lang: str
    currency: str
    title: str = r"(?is)<title>\s*(.*?)\s*</title>"
    price: str = r'(?i)class="price"[^>]*>\s*[^0-9<]*([0-9][0-9.,]*)'
    seller: str = r'(?i)class="seller"[^>]*>\s*([^<]*?)\s*<'
    comma: bool = False


REGISTRY: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    if adapter.market in REGISTRY:
        raise ValueError(f"{adapter.market} is registered already")
    REGISTRY[adapter.market] = adapter
    return adapter


for _market, _lang, _currency, _comma in (
    ("1688", "zh", "CNY", False),
    ("taobao", "zh", "CNY", False),
    ("pinduoduo", "zh", "CNY", False),
    ("trendyol", "tr", "TRY", True),
    ("hepsiburada", "tr", "TRY", True),
    ("amazon_tr", "tr", "TRY", True),
    ("dhgate", "en", "USD", False),
    ("ebay", "en", "USD", False),
    ("tokopedia", "id", "IDR", True),
    ("lazada_th", "th", "THB", False),
):
    register(Adapter(_market, _lang, _currency, comma=_comma))


def parsed(pages: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Offers of the pages of the adapters' markets; what a page lacks is null. One scan: each
    column is one expression, with a branch for each different pattern, not for each market."""

    def branch(of: Callable[[Adapter], object], make: Callable[[object], Column]) -> Column:
        markets: dict[object, list[str]] = {}
        for a in adapters:
            markets.setdefault(of(a), []).append(a.market)
        out = None
        for key, names in markets.items():
            here = F.col("market").isin(names)
            out = F.when(here, make(key)) if out is None else out.when(here, make(key))
        return F.lit(None).cast("string") if out is None else out

    def text(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))

    def amount(key: tuple[str, bool]) -> Column:
        pattern, comma = key
        raw = F.regexp_extract("html", pattern, 1)
        return F.translate(F.translate(raw, "." if comma else ",", ""), ",", ".").try_cast("decimal(12,2)")

    return pages.where(F.col("market").isin([a.market for a in adapters])).select(
        "market",
        "url",
        branch(lambda a: a.lang, F.lit).alias("lang"),
        branch(lambda a: a.title, text).alias("title"),
        branch(lambda a: (a.price, a.comma), amount).cast("decimal(12,2)").alias("price"),
        branch(lambda a: a.currency, F.lit).alias("currency"),
        branch(lambda a: a.seller, text).alias("seller"),
    )


def search(pages: DataFrame, markets: list[str] | None = None, words: list[str] = ()) -> DataFrame:
    """Offers of all asked markets whose titles hold all words, in either case by the rules of each
    market's language; all markets in one scan."""
    found = parsed(pages, [REGISTRY[m] for m in (sorted(REGISTRY) if markets is None else markets)])
    title, turkish = lowered(F.col("title"), F.col("lang")), F.col("lang") == "tr"
    for word in words:
        found = found.where(F.contains(title, F.when(turkish, turkish_lower(F.lit(word))).otherwise(F.lit(word.lower()))))
    return found


def market_labels(spark: SparkSession) -> DataFrame:
    """One row for each registered market; small and fixed."""
    rows = ", ".join(f"('{a.market}', '{a.lang}', '{a.currency}')" for a in REGISTRY.values())
    return spark.sql(f"select * from (values {rows}) as t(market, lang, currency)")


def read_bulk_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, market) rows of a CSV with a header; malformed rows keep their text in ``bad``."""
    return spark.read.csv(path, header=True, schema="query string, market string, bad string", columnNameOfCorruptRecord="bad", multiLine=False, escape='"')


def bulk_search(queries: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers whose titles hold all words of a query, of the query's market (null: of any).

    Words of titles are joined with words of queries and counted, so nothing is compared with
    everything; the query file is the small side, but is not assumed to fit a broadcast. Both are
    lower-cased by the rules of the offer's language: Turkish or others.
    """
    q = queries.select(F.trim("query").alias("query"), "market").distinct().where("query <> ''")
    forms = F.array(*[F.struct(F.lit(t).alias("turkish"), F.array_distinct(F.split(low, r"\s+")).alias("w")) for t, low in ((False, F.lower("query")), (True, turkish_lower(F.col("query"))))])
    asked = q.select("query", F.col("market").alias("asked"), F.explode(forms).alias("f"))
    asked = asked.select("query", "asked", "f.turkish", F.size("f.w").alias("n"), F.explode("f.w").alias("word"))
    title = lowered(F.col("title"), F.col("lang"))
    seen = offers.select("market", "url", "title", "price", (F.col("lang") == "tr").alias("turkish"), F.explode(F.array_distinct(F.split(title, r"\s+"))).alias("word"))
    hits = seen.join(asked, ["turkish", "word"]).where("asked is null or asked = market")
    return hits.groupBy("query", "asked", "market", "url", "title", "price", "n").agg(F.count("*").alias("k")).where("k = n").drop("k", "n")


def export_csv(df: DataFrame, path: str) -> None:
    """Writes CSV part files with a header, one or more for each task."""
    df.write.mode("errorifexists").csv(path, header=True, escape='"')
