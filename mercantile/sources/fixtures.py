"""Made-up pages of markets, for calibrating adapters and for queries over many markets.

Pages are SQL expressions over rows (item, name, cents), so that any SQL engine knows which offers
stand in them. Also a Python data source that serves such pages, one partition a market.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.search import DICTIONARY
from .adapters import REGISTRY

#: Market, which items it lists (SQL), percent on top of the price, and its titles (SQL; ``words``: the
#: name in the market's language).
LISTED = (
    ("ebay", "size <= 40", 5, "words || ' ' || brand || ' ' || kind || ' ' || size"),
    ("trendyol", "kind <> 'LARGE'", 0, "words || ' ' || upper(brand) || ' NO ' || size"),
    ("dhgate", "size > 10", -10, "brand || ' ' || words || ' wholesale ' || size"),
    ("taobao", "kind in ('ECONOMY', 'SMALL', 'STANDARD')", -20, "words || ' ' || brand || ' ' || lower(kind) || ' ' || size"),
)
#: Items for which no market shows a price.
UNPRICED = "size = 7"
#: Columns of items.
ITEM = ["item", "name", "brand", "kind", "size", "cents"]
#: Items of a task, about: a file of a few bytes an item becomes pages of hundreds.
TASK_ITEMS = 25_000


def turkish_upper(word: str) -> str:
    return word.translate({ord("i"): "İ", ord("ı"): "I"}).upper()


def word_cases(lang: str, word: str) -> str:
    """SQL for an English word in a market's language, where the dictionary knows it."""
    turkish = {e: t for t, to, e in DICTIONARY if to == "en"}
    other = {t: x for t, to, x in DICTIONARY if to == lang}
    known = {e: turkish_upper(t) if lang == "tr" else other[t] for e, t in turkish.items() if lang == "tr" or t in other}
    return word if lang == "en" else f"case {word} " + " ".join(f"when '{e}' then '{x}'" for e, x in known.items()) + f" else {word} end"


def _amount(cents, comma: bool):
    """1234.5 as 1.234,50 or 1,234.50."""
    shown = F.format_number(cents / 100, 2)
    return F.translate(shown, ",.", ".,") if comma else shown


def market_pages(items: DataFrame) -> DataFrame:
    """(market, url, html) of items (``ITEM``): a row for each market that lists it. One pass: markets
    are an array that is exploded. Items are dealt over tasks by their number, as their files are small."""
    tasks = -(-items.count() // TASK_ITEMS)
    items = items.repartition(tasks, "item") if tasks > 1 else items
    rows = []
    for m, rule, more, title in LISTED:
        words = f"array_join(transform(split(name, ' '), w -> {word_cases(REGISTRY[m].lang, 'w')}), ' ')"
        rows.append(F.when(F.expr(rule), F.struct(F.lit(m).alias("market"), F.lit(more).alias("more"), F.lit(REGISTRY[m].comma).alias("comma"), F.expr(title.replace("words", words)).alias("title"))))
    one = items.select("*", F.explode(F.array_compact(F.array(*rows))).alias("m")).select("item", "size", "m.*", F.expr("cents + cents * m.more div 100").alias("cents"))
    price = F.when(F.col("comma"), F.concat(_amount(F.col("cents"), True), F.lit(" TL"))).otherwise(F.concat(F.lit("$"), _amount(F.col("cents"), False)))
    tag = F.when(F.expr(UNPRICED), "").otherwise(F.concat(F.lit('<b class="price">'), price, F.lit("</b>")))
    seller = F.concat(F.lit('<i class="seller">seller '), F.col("size").cast("string"), F.lit("</i>"))
    html = F.concat(F.lit("<html><title> "), "title", F.lit(" </title>"), tag, seller, F.lit("</html>"))
    return one.select("market", F.concat(F.lit("https://"), "market", F.lit(".example/"), F.col("item").cast("string")).alias("url"), html.alias("html"))


def _offers_sql(items: str) -> str:
    """The offers that ``market_pages`` writes, for items as SQL."""
    parts = []
    for m, rule, more, title in LISTED:
        a = REGISTRY[m]
        cents = f"cents + cast(trunc(cents * {more} / 100e0) as bigint)"
        words = f"array_to_string(list_transform(string_split(name, ' '), lambda w: {word_cases(a.lang, 'w')}), ' ')"
        parts.append(f"""select '{m}' as market, 'https://{m}.example/' || item as url, '{a.lang}' as lang, {title.replace("words", words)} as title,
            case when {UNPRICED} then null else cast(({cents}) / 100e0 as decimal(12,2)) end as price, '{a.currency}' as currency, 'seller ' || size as seller from ({items}) where {rule}""")
    return " union all ".join(parts)


class Market(InputPartition):
    def __init__(self, market: str):
        self.market = market


class CapturedPages(DataSource):
    """``spark.read.format("captured_pages").option("items", n)``: a page for each item of each
    registered market, one partition a market, so markets are read side by side."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "market string, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return CapturedPagesReader(sorted(REGISTRY), int(self.options.get("items", "10")))


class CapturedPagesReader(DataSourceReader):
    def __init__(self, markets: list[str], items: int):
        self.markets, self.items = markets, items

    def partitions(self) -> list[Market]:
        return [Market(m) for m in self.markets]

    def read(self, partition: Market) -> Iterator[tuple[str, str, str]]:
        for i in range(self.items):
            yield partition.market, f"https://{partition.market}.example/{i}", f'<title>thing {i}</title><b class="price">{i}</b><i class="seller">seller {i % 11}</i>'
