"""Queries over made-up market pages, streams and Spark's extension points, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html
from ..functions import pages as pg
from ..operators import cost, search, similar
from ..sources import adapters, fixtures, warc, xlsx
from ..storage import broadcast_if_small, shared_dir, table
from ..streaming import watch, watchlist
from . import queries as plans
from .queries import query

_ITEMS = "select p_partkey as item, p_name as name, p_brand as brand, p_type as kind, p_size as size, cast(round(p_retailprice * 100) as bigint) as cents from part"
_OFFERS = fixtures._offers_sql(_ITEMS)
#: A title in lower case by the rules of its language.
_LOW = "case when lang = 'tr' then lower(translate(title, 'Iİ', 'ıi')) else lower(title) end"


def pages(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    return fixtures.market_pages(part.select(*[F.col(c).alias(n) for c, n in zip(("p_partkey", "p_name", "p_brand", "p_type", "p_size", "cents"), fixtures.ITEM, strict=True)]))


def amounts(df, *columns):
    """Decimals as doubles, which all engines show alike."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


@query(f"select market, url, lang, title, cast(price as double) as price, currency, seller from ({_OFFERS})")
def market_offers(spark, sf_dir):
    """Offers of all markets from their pages, in one scan."""
    return amounts(adapters.search(pages(spark, sf_dir)), "price")


@query(f"select market, url, cast(price as double) as price from ({_OFFERS}) where market in ('ebay', 'trendyol') and (contains({_LOW}, 'small') or contains({_LOW}, 'kırmızı'))")
def market_search(spark, sf_dir):
    """Titles that hold a word, in either case; Turkish ones by Turkish rules."""
    found = [adapters.search(pages(spark, sf_dir), ["ebay", "trendyol"], [w]) for w in ("Small", "KIRMIZI")]
    return amounts(found[0].unionByName(found[1]).distinct(), "price").select("market", "url", "price")


@query(f"""
with q(query, asked) as (values ('red ring', 'ebay'), ('gear', null), ('bolt, blue', 'ebay'), ('螺栓 brand#7', 'taobao'), ('kirmizi', null), ('kırmızı halka', null)),
 o as (select *, string_split({_LOW}, ' ') as w from ({_OFFERS}))
select query, asked, market, url, cast(price as double) as price from q join o on list_has_all(w, string_split(query, ' ')) and (asked is null or asked = market)""")
def bulk_csv_search(spark, sf_dir):
    """Queries of a CSV file over the offers of all markets."""
    path = shared_dir(spark)
    rows = "select * from values ('Red ring', 'ebay'), (' gear ', null), ('bolt, blue', 'ebay'), ('螺栓 Brand#7', 'taobao'), ('', 'ebay'), ('kirmizi', null), ('kırmızı halka', null) as t(query, market)"
    adapters.export_csv(spark.sql(rows), path)
    found = adapters.bulk_search(adapters.read_bulk_queries(spark, path), adapters.search(pages(spark, sf_dir)))
    return amounts(found, "price").select(F.lower("query").alias("query"), "asked", "market", "url", "price")


@query(f"""
with o as (select *, cast(regexp_extract(seller, '([0-9]+)$', 1) as bigint) as seller_id from ({_OFFERS}))
select market, url, seller, s_name, n_name, trust, verified from o left join ({plans.SQL['supplier_trust']}) t on seller_id = t.s_suppkey left join supplier s on seller_id = s.s_suppkey left join nation on s_nationkey = n_nationkey""")
def offer_sellers(spark, sf_dir):
    """Offers of all markets with what is known of their sellers: name, country and verification."""
    found = adapters.search(pages(spark, sf_dir))
    seller = F.regexp_extract("seller", "([0-9]+)$", 1).try_cast("bigint").alias("s_suppkey")
    known = plans.supplier_trust(spark, sf_dir).select("s_suppkey", "trust", "verified")
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")
    detail = known.join(named, "s_suppkey")
    return found.select("market", "url", "seller", seller).join(broadcast_if_small(detail), "s_suppkey", "left").drop("s_suppkey")


@query("select market, lang, currency, lang = 'tr' as turkish from (values {}) as t(market, lang, currency)".format(", ".join(f"('{a.market}', '{a.lang}', '{a.currency}')" for a in adapters.REGISTRY.values())))
def market_registry(spark, sf_dir):
    return adapters.market_labels(spark).withColumn("turkish", F.col("lang") == "tr")


@query("select p_partkey, p_name, p_brand from part")
def csv_export(spark, sf_dir):
    """A table as it comes back from its CSV export."""
    path, own = shared_dir(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    adapters.export_csv(own, path)
    return spark.read.csv(path, header=True, schema=own.schema, escape='"')


@query(f"select market, url, lang, title, cast(price as double) as price, currency, seller from ({_OFFERS})")
def xlsx_export(spark, sf_dir):
    """The offers of all markets as they come back from their export to Excel."""
    xlsx.use(spark)
    path, own = shared_dir(spark), amounts(adapters.search(pages(spark, sf_dir)), "price")
    own.write.format("xlsx").mode("append").save(path)
    return spark.read.format("xlsx").schema(own.schema).load(path)


#: Value of a unit of each currency in the currency of costs. Made-up rates.
_FX = "('USD', 1.0), ('TRY', 0.03), ('CNY', 0.14)"


@query(f"""
with dict as ({search.DICTIONARY_SQL}),
 w as (select query_id, string_split(lower(translate(text, 'Iİ', 'ıi')), ' ') as words from ({search.QUERIES_SQL})),
 p as (select query_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place, len(words) as n from w),
 t as (select query_id, lang, place, n, translated from p join dict using (word) where lang in ('en', 'zh') union all select query_id, 'tr', place, n, word from p),
 r as (select query_id, lang, 1 as rung, list(translated) as words from t group by query_id, lang, n having count(*) = n union all select query_id, lang, 2, [translated] from t where place = n),
 o as (select *, string_split({_LOW}, ' ') as title_words, case lang when 'tr' then 'TR' when 'en' then 'US' else 'CN' end as origin from ({_OFFERS}) where price is not null),
 h as (select query_id, rung, market, url, origin, cast(price as double) * cast(fx as double) as price from o join r on o.lang = r.lang and list_has_all(title_words, words) join (values {_FX}) as f(currency, fx) using (currency)),
 f as (select * from h x where rung = (select min(rung) from h y where x.query_id = y.query_id)),
 l as (select query_id, rung, country, market, url, (price + ship) * (1e0 + case when origin = country then 0e0 else duty end) * (1e0 + vat) as landed from f cross join ({cost.PROFILES_SQL}))
select query_id, rung, country, market, url, landed from (select *, row_number() over (partition by query_id, country order by landed, url) as place from l) where place = 1""")
def best_offer(spark, sf_dir):
    """End to end: queries in the languages of the markets, the offers of all markets that their first
    rung with hits finds, the landed cost in each country, and the best of them."""
    asked, words = spark.sql(search.QUERIES_SQL), search.dictionary(spark)
    rungs = reduce(lambda a, b: a.unionByName(b), [search.ladder(asked, words, lang=g).withColumn("lang", F.lit(g)) for g in ("en", "zh", "tr")])
    hits = search.ladder_hits(rungs, adapters.search(pages(spark, sf_dir)).where("price is not null"))
    fx = spark.sql(f"select currency, cast(fx as double) as fx from values {_FX} as t(currency, fx)")
    origin = F.when(F.col("lang") == "tr", "TR").when(F.col("lang") == "en", "US").otherwise("CN")
    priced = hits.join(broadcast_if_small(fx), "currency").select("query_id", "rung", "market", "url", origin.alias("origin"), (F.col("price").cast("double") * F.col("fx")).alias("price"))
    # an origin's cheapest offer is all that a country needs
    few = cost.best_source(priced, by=["query_id", "origin"], cost="price", tiebreak=["url"], carry=["market", "rung"])
    best = cost.landed_best(few, cost.profiles(spark), product="query_id", origin="origin", price="price", supplier="url")
    return best.join(few.select("query_id", "rung", "url", "market"), ["query_id", "url"]).select("query_id", "rung", "country", "market", "url", "landed")


_TITLE_TOKENS = f"list_distinct(list_filter(regexp_split_to_array({_LOW}, '[^\\p{{L}}\\p{{N}}#]+'), lambda x: x <> ''))"
#: Tokens of titles with Turkish and Chinese words in English.
_ENGLISH = "list_distinct(list_transform({t}, lambda w: case w " + " ".join(f"when '{x}' then '{e}'" for x, e in search.to_english().items()) + " else w end))"
_SETS = f"""
o as (select market, url, list_sort({_ENGLISH.format(t=_TITLE_TOKENS)}) as tokens from ({_OFFERS})),
s as (select market, tokens, min(url) as rep from o group by 1, 2)"""


def _matches(spark, sf_dir):
    found = adapters.search(pages(spark, sf_dir))
    tokens = search.in_english(similar.title_tokens(search.lowered(F.col("title"), F.col("lang"))))
    return similar.similar_sets(found.select("url", "market", tokens.alias("tokens")), id_col="url", group="market", tokens="tokens")


@query(f"""
with {_SETS},
 e as (select rep, market, unnest(tokens) as token from s),
 f as (select token, length(bin((select count(*) from s) // count(*))) as w from e group by token),
 t as (select rep, market, token, w, sum(w) over (partition by rep) as total from e join f using (token)),
 p as (select a.rep as a, b.rep as b, sum(a.w) as shared, any_value(a.total) + any_value(b.total) as sums from t a join t b on a.token = b.token and a.market < b.market group by 1, 2)
select a, b, cast(shared as bigint) as shared, cast(sums - shared as bigint) as total from p where shared * 10 >= (sums - shared) * 7""")
def title_matches(spark, sf_dir):
    """Titles of different markets that name the same product: weighted Jaccard similarity of 0.7 or
    more, between the first of equal titles of each market."""
    return _matches(spark, sf_dir).pairs


@query(f"with {_SETS} select url as id, rep from o join s using (market, tokens)")
def title_members(spark, sf_dir):
    """Each offer with the offer that stands for it in ``title_matches``."""
    return _matches(spark, sf_dir).members


@query("""with m as (select unnest(['1688', 'taobao', 'pinduoduo', 'trendyol', 'hepsiburada', 'amazon_tr', 'dhgate', 'ebay', 'tokopedia', 'lazada_th']) as market)
select market, 'https://' || market || '.example/' || i as url, 'thing ' || i as title, cast(i as double) as price from m, range(25) as r(i)""")
def source_offers(spark, sf_dir):
    """Offers of the pages that a Python data source serves, a partition for each market."""
    spark.dataSource.register(fixtures.CapturedPages)
    read = spark.read.format("captured_pages").option("items", "25").load()
    return amounts(adapters.search(read), "price").select("market", "url", "title", "price")


_LAST = "(select max(ts) from events) - interval 1 hour"


@query(f"""
select cast(s as varchar) as start, event_type, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total
from (select *, unnest([time_bucket(interval 12 hours, ts), time_bucket(interval 12 hours, ts) - interval 12 hours]) as s from events)
where s + interval 1 day <= {_LAST} group by 1, 2""")
def stream_sliding(spark, sf_dir):
    """Windows of a day that begin each half day, from a stream."""
    done = watch.drain(watch.windowed_counts(watch.read_events(spark, sf_dir, "events.parquet"), slide="12 hours"))
    return done.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""
select user_id, cast(min(ts) as varchar) as start, count(*) as n from (
 select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events))
group by user_id, run having max(ts) + interval 6 hour <= {_LAST}""")
def stream_sessions(spark, sf_dir):
    """Sessions from a stream: those that the watermark has passed."""
    done = watch.drain(watch.session_counts(watch.read_events(spark, sf_dir, "events.parquet")))
    return done.withColumn("start", F.col("start").cast("string"))


#: Days by which events of a type come late, days of a delivery, and days that are waited for late ones.
_LATE, _DELIVERY, _WAIT = {"error": 3, "signup": 1}, 6, 2
#: Events with the number of their delivery, and the watermark (in milliseconds) at each.
_DELIVERED = f"""
d as (select *, cast(epoch_us(ts - (select date_trunc('day', min(ts)) from events)) // 86400000000 + case event_type {" ".join(f"when '{t}' then {n}" for t, n in _LATE.items())} else 0 end as bigint) // {_DELIVERY} as number from events),
w as (select number, (select max(epoch_us(ts)) // 1000 from d y where y.number < x.number) - {_WAIT * 86_400_000} as mark from (select distinct number from d) x),
last as (select max(epoch_us(ts)) // 1000 - {_WAIT * 86_400_000} as mark from d)"""
_ON_TIME = "(mark is null or epoch_us(ts) > mark * 1000)"


def _deliveries(spark, sf_dir):
    """Events with the number of their delivery, and how many there are."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    begin = events.agg(F.date_trunc("day", F.min("ts")).alias("t")).first()["t"]
    late = F.lit(0)
    for kind, days in _LATE.items():
        late = F.when(F.col("event_type") == kind, days).otherwise(late)
    day = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(begin))) / 86_400_000_000) + late
    numbered = events.withColumn("number", F.floor(day / _DELIVERY).cast("long"))
    return numbered, (numbered.agg(F.max("number")).first()[0] or 0) + 1


def _run(spark, sf_dir, run, more=None):
    events, count = _deliveries(spark, sf_dir)
    every, count = (events, count) if more is None else (more(events), count + 1)
    return watchlist.deliver(every, F.col("number"), count, run)


@query(f"""with {_DELIVERED}
select cast(date_trunc('day', ts) as varchar) as start, event_type, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total from d join w using (number)
where mark is null or epoch_ms(date_trunc('day', ts) + interval 1 day) > mark
group by date_trunc('day', ts), event_type having epoch_ms(date_trunc('day', ts) + interval 1 day) <= (select mark from last)""")
def stream_late_counts(spark, sf_dir):
    """Counts of days from deliveries out of order; what comes after its day is closed is dropped."""
    return _run(spark, sf_dir, lambda s: watch.windowed_counts(s, late=f"{_WAIT} days")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss").cast("string"))


@query(f"""with {_DELIVERED},
 again as (select event_id, ts, number from d union all select event_id, ts, number + 1 from d where event_type in ('purchase', 'view')),
 x as (select distinct number from again), m as (select number, (select max(epoch_us(ts)) // 1000 from again y where y.number < x.number) - {_WAIT * 86_400_000} as mark from x)
select distinct event_id from again join m using (number) where {_ON_TIME}""")
def stream_once(spark, sf_dir):
    """Events of which some are delivered twice, each once."""
    twice = lambda e: e.unionByName(e.where("event_type in ('purchase', 'view')").withColumn("number", F.col("number") + 1))
    return _run(spark, sf_dir, lambda s: watchlist.once(s, id_col="event_id", at="ts", late=f"{_WAIT} days").select("event_id"), twice)


@query(f"""with {_DELIVERED},
 s as (select number, (select least(max(epoch_us(ts)) filter (event_type = 'error'), max(epoch_us(ts)) filter (event_type = 'purchase')) // 1000 from d y where y.number < w.number) - {_WAIT * 86_400_000} as mark from w),
 t as (select * from d join s using (number) where {_ON_TIME})
select a.event_id as first_id, b.event_id as then_id from t a join t b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 6 hours where a.event_type = 'error' and b.event_type = 'purchase'""")
def stream_followed(spark, sf_dir):
    """Purchases within six hours of an error of the same user, whichever is delivered first. The
    watermark is that of the side which is behind."""
    return _run(spark, sf_dir, lambda s: watchlist.followed(s, F.col("event_type") == "error", F.col("event_type") == "purchase", by="user_id", id_col="event_id", at="ts", within="6 hours", late=f"{_WAIT} days"))


@query(f"""with {_DELIVERED}, t as (select user_id, epoch_us(ts) // 1000 as ms, value from d join w using (number) where {_ON_TIME} and value is not null),
 r as (select *, sum(fresh) over (partition by user_id order by ms rows unbounded preceding) as visit from (select *, case when ms - lag(ms) over (partition by user_id order by ms) < 21600000 then 0 else 1 end as fresh from t))
select user_id as key, min(ms) as started, max(ms) as ended, count(*) as n, min(value) as least, max(value) as most from r group by user_id, visit having max(ms) + 21600000 <= (select mark from last)""")
def stream_visits(spark, sf_dir):
    """Visits of users, from deliveries out of order, as the state's timers close them."""
    return _run(spark, sf_dir, lambda s: watchlist.visits(s, by="user_id", at="ts", value="value", idle_ms=21_600_000, late=f"{_WAIT} days"))


@query("select event_type, min(value) as least, max(value) as most, count(*) as n from events group by 1")
def stream_running_extremes(spark, sf_dir):
    """Least and largest values so far of each type, kept as a stream's own state."""
    return watch.latest(watch.running_extremes(watch.read_events(spark, sf_dir, "events.parquet")), by=["event_type"], order="n")


@query("select p_brand, p_type, count(*) as n, max(p_size) as size from part group by rollup (p_brand, p_type)")
def part_rollup(spark, sf_dir):
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("size"))


@query("select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) as level, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def order_grouping_sets(spark, sf_dir):
    cols = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    return table(spark, sf_dir, "orders").groupingSets([[cols[0]], [cols[1]], []], *cols).agg(F.grouping_id(*cols).alias("level"), F.count("*").alias("n"))


@query("""
select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as counts, coalesce(max(case when event_type = 'click' then n end), 0) as clicks
from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def user_event_map(spark, sf_dir):
    """Each user's counts by type, as a map."""
    one = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    made = one.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return made.select("user_id", shown.alias("counts"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"))


@query("select s_suppkey, s_name, s_acctbal from supplier")
def json_round_trip(spark, sf_dir):
    path, own = shared_dir(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    own.write.json(path)
    return spark.read.schema(own.schema).json(path)


@query("select s_suppkey, s_name, s_acctbal from supplier")
def xml_round_trip(spark, sf_dir):
    path, own = shared_dir(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    own.write.format("xml").option("rowTag", "supplier").save(path)
    return spark.read.format("xml").option("rowTag", "supplier").schema(own.schema).load(path)


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())]))
class Words:
    """The words of a text with their places."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split(), 1)


@query("select word, cast(place as int) as place, count(*) as n from (select unnest(string_split(p_name, ' ')) as word, unnest(range(1, len(string_split(p_name, ' ')) + 1)) as place from part) group by 1, 2")
def name_words(spark, sf_dir):
    """Words of names by place, through a table function."""
    spark.udtf.register("words_of", Words)
    return spark.sql("select word, place, count(*) as n from {parts}, lateral words_of(p_name) group by word, place", parts=table(spark, sf_dir, "part"))


@F.pandas_udf(T.DoubleType())
def spread(v: pd.Series) -> float:
    return float(v.max() - v.min())


@query("select s_nationkey, max(s_acctbal) - min(s_acctbal) as spread from supplier group by 1")
def balance_spread(spark, sf_dir):
    """An aggregate function of one's own over groups of bounded size: the suppliers of a nation."""
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(spread("s_acctbal").alias("spread"))


@query("""
with recursive w as (select distinct p_partkey, p_brand, p_name, unnest(string_split(p_name, ' ')) as word from part),
 h as (select p_brand, word, min(p_partkey) as first_id, count(*) as n from w group by 1, 2)
select p_brand, word, first_id, n from h where n > 1""")
def shared_name_words(spark, sf_dir):
    """Products of a brand that share a word of their names: fuzzy groups across markets by blocking on words."""
    words = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    return words.groupBy("p_brand", "word").agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("n")).where("n > 1")


_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"


@query(f"select page_id, url, {_HOST} as host, md5(html) as html_md5 from pages where {_HOST} in (select distinct {_HOST} from pages order by 1 limit 3)")
def warc_hosts(spark, sf_dir):
    """All pages written as WARC files, and those of three hosts read back by the index."""
    warc.use(spark)
    path, own = shared_dir(spark), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    own.write.format("page_warc").mode("append").save(path)
    asked = [r[0] for r in own.select(pg.host(F.col("url")).alias("h")).distinct().orderBy("h").limit(3).collect()]
    found = spark.read.format("page_warc").load(path).where(F.col("host").isin(asked))
    return found.select("page_id", "url", "host", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query(f"select {_HOST} as host, count(*) as n, cast(sum(length(html)) as bigint) as n_chars from pages group by 1")
def warc_stream(spark, sf_dir):
    """Pages of two commits of WARC files, read as a stream."""
    warc.use(spark)
    path, own = shared_dir(spark), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    secure = F.coalesce(F.startswith("url", F.lit("https:")), F.lit(False))
    for part in (secure, ~secure):
        own.where(part).write.format("page_warc").mode("append").save(path)
    read = watch.drain(spark.readStream.format("page_warc").load(path).select("host", F.length("html").alias("n")))
    return read.groupBy("host").agg(F.count("*").alias("n"), F.sum("n").alias("n_chars"))


def _decoded(x: str) -> str:
    """SQL for a text of ``pages`` with its entities decoded and its white space collapsed."""
    for name, text in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{text}')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(rf"""
with l as (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as a from pages),
 e as (select page_id, unnest(a) as a, unnest(range(1, len(a) + 1)) as place from l)
select page_id, cast(place as int) as place, regexp_extract(a, '"([^"]*)"', 1) as href, {_decoded("regexp_extract(a, '>([^<]*)<', 1)")} as anchor from e""")
def page_links(spark, sf_dir):
    """The links of all pages with their anchors, in order."""
    read = html.read_pages(table(spark, sf_dir, "pages"), keep=["page_id"])
    return read.select("page_id", F.posexplode("links").alias("at", "l")).select("page_id", (F.col("at") + 1).alias("place"), "l.href", "l.anchor")


@query(rf"""
with l as (select page_id, regexp_extract_all(html, '<h[1-6]>[^<]*</h[1-6]>') as a from pages),
 e as (select page_id, unnest(a) as a, unnest(range(1, len(a) + 1)) as place from l)
select page_id, cast(place as int) as place, cast(substr(a, 3, 1) as int) as level, {_decoded("regexp_extract(a, '>([^<]*)<', 1)")} as heading from e""")
def page_headings(spark, sf_dir):
    read = html.read_pages(table(spark, sf_dir, "pages"), keep=["page_id"])
    return read.select("page_id", F.posexplode("headings").alias("at", "h")).select("page_id", (F.col("at") + 1).alias("place"), "h.level", F.col("h.text").alias("heading"))


@query(rf"""
with a as (select page_id, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) as x from pages),
 b as (select page_id, string_split(regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '</?(p|h1|br)>', chr(10), 'g'), '</?b>', '', 'g'), chr(10)) as parts from a),
 c as (select page_id, list_filter(list_transform(parts, lambda t: {_decoded("t")}), lambda t: t <> '') as lines from b)
select page_id, array_to_string(lines, chr(10)) as main_text, cast(len(lines) as int) as n_lines from c""")
def page_main_text(spark, sf_dir):
    """The main text of all pages, without frames and advertisements."""
    read = html.read_pages(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", html.main_text(F.col("blocks")).alias("main_text"))
    return read.withColumn("n_lines", F.when(F.col("main_text") == "", 0).otherwise(F.size(F.split("main_text", "\n"))).cast("int"))


@query("select host, count(*) as n, min(page_id) as first_id from (select page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host from pages) group by 1")
def hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(pg.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
