"""Named queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand in for captured market data: ``lineitem`` rows are priced offers of parts by
suppliers, nations map to countries, ``events`` are observations over time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as pg
from ..operators import clusters, cost, scoring, search, skyline, spelling, trust
from ..sources import catalogue as cat
from ..storage import broadcast_if_small, materialise, table
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, l_suppkey, price, origin): every priced line with its supplier's country."""
    country = F.element_at(F.array(*map(F.lit, cost.COUNTRIES)), F.pmod("s_nationkey", F.lit(8)) + 1)
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), country.alias("origin"))
    return unit_prices(spark, sf_dir).join(sellers, "l_suppkey")


_COUNTRY = "(" + " ".join(["case s_nationkey % 8", *[f"when {i} then '{c}'" for i, c in enumerate(cost.COUNTRIES)], "end"]) + ")"
_OFFERS = f"select l_partkey, l_suppkey, l_extendedprice / l_quantity as price, {_COUNTRY} as origin from lineitem join supplier on l_suppkey = s_suppkey"
_CHAIN = """select l_partkey, l_shipdate, price, lag(price) over (partition by l_partkey order by l_shipdate) as before_price
            from (select l_partkey, l_shipdate, min(l_extendedprice / l_quantity) as price from lineitem group by 1, 2)"""


def _landed(rates: str) -> str:
    return f"""
with o as ({_OFFERS}), r as ({rates}),
     c as (select l_partkey, l_suppkey, country, (price + ship) * (1e0 + case when origin = country then 0e0 else duty end) * (1e0 + vat) as landed from o, r),
     k as (select *, row_number() over (partition by l_partkey, country order by landed, l_suppkey) as place from c)
select l_partkey, country, landed, l_suppkey from k where place = 1"""


@query(_landed(cost.PROFILES_SQL))
def landed_best(spark, sf_dir):
    """The cheapest landed supplier of each part for each of eight countries."""
    return cost.landed_best(offers(spark, sf_dir), cost.profiles(spark), product="l_partkey", origin="origin", price="price", supplier="l_suppkey")


_OVERRIDDEN = f"""select p.country, coalesce(o.duty, p.duty) duty, coalesce(o.vat, p.vat) vat, coalesce(o.ship, p.ship) ship
from ({cost.PROFILES_SQL}) p left join ({cost.OVERRIDES_SQL}) o on p.country = o.country"""


@query(_landed(_OVERRIDDEN))
def landed_best_own_rates(spark, sf_dir):
    """The same with rates that a user has set."""
    rates = cost.overridden(cost.profiles(spark), spark.sql(cost.OVERRIDES_SQL))
    return cost.landed_best(offers(spark, sf_dir), rates, product="l_partkey", origin="origin", price="price", supplier="l_suppkey")


@query(f"""
with c as (select l_partkey, min(l_extendedprice / l_quantity) as price from lineitem group by 1), r as ({cost.PROFILES_SQL})
select p_partkey, country, ((p_retailprice * 3e0 / (1e0 + vat)) - (price / 10e0 + ship) * (1e0 + duty) * (1e0 + vat)) / (p_retailprice * 3e0 / (1e0 + vat)) as margin
from part join c on p_partkey = l_partkey, r""")
def vat_margin(spark, sf_dir):
    """Margin by country of parts sold at three times their retail price, bought in tens."""
    least = unit_prices(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("price").alias("price"))
    every = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").join(least, "p_partkey").crossJoin(F.broadcast(cost.profiles(spark)))
    paid = cost.landed(F.col("price") / 10.0, F.col("duty"), F.col("vat"), F.col("ship"))
    return every.select("p_partkey", "country", cost.vat_margin(F.col("p_retailprice") * 3.0, paid, F.col("vat")).alias("margin"))


@query(f"select l_partkey, cast(l_shipdate as date) as day, price, before_price, price - before_price as change from ({_CHAIN})")
def price_chain(spark, sf_dir):
    chain = cost.price_chain(unit_prices(spark, sf_dir), product="l_partkey", at="l_shipdate", price="price")
    return chain.select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "price", F.col("before").alias("before_price"), "change")


@query("""
select l_partkey, case when l_quantity >= 40 then 3 when l_quantity >= 20 then 2 when l_quantity >= 10 then 1 else 0 end as tier,
       min(l_extendedprice / l_quantity) as unit_price, count(*) as n_prices from lineitem group by 1, 2""")
def quantity_tiers(spark, sf_dir):
    return cost.quantity_tiers(unit_prices(spark, sf_dir), product="l_partkey", quantity="l_quantity", price="price", edges=[0, 10, 20, 40])


@query("""
with r as (select user_id % 5 as cur, ts, max(value) as value from events where event_type = 'signup' group by 1, 2),
     p as (select event_id, user_id % 5 as cur, ts from events where event_type = 'purchase')
select event_id, p.cur, r.value as asof_value from p asof left join r on p.cur = r.cur and p.ts >= r.ts""")
def rate_asof(spark, sf_dir):
    """Each purchase with the last rate of its currency before it (signups stand in for rates)."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("cur"), "ts", "value", "event_type")
    bought = e.where("event_type = 'purchase'").select("event_id", "cur", "ts")
    return cost.asof_join(bought, e.where("event_type = 'signup'"), by="cur", left_at="ts", right_at="ts", value="value").select("event_id", "cur", "asof_value")


_FACTS = """select s_suppkey, s_acctbal, coalesce(n, 0) as n_lines, returned / nullif(quantity, 0) as returned_share from supplier left join
 (select l_suppkey, count(*) n, cast(sum(cast(l_quantity as decimal(12,2))) as double) quantity,
         cast(sum(case when l_returnflag = 'R' then cast(l_quantity as decimal(12,2)) else 0 end) as double) returned from lineitem group by 1) on s_suppkey = l_suppkey"""


def facts(spark, sf_dir):
    return scoring.supplier_facts(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem"))


@query(f"""select s_suppkey, returned_share, volume_rank, (1e0 - coalesce(returned_share, 1e0)) * 0.5e0 + volume_rank * 0.5e0 as score
from (select *, percent_rank() over (order by n_lines) as volume_rank from ({_FACTS}))""")
def supplier_score(spark, sf_dir):
    return scoring.supplier_score(facts(spark, sf_dir))


@query(f"""select s_suppkey, n_lines >= 550 as enough_lines, coalesce(returned_share <= 34e-2, false) as few_returns, coalesce(s_acctbal >= 0, false) as solvent,
 cast((case when n_lines >= 550 then 40 else 0 end) + (case when returned_share <= 34e-2 then 35 else 0 end) + (case when s_acctbal >= 0 then 25 else 0 end) as int) as trust,
 n_lines >= 550 and coalesce(returned_share <= 34e-2, false) and coalesce(s_acctbal >= 0, false) as verified from ({_FACTS})""")
def supplier_trust(spark, sf_dir):
    return scoring.verified(facts(spark, sf_dir), min_lines=550, max_returned=0.34)


_DEALINGS = """select l_suppkey as supplier, o_custkey as customer, cast(sum(case when l_returnflag = 'R' then 0 else l_quantity end) as bigint) as kept, cast(sum(case when l_returnflag = 'R' then l_quantity else 0 end) as bigint) as returned
from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 0 group by 1, 2"""


@query(trust.mutual_trust_sql(_DEALINGS))
def mutual_trust(spark, sf_dir):
    """Trust in suppliers and reliability of customers, each from the other, in three rounds."""
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return trust.mutual_trust(trust.dealings(bought, supplier="l_suppkey", customer="o_custkey", quantity="l_quantity", returned="l_returnflag = 'R'"))


_AIMS = f"select l_partkey as product, l_extendedprice / l_quantity as cost, trust, cast(l_quantity as int) as quantity, l_suppkey as supplier from lineitem join ({SQL['supplier_trust']}) on l_suppkey = s_suppkey"


@query(f"""
with o as ({_AIMS}), u as (select product, cost, trust, quantity, min(supplier) as supplier from o group by 1, 2, 3, 4)
select * from u where not exists (select 1 from u b where b.product = u.product and b.cost <= u.cost and b.trust >= u.trust and b.quantity >= u.quantity and (b.cost < u.cost or b.trust > u.trust or b.quantity > u.quantity))""")
def best_sources(spark, sf_dir):
    """Offers of each part that no other one beats in price, trust and quantity."""
    trusted = materialise(supplier_trust(spark, sf_dir).select("s_suppkey", "trust"))
    own = unit_prices(spark, sf_dir).join(broadcast_if_small(trusted), F.col("l_suppkey") == F.col("s_suppkey"))
    return skyline.skyline(own.withColumn("quantity", F.col("l_quantity").cast("int")), product="l_partkey", cost="price", trust="trust", quantity="quantity", supplier="l_suppkey")


@query(f"""
with w as (select p_partkey, unnest(list_distinct(string_split_regex(lower(p_name), '[^a-z]+'))) as word from part),
     s as (select p_partkey, code, sum(weight) as points from w join ({scoring.CODES_SQL}) c on w.word = c.word group by 1, 2),
     b as (select *, row_number() over (partition by p_partkey order by points desc, code) as place from s)
select part.p_partkey, code, cast(points as bigint) as points from part left join b on part.p_partkey = b.p_partkey and place = 1""")
def customs_codes(spark, sf_dir):
    return scoring.suggest_codes(table(spark, sf_dir, "part"), scoring.codes(spark), id_col="p_partkey", text="p_name")


@query("""
with recursive e as (select a.p_partkey a, b.p_partkey b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_name = b.p_name
     and a.p_partkey <> b.p_partkey and abs(a.p_retailprice - b.p_retailprice) <= 5),
 reach as (select p_partkey as n, p_partkey as m from part union select reach.n, e.b from reach join e on reach.m = e.a)
select n as p_partkey, min(m) as cluster_id from reach group by 1""")
def same_product_clusters(spark, sf_dir):
    """Parts of one brand, type and name whose prices are near, joined along chains."""
    parts = table(spark, sf_dir, "part")
    return clusters.price_clusters(parts, id_col="p_partkey", keys=["p_brand", "p_type", "p_name"], price="p_retailprice", tolerance=5.0)


@query("select min(doc_id) as cluster_id, count(*) as n_members from documents where text is not null group by text having count(*) > 1")
def exact_text_clusters(spark, sf_dir):
    return clusters.exact_clusters(table(spark, sf_dir, "documents").where("text is not null"), id_col="doc_id", keys=["text"])


@query("""
with h as (select vec_id, label, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end)[1:32], '') as bits from embeddings),
     u as (select label, bits, min(vec_id) as rep, count(*) as n from h where label is not null group by 1, 2)
select x.rep as a, y.rep as b, x.n as n_a, y.n as n_b, cast(bit_count(xor(x.bits::bit, y.bits::bit)) as int) as distance
from u x join u y on x.label = y.label and x.rep < y.rep where bit_count(xor(x.bits::bit, y.bits::bit)) <= 7""")
def fingerprint_pairs(spark, sf_dir):
    """Pairs of 32-bit fingerprints at most 7 bits apart, within a label."""
    prints = table(spark, sf_dir, "embeddings").select("vec_id", "label", pg.sign_bits(F.slice("embedding", 1, 32)).alias("bits"))
    return clusters.hamming_pairs(prints, id_col="vec_id", bits="bits", by="label", distance=7, width=32)


_PRINTS = "select vec_id, label, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end)[1:32], '')::bit as bits from embeddings"


@query(f"""
with h as ({_PRINTS}),
 u as (select bits, min(vec_id) as lo, max(vec_id) as hi from h group by bits),
 p as (select x.vec_id as query, case when lo <> x.vec_id then lo when hi <> x.vec_id then hi end as id, cast(bit_count(xor(x.bits, u.bits)) as int) as distance from h x join u on bit_count(xor(x.bits, u.bits)) <= 6)
select query, cast(place as int) as place, id, distance from (select *, row_number() over (partition by query order by distance, id) as place from p where id is not null) where place <= 3""")
def nearest_fingerprints(spark, sf_dir):
    """Search by hash, as by image: for each fingerprint of 32 bits the three nearest others at most
    6 bits away, over all labels."""
    prints = table(spark, sf_dir, "embeddings").select("vec_id", pg.sign_bits(F.slice("embedding", 1, 32)).alias("bits"))
    return clusters.nearest_hashes(prints, prints, id_col="vec_id", bits="bits", distance=6, k=3, width=32)


@query("""
select page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as title,
       regexp_extract(html, '<html lang="([a-z-]+)"', 1) as lang, cast((length(html) - length(replace(html, '<a ', ''))) // 3 as bigint) as n_links from pages""")
def page_details(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pg.title(F.col("html")).alias("title"), pg.lang(F.col("html")).alias("lang"), pg.occurrences(F.col("html"), "<a ").alias("n_links"))


@query("""
select page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path,
       nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page from pages""")
def link_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", pg.host(u).alias("host"), pg.path(u).alias("path"), pg.parameter(u, "page").alias("page"))


@query("""
with d(word, translated) as (values ('halka', 'ring'), ('dişli', 'gear'), ('cıvata', 'bolt'), ('kırmızı', 'red'), ('mavi', 'blue'), ('küçük', 'small'), ('sıcak', 'hot')),
 q(query_id, first, second) as (values (1, 'kırmızı', 'halka'), (2, 'mavi', 'dişli'), (3, 'küçük', 'cıvata'), (4, 'sıcak', 'halka'), (5, 'ahşap', 'dişli'), (6, 'ahşap', 'masa'), (7, 'kırmızı', 'halka')),
 t as (select query_id, a.translated as x, b.translated as y from q left join d a on first = a.word left join d b on second = b.word),
 r as (select query_id, 1 as rung, x || ' ' || y as text from t where x is not null and y is not null union all select query_id, 2, y from t where y is not null),
 h as (select query_id, rung, text, count(*) as n_hits, min(p_partkey) as best_id from r join part on lower(p_name) = text or list_contains(string_split(lower(p_name), ' '), text) group by 1, 2, 3)
select query_id, rung, text, n_hits, best_id from (select *, row_number() over (partition by query_id order by rung) as place from h) where place = 1""")
def query_ladder(spark, sf_dir):
    rungs = search.ladder(spark.sql(search.QUERIES_SQL), search.dictionary(spark), lang="en")
    return search.first_hits(rungs, table(spark, sf_dir, "part"), id_col="p_partkey", name="p_name")


@query(f"""select l_partkey, cast(l_shipdate as date) as day, price, before_price from ({_CHAIN})
where l_partkey in (select p_partkey from part where p_brand = 'Brand#7') and before_price > 0 and price <= before_price * 0.8e0""")
def watchlist_drops(spark, sf_dir):
    """Falls of 20 % or more of watched parts."""
    watched = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"))
    # the watch comes first, so other parts' prices are never ranked
    chain = cost.price_chain(search.members(unit_prices(spark, sf_dir), watched, key="l_partkey"), product="l_partkey", at="l_shipdate", price="price")
    return search.price_drops(chain, watched, key="l_partkey", share=0.2).select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "price", F.col("before").alias("before_price"))


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem where l_partkey in (select p_partkey from part where p_size = 15)")
def project_offers(spark, sf_dir):
    project = table(spark, sf_dir, "part").where("p_size = 15").select(F.col("p_partkey").alias("l_partkey"))
    return search.members(table(spark, sf_dir, "lineitem"), project, key="l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"select l_partkey, {', '.join(f'''min(case when origin = '{c}' then price end) as {c}''' for c in cost.COUNTRIES)} from ({_OFFERS}) group by 1")
def market_comparison(spark, sf_dir):
    return search.comparison(offers(spark, sf_dir), rows="l_partkey", columns="origin", values=cost.COUNTRIES, cost="price")


@query(cat.CATALOGUE_SQL.format(source=f"(select range as id from range({cat.PRODUCTS}))"))
def catalogue(spark, sf_dir):
    return cat.catalogue(spark)


@query("""
select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as sum_price,
       cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(1 - l_discount as decimal(4,2))) as double) as sum_net, count(*) as n
from lineitem where l_shipdate <= timestamp '2001-09-02' group by 1, 2""")
def pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2001-09-02'")
    price, net = F.col("l_extendedprice").cast("decimal(12,2)"), (1 - F.col("l_discount")).cast("decimal(4,2)")
    sums = {"sum_qty": F.col("l_quantity").cast("decimal(12,2)"), "sum_price": price, "sum_net": price * net}
    return lines.groupBy("l_returnflag", "l_linestatus").agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()], F.count("*").alias("n"))


@query("""
select p_brand, p_type, grouping_id(p_brand, p_type) as level, count(*) as n, cast(sum(cast(p_retailprice as decimal(12,2))) as double) as total from part group by cube(p_brand, p_type)""")
def price_cube(spark, sf_dir):
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(F.col("p_retailprice").cast("decimal(12,2)")).cast("double").alias("total"))


@query("""
with o as (select o_orderkey, o_custkey, epoch_us(o_orderdate) / 86400000000e0 as day from orders)
select a.o_custkey, a.o_orderkey as first_order, b.o_orderkey as second_order from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.day < b.day + 20e0 and b.day < a.day + 20e0""")
def overlapping_orders(spark, sf_dir):
    """Orders of one customer whose twenty days of delivery overlap."""
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86_400_000_000)
    spans = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.alias("lo"), (day + 20).alias("hi"))
    met = search.overlap_join(spans, spans, start="lo", stop="hi", width=1.0, by=["o_custkey"]).where("a.o_orderkey < b.o_orderkey")
    return met.select("a.o_custkey", F.col("a.o_orderkey").alias("first_order"), F.col("b.o_orderkey").alias("second_order"))


@query("""
with n as (select lower(p_name) as name, min(p_partkey) as id, count(*) as c from part group by 1),
 q as (select id as query_id, substr(name, 1, 1) || substr(name, 3) || ' cheapest' as text from n),
 w as (select distinct query_id, unnest(string_split(text, ' ')) as word from q),
 v as (select word, count(*) as n from (select distinct p_partkey, unnest(string_split(lower(p_name), ' ')) as word from part) group by 1),
 c as (select x.word, v.word as found, v.n, row_number() over (partition by x.word order by levenshtein(x.word, v.word), v.n desc, v.word) as r
  from (select distinct word from w) x join v on levenshtein(x.word, v.word) <= case when length(x.word) >= 8 then 2 when length(x.word) >= 4 then 1 else 0 end),
 b as (select distinct query_id, found, n from w join c using (word) where r = 1),
 p as (select *, row_number() over (partition by query_id order by n, found) as place, count(*) over (partition by query_id) as total from b),
 r as (select query_id, total - k + 1 as rung, list(found order by found) as words from p join (select unnest(range(1, 10)) as k) on place <= k and k <= total group by query_id, total, k),
 h as (select query_id, rung, words, sum(c) as n_hits, min(id) as best_id from r join n on list_has_all(string_split(name, ' '), words) group by all)
select query_id, cast(rung as int) as rung, array_to_string(words, ' ') as words, cast(n_hits as bigint) as n_hits, best_id from (select *, row_number() over (partition by query_id order by rung) as f from h) where f = 1""")
def misspelt_search(spark, sf_dir):
    """Every name, without its second letter and with a word that no name holds: its corrected
    words, and the first rung with hits."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    asked = names.groupBy("name").agg(F.min("p_partkey").alias("query_id"))
    asked = asked.select("query_id", F.concat(F.substring("name", 1, 1), F.substring("name", 3, 1000), F.lit(" cheapest")).alias("text"))
    return spelling.spelled_hits(asked, names, id_col="p_partkey", name="name")


@query("""
select c_mktsegment, o_orderkey, o_totalprice, place from (select c_mktsegment, o_orderkey, o_totalprice, cast(row_number() over (partition by c_mktsegment order by o_totalprice desc, o_orderkey) as int) as place
from orders join customer on o_custkey = c_custkey) where place <= 5""")
def top_orders(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return search.top_per_group(joined, by=["c_mktsegment"], order=[F.desc("o_totalprice"), F.col("o_orderkey")], n=5).select("c_mktsegment", "o_orderkey", "o_totalprice", "place")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def idle_customers(spark, sf_dir):
    """Customers without a large order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
select p_partkey, band from part join (values (0, 900e0, 925e0), (1, 920e0, 950e0), (2, 950e0, 990e0)) as t(band, lo, hi) on p_retailprice >= lo and p_retailprice < hi""")
def price_bands(spark, sf_dir):
    bands = spark.sql("select band, cast(lo as double) lo, cast(hi as double) hi from (values (0, 900, 925), (1, 920, 950), (2, 950, 990)) as t(band, lo, hi)")
    return search.interval_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, at="p_retailprice", start="lo", stop="hi", width=10.0).select("p_partkey", "band")


@query("""
select nation_key, side from (
 (select s_nationkey as nation_key, 'both' as side from supplier intersect select c_nationkey, 'both' from customer)
 union all (select c_nationkey, 'customers only' from customer except select s_nationkey, 'customers only' from supplier))""")
def nation_sets(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation_key")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation_key"))
    return s.intersect(c).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers only")))


@query("select event_type, cast(json_extract_string(props, '$.k') as int) % 10 as k, count(*) as n from events group by 1, 2")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("""
select user_id, count(*) as n_events, cast(min(ts) as varchar) as first_at from (
 select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events))
group by user_id, run""")
def user_sessions(spark, sf_dir):
    return search.sessions(table(spark, sf_dir, "events"), by="user_id", at="ts", gap_seconds=6 * 3600).select("user_id", "n_events", F.col("first_at").cast("string").alias("first_at"))


_DAY = "select cast(date_trunc('day', ts) as varchar) as start, event_type, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total from events {} group by 1, 2"


@query(_DAY.format(""))
def daily_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.windowed_counts(e).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(_DAY.format("where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour"))
def stream_daily_events(spark, sf_dir):
    """The same from a stream: the days that the watermark has passed."""
    done = watch.drain(watch.windowed_counts(watch.read_events(spark, sf_dir, "events.parquet")))
    return done.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("select event_id, user_id, value from events where value >= 15 and user_id in (select user_id from events where event_type = 'signup' and value >= 150)")
def stream_alerts(spark, sf_dir):
    watched = table(spark, sf_dir, "events").where("event_type = 'signup' and value >= 150").select("user_id").distinct()
    return watch.drain(watch.alerts(watch.read_events(spark, sf_dir, "events.parquet"), watched, above=15.0).select("event_id", "user_id", "value"))
