"""Operators on small rows of our own."""

import random
import struct
import zlib

from mercantile.functions import images
from mercantile.operators import clusters, cost, scoring, search
from mercantile.sources import adapters


def test_hamming_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(4)]
    prints = [(i, i % 2, b ^ sum(1 << p for p in rng.sample(range(63), rng.randint(0, 5)))) for i, b in enumerate(base * 12)] + [(90, None, 1), (91, 0, None), (92, 0, -1), (93, 0, -2)]
    got = {(r["a"], r["b"]): r["distance"] for r in clusters.hamming_pairs(spark.createDataFrame(prints, "id long, g int, bits long"), id_col="id", bits="bits", by="g", distance=7).collect()}
    first = {}
    for i, g, b in prints:
        if g is not None and b is not None:
            first.setdefault((g, b), i)
    want = {(i, j): ((b ^ c) & (2**64 - 1)).bit_count() for (g, b), i in first.items() for (h, c), j in first.items() if g == h and i < j}
    assert got == {k: v for k, v in want.items() if v <= 7} and (92, 93) in got


def test_components_do_not_hang_on_order(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 51), (51, 50), (7, 7)]
    got = {r["node"]: r["component"] for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50}


def test_adapters_and_bulk_search(spark, tmp_path):
    pages = [("trendyol", "u1", '<title> Red Ring </title><b class="price">1.234,50 TL</b><i class="seller">Ali</i>'), ("ebay", "u2", '<title>red gear</title><b class="price">$1,234.50</b>'), ("ebay", "u3", None), ("unknown", "u4", "<title>red ring</title>")]
    found = adapters.search(spark.createDataFrame(pages, "market string, url string, html string"))
    rows = {r["url"]: (r["title"], None if r["price"] is None else str(r["price"]), r["seller"]) for r in found.collect()}
    assert rows == {"u1": ("Red Ring", "1234.50", "Ali"), "u2": ("red gear", "1234.50", None), "u3": (None, None, None)}
    (tmp_path / "q.csv").write_text('query,market\n"ring red",trendyol\nred,\n"red, blue",ebay\n')
    asked = adapters.read_bulk_queries(spark, str(tmp_path / "q.csv"))
    assert sorted((r["query"], r["url"]) for r in adapters.bulk_search(asked, found).collect()) == [("red", "u1"), ("red", "u2"), ("ring red", "u1")]
    adapters.export_csv(found.select("url", "title"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_turkish_and_ladder(spark):
    assert spark.range(1).select(search.turkish_lower(search.F.lit("KIRMIZI İP"))).first()[0] == "kırmızı ip"
    rungs = search.ladder(spark.sql(search.QUERIES_SQL), search.dictionary(spark), lang="en").where("query_id = 5").collect()
    assert [(r["rung"], r["text"]) for r in rungs] == [(2, "gear")]


def test_asof_carries_over_days(spark):
    left = spark.sql("select * from values (1, 'a', timestamp'2024-01-01'), (2, 'a', timestamp'2024-03-01'), (3, 'b', timestamp'2024-03-01'), (4, 'a', null) as t(id, k, ts)")
    right = spark.sql("select * from values ('a', timestamp'2024-01-01', 1.5D), ('a', timestamp'2024-01-05', 2.5D), ('a', timestamp'2024-01-05', 2.0D), ('a', timestamp'2024-03-02', 9D) as t(k, ts, v)")
    got = {r["id"]: r["asof_v"] for r in cost.asof_join(left, right, by="k", left_at="ts", right_at="ts", value="v").collect()}
    assert got == {1: 1.5, 2: 2.5, 3: None, 4: None}


def test_percent_ranks(spark):
    values = [3, 1, 1, 2, None, 9]
    got = scoring.percent_ranks(spark.createDataFrame([(v,) for v in values], "v int"), "v", "r").collect()
    assert sorted((r["v"], r["r"]) for r in got if r["v"] is not None) == [(1, 0.0), (1, 0.0), (2, 0.5), (3, 0.75), (9, 1.0)] and len(got) == 6


def png(rows):
    raw = b"".join(b"\x00" + bytes(r) for r in rows)

    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    size = struct.pack(">IIBBBBB", len(rows[0]) if rows else 0, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", size) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def bmp(rows):
    """24 bits, rows from the last to the first; widths that are multiples of four."""
    data = b"".join(bytes(x for v in r for x in (v, v, v)) for r in reversed(rows))
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, len(rows[0]), len(rows), 1, 24, 0, len(data), 0, 0, 0, 0) + data


def test_image_hash(spark, tmp_path):
    rng = random.Random(1)
    rows = [[rng.randrange(256) for _ in range(64)] for _ in range(64)]
    (tmp_path / "a.png").write_bytes(png(rows))
    (tmp_path / "b.bmp").write_bytes(bmp(rows))
    (tmp_path / "c.png").write_bytes(b"junk")
    (tmp_path / "d.png").write_bytes(png([])[:20])
    got = {r["path"][-5:]: r["hash"] for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got["a.png"] == got["b.bmp"] is not None and got["c.png"] is got["d.png"] is None


def test_price_clusters(spark):
    """Chains of prices by brute force, over equal prices, cell edges, nulls and one hot product."""
    rng = random.Random(3)
    offers = [(i, rng.choice("ab"), rng.choice([None, *[round(rng.uniform(0, 60), 2) for _ in range(5)], 5.0, 10.0])) for i in range(120)] + [(500, None, 1.0)]
    got = {r["id"]: r["cluster_id"] for r in clusters.price_clusters(spark.createDataFrame(offers, "id long, k string, p double"), id_col="id", keys=["k"], price="p", tolerance=2.5).collect()}
    want = {i: i for i, k, p in offers}
    for key in "ab":
        own, run = sorted((p, i) for i, k, p in offers if k == key and p is not None), []
        for p, i in own:
            if run and p - run[-1][0] > 2.5:
                want |= {j: min(x for _, x in run) for _, j in run}
                run = []
            run.append((p, i))
        want |= {j: min(x for _, x in run) for _, j in run}
    assert got == want


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from mercantile.storage import shared_dir

    with pytest.raises(ValueError, match="share"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:1")))
