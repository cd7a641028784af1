"""Joins by similarity: token sets, fingerprints, hot keys."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercantile.functions import images
from mercantile.operators import clusters, search, similar, skew, spelling
from mercantile.sources import fixtures


def brute_sets(rows, least=0.7):
    """Representatives of (group, set), and the pairs of different groups that are similar."""
    reps, members = {}, {}
    for i, g, t in rows:
        key = (g, frozenset(x for x in t or () if x is not None))
        if i is None or g is None or not key[1]:
            continue
        reps[key] = min(i, reps.get(key, i))
    for i, g, t in rows:
        members[i] = reps.get((g, frozenset(x for x in t or () if x is not None)), i)
    df = Counter(x for _, s in reps for x in s)
    w = {x: (len(reps) // n).bit_length() for x, n in df.items()}
    pairs = {}
    for (g, s), a in reps.items():
        for (h, t), b in reps.items():
            if g < h:
                shared, total = sum(w[x] for x in s & t), sum(w[x] for x in s | t)
                if shared * 10 >= total * 7:
                    pairs[a, b] = (shared, total)
    return members, pairs


@pytest.mark.parametrize(("hot", "dealt"), [(1, 3), (5, 4096), (10**6, 7)])
def test_similar_sets(spark, monkeypatch, hot, dealt):
    """Crowded first tokens, keys dealt over tasks, copies, empty and null sets, tokens twice."""
    monkeypatch.setattr(skew, "HOT_ROWS", dealt)
    rng = np.random.default_rng(11)
    kinds = [f"t{i}" for i in range(25)]
    share = np.array([1 / (i + 1) for i in range(25)])
    rows = []
    for i in range(260):
        base = list(rng.choice(kinds, rng.integers(1, 7), replace=False, p=share / share.sum()))
        rows.append((i, "abc"[i % 3], [*map(str, base), *map(str, base[:1])]))
    rows += [(1000 + i, "d", ["t0", "t1"]) for i in range(30)] + [(2000 + i, "e", ["t0", "t1", None]) for i in range(30)]
    rows += [(3000, "a", []), (3001, "a", None), (3002, None, ["t0"]), (3003, "b", ["t0"])]
    found = similar.similar_sets(spark.createDataFrame(rows, "i long, g string, t array<string>"), id_col="i", group="g", tokens="t", hot=hot)
    members, pairs = brute_sets(rows)
    assert {r["id"]: r["rep"] for r in found.members.collect()} == members
    got = [(r["a"], r["b"], r["shared"], r["total"]) for r in found.pairs.collect()]
    assert len(got) == len(pairs) > 50 and {(a, b): (s, t) for a, b, s, t in got} == pairs


def test_similar_sets_meet_seldom(spark):
    """Titles of few words, all crowded: few sets meet that are not similar, and no pair is lost."""
    rng = np.random.default_rng(3)
    kinds = {"a": 8, "n": 8, "b": 10, "k": 6, "s": 20}
    rows = [(i, "pqr"[i % 3], [f"{x}{rng.integers(0, n)}" for x, n in kinds.items()]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "rep long, group string, tokens array<string>")
    bodies = similar.weighed(frame).groupBy("rep").agg(F.first("group").alias("group"), F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("df", "token", "w", "rest"))).alias("body"))
    keyed = similar.keyed_sets(bodies, (7, 10), 5).select("key", "rep", "group", "total", "short").collect()
    light, met = {}, set()
    for r in keyed:
        if r["short"]:
            light.setdefault(tuple(r["key"]), []).append(r)
    for h in keyed:
        met |= {frozenset((x["rep"], h["rep"])) for x in light.get(tuple(h["key"]), ()) if x["group"] != h["group"] and (x["total"], x["rep"]) < (h["total"], h["rep"])}
    found = similar.similar_sets(frame, id_col="rep", group="group", tokens="tokens", hot=5).pairs.collect()
    pairs = {frozenset((r["a"], r["b"])) for r in found}
    assert pairs == {frozenset(p) for p in brute_sets(rows)[1]} and len(pairs) > 50
    assert pairs <= met and len(met) < 2000


def test_similar_sets_empty(spark):
    found = similar.similar_sets(spark.createDataFrame([], "i long, g string, t array<string>"), id_col="i", group="g", tokens="t")
    assert found.members.count() == found.pairs.count() == 0


def test_dealt_join(spark, monkeypatch):
    """A key with most rows is in many tasks, and every pair is there once."""
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([("hot", i) for i in range(5)] + [("cold", 9), (None, 1)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 3), (None, 2)], "k string, b int")
    joined = skew.dealt_join(left, right, ["k"], by=F.col("b"))
    assert sorted(map(tuple, joined.collect())) == sorted([("hot", a, b) for a in range(5) for b in range(100)] + [("cold", 9, 3)])


def test_blocks():
    """No two fingerprints within the distance miss each other, and few others meet."""
    for width, distance in ((32, 7), (64, 10), (16, 3), (8, 8), (4, 0)):
        cut = clusters.blocks(width, distance, 20_000)
        assert sum(r + 1 for _, _, r in cut.cuts) >= distance + 1 and sum(w for _, w, _ in cut.cuts) == width
    assert clusters.blocks(32, 7, 2000).share < 0.05 and clusters.blocks(64, 7, 10**9).share < 0.001
    assert sorted(clusters.flips(3, 1)) == [0, 1, 2, 4]


@pytest.mark.parametrize(("width", "distance", "dealt"), [(16, 3, 4), (64, 9, 4096), (12, 12, 50)])
def test_nearest_hashes(spark, monkeypatch, width, distance, dealt):
    monkeypatch.setattr(skew, "HOT_ROWS", dealt)
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 63), 1 << 63, 6, dtype=np.int64)
    mask = (1 << width) - 1
    prints = []
    for i in range(80):
        x = int(base[i % 6])
        for b in rng.choice(width, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        x &= mask
        prints.append((i, x - (1 << 64) if x >= 1 << 63 else x))
    prints += [(100, prints[0][1]), (101, prints[0][1]), (102, None)]
    frame = spark.createDataFrame(prints, "i long, x long")
    got = {}
    for r in clusters.nearest_hashes(frame, frame, id_col="i", bits="x", distance=distance, k=4, width=width).collect():
        got.setdefault(r["query"], []).append((r["place"], r["distance"], r["id"]))
    same = {}
    for j, y in prints:
        if y is not None:
            same.setdefault(y, []).append(j)
    for i, x in prints:
        near = []
        for y, ids in same.items():
            d = ((x ^ y) & (1 << 64) - 1).bit_count() if x is not None else width + 1
            if d <= distance and (ids[0] != i or ids[-1] != i):
                near.append((d, ids[0] if ids[0] != i else ids[-1]))
        assert sorted(got.get(i, [])) == [(k + 1, d, j) for k, (d, j) in enumerate(sorted(near)[:4])]


def test_image_search(spark):
    """A product's image is found by a brighter and by a noisy copy of it, not by others."""
    rng = np.random.default_rng(4)
    shots = [np.kron(rng.integers(0, 200, (6, 6)), np.ones((20, 20))) for _ in range(12)]
    index = spark.createDataFrame([(i, images.phash(x)) for i, x in enumerate(shots)], "id long, h long")
    asked = spark.createDataFrame([(100 + i, images.phash(x * 1.1 + 5)) for i, x in enumerate(shots)] + [(200 + i, images.phash(x + rng.normal(0, 15, x.shape))) for i, x in enumerate(shots)], "id long, h long")
    got = {r["query"]: r["id"] for r in clusters.nearest_hashes(asked, index, id_col="id", bits="h", distance=10, k=1).collect()}
    assert all(got[k + i] == i for k in (100, 200) for i in range(12))


def test_turkish_titles(spark):
    offers = spark.createDataFrame([("trendyol", "u1", "tr", "KIRMIZI HALKA"), ("ebay", "u2", "en", "RED RING I"), ("ebay", "u3", "en", None)], "market string, url string, lang string, title string")
    low = search.lowered(F.col("title"), F.col("lang"))
    assert [r[0] for r in offers.orderBy("url").select(low).collect()] == ["kırmızı halka", "red ring i", None]
    rungs = spark.createDataFrame([(1, "tr", 1, "kırmızı top"), (1, "tr", 2, "kırmızı"), (2, "en", 1, "ring red"), (2, "en", 2, "red"), (3, "en", 1, "anvil")], "query_id int, lang string, rung int, text string")
    assert sorted((r["query_id"], r["rung"], r["url"]) for r in search.ladder_hits(rungs, offers).collect()) == [(1, 2, "u1"), (2, 1, "u2")]


@pytest.mark.parametrize("dealt", [3, 4096])
def test_intervals(spark, monkeypatch, dealt):
    """Intervals of all lengths and levels, one over everything, points that crowd one cell, nulls."""
    monkeypatch.setattr(skew, "HOT_ROWS", dealt)
    rng = np.random.default_rng(9)
    points = [(i, "ab"[i % 2], float(x)) for i, x in enumerate(rng.uniform(-50, 50, 60))] + [(100 + i, "a", 7.25) for i in range(20)] + [(200, "a", None), (201, None, 1.0), (202, "b", -1e6)]
    spans = [(i, "ab"[i % 2], float(lo), float(lo + 2.0 ** rng.integers(-6, 7))) for i, lo in enumerate(rng.uniform(-60, 50, 60))]
    spans += [(90, "a", -1e9, 1e9), (91, "a", 5.0, 5.0), (92, "a", 6.0, 5.0), (93, "b", None, 1.0), (94, None, 0.0, 2.0), (95, "a", 7.25, 8.25)]
    p, s = spark.createDataFrame(points, "i int, g string, at double"), spark.createDataFrame(spans, "j int, g string, lo double, hi double")
    got = sorted((r["i"], r["j"]) for r in search.interval_join(p, s, at="at", start="lo", stop="hi", width=1.0, by=["g"]).collect())
    assert got == sorted((i, j) for i, g, x in points for j, h, lo, hi in spans if g and g == h and x is not None and lo is not None and lo <= x < hi)
    both = sorted((r["a"]["j"], r["b"]["j"]) for r in search.overlap_join(s, s, start="lo", stop="hi", width=1.0, by=["g"]).collect())
    assert both == sorted((i, j) for i, g, a, b in spans for j, h, c, d in spans if g and g == h and None not in (a, c) and a < b and c < d and a < d and c < b)


def test_wide_intervals_are_not_spread(spark):
    """An interval a million million cells wide is looked up like any other."""
    p, s = spark.createDataFrame([(1, 5.0), (2, -1.0)], "i int, at double"), spark.createDataFrame([(1, 0.0, 1e12)], "j int, lo double, hi double")
    assert [r["i"] for r in search.interval_join(p, s, at="at", start="lo", stop="hi", width=1.0).collect()] == [1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_corrected(spark):
    rng = np.random.default_rng(6)
    known = {"".join(rng.choice(list("abc"), rng.integers(1, 11))): int(rng.integers(1, 5)) for _ in range(150)}
    asked = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 11))) for _ in range(120)} | {"", "a"})
    got = {r["word"]: (r["distance"], -r["n"], r["found"]) for r in spelling.corrected(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, n long")).collect()}
    want = {}
    for w in asked:
        allowed = 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0
        near = [(d, -n, k) for k, n in known.items() if (d := levenshtein(w, k)) <= allowed]
        if near:
            want[w] = min(near)
    assert got == want and len(want) > 60


def test_ladder_drops_common_words(spark):
    names = [(i, f"red {x}") for i, x in enumerate(["gear", "gear", "ring", "bolt", "anvil"])] + [(9, "blue sprocket")]
    asked = spark.createDataFrame([(1, "red geer"), (2, "blue anvil"), (3, "sprokcet red"), (4, "zzzz"), (5, "")], "query_id int, text string")
    got = {r["query_id"]: (r["rung"], r["words"], r["n_hits"], r["best_id"]) for r in spelling.spelled_hits(asked, spark.createDataFrame(names, "id int, name string"), id_col="id", name="name").collect()}
    assert got == {1: (1, "gear red", 2, 0), 2: (2, "anvil", 1, 4), 3: (2, "sprocket", 1, 9)}


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_meetings(monkeypatch, held):
    """Each pair within the distance once, as brute force finds them, however little is held at once;
    no fingerprint is copied for each of its near keys."""
    monkeypatch.setattr(clusters, "AT_ONCE", 64)
    monkeypatch.setattr(clusters, "MOST_HELD", held)
    rng = np.random.default_rng(5)
    xa, xb = (rng.integers(0, 1 << 32, n, dtype=np.uint64) for n in (200, 1500))
    xb[:300] = xa[rng.integers(0, 200, 300)] ^ (np.uint64(1) << rng.integers(0, 32, 300, dtype=np.uint64))
    want = {(i, j): n for i, j, n in ((i, j, int(n)) for i, row in enumerate(np.bitwise_count(xa[:, None] ^ xb)) for j, n in enumerate(row)) if n <= 6}
    for cut in (clusters.blocks(32, 6, 1500), clusters.Blocks(((0, 22, 3), (22, 10, 2)))):
        pairs = [p for i, j, far in clusters.meetings(xa, xb, 6, cut) for p in zip(i.tolist(), j.tolist(), far.tolist(), strict=True)]
        assert len(pairs) == len(want) > 300 and {(i, j): n for i, j, n in pairs} == want


def test_hashes_in_slices(spark, monkeypatch):
    """The nearest over many slices are those of one."""
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(0, 1 << 12, 400))], "i long, x long")
    found = lambda: sorted(map(tuple, clusters.nearest_hashes(frame, frame, id_col="i", bits="x", distance=2, k=3, width=12).collect()))
    whole = found()
    monkeypatch.setattr(clusters, "LEFT_PRINTS", 50)
    monkeypatch.setattr(clusters, "RIGHT_PRINTS", 90)
    assert whole and found() == whole


def test_ladder_hits_of_offers_listed_twice(spark):
    """Words are not counted: an offer that is listed twice is found twice, and a rung named twice finds it no more often."""
    offers = spark.createDataFrame([("u1", "en", "small red ring"), ("u1", "en", "small red ring"), ("u2", "en", "ring ring blue")], "url string, lang string, title string")
    rungs = spark.createDataFrame([(1, "en", 1, "red ring ring"), (1, "en", 1, "red ring ring"), (1, "en", 2, "ring"), (2, "en", 1, "red bolt"), (2, "en", 2, "ring")], "query_id int, lang string, rung int, text string")
    assert sorted((r["query_id"], r["rung"], r["url"]) for r in search.ladder_hits(rungs, offers).collect()) == [(1, 1, "u1"), (1, 1, "u1"), (2, 2, "u1"), (2, 2, "u1"), (2, 2, "u2")]


def test_pages_are_made_by_as_many_tasks_as_items_ask_for(spark, monkeypatch):
    items = spark.range(40).selectExpr("id as item", "'red ring' as name", "'Brand#1' as brand", "'SMALL' as kind", "cast(id as int) as size", "id * 100 as cents").coalesce(1)
    whole = sorted(map(tuple, fixtures.market_pages(items).collect()))
    monkeypatch.setattr(fixtures, "TASK_ITEMS", 5)
    dealt = fixtures.market_pages(items)
    assert dealt.rdd.getNumPartitions() == 8 and sorted(map(tuple, dealt.collect())) == whole
