"""Trust, several aims, ranks over whole tables."""

import numpy as np
import pytest

from mercantile.operators import clusters, scoring, skew, skyline, trust


def brute_trust(pairs, rounds):
    one = trust.ONE
    weight = {c: one for _, c, _, _ in pairs}
    share = {}
    for _ in range(rounds):
        kept, every = {}, {}
        for s, c, k, r in pairs:
            kept[s] = kept.get(s, 0) + k * weight[c]
            every[s] = every.get(s, 0) + (k + r) * weight[c]
        n, k_all, e_all = len(kept), sum(kept.values()), sum(every.values())
        share = {s: (kept[s] + k_all // n) * one // (every[s] + e_all // n) for s in kept}
        agreed, all_of = {}, {}
        for s, c, k, r in pairs:
            agreed[c] = agreed.get(c, 0) + k * share[s] + r * (one - share[s])
            all_of[c] = all_of.get(c, 0) + k + r
        weight = {c: agreed[c] // all_of[c] for c in agreed}
    return share


@pytest.mark.parametrize(("rounds", "dealt"), [(1, 4096), (4, 5)])
def test_mutual_trust(spark, monkeypatch, rounds, dealt):
    monkeypatch.setattr(skew, "HOT_ROWS", dealt)
    rng = np.random.default_rng(1)
    pairs = [(int(s), int(c), int(rng.integers(0, 50)), int(rng.integers(1, 20))) for s in range(8) for c in range(30) if rng.random() < 0.5 or s == 0]
    got = {r["supplier"]: r["trust"] for r in trust.mutual_trust(spark.createDataFrame(pairs, "supplier long, customer long, kept long, returned long"), rounds=rounds).collect()}
    assert got == brute_trust(pairs, rounds)


def test_grudging_customer_counts_less(spark):
    """A customer that returns everything, from whomever, weighs less than those that agree."""
    lines = [(s, c, 10.0, "A") for s in (1, 2) for c in range(10)] + [(1, 99, 30.0, "R"), (2, 99, 30.0, "R"), (3, 1, 10.0, "R"), (3, 2, 10.0, "R"), (None, 1, 5.0, "A"), (4, 1, None, "A")]
    frame = trust.dealings(spark.createDataFrame(lines, "s int, c int, q double, f string"), supplier="s", customer="c", quantity="q", returned="f = 'R'")
    first, later = ({r["supplier"]: r["trust"] for r in trust.mutual_trust(frame, rounds=n).collect()} for n in (1, 3))
    assert first.keys() == {1, 2, 3} and later[1] > first[1] and later[3] < later[1]
    assert trust.mutual_trust(frame.limit(0)).count() == 0


def test_skyline(spark):
    rng = np.random.default_rng(3)
    rows = [(int(p), float(rng.integers(1, 12)), int(rng.integers(0, 4)) * 25, int(rng.integers(1, 6)), i) for i, p in enumerate(rng.choice(4, 300, p=[0.7, 0.1, 0.1, 0.1]))]
    rows += [(9, 1.0, 25, 3, 1000), (9, 1.0, 25, 3, 999), (9, None, 25, 3, 5), (9, 1.0, None, 3, 6)]
    got = sorted(map(tuple, skyline.skyline(spark.createDataFrame(rows, "p int, c double, t int, q int, s int"), product="p", cost="c", trust="t", quantity="q", supplier="s").collect()))
    first = {}
    for p, c, t, q, s in rows:
        if None not in (c, t):
            first[p, c, t, q] = min(s, first.get((p, c, t, q), s))

    def beats(a, b):
        return a[0] == b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3] and a != b

    assert got == sorted((*k, s) for k, s in first.items() if not any(beats(o, k) for o in first))
    assert skyline.skyline(spark.createDataFrame([], "p int, c double, t int, q int, s int"), product="p", cost="c", trust="t", quantity="q", supplier="s").count() == 0


def test_skyline_tasks_follow_the_offers(spark, monkeypatch):
    """No offer is copied for each level of trust, and tasks grow with the offers."""
    rows = [(i % 5, float(i * 7 % 31), i % 4, i % 9, i) for i in range(400)]
    frame = spark.createDataFrame(rows, "p int, c double, t int, q int, s int")
    names = {"product": "p", "cost": "c", "trust": "t", "quantity": "q", "supplier": "s"}
    whole = sorted(map(tuple, skyline.skyline(frame, **names).collect()))
    monkeypatch.setattr(skyline, "TASK_ROWS", 20)
    dealt = skyline.skyline(frame, **names)
    assert "Generate" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) > 5


@pytest.mark.parametrize("small", [100_000, 3])
def test_percent_ranks_of_many_values(spark, monkeypatch, small):
    """In one task and over ranges, the same."""
    monkeypatch.setattr(scoring, "SMALL_ROWS", small)
    values = [int(x) for x in np.random.default_rng(5).integers(0, 40, 300)] + [7] * 200 + [None]
    got = sorted((r["v"], r["r"]) for r in scoring.percent_ranks(spark.createDataFrame([(v,) for v in values], "v int"), "v", "r").collect() if r["v"] is not None)
    known = sorted(v for v in values if v is not None)
    assert got == [(v, known.index(v) / (len(known) - 1)) for v in known]
    assert [r["r"] for r in scoring.percent_ranks(spark.createDataFrame([(1,), (None,)], "v int"), "v", "r").orderBy("v").collect()] == [None, 0.0]


def test_exact_clusters_of_long_texts(spark):
    rows = [(i, "x" * 1000 + str(i % 3), i % 2) for i in range(12)] + [(50, None, 1), (51, None, 1)]
    got = sorted(map(tuple, clusters.exact_clusters(spark.createDataFrame(rows, "i int, t string, g int"), id_col="i", keys=["t", "g"]).collect()))
    assert got == [(i, 2) for i in range(6)] + [(50, 2)]
