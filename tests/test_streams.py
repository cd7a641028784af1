"""Streams in deliveries: late rows, repetitions, intervals, visits and their state."""

from pyspark.sql import functions as F

from mercantile.streaming import watchlist


def test_merged():
    a = (0, 0, 1, 5.0, 5.0)
    assert watchlist.merged([(30, 31, 2, 1.0, 2.0), a, (9, 9, 1, 7.0, 7.0)], 10) == [(0, 9, 2, 5.0, 7.0), (30, 31, 2, 1.0, 2.0)]
    assert watchlist.merged([(10, 10, 1, 1.0, 1.0), a], 10) == [a, (10, 10, 1, 1.0, 1.0)] and watchlist.merged([], 5) == []


def events(spark, rows):
    return spark.createDataFrame(rows, "number int, event_id long, user_id long, minute int, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60))


def test_visits_and_state(spark):
    """Late rows are dropped, an old row that is not late opens or joins an earlier visit, keys are
    apart, nulls are dropped, and the state shrinks when the timers fire."""
    rows = [
        *((0, 1, 1, 0, 5.0), (0, 2, 1, 5, 3.0), (0, 3, 2, 3, 1.0), (0, 4, None, 3, 1.0), (0, 5, 1, 3, None), (0, 14, 3, 5, 4.0)),
        *((1, 6, 1, 100, 9.0), (1, 7, 1, 14, 2.0), (1, 8, 2, 4, 8.0)),
        # the watermark is at minute 40 now: the first two are late, the third opens a visit before that at minute 100
        *((2, 9, 1, 20, 1.0), (2, 10, 2, 40, 1.0), (2, 11, 1, 50, 7.0), (2, 12, 1, 45, 6.0)),
        (3, 13, 9, 1000, 0.0),
    ]
    seen = []
    run = lambda s: watchlist.visits(s, by="user_id", at="ts", value="value", idle_ms=600_000, late="60 minutes")
    got = watchlist.deliver(events(spark, rows), F.col("number"), 4, run, seen.append)
    minute = lambda ms: (ms - 1_700_000_000_000) // 60_000
    found = sorted((r["key"], minute(r["started"]), minute(r["ended"]), r["n"], r["least"], r["most"]) for r in got.collect())
    assert found == [(1, 0, 14, 3, 2.0, 5.0), (1, 45, 50, 2, 6.0, 7.0), (1, 100, 100, 1, 9.0, 9.0), (2, 3, 4, 2, 1.0, 8.0), (3, 5, 5, 1, 4.0, 4.0)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert max(held) > held[-1] > 0  # the visit of key 9 is open


def test_once_forgets(spark):
    """A repetition is dropped in the same delivery and later; a late one is dropped as well; ids leave the state."""
    rows = [(0, 1, 1, 0, 0.0), (0, 1, 1, 0, 0.0), (0, 2, 1, 30, 0.0), (1, 1, 1, 0, 0.0), (1, 2, 1, 30, 0.0), (1, 3, 1, 500, 0.0), (2, 2, 1, 30, 0.0), (2, 4, 1, 2000, 0.0), (2, 5, 1, 450, 0.0)]
    seen = []
    got = watchlist.deliver(events(spark, rows), F.col("number"), 3, lambda s: watchlist.once(s, id_col="event_id", at="ts", late="60 minutes").select("event_id"), seen.append)
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 4, 5]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert held[-1] == 1 < max(held)


def test_followed(spark):
    rows = [(0, 1, 1, 0, 1.0), (1, 2, 1, 30, 2.0), (1, 3, 2, 10, 2.0), (1, 4, 1, 61, 2.0), (2, 5, 1, 500, 1.0), (2, 6, 1, 559, 2.0), (3, 7, 1, 498, 1.0), (4, 8, 1, 440, 1.0)]
    got = watchlist.deliver(events(spark, rows), F.col("number"), 5, lambda s: watchlist.followed(s, F.col("value") == 1, F.col("value") == 2, by="user_id", id_col="event_id", at="ts", within="60 minutes", late="90 minutes"))
    # 8 is late: the watermark is at minute 469
    assert sorted(map(tuple, got.collect())) == [(1, 2), (5, 6)]


def test_visits_of_a_shared_part(spark, monkeypatch):
    """Keys of one group are apart, have one timer for all their visits, and close in their order."""
    monkeypatch.setattr(watchlist, "PARTS", 1)
    rows = [*((0, i, i, i % 7, float(i)) for i in range(50)), *((0, 100 + i, i, 30, 1.0) for i in range(50)), (1, 200, 7, 1000, 0.0), (2, 201, 7, 2000, 0.0)]
    seen = []
    run = lambda s: watchlist.visits(s, by="user_id", at="ts", value="value", idle_ms=600_000, late="60 minutes")
    got = watchlist.deliver(events(spark, rows), F.col("number"), 3, run, seen.append)
    minute = lambda ms: (ms - 1_700_000_000_000) // 60_000
    found = sorted((r["key"], minute(r["started"]), r["n"], r["least"]) for r in got.collect())
    assert found == sorted([*((i, i % 7, 1, float(i)) for i in range(50)), *((i, 30, 1, 1.0) for i in range(50)), (7, 1000, 1, 0.0)])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert max(held) < 20  # not one for each key


def test_stores_are_bounded_by_cores(spark):
    """Each partition of a stateful step opens its stores in every batch, so there are a few for each core; the setting is put back."""
    rows = [(n, 10 * n + i, i % 3, 100 * n + i, 1.0 + i % 2) for n in range(2) for i in range(6)]
    kept, seen = spark.conf.get(watchlist.SHUFFLES), []
    spark.conf.set(watchlist.SHUFFLES, "40")
    try:
        watchlist.deliver(events(spark, rows), F.col("number"), 2, lambda s: watchlist.once(s, id_col="event_id", at="ts", late="60 minutes").select("event_id"), seen.append)
        assert spark.conf.get(watchlist.SHUFFLES) == "40"
    finally:
        spark.conf.set(watchlist.SHUFFLES, kept)
    assert {o["numShufflePartitions"] for p in seen for o in p["stateOperators"]} == {watchlist.STATE_WAVES * spark.sparkContext.defaultParallelism}
