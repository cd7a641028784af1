"""Watchlists as streams: late rows, duplicates, intervals between streams, and state with timers.

Events arrive in deliveries. Each delivery is drained by a run of the same query on one checkpoint, so
the watermark at a delivery is the largest time of those before it, less the allowed delay: that
tells exactly which rows are late, whatever files a delivery consists of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SHUFFLES = "spark.sql.shuffle.partitions"
#: Partitions of a stateful step for each core, at most.
STATE_WAVES = 2


def deliver(events: DataFrame, number: Column, count: int, run: Callable[[DataFrame], DataFrame], watch: Callable[[dict], None] | None = None) -> DataFrame:
    """The rows that ``run(stream)`` appends if ``events`` come as a stream of ``count`` deliveries:
    those with ``number`` 0, then those with 1, and so on. ``watch`` gets the progress of each batch.

    Each partition of a stateful step opens, commits and uploads its stores in every batch, however few its rows (a join
    of streams has four), so there are ``STATE_WAVES`` for each core at most. RocksDB keeps what they hold on disk."""
    spark = events.sparkSession
    top = shared_dir(spark)
    kept, parts = spark.conf.get(STORE), spark.conf.get(SHUFFLES)
    spark.conf.set(STORE, ROCKS)
    spark.conf.set(SHUFFLES, str(min(int(parts), STATE_WAVES * spark.sparkContext.defaultParallelism)))
    try:
        for k in range(count):
            events.where(number == k).write.mode("append").parquet(f"{top}/in")
            stream = run(spark.readStream.schema(events.schema).parquet(f"{top}/in"))
            query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            for p in query.recentProgress if watch else ():
                watch(p)
    finally:
        spark.conf.set(STORE, kept)
        spark.conf.set(SHUFFLES, parts)
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def once(events: DataFrame, *, id_col: str, at: str, late: str) -> DataFrame:
    """Events without those that are late, and without repetitions that come before their time is out."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def followed(events: DataFrame, first: Column, then: Column, *, by: str, id_col: str, at: str, within: str, late: str) -> DataFrame:
    """(first_id, then_id): pairs of events of one ``by``, the second up to ``within`` after the first. The
    watermark is the lesser of both sides'. The interval bounds the state: an event is kept until none that matches it can come in time."""
    a = events.withWatermark(at, late).where(first).select(F.col(by).alias("a_by"), F.col(id_col).alias("first_id"), F.col(at).alias("a_at"))
    # a watermark of its own: of one that both sides share, Spark counts one side only
    b = events.withWatermark(at, late).where(then).select(F.col(by).alias("b_by"), F.col(id_col).alias("then_id"), F.col(at).alias("b_at"))
    near = (F.col("a_by") == F.col("b_by")) & (F.col("b_at") >= F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + F.expr(f"interval {within}"))
    return a.join(b, near).select("first_id", "then_id")


VISIT = ["started", "ended", "n", "least", "most"]
#: Groups that the keys of visits are dealt to.
PARTS = 1024


def runs(visits: pd.DataFrame, idle_ms: int) -> pd.DataFrame:
    """Visits (key, ``VISIT``) in order, those of a key that are less than ``idle_ms`` apart as one."""
    if not len(visits):
        return visits
    own = visits.sort_values(["key", "started"], kind="stable")
    key, started = own["key"].to_numpy(), own["started"].to_numpy()
    until = own.groupby("key")["ended"].cummax().to_numpy()
    fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (started[1:] - until[:-1] >= idle_ms)]))
    # of NaN, which counts as the largest value, as in SQL
    how = {"ended": np.maximum, "n": np.add, "least": np.fmin, "most": np.maximum}
    return pd.DataFrame({"key": key[fresh], "started": started[fresh], **{c: f.reduceat(own[c].to_numpy(), fresh) for c, f in how.items()}})


def merged(visits: list[tuple], idle_ms: int) -> list[tuple]:
    """``runs`` of the visits (``VISIT``) of one key."""
    return list(runs(pd.DataFrame(visits, columns=VISIT).assign(key=0), idle_ms)[VISIT].itertuples(index=False, name=None))


class Watch(StatefulProcessor):
    """Visits of watched keys, given out once nothing more can belong to them.

    Keys are dealt to parts, as a call, its state and its timer cost far more than a row. The state of
    a part are the open visits of its keys, in whatever order their events come: the key and five numbers
    each. A part has one timer, for the visit that may end first. The watermark fires it, and the visits
    that have been idle for long enough leave the state.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getListState("visits", "key long, started long, ended long, n long, least double, most double")

    def held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(v) for v in self.visits.get()] if self.visits.exists() else [], columns=["key", *VISIT])

    def keep(self, open_visits: pd.DataFrame) -> None:
        if len(open_visits):
            self.visits.put(list(zip(*(open_visits[c].tolist() for c in ("key", *VISIT)), strict=True)))
        else:
            self.visits.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        before, now = held["ended"].min(), [held] if len(held) else []
        for got in rows:
            now = [runs(pd.concat([*now, pd.DataFrame({"key": got["key"], "started": got["at_ms"], "ended": got["at_ms"], "n": 1, "least": got["value"], "most": got["value"]})]), self.idle_ms)]
        self.keep(now[0])
        after = now[0]["ended"].min()
        if not len(held) or after != before:
            if len(held):
                self.handle.deleteTimer(int(before) + self.idle_ms)
            self.handle.registerTimer(int(after) + self.idle_ms)
        yield pd.DataFrame(columns=["key", *VISIT])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        due = held["ended"] + self.idle_ms <= timerValues.getCurrentWatermarkInMs()
        rest = held[~due]
        self.keep(rest)
        if len(rest):
            self.handle.registerTimer(int(rest["ended"].min()) + self.idle_ms)
        yield held[due]

    def close(self) -> None:
        pass


def visits(events: DataFrame, *, by: str, at: str, value: str, idle_ms: int, late: str) -> DataFrame:
    """(key, started, ended, n, least, most), times in milliseconds: visits of each ``by`` (``Watch``), closed
    by event time. Late events are dropped, and those without key, time or value."""
    own = events.withWatermark(at, late).where(F.col(value).isNotNull() & F.col(by).isNotNull() & F.col(at).isNotNull())
    own = own.select(F.col(by).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"), F.col(value).cast("double").alias("value"))
    own = own.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    return own.groupBy("part").transformWithStateInPandas(Watch(idle_ms), "key long, started long, ended long, n long, least double, most double", "append", "eventTime")
