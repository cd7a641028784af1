"""Streams of offers and events: watchlist alerts, windows and sessions with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def read_events(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """Event files of a folder as a stream; ``ts`` as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "100").option("pathGlobFilter", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and summed values of each type and window; state goes once the watermark passes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    one = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total"))
    return one.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def session_counts(events: DataFrame, *, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    one = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return one.select("user_id", F.col("w.start").alias("start"), "n")


def alerts(events: DataFrame, watched: DataFrame, *, above: float) -> DataFrame:
    """Events of watched users at or above a value, as they come: a join with a table, no state."""
    return events.join(watched.select("user_id").distinct(), "user_id", "left_semi").where(F.col("value") >= above)


def drain(stream: DataFrame) -> DataFrame:
    """Runs a stream over what there is and reads the result; files and checkpoint are in the
    shared folder. Windows that the last watermark has not passed are not part of it."""
    spark = stream.sparkSession
    top = shared_dir(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def running_extremes(events: DataFrame) -> DataFrame:
    """(event_type, least, most, n) after each batch: a state of three numbers for each type."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least, most, n = state.get if state.exists else (float("inf"), float("-inf"), 0)
        for batch in batches:
            v = batch["value"].dropna()
            if len(v):
                least, most = min(least, float(v.min())), max(most, float(v.max()))
            n += len(batch)
        state.update((least, most, n))
        yield pd.DataFrame({"event_type": [key[0]], "least": [least], "most": [most], "n": [n]})

    one = events.select("event_type", "value").groupBy("event_type")
    return one.applyInPandasWithState(step, "event_type string, least double, most double, n long", "least double, most double, n long", "append", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, *, by: list[str], order: str) -> DataFrame:
    """The last of the rows that a stream has given for each group."""
    done = drain(stream)
    return done.groupBy(*by).agg(F.max(F.struct(order, *[c for c in done.columns if c not in (*by, order)])).alias("x")).select(*by, "x.*")
