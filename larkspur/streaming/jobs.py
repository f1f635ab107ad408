"""Stateful stream jobs over the contact log; each equals its batch counterpart on the same rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def source_counts(log: DataFrame) -> DataFrame:
    """Contacts per topic and source so far: the observer's running state."""
    return log.groupBy("topic", "source_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def trust(log: DataFrame) -> DataFrame:
    """Trust per source so far, by the closed form of its running update."""
    return log.groupBy("source_id").agg(F.round((1 + F.sum("signal")) / (F.count("*") + 2), 6).alias("trust"), F.count("*").alias("observations"))


def rates(log: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Contacts per topic in time windows; rows later than the watermark allows are left out, and state is freed."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "topic").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "topic", "n", "total")


def daily_budget(requests: DataFrame, budget: float) -> DataFrame:
    """Each request (client, day, seq, cost, ts) with granted: whether it fits what is left of the client's day.

    A request that doesn't fit is refused and not charged. State is one number per client and day, dropped once the
    watermark, two days behind the latest request, has passed the day by two days.
    """

    def fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("seq")
        granted = []
        for cost in rows["cost"]:
            fits = spent + cost <= budget + 1e-9
            spent += cost if fits else 0.0
            granted.append(fits)
        state.update((spent,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 2 * 86_400_000)
        yield pd.DataFrame({"client": key[0], "day": key[1], "seq": rows["seq"], "cost": rows["cost"], "granted": granted})

    kind = requests.schema["client"].dataType.simpleString()
    seq = requests.schema["seq"].dataType.simpleString()
    return requests.withWatermark("ts", "2 days").groupBy("client", "day").applyInPandasWithState(
        fold, f"client {kind}, day string, seq {seq}, cost double, granted boolean", "spent double", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and returns its result table."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
