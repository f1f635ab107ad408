"""Cover traffic: every device sends one round a tick, a waiting question or a cover round, so nobody sees when it is asked.

cover_schedule() gives the rounds of a finished log from counts by tick; CoverRounds sends them from timers with state, and both
give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that several kinds of state per key need: set as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _queues(asked: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Questions with the tick that they are sent at, and per device and tick of arrival: first (sent), n, next (first of what comes after).

    A queue's length follows from the numbers of questions per tick: windows run over these counts, and places are counted
    within one tick, so a device with a third of all questions is as many tasks as it has ticks.
    """
    rows = asked.where("device is not null and question is not null and ts is not null").withColumn("arrived", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)).cast("long"))
    order = Window.partitionBy("device").orderBy("arrived")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy("device", "arrived").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(so_far) - F.col("n"))
    sent = counts.withColumn("first", F.col("before") + 1 + F.max(F.col("arrived") - F.col("before") - 1).over(so_far)).withColumn("next", F.lead("first").over(order))
    place = F.row_number().over(Window.partitionBy("device", "arrived").orderBy("ts", "question"))
    real = rows.withColumn("place", place).join(sent.select("device", "arrived", "first"), ["device", "arrived"])
    return real.select("device", (F.col("first") + F.col("place") - 1).alias("tick"), F.lit("real").alias("kind"), "question"), sent


def sent_ticks(asked: DataFrame, seconds: int = 3600) -> DataFrame:
    """The tick at which each question of cover_schedule() is sent, however late: device, question, tick."""
    return _queues(asked, seconds)[0].select("device", "question", "tick")


def cover_schedule(asked: DataFrame, until: int, seconds: int = 3600) -> DataFrame:
    """Rounds of each device up to tick until: device, tick, kind ("real" or "cover"), question (null for cover).

    asked: device, question (long), ts. A question waits from the tick of its time (ts over seconds, rounded down) on; the oldest
    goes first, ties by question. A device starts with its first question's tick. Questions that are still waiting at until have no row;
    rows without device, question or ts are left out; a repeated question is sent again.
    """
    real, sent = _queues(asked, seconds)
    start, end = F.col("first") + F.col("n"), F.least(F.coalesce(F.col("next") - 1, F.lit(until)), F.lit(until))
    gaps = sent.where(start <= end).select("device", F.explode(F.sequence(start, end)).alias("tick"), F.lit("cover").alias("kind"))
    return real.where(F.col("tick") <= until).unionByName(gaps, allowMissingColumns=True)


class CoverRounds(StatefulProcessor):
    """One round per tick and device, from a timer at the tick's end.

    State: the next tick and the queue's two ends; the questions of ticks that haven't ended, by tick; the queue by place. A tick
    appends its questions in order and takes the first of the queue: a tick costs its own questions, however many wait.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "tick long, head long, tail long")
        self.coming = handle.getMapState("coming", "tick long", "micros array<long>, questions array<long>")
        self.queue = handle.getMapState("queue", "place long", "question long")

    def _timer(self, tick: int) -> int:
        return (tick + 1) * self.seconds * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict = {}
        for frame in rows:
            for micros, question in zip(frame["micros"], frame["question"], strict=True):
                new.setdefault(int(micros) // (self.seconds * 1_000_000), []).append((int(micros), int(question)))
        if not new:
            return
        tick, head, tail = self.clock.get() if self.clock.exists() else (None, 0, 0)
        earliest = min(new)
        if tick is None or (earliest < tick and tail == 0):  # the first tick puts a question into the queue: none has passed yet
            if tick is not None:
                self.handle.deleteTimer(self._timer(tick))
            tick = earliest
            self.handle.registerTimer(self._timer(tick))
            self.clock.update((tick, head, tail))
        for at, found in new.items():
            name = (max(at, tick),)
            if self.coming.containsKey(name):
                micros, questions = self.coming.getValue(name)
                found = [*zip(micros, questions, strict=True), *found]
            self.coming.updateValue(name, ([m for m, _ in found], [q for _, q in found]))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tick, head, tail = self.clock.get()
        out = []
        while self._timer(tick) <= timerValues.getCurrentWatermarkInMs():
            if self.coming.containsKey((tick,)):
                micros, questions = self.coming.getValue((tick,))
                self.coming.removeKey((tick,))
                for _, question in sorted(zip(micros, questions, strict=True)):
                    self.queue.updateValue((tail,), (question,))
                    tail += 1
            question = None
            if head < tail:
                question = self.queue.getValue((head,))[0]
                self.queue.removeKey((head,))
                head += 1
            out.append((key[0], tick, "cover" if question is None else "real", question))
            tick += 1
        self.clock.update((tick, head, tail))
        self.handle.registerTimer(self._timer(tick))
        if out:
            frame = pd.DataFrame(out, columns=["device", "tick", "kind", "question"])
            yield frame.assign(question=frame["question"].astype("Int64"))

    def close(self) -> None:
        pass


def cover_rounds(asked: DataFrame, seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """The rounds of cover_schedule() for a stream of questions (device, question, ts), up to the watermark.

    A tick's round goes once the watermark, late behind the latest question of all devices, has passed its end; a question that comes later than
    that is dropped by the watermark. Needs the state store PROVIDER.
    """
    kind = asked.schema["device"].dataType.simpleString()
    at = F.col("ts").cast("timestamp")
    rows = asked.where("device is not null and question is not null and ts is not null").select("device", F.col("question").cast("long").alias("question"), F.unix_micros(at).alias("micros"), at.alias("ts"))
    keyed = rows.withWatermark("ts", late).groupBy("device")
    return keyed.transformWithStateInPandas(CoverRounds(seconds), f"device {kind}, tick long, kind string, question long", "Append", "EventTime")
