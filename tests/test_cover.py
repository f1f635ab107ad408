"""Cover rounds: the stream's timers give the batch's rows, across restarts; the batch equals a plain queue."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import cover

SCHEMA = "device string, question long, ts timestamp"
START = datetime(2024, 3, 1)


def plain(rows, until):
    """A queue per device, one tick after the other."""
    out = []
    for device in {d for d, q, t in rows if d is not None and q is not None and t is not None}:
        mine = sorted((t, q) for d, q, t in rows if d == device and q is not None and t is not None)
        tick_of = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() // 3600)
        queue, at = deque(), 0
        for tick in range(tick_of(mine[0][0]), until + 1):
            while at < len(mine) and tick_of(mine[at][0]) <= tick:
                queue.append(mine[at][1])
                at += 1
            out.append((device, tick, "real", queue.popleft()) if queue else (device, tick, "cover", None))
    return sorted(out, key=str)


def log(seed, n=300, hours=60):
    draw = random.Random(seed)
    rows = [("hot" if draw.random() < 0.4 else f"d{draw.randrange(6)}", k, START + timedelta(seconds=draw.randrange(hours * 3600))) for k in range(n)]
    rows += [("burst", 1000 + k, START + timedelta(hours=9)) for k in range(15)]
    return rows + [("late", 2000, START + timedelta(hours=hours - 1)), ("tie", 3001, START), ("tie", 3000, START), ("tie", 3000, START)]


def rows_of(df):
    return sorted(((r["device"], r["tick"], r["kind"], r["question"]) for r in df.collect()), key=str)


def test_schedule_equals_a_plain_queue(spark):
    odd = [(None, 1, START), ("d1", None, START), ("d1", 5, None)]
    until = int((START - datetime(1970, 1, 1)).total_seconds() // 3600) + 70
    for seed in (1, 2):
        rows = log(seed) + odd
        got = rows_of(cover.cover_schedule(spark.createDataFrame(rows, SCHEMA), until))
        assert got == plain(rows, until)
        assert {k for _, _, k, _ in got} == {"real", "cover"}
        # until within the backlog: what still waits has no row
        assert rows_of(cover.cover_schedule(spark.createDataFrame(rows, SCHEMA), until - 40)) == plain(rows, until - 40)
    assert cover.cover_schedule(spark.createDataFrame([], SCHEMA), until).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, cover.PROVIDER)
    yield spark
    spark.conf.set(name, old)


def test_timers_equal_the_schedule_across_restarts(rocks, tmp_path):
    rows = sorted(log(7, n=120, hours=30), key=lambda r: r[2])
    draw = random.Random(1)
    # out of order by less than the watermark's two hours
    rows.sort(key=lambda r: r[2] + timedelta(minutes=draw.randrange(110)))
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))

    def run():
        asked = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        sink = cover.cover_rounds(asked).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()

    parts = [rows[:40], rows[40:41], rows[41:90], rows[90:], [("end", 9999, START + timedelta(hours=45))]]
    for k, part in enumerate(parts):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 4):  # stops after two files, starts again from the checkpoint for the rest
            run()
    until = int((START - datetime(1970, 1, 1)).total_seconds() // 3600) + 42
    want = rows_of(cover.cover_schedule(rocks.createDataFrame(rows, SCHEMA), until))
    got = rows_of(rocks.read.parquet(out).where(F.col("device") != "end"))
    assert got == want == plain(rows, until)
