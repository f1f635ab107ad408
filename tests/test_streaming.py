from pyspark.sql import functions as F

from larkspur.streaming import jobs


def log(df):
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select("ts", "value", F.col("event_type").alias("topic"), F.pmod(k, F.lit(12)).alias("source_id"), (F.col("value") / 100).alias("signal"))


def prepared(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    return events, jobs.event_stream(spark, str(tmp_path / "in"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_running_state_equals_batch(spark, tmp_path):
    events, stream = prepared(spark, tmp_path)
    for name, job in (("counts", jobs.source_counts), ("trust", jobs.trust)):
        got = jobs.run_to_end(job(log(stream)), name, "complete", str(tmp_path / name))
        assert rows(got) == rows(job(log(events)))


def test_windows_close_with_the_watermark(spark, tmp_path):
    events, stream = prepared(spark, tmp_path)
    got = jobs.run_to_end(jobs.rates(log(stream)), "rates", "append", str(tmp_path / "rates"))
    batch = log(events).groupBy(F.window("ts", "1 day").start.alias("start"), "topic").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    assert got.count() > 0 and set(rows(got)) <= set(rows(batch))


def test_budget_is_skip_greedy_across_batches(spark, tmp_path):
    events, stream = prepared(spark, tmp_path)
    pick = lambda d: d.select(F.col("user_id").alias("client"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"), F.col("value").alias("cost"), "ts")
    got = jobs.run_to_end(jobs.daily_budget(pick(stream), 60.0), "budget", "append", str(tmp_path / "budget")).collect()
    assert len(got) == events.count()
    spent = {}
    for r in got:
        if r["granted"]:
            spent[r["client"], r["day"]] = spent.get((r["client"], r["day"]), 0) + r["cost"]
    assert max(spent.values()) <= 60.0 + 1e-6 and {r["granted"] for r in got} == {True, False}
