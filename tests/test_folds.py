"""Folds in constant memory: equal to the fold over a key's array, one key with a third of all rows, batches of few rows."""

import random

from pyspark.sql import functions as F

from larkspur.operators import folds, routing


def test_budget_equals_the_fold_over_an_array(spark):
    rng = random.Random(4)
    rows = [(7 if k % 3 == 0 else k % 50, k, round(rng.uniform(0, 30), 2), rng.random() < 0.05) for k in range(6000)]
    rows += [(None, 1, 5.0, False), (None, 2, 200.0, False), (None, 3, 1.0, None), (60, 1, None, False)]
    df = spark.createDataFrame(rows, "user int, seq int, cost double, safe boolean").withColumn("_x", F.lit("stays")).repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = folds.granted(df, ["user"], ["seq"], F.col("cost"), 120.0, F.col("safe"))
        assert got.columns == [*df.columns, "granted"]
        kept = {(r["user"], r["seq"]) for r in got.where("granted").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    item = F.struct("seq", F.col("seq").cast("string").alias("id"), F.coalesce(F.col("cost"), F.lit(0.0)).cast("decimal(18,6)").alias("cost"), F.coalesce("safe", F.lit(False)).alias("protected"))
    whole = df.groupBy("user").agg(F.array_sort(F.collect_list(item)).alias("items")).select("user", routing.skip_greedy(F.col("items"), F.lit(120))["kept"].alias("k"))
    assert kept == {(r["user"], int(k)) for r in whole.collect() for k in r["k"]}


def test_no_rows(spark):
    df = spark.createDataFrame([], "user int, seq int, cost double")
    assert folds.granted(df, ["user"], ["seq"], F.col("cost"), 1.0).count() == 0
