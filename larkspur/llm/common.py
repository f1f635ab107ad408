"""Helpers that the operators of this subpackage share: staging, ids, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session, as in tests, gets a temporary folder of its own when the setting is absent.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are dropped when it ends, since nothing reads them afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        while base.lower() in taken:
            base += "_"
        taken.add(base.lower())
        out.append(base)
    return out


def byte_slices(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in one text column, a longer text alone, and so many rows."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, side="right"))
        b = max(a + 1, min(b, a + most_rows))
        yield batch.slice(a, b - a)
        a = b


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every id that occurs in an edge: (id, component_id).

    Alternating large-star and small-star rounds: every round hangs each node on the smallest neighbour it knows.
    Minima are partial aggregates and the joins are plain equi-joins, so a hub with very many edges is combined
    before its shuffle and can be split after it. Lineage is cut every round; nothing but two counts reaches the
    driver. An empty edge table gives an empty result; self-loops and repeated edges change nothing.
    """
    shared_dir(edges.sparkSession)

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    star = tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()).checkpoint()
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = tidy(small.unionByName(lows.select("u", F.col("m").alias("v")))).checkpoint()
        roots = star.select(F.col("v").alias("u")).distinct()
        loose = star.join(roots, "u", "left_semi").limit(1).count()
        if not loose and star.count() == star.select("u").distinct().count():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return star.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        star.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
