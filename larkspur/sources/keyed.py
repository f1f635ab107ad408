"""A keyed table with versions: read what is there, write what is missing, the newest version of a key wins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed


class KeyedTable:
    """Rows by a string key in a folder, in buckets by a hash of the key.

    An upsert writes its rows as one data folder (partitioned by bucket, sorted by key) and then publishes it by creating
    the next numbered manifest, which fails if another writer was first; it then takes the number after. So a writer that
    dies before that leaves the table as it was, writers at the same time lose nothing, and readers see whole upserts only.
    Of several rows of a key the one of the highest manifest wins. Lookups join on (bucket, key), and only buckets that are
    asked for are read, of a bounded number. compact() folds all versions into one.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64):
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), columns, buckets

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, dict]]:
        """Published manifests in order; one that its writer left unfinished is none."""
        path, fs = self._file("manifest")
        if not fs.exists(path):
            return []
        text = self.spark.read.text(f"{self.path}/manifest", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^v([0-9]+)", 1).cast("long").alias("v"), "value")
        rows = sorted((r["v"], json.loads(r["value"])) for r in text.collect() if r["v"] is not None and r["value"].endswith("}"))
        start = max((v for v, m in rows if m["whole"]), default=0)
        return [(v, m) for v, m in rows if v >= start]

    def _publish(self, data: str, whole: bool, after: int) -> int:
        """Creates the next manifest; a number that is taken already means that another writer was first."""
        body = bytearray(json.dumps({"data": data, "whole": whole}).encode())
        while True:
            after += 1
            path, fs = self._file(f"manifest/v{after:012d}")
            try:
                out = fs.create(path, False)
            except Exception as e:  # the file system's own "already exists", through the gateway
                if "exist" not in str(e):
                    raise
                if whole:
                    raise RuntimeError("another writer was first; compact again") from e
                continue
            out.write(body)
            out.close()
            return after

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def stored(self) -> DataFrame:
        """All rows of all versions with bucket and version."""
        out = self.spark.createDataFrame([], f"{self.columns}, bucket int, version long")
        for v, m in self.versions():
            part = self.spark.read.schema(f"{self.columns}, bucket int").parquet(f"{self.path}/{m['data']}")
            out = out.unionByName(part.withColumn("version", F.lit(v).cast("long")))
        return out

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("key", "bucket", "version")]
        best = rows.groupBy("bucket", "key").agg(F.max_by(F.struct(*rest), "version").alias("x"))
        return best.select("bucket", "key", *(F.col(f"x.{c}").alias(c) for c in rest))

    def read(self) -> DataFrame:
        return self._newest(self.stored()).drop("bucket")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Newest rows of the asked keys (a column key); only their buckets are read, which are a filter on the folders."""
        keys = checkpointed(self._bucket(asked.select("key").where("key is not null").distinct()))
        buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        return self._newest(self.stored().where(F.col("bucket").isin(buckets)).join(keys, ["bucket", "key"], "left_semi")).drop("bucket")

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows or replaces their keys' rows; returns the new version. Null keys are an error, repeated keys keep one row."""
        last = max((v for v, _ in self.versions()), default=0)
        data = f"data-{uuid.uuid4().hex}"
        names = [f.name for f in self.spark.createDataFrame([], self.columns).schema]
        once = self._bucket(rows.select(*names)).groupBy("bucket", F.assert_true(F.col("key").isNotNull()).alias("ok"), "key").agg(F.max(F.struct(*(c for c in names if c != "key"))).alias("x"))
        once.select("key", *(F.col(f"x.{c}").alias(c) for c in names if c != "key"), "bucket").repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/{data}")
        return self._publish(data, False, last)

    def compact(self) -> int:
        """Folds all versions into one data folder; older folders stay until their readers are done."""
        found = self.versions()
        data = f"data-{uuid.uuid4().hex}"
        self._newest(self.stored()).repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/{data}")
        return self._publish(data, True, max((v for v, _ in found), default=0))


def embed_cached(texts: DataFrame, table: KeyedTable, model: str, embed: Callable[[DataFrame], DataFrame], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with key, vec and cached: whether the table had it; the distinct missing texts that were embedded and stored).

    The key is the hash of the model's name, a zero byte and the text. embed maps (key, text) to (key, vec) and sees each
    missing text once, whatever the number of rows that ask for it. Null texts get no vector.
    """
    keyed = texts.withColumn("key", F.sha2(F.concat(F.lit(f"{model}\0"), F.col(text_col)).cast("binary"), 256))
    before = table.lookup(keyed.where("key is not null")).select("key").withColumn("had", F.lit(True))
    missing = keyed.where("key is not null").select("key", F.col(text_col).alias("text")).dropDuplicates(["key"]).join(before, "key", "left_anti")
    version = table.upsert(embed(missing).select("key", "vec"))
    stored = table.stored()
    new = stored.where(F.col("version") == version).select("key", "vec")
    vectors = table.lookup(keyed.where("key is not null"))
    had = stored.where(F.col("version") < version).select("key").distinct().withColumn("cached", F.lit(True))
    out = keyed.join(vectors, "key", "left").join(had, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return out, new
