"""Readers of the reference's input formats and writers of its outputs, all with stated schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "node_id string, local_model string, documents array<string>, collections map<string,array<string>>, policy_labels array<string>, access_policy map<string,array<string>>, _corrupt_record string"
LOG_SCHEMA = "query_id string, topic_key string, genuine array<string>, decoys array<string>, dispatched array<string>, coarse array<string>, stage_latency_ms map<string,double>, bytes_transferred map<string,double>, timestamp double, extra string"


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of {_id, title, text} lines: "title. text" when there is a title, both trimmed."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    return rows.select(F.col("_id").alias("doc_id"), F.when(title != "", F.concat_ws(". ", title, text)).otherwise(text).alias("text"))


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), "text")


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Positive judgements of a tab-separated file with a header line."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, doc_id string, score int")
    return rows.where("score > 0")


def graded_qrels(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """query_id, source_id, grade of lines "query iteration source grade", of known sources only."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts[0].alias("query_id"), parts[2].alias("source_id"), parts[3].cast("double").alias("grade"))
    return rows.join(sources.select("source_id"), "source_id", "left_semi").select("query_id", "source_id", "grade")


def mapping_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="key string, value string")


def patients_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of (patient_uid, PMID, patient) and one per entry of the similar_patients dictionary: similar, grade."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="patient_uid string, PMID string, patient string, similar_patients string")
    known = F.from_json(F.translate("similar_patients", "'", '"'), "map<string,int>")
    return rows.select("patient_uid", "PMID", "patient", F.explode_outer(known).alias("similar", "grade"))


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """subset, qid, question, options, answer of one nested JSON file."""
    kind = "map<string,map<string,struct<question:string,options:map<string,string>,answer:string>>>"
    nested = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("subset", "items"))
    return nested.select("subset", F.explode("items").alias("qid", "q")).select("subset", "qid", "q.question", "q.options", "q.answer")


def node_specs(spark: SparkSession, path: str) -> DataFrame:
    """Passages of a folder of node files: source_id, doc_ix, text, collection. A broken file is left out alone."""
    rows = spark.read.schema(NODE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("node_id").isNotNull())
    plain = good.select("node_id", F.posexplode("documents").alias("doc_ix", "item"))
    one = F.when(F.col("item").startswith("{"), F.get_json_object("item", "$.text")).otherwise(F.col("item"))
    where = F.when(F.col("item").startswith("{"), F.coalesce(F.get_json_object("item", "$.collection"), F.lit("public"))).otherwise(F.lit("public"))
    listed = plain.select(F.col("node_id").alias("source_id"), "doc_ix", one.alias("text"), where.alias("collection"))
    named = good.select("node_id", F.explode("collections").alias("collection", "texts")).select("node_id", "collection", F.posexplode("texts").alias("doc_ix", "text"))
    return listed.unionByName(named.select(F.col("node_id").alias("source_id"), "doc_ix", "text", "collection"))


def unregistered(available: DataFrame, registered: DataFrame) -> DataFrame:
    """Available nodes that aren't registered, with their number of passages."""
    return available.groupBy("source_id").agg(F.count("*").alias("documents")).join(registered.select("source_id"), "source_id", "left_anti")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by an order column: a bounded scan whose result doesn't depend on how files are split."""
    return df.orderBy(order).limit(n)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def audit(log: DataFrame, query_id: str) -> DataFrame:
    """A question's record with its decoys: what was dispatched besides the genuine sources, in order and with repeats."""
    rest = F.filter("dispatched", lambda x: ~F.array_contains("genuine", x))
    return log.where(F.col("query_id") == query_id).withColumn("derived_decoys", rest).orderBy("timestamp").limit(1)


def write_sorted_log(log: DataFrame, path: str, files: int = 64) -> None:
    """The log as Parquet files by ranges of query_id, sorted, with Bloom filters: a lookup opens few row groups (audit_at())."""
    ranged = log.repartitionByRange(files, "query_id").sortWithinPartitions("query_id", "timestamp")
    ranged.write.mode("append").option("parquet.bloom.filter.enabled#query_id", "true").option("parquet.page.row.count.limit", "1000").parquet(path)


def audit_at(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """audit() of a log that write_sorted_log() wrote: the filter is pushed to the files' ranges and Bloom filters."""
    return audit(spark.read.schema(LOG_SCHEMA).parquet(path), query_id)


def newest_file_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, from the file modified last; the file's name decides ties. df must come from a file reader."""
    dated = df.withColumn("__t", F.col("_metadata.file_modification_time")).withColumn("__p", F.col("_metadata.file_path"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__p")))
    return dated.withColumn("__n", place).where("__n = 1").drop("__t", "__p", "__n")


def union_results(parts: Iterable[DataFrame]) -> DataFrame:
    """Result tables with different columns as one, blanks where a table has none."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: rows whose keys have no result yet."""
    return todo.join(done.select(*keys), keys, "left_anti")


def cached(asked: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is cached with their vectors, distinct keys and texts to embed)."""
    keyed = asked.withColumn("key", F.sha2(F.concat(F.lit(f"{model}\0"), F.col(text_col)), 256))
    missing = keyed.select("key", text_col).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return keyed.join(cache, "key"), missing
