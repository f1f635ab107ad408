"""Readers and writers over files that Spark writes from the tables, and canonical payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators.running import rank_by_hash
from ..sources import readers
from ..sources.keyed import KeyedTable, embed_cached
from ..sources.shared import shared_folder
from .routing import BASE, centroids, read, vectors


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s1_corpus_file(spark, sf):
    """Documents written as {_id, title, text} lines and read as one passage each."""
    path = folder(spark, "corpus")
    d = read(spark, sf, "documents")
    d.select(F.col("doc_id").cast("string").alias("_id"), F.when(F.pmod("doc_id", F.lit(3)) != 0, F.concat(F.lit(" "), "source")).alias("title"), F.concat("text", F.lit("  ")).alias("text")).write.json(path)
    return readers.corpus_jsonl(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


S1 = "SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 THEN source || '. ' || rtrim(ltrim(text, ' '), ' ') ELSE rtrim(ltrim(text, ' '), ' ') END) AS digest FROM documents"


def s2_first_rows(spark, sf):
    """The thirty benchmark passages with the smallest ids: a bounded scan is the feature."""
    return readers.first_rows(read(spark, sf, "benchmark"), "item_id", 30).select("item_id", F.length("text").alias("chars"))


S2 = "SELECT item_id, length(text)::INT AS chars FROM benchmark ORDER BY item_id LIMIT 30"


def s3_qrels_file(spark, sf):
    """Judgements written as a tab-separated file with a header; only positive ones come back."""
    path = folder(spark, "qrels")
    n = read(spark, sf, "labels").select(F.concat(F.lit("q"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("query-id"), F.col("doc_id").alias("corpus-id"), (F.col("quality") + F.col("toxic")).alias("score"))
    n.write.option("sep", "\t").option("header", True).csv(path)
    return readers.qrels_tsv(spark, path).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


S3 = "SELECT 'q' || (doc_id % 7) AS query_id, count(*) AS n, sum(quality + toxic)::BIGINT AS score FROM labels WHERE quality + toxic > 0 GROUP BY 1"


def s4_graded_file(spark, sf):
    """Graded judgements in four blank-separated columns, of known sources only."""
    path = folder(spark, "graded")
    e = read(spark, sf, "events").select(F.concat_ws(" ", F.concat(F.lit("u"), "user_id"), F.lit("0"), "event_type", F.floor("value").cast("string")).alias("value"))
    e.write.text(path)
    known = read(spark, sf, "events").where("event_type <> 'error'").select(F.col("event_type").alias("source_id")).distinct()
    return readers.graded_qrels(spark, path, known).groupBy("query_id", "source_id").agg(F.count("*").alias("n"), F.sum("grade").alias("grade"))


S4 = "SELECT 'u' || user_id AS query_id, event_type AS source_id, count(*) AS n, sum(floor(value)) AS grade FROM events WHERE event_type <> 'error' GROUP BY ALL"


def s5_queries_file(spark, sf):
    path = folder(spark, "queries")
    read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text").write.json(path)
    return readers.queries_jsonl(spark, path).select("query_id", F.md5("text").alias("digest"))


S5 = "SELECT item_id::VARCHAR AS query_id, md5(text) AS digest FROM benchmark"


def s6_mapping_files(spark, sf):
    """Nations as a tab-separated mapping joined with their regions' table in CSV."""
    one, two = folder(spark, "mapping"), folder(spark, "regions")
    read(spark, sf, "nation").select(F.col("n_name"), F.col("n_regionkey").cast("string")).write.option("sep", "\t").csv(one)
    readers.write_csv(read(spark, sf, "region").select("r_regionkey", "r_name"), two)
    regions = spark.read.csv(two, header=True, schema="r_regionkey string, r_name string")
    return readers.mapping_tsv(spark, one).join(regions, F.col("value") == F.col("r_regionkey")).select(F.col("key").alias("nation"), F.col("r_name").alias("region"))


S6 = "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"


def s7_similar_patients(spark, sf):
    """Customers with a dictionary of similar ones in a CSV column: pairs of different segments that are in the table (J11)."""
    path = folder(spark, "patients")
    c = read(spark, sf, "customer")
    near = F.create_map(*(x for d in (7, 13, 100_003) for x in (F.concat(F.lit("c"), (F.col("c_custkey") + d).cast("string")), F.lit(d % 5).cast("int"))))
    listed = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(near), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", "), F.lit("}"))
    c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("patient_uid"), F.col("c_mktsegment").alias("PMID"), F.concat(F.col("c_name"), F.lit(', "known"')).alias("patient"), listed.alias("similar_patients")).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    p = readers.patients_csv(spark, path)
    other = p.select(F.col("patient_uid").alias("similar"), F.col("PMID").alias("segment")).distinct()
    return p.join(other, "similar").where("PMID <> segment").select("patient_uid", "similar", "grade")


S7 = "WITH s AS (SELECT c_custkey, c_mktsegment, d FROM customer, (VALUES (7), (13), (100003)) v(d)) SELECT 'c' || s.c_custkey AS patient_uid, 'c' || o.c_custkey AS similar, d % 5 AS grade FROM s JOIN customer o ON o.c_custkey = s.c_custkey + d WHERE o.c_mktsegment <> s.c_mktsegment"


def s9_node_files(spark, sf):
    """Suppliers of each region as one node file, some with collections, one broken (S10): passages by node and collection."""
    path = folder(spark, "nodes")
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    listed = s.groupBy(F.concat(F.lit("node_"), F.col("n_regionkey").cast("string")).alias("node_id"), F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("s_name")).alias("all"))
    plain = F.when(F.col("k") % 2 == 0, F.col("all"))
    named = F.when(F.col("k") % 2 == 1, F.create_map(F.lit("public"), F.slice("all", 1, 1), F.lit("clinical"), F.slice("all", F.lit(2), F.size("all"))))
    rows = listed.select("node_id", plain.alias("documents"), named.alias("collections"))
    lines = rows.select(F.to_json(F.struct("node_id", "documents", "collections")).alias("value")).unionByName(spark.range(1).select(F.lit('{"node_id": "broken", "documents": [').alias("value")))
    lines.withColumn("file", F.xxhash64("value")).repartition("file").write.partitionBy("file").text(path)
    return readers.node_specs(spark, f"{path}/*").groupBy("source_id", "collection").agg(F.count("*").alias("passages"), F.min("text").alias("first"))


S9 = """WITH s AS (SELECT 'node_' || n_regionkey AS source_id, n_regionkey AS k, s_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_name) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT source_id, CASE WHEN k % 2 = 0 OR r = 1 THEN 'public' ELSE 'clinical' END AS collection, count(*) AS passages, min(s_name) AS first FROM s GROUP BY ALL"""


def s13_questions_file(spark, sf):
    """Conversations written as one nested JSON of questions by subset, read back, and a seeded sample of ten a subset."""
    path = folder(spark, "questions")
    t = read(spark, sf, "conversations").where("turn = 0").withColumn("subset", F.concat(F.lit("s"), F.pmod("conv_id", F.lit(4)).cast("string")))
    item = F.struct(F.col("text").alias("question"), F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.lit("no")).alias("options"), F.lit("A").alias("answer"))
    by = t.groupBy("subset").agg(F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), item))).alias("items"))
    by.select(F.col("subset").alias("file"), F.to_json(F.create_map("subset", "items")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    q = readers.questions_json(spark, f"{path}/*").withColumn("h", F.sha2(F.concat(F.lit("5:"), "qid"), 256))
    return rank_by_hash(q, ["subset"], "h").where("place <= 10").select("subset", F.col("qid").cast("long").alias("qid"), F.md5("question").alias("digest"), F.size("options").alias("options"))


S13 = "SELECT subset, conv_id AS qid, md5(text) AS digest, 2 AS options FROM (SELECT 's' || (conv_id % 4) AS subset, conv_id, text FROM conversations WHERE turn = 0) QUALIFY row_number() OVER (PARTITION BY subset ORDER BY sha256('5:' || conv_id)) <= 10"


def s15_query_log(spark, sf):
    """Two appends to a log of JSON lines, read back by topic (T12)."""
    path = folder(spark, "log")
    e = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("topic_key"), F.array("event_type").alias("dispatched"), F.unix_timestamp("ts").cast("double").alias("timestamp"))
    for half in (0, 1):
        readers.append_log(e.where(F.pmod(F.col("query_id").cast("long"), F.lit(2)) == half), path)
    return readers.read_log(spark, path).groupBy("topic_key").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("questions"))


S15 = "SELECT event_type AS topic_key, count(*) AS n, count(DISTINCT event_id) AS questions FROM events GROUP BY event_type"


def s18_pruned_audits(spark, sf):
    """Records of three questions looked up in a sorted log with Bloom filters, each by its first record in time, with its decoys."""
    path = folder(spark, "sorted-log")
    e = read(spark, sf, "events")
    ids = F.concat(F.lit("q"), F.pmod("event_id", F.lit(500)).cast("string"))
    sent = F.array(F.col("event_type"), F.lit("x"), F.concat(F.lit("u"), "user_id"), F.lit("x"))
    log = e.select(ids.alias("query_id"), F.col("event_type").alias("topic_key"), F.array("event_type").alias("genuine"), F.array().cast("array<string>").alias("decoys"), sent.alias("dispatched"), F.array().cast("array<string>").alias("coarse"), F.lit(None).cast("map<string,double>").alias("stage_latency_ms"), F.lit(None).cast("map<string,double>").alias("bytes_transferred"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000.0 + F.col("event_id") % 1000).alias("timestamp"), F.col("event_id").cast("string").alias("extra"))
    readers.write_sorted_log(log, path, 8)
    found = [readers.audit_at(spark, path, q) for q in ("q7", "q123", "q499", "nowhere")]
    return readers.union_results(found).select("query_id", F.col("extra").cast("long").alias("event_id"), F.array_join("derived_decoys", ",").alias("decoys"))


S18 = "SELECT 'q' || (event_id % 500) AS query_id, event_id, 'x,u' || user_id || ',x' AS decoys FROM events WHERE event_id % 500 IN (7, 123, 499) QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY epoch_us(ts) * 1000.0::DOUBLE + event_id % 1000) = 1"


def s16_results(spark, sf):
    """Result tables with different columns as one, written as CSV and read back, blanks where a table has none."""
    path = folder(spark, "results")
    d = read(spark, sf, "documents")
    parts = [d.groupBy("lang").agg(F.count("*").alias("docs")), d.groupBy("lang").agg(F.max("n_chars").alias("longest")).withColumn("kind", F.lit("size"))]
    readers.write_csv(readers.union_results(parts), path)
    return spark.read.csv(path, header=True, schema="lang string, docs long, longest long, kind string")


S16 = "SELECT lang, count(*) AS docs, NULL::BIGINT AS longest, NULL::VARCHAR AS kind FROM documents GROUP BY lang UNION ALL SELECT lang, NULL, max(n_chars)::BIGINT, 'size' FROM documents GROUP BY lang"


def s14_cache_misses(spark, sf):
    """Texts asked for against a cache of every second document: hits by language, and distinct misses to embed."""
    d = read(spark, sf, "documents")
    key = F.sha2(F.concat(F.lit("m\0"), F.col("text")), 256)
    cache = d.where("doc_id % 2 = 0").select(key.alias("key")).distinct().withColumn("vec", F.array(F.lit(1.0)))
    hits, misses = readers.cached(d.select("lang", "text"), cache, "m")
    return hits.groupBy("lang").agg(F.count("*").alias("hits")).join(misses.agg(F.count("*").alias("misses")), how="cross")


S14 = "WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), m AS (SELECT count(DISTINCT text) AS misses FROM documents WHERE text NOT IN (SELECT text FROM c)) SELECT lang, count(*) AS hits, (SELECT misses FROM m) AS misses FROM documents WHERE text IN (SELECT text FROM c) GROUP BY lang"


def s14_embedding_upsert(spark, sf):
    """A cache that is asked twice: it holds every second document's text at first, embeds and stores what it misses, and
    then has all; every tenth text is embedded anew at the end, and its newest vector counts."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "text")
    cache = KeyedTable(spark, folder(spark, "vectors"), "key string, vec array<double>", buckets=16)
    lengths = lambda k: lambda t: t.select("key", F.array((F.char_length("text") * k).cast("double"), F.lit(1.0)).alias("vec"))
    embed_cached(d.where("doc_id % 2 = 0"), cache, "m", lengths(1))
    first, missed = embed_cached(d, cache, "m", lengths(1))
    again, none = embed_cached(d, cache, "m", lengths(5))
    key = F.sha2(F.concat(F.lit("m\0"), F.col("text")).cast("binary"), 256)
    cache.upsert(lengths(2)(d.where("doc_id % 10 = 0").select(key.alias("key"), "text").distinct()))
    newest = again.select("lang", "key").join(cache.read(), "key").groupBy("lang").agg(F.sum(F.get("vec", F.lit(0))).alias("length"))
    hits = first.groupBy("lang").agg(F.sum(F.col("cached").cast("long")).alias("hits"), F.count("*").alias("asked"))
    counts = missed.agg(F.count("*").alias("embedded")).crossJoin(F.broadcast(none.agg(F.count("*").alias("embedded_again"))))
    return hits.join(newest, "lang").crossJoin(F.broadcast(counts))


S14_UPSERT = """WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), n AS (SELECT DISTINCT text FROM documents WHERE doc_id % 10 = 0)
SELECT lang, count(*) FILTER (text IN (SELECT text FROM c)) AS hits, count(*) AS asked, sum(length(text) * CASE WHEN text IN (SELECT text FROM n) THEN 2 ELSE 1 END)::DOUBLE AS length,
  (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM c)) AS embedded, 0::BIGINT AS embedded_again FROM documents GROUP BY lang"""


def s17_newest_file(spark, sf):
    """Two files of one kind, the second newer: its row wins for each key that both have."""
    path = folder(spark, "newest")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    for run in (0, 1):
        s.where(F.lit(run == 0) | (F.col("s_suppkey") % 3 == 0)).withColumn("run", F.lit(run)).coalesce(1).write.mode("append").json(path)
    rows = readers.newest_file_wins(spark.read.schema("s_suppkey long, s_acctbal double, run int").json(path).select("*", "_metadata"), ["s_suppkey"])
    return rows.select("s_suppkey", "run")


S17 = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS run FROM supplier"


def d22_payloads(spark, sf):
    """Canonical payload of each source (sorted keys, centroids in units of 1e-8): its fingerprint and length in bytes (D23)."""
    units = F.transform("vec", lambda x: F.rint(x * 1e8).cast("long"))
    c = centroids(spark, sf).select("source_id", "centroid_ix", units.alias("v")).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("centroid_ix", "v"))), lambda x: x["v"]).alias("centroids"))
    body = F.to_json(F.struct("centroids", F.lit("").alias("description"), F.lit(1).alias("profile_version"), F.concat(F.lit("shard-"), F.col("source_id").cast("string")).alias("source_id")))
    return c.select(F.col("source_id"), F.sha2(body, 256).alias("fingerprint"), F.octet_length(body).cast("long").alias("bytes"))


D22 = f"""WITH {BASE}, c AS (SELECT source_id, list([round_even(x * 1e8, 0)::BIGINT FOR x IN vec] ORDER BY centroid_ix) AS v FROM centroids GROUP BY source_id),
b AS (SELECT source_id, '{{"centroids":[' || array_to_string(['[' || array_to_string(y, ',') || ']' FOR y IN v], ',') || '],"description":"","profile_version":1,"source_id":"shard-' || source_id || '"}}' AS b FROM c) SELECT source_id, sha256(b) AS fingerprint, strlen(b) AS bytes FROM b"""


def f9_vector_checks(spark, sf):
    """Vectors that may be published: of the right width, without null or infinite components; clipped ones (F9, V3)."""
    e = vectors(spark, sf).withColumn("vec", F.when(F.pmod("vec_id", F.lit(9)) == 0, F.slice("vec", 1, 63)).otherwise(F.col("vec")))
    return e.groupBy("label").agg(F.sum(v.is_finite(F.col("vec"), 64).cast("int")).alias("usable"), F.round(F.sum(v.clip01(F.element_at("vec", 1))), 6).alias("clipped"))


F9 = "SELECT label, sum((vec_id % 9 <> 0)::INT)::BIGINT AS usable, round(sum(greatest(0, least(1, embedding[1]::DOUBLE))), 6) AS clipped FROM embeddings GROUP BY label"

QUERIES = {
    "s1_corpus_file": (s1_corpus_file, S1), "s2_first_rows": (s2_first_rows, S2), "s3_qrels_file": (s3_qrels_file, S3), "s4_graded_file": (s4_graded_file, S4), "s5_queries_file": (s5_queries_file, S5), "s6_mapping_files": (s6_mapping_files, S6), "s7_similar_patients": (s7_similar_patients, S7), "s9_node_files": (s9_node_files, S9),
    "s13_questions_file": (s13_questions_file, S13), "s14_cache_misses": (s14_cache_misses, S14), "s14_embedding_upsert": (s14_embedding_upsert, S14_UPSERT), "s15_query_log": (s15_query_log, S15), "s16_results": (s16_results, S16), "s18_pruned_audits": (s18_pruned_audits, S18), "s17_newest_file": (s17_newest_file, S17), "d22_payloads": (d22_payloads, D22), "f9_vector_checks": (f9_vector_checks, F9),
}
