"""Retrieval and text queries: documents by source are the passages, label means and benchmark items the questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import deidentify as d
from ..functions import text as t
from ..functions import vectors as v
from ..operators import clusters as c
from ..operators import retrieval as k
from ..operators import routing as r
from ..operators.running import rank_by_hash, tile
from .deid import re2
from .routing import BASE, count_bucket, read, vectors


def topics(spark, sf):
    """Label means as stated questions: their number doesn't follow the data."""
    return v.mean_vectors(vectors(spark, sf), ["label"]).withColumnRenamed("label", "query_id")


def scored(spark, sf):
    docs = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("shard").alias("source_id"), "vec")
    return k.score_documents(topics(spark, sf), docs)


SCORED = f"""{BASE}, asked AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM elems GROUP BY label, i) GROUP BY label),
found AS (SELECT a.query_id, (e.vec_id % 12)::INT AS source_id, e.vec_id AS doc_id, round(list_cosine_similarity(a.q, e.embedding::DOUBLE[]), 6) AS score FROM asked a, embeddings e)"""


def k1_retrieve(spark, sf):
    """Five best of every source for every question."""
    return k.top_n(scored(spark, sf), ["query_id", "source_id"], 5)


K1 = f"WITH {SCORED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, doc_id)::INT AS rank FROM found) WHERE rank <= 5"


def k11_server_fusion(spark, sf):
    """Ten best of each source, then ten best of all."""
    each = k.top_n(scored(spark, sf), ["query_id", "source_id"], 10).drop("rank")
    return k.top_n(each, ["query_id"], 10)


K11 = f"""WITH {SCORED}, each AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, doc_id) <= 10)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM each) WHERE rank <= 10"""


def k12_centralized(spark, sf):
    return k.top_n(scored(spark, sf), ["query_id"], 10).select("query_id", "doc_id", "score", "rank")


K12 = f"WITH {SCORED} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM found) WHERE rank <= 10"


def k9_rank_fusion(spark, sf):
    """Sources' ten nearest by squared distance, fused over all lists by each text's last place; and plainly, without fusion."""
    docs = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("shard").alias("source_id"), "vec")
    d = F.round(F.aggregate(F.zip_with("vec", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 6)
    each = docs.crossJoin(r.small(topics(spark, sf).withColumnRenamed("vec", "q"))).select("query_id", "source_id", "doc_id", d.alias("distance"))
    lists = k.top_n(each, ["query_id", "source_id"], 10, [F.col("distance"), F.col("doc_id")]).withColumn("text", F.concat(F.lit("text "), F.floor(F.col("doc_id") / 3).cast("string")))
    fused, plain = (k.reciprocal_rank_fusion(lists, 10, n).withColumn("k", F.lit(n)) for n in (60, 0))
    return fused.unionByName(plain)


K9 = f"""WITH {SCORED}, far AS (SELECT query_id, e.vec_id AS doc_id, (e.vec_id % 12)::INT AS source_id, round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(e.embedding::DOUBLE[], a.q)]), 6) AS d FROM embeddings e, asked a),
each AS (SELECT *, sha256('text ' || (doc_id // 3)) AS key FROM far QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY d, doc_id) <= 10),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) - 1 AS position FROM each), f AS (SELECT query_id, key, round(1.0::DOUBLE / (max(position) + 61), 9) AS score FROM placed GROUP BY query_id, key)
SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank, 60 AS k FROM f QUALIFY rank <= 10
UNION ALL SELECT query_id, key, (-position)::DOUBLE, (position + 1)::INT, 0 FROM placed WHERE position < 10"""


def k16_inversion(spark, sf):
    """The question that each document's vector gives away: its nearest topic."""
    top = scored(spark, sf).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"))).alias("m"))
    e = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "label")
    return top.join(e, "doc_id").select("doc_id", (-F.col("m.q")).alias("guess"), F.col("m.score").alias("score"), (F.col("label") == -F.col("m.q")).alias("right"))


K16 = f"WITH {SCORED} SELECT f.doc_id, f.query_id AS guess, f.score, e.label = f.query_id AS \"right\" FROM found f JOIN embeddings e ON e.vec_id = f.doc_id QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY f.score DESC, f.query_id) = 1"


def source_questions(spark, sf):
    """One benchmark passage per source as its question, by the source's number: query_id (the source), text, terms."""
    b = read(spark, sf, "benchmark")
    number = F.coalesce(F.regexp_extract("query_id", "[0-9]+", 0).try_cast("long"), F.lit(0))
    sources = read(spark, sf, "documents").select(F.col("source").alias("query_id")).where("query_id is not null").distinct()
    asked = sources.crossJoin(F.broadcast(b.agg(F.count("*").alias("n")))).withColumn("item_id", F.pmod(number, F.greatest(F.lit(1), "n")))
    return asked.join(b, "item_id").select("query_id", "text", t.tokens(F.col("text")).alias("terms"))


def source_pool(spark, sf):
    return read(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", "text")


def k4_bm25(spark, sf):
    """Okapi scores of all documents for their source's question, with each source's statistics."""
    return k.bm25(k.bm25_counts(source_pool(spark, sf), source_questions(spark, sf)))


_STOP = ", ".join(f"'{w}'" for w in t.LEXICAL_STOPWORDS)
ASKED = """asked AS (SELECT s.source AS query_id, b.text FROM (SELECT DISTINCT source, coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT), 0) % (SELECT count(*) FROM benchmark) AS k FROM documents) s JOIN benchmark b ON b.item_id = s.k),"""
BM25 = f"""{ASKED}
words AS (SELECT doc_id, source AS query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS t FROM documents),
lens AS (SELECT doc_id, query_id, len(t) AS len FROM words), stats AS (SELECT query_id, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY query_id),
flat AS (SELECT doc_id, query_id, unnest(t) AS term FROM words),
terms AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS term FROM asked),
tf AS (SELECT f.query_id, f.doc_id, f.term, count(*) AS tf FROM flat f JOIN terms USING (query_id, term) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
part AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / coalesce(nullif(avg_len, 0), 1)))) AS bm25 FROM tf JOIN df USING (query_id, term) JOIN lens USING (query_id, doc_id) JOIN stats USING (query_id) GROUP BY query_id, doc_id),
bm25 AS (SELECT query_id, doc_id, round(coalesce(bm25, 0)::DOUBLE, 6) AS bm25 FROM lens LEFT JOIN part USING (query_id, doc_id))"""
K4 = f"WITH {BM25} SELECT query_id, doc_id, bm25 FROM bm25"


def hashed_questions(spark, sf):
    """Questions as counts of hashed words, an array by bucket."""
    n = v.hashed_features(source_questions(spark, sf), "query_id", "text")
    full = n.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"))
    return full.select("query_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("q"))


def hybrid_pool(spark, sf):
    """Documents with the cosine of their hashed words and their Okapi score for their source's question."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    q = hashed_questions(spark, sf)
    pool = source_pool(spark, sf).join(r.small(q), "query_id", "left").withColumn("cosine", F.round(F.coalesce(k.hashed_cosine(words, F.coalesce("q", F.array_repeat(F.lit(0.0), 256))), F.lit(0.0)), 6))
    return k.bm25(k.bm25_counts(pool, source_questions(spark, sf), "cosine"), "cosine")


HYBRID = f"""{BM25}, toks AS (SELECT doc_id, source AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), dn AS (SELECT doc_id, query_id, (('0x' || substr(sha256('m:' || w), 1, 8))::BIGINT % 256)::INT AS b, count(*)::DOUBLE AS n FROM toks GROUP BY ALL),
qn AS (SELECT query_id, (('0x' || substr(sha256('m:' || w), 1, 8))::BIGINT % 256)::INT AS b, count(*)::DOUBLE AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM asked) GROUP BY ALL),
ql AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM qn GROUP BY query_id), dl AS (SELECT doc_id, query_id, sqrt(sum(n * n)) AS l FROM dn GROUP BY ALL), dots AS (SELECT doc_id, sum(dn.n * qn.n) AS dot FROM dn JOIN qn USING (query_id, b) GROUP BY doc_id),
p AS (SELECT b.query_id, b.doc_id, bm25, round(coalesce(dot / dl.l / ql.l, 0), 6) AS cosine FROM bm25 b LEFT JOIN dots USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN ql ON ql.query_id = b.query_id),
z AS (SELECT query_id, doc_id, cosine, round(CASE WHEN count(*) OVER w < 2 THEN cosine ELSE
  CASE WHEN stddev_pop(cosine) OVER w <= 1e-12 THEN 0 ELSE (cosine - avg(cosine) OVER w) / stddev_pop(cosine) OVER w END + 0.5 * CASE WHEN stddev_pop(bm25) OVER w <= 1e-12 THEN 0 ELSE (bm25 - avg(bm25) OVER w) / stddev_pop(bm25) OVER w END END, 6) AS score FROM p WINDOW w AS (PARTITION BY query_id))"""


def k6_hybrid(spark, sf):
    """Summed z-scores of cosine and Okapi score of every document for its source's question."""
    return k.hybrid(hybrid_pool(spark, sf)).select("query_id", "doc_id", "score")


K6 = f"WITH {HYBRID} SELECT query_id, doc_id, score FROM z"


def k7_hybrid_rerank(spark, sf):
    """Five best documents of each source by the hybrid score, and by cosine alone (weight 0)."""
    pool = hybrid_pool(spark, sf)
    parts = [k.top_n(k.hybrid(pool, w), ["query_id"], 5).select(F.lit(w).alias("weight"), "query_id", "doc_id", "rank") for w in (0.5, 0.0)]
    return parts[0].unionByName(parts[1])


K7 = f"""WITH {HYBRID} SELECT 0.5::DOUBLE AS weight, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM z QUALIFY rank <= 5
UNION ALL SELECT 0.0::DOUBLE, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id)::INT AS rank FROM z QUALIFY rank <= 5"""


def v6_feature_hashing(spark, sf):
    f = v.hashed_features(read(spark, sf, "documents"), "doc_id", "text")
    return f.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


V6 = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
b AS (SELECT doc_id, (('0x' || substr(sha256('m:' || t), 1, 8))::BIGINT % 256)::INT AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT bucket, count(*) AS docs, sum(n)::BIGINT AS n FROM b GROUP BY bucket"""


def c7_topics(spark, sf):
    return t.document_topics(read(spark, sf, "documents"), "source").select("source", "rank", "term", "df")


def _topics_sql() -> str:
    x = "text"
    for pattern, mark in ((d.EMAIL, "[REDACTED_EMAIL]"), (d.SSN, "[REDACTED_ID]"), (d.PHONE_WIDE, "[REDACTED_PHONE]")):
        x = f"regexp_replace({x}, '{re2(pattern)}', '{mark}', 'g')"
    x = f"lower(regexp_replace({x}, '{d.PLACEHOLDERS}', ' ', 'g'))"
    stop = ", ".join(f"'{w}'" for w in t.TOPIC_STOPWORDS)
    return f"""topics AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY df DESC, term)::INT AS rank, term, df FROM (
  SELECT source, term, count(*) AS df FROM (SELECT DISTINCT source, doc_id, term FROM (SELECT source, doc_id, unnest(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents))
  WHERE regexp_full_match(term, '[a-z]{{3,}}') AND term NOT IN ({stop}) GROUP BY source, term) QUALIFY rank <= 16)"""


def c8_descriptions(spark, sf):
    return t.describe(t.document_topics(read(spark, sf, "documents"), "source"), "source")


def c15_common_words(spark, sf):
    return t.common_words(read(spark, sf, "documents"))


C15 = """SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z][a-z'']+') GROUP BY word) WHERE n >= 3"""


def c16_session_chunks(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", t.session_chunks(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").alias("chunks"), F.transform("c", lambda x: F.length(x)).alias("l")).select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lengths")).select("doc_id", F.when(F.col("lengths").isNull(), 0).otherwise(F.col("chunks")).alias("chunks"), F.coalesce("lengths", F.lit("")).alias("lengths"))


C16 = r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 3) AS s FROM documents)
SELECT doc_id, CASE WHEN len(s) >= 5 THEN 5 ELSE 0 END AS chunks, CASE WHEN len(s) >= 5 THEN array_to_string([length(array_to_string(s[k * len(s) // 5 + 1 : (k + 1) * len(s) // 5], ' ')) FOR k IN range(5)], ',') ELSE '' END AS lengths FROM s"""


def d20_term_recovery(spark, sf):
    """Word overlap of each turn with the conversation's first turn."""
    turns = read(spark, sf, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("truth"))
    return turns.join(first, "conv_id").select("conv_id", "turn", F.round(t.term_recovery(F.col("truth"), F.col("text")), 6).alias("recovery"))


D20 = """WITH f AS (SELECT conv_id, arg_min(text, turn) AS truth FROM conversations GROUP BY conv_id),
w AS (SELECT c.conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(truth), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS b FROM conversations c JOIN f USING (conv_id))
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS recovery FROM w"""


def d21_answers(spark, sf):
    """Answer letters of assistants' turns, among all four options and among two."""
    x = read(spark, sf, "conversations").where("role = 'assistant'").select(t.answer_letter(F.col("text")).alias("letter"), t.answer_letter(F.col("text"), ["A", "C"]).alias("among"))
    return x.groupBy("letter", "among").agg(F.count("*").alias("n"))


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
_FIRST = f"regexp_extract({_TRIM} || ' ', '^\\(?([A-D])\\)?[.):\\s]', 1)"
D21 = f"""WITH a AS (SELECT {_FIRST} AS f, regexp_extract_all({_TRIM}, '\\b([A-D])\\b', 1) AS l FROM conversations WHERE role = 'assistant')
SELECT CASE WHEN f <> '' THEN f ELSE l[1] END AS letter, CASE WHEN f IN ('A', 'C') THEN f ELSE list_filter(l, lambda x: x IN ('A', 'C'))[1] END AS among, count(*) AS n FROM a GROUP BY ALL"""


def d21_prompts(spark, sf):
    """Prompts with options, and with a conversation's turns as numbered passages."""
    turns = read(spark, sf, "conversations")
    by = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("all"))
    one = by.select("conv_id", t.choice_prompt(F.get("all", F.lit(0)), F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes"))).alias("a"), t.passage_prompt(F.get("all", F.lit(0)), F.slice("all", F.lit(2), F.size("all"))).alias("b"))
    return one.select("conv_id", F.md5("a").alias("choice"), F.md5("b").alias("passages"))


D21_PROMPTS = f"""WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, x[1] AS q, array_to_string([('[' || i || '] ' || y) FOR y, i IN x[2:]], chr(10)) AS l FROM t)
SELECT conv_id, md5(q || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || chr(10) || 'Choose the best option. Reply with the single option letter only.') AS choice,
  md5('{t.PROMPT[0].replace("'", "''").split(chr(10))[0]}' || chr(10) || chr(10) || 'Question: ' || q || chr(10) || chr(10) || 'Passages:' || chr(10) || CASE WHEN l = '' THEN '(none returned)' ELSE l END || chr(10) || chr(10) || 'Answer:') AS passages FROM p"""


def d17_exposed(spark, sf):
    """Benchmark passages that documents hold, by source."""
    d, b = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    hit = k.passages_held(d.select("doc_id", "text"), b).join(d.select("doc_id", "source"), "doc_id")
    return hit.groupBy("source").agg(F.count("*").alias("pairs"), F.countDistinct("item_id").alias("items"))


D17 = "SELECT source, count(*) AS pairs, count(DISTINCT item_id) AS items FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text)) GROUP BY source"


def c4_cluster_index(spark, sf):
    docs = vectors(spark, sf).select(F.col("shard").alias("source_id"), F.when(F.col("label") < 5, "public").otherwise("clinical").alias("collection"), F.col("vec_id").alias("doc_id"), "vec")
    return c.cluster_index(docs)


def c1_kmeans(spark, sf):
    docs = vectors(spark, sf).select(F.col("shard").alias("source_id"), F.col("vec_id").alias("doc_id"), "vec")
    return c.kmeans_profiles(docs, 4).select("source_id", "centroid_ix", "members", F.round(v.norm(F.col("vec")), 6).alias("norm"))


def c10_nearest(spark, sf):
    """Each vector's nearest topic mean by Euclidean distance."""
    e = vectors(spark, sf).select("vec_id", "vec").crossJoin(r.small(topics(spark, sf).withColumnRenamed("vec", "q")))
    far = F.round(F.aggregate(F.zip_with("vec", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 6)
    near = e.select("vec_id", "query_id", far.alias("d")).groupBy("vec_id").agg(F.min(F.struct("d", "query_id")).alias("m"))
    return near.select("vec_id", F.col("m.query_id").alias("cluster"), F.col("m.d").alias("distance"))


C10 = f"WITH {SCORED} SELECT vec_id, query_id AS cluster, d AS distance FROM (SELECT e.vec_id, a.query_id, round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(e.embedding::DOUBLE[], a.q)]), 6) AS d FROM embeddings e, asked a) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, query_id) = 1"


def c9_partition(spark, sf):
    """Documents of each source dealt to five near-equal parts in hash order, the first ones one larger."""
    d = read(spark, sf, "documents").select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    placed = rank_by_hash(d, ["source"], "h").join(r.small(d.groupBy("source").agg(F.count("*").alias("n"))), "source")
    return placed.select("source", "doc_id", tile(F.col("place"), F.col("n"), 5).alias("part"))


C9 = "SELECT source, doc_id, ntile(5) OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR))::INT AS part FROM documents"


def c11_dirichlet(spark, sf):
    """Documents of each language spread over eight clients with uneven proportions; shares are near those drawn."""
    d = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    return c.dirichlet_partition(d, 8, 0.5, seed=11).groupBy("topic", "client").agg(F.count("*").alias("n"))


def c6_profiles(spark, sf):
    """What each shard publishes: k-means centroids with noise, and a coarse document count."""
    docs = vectors(spark, sf).select(F.col("shard").alias("source_id"), F.col("vec_id").alias("doc_id"), "vec")
    made = v.perturb(c.kmeans_profiles(docs, 3), "vec", 0.01, 5, "source_id", "centroid_ix")
    n = docs.groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", count_bucket(F.col("n")).alias("bucket"))
    return made.groupBy("source_id").agg(F.count("*").alias("centroids"), F.sum("members").alias("members"), F.max(F.size("vec")).alias("width")).join(r.small(n), "source_id")


C6 = """SELECT (vec_id % 12)::INT AS source_id, least(3, count(*)) AS centroids, count(*) AS members, max(len(embedding))::INT AS width, CASE WHEN count(*) <= 100 THEN '1-100' WHEN count(*) <= 1000 THEN '101-1000' WHEN count(*) <= 10000 THEN '1001-10000' WHEN count(*) <= 100000 THEN '10001-100000' ELSE '100000+' END AS bucket FROM embeddings GROUP BY 1"""


def c12_centroid_leak(spark, sf):
    """Clusters, their smallest and single ones, and the share whose centroid nearly is a document."""
    s = scored(spark, sf).groupBy("query_id").agg(F.max("score").alias("near"))
    n = vectors(spark, sf).groupBy(F.col("label").alias("query_id")).agg(F.count("*").alias("n"))
    return s.join(n, "query_id").agg(F.count("*").alias("clusters"), F.min("n").alias("smallest"), F.round(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 6).alias("single"), F.round(F.avg(F.when(F.col("near") > 0.95, 1.0).otherwise(0.0)), 6).alias("leaky"))


C12 = f"WITH {SCORED}, s AS (SELECT query_id, max(score) AS near FROM found GROUP BY query_id), n AS (SELECT label AS query_id, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS clusters, min(n) AS smallest, round(avg((n = 1)::INT), 6) AS single, round(avg((near > 0.95)::INT), 6) AS leaky FROM s JOIN n USING (query_id)"

QUERIES = {
    "k1_retrieve": (k1_retrieve, K1), "k4_bm25": (k4_bm25, K4), "k6_hybrid": (k6_hybrid, K6), "k7_hybrid_rerank": (k7_hybrid_rerank, K7), "k9_rank_fusion": (k9_rank_fusion, K9), "k11_server_fusion": (k11_server_fusion, K11), "k12_centralized": (k12_centralized, K12),
    "k16_inversion": (k16_inversion, K16), "v6_feature_hashing": (v6_feature_hashing, V6),
    "c7_topics": (c7_topics, f"WITH {_topics_sql()} SELECT source, rank, term, df FROM topics"),
    "c8_descriptions": (c8_descriptions, f"WITH {_topics_sql()} SELECT source, 'Collection topics: ' || string_agg(term, ', ' ORDER BY rank) || '.' AS description FROM topics GROUP BY source"),
    "c15_common_words": (c15_common_words, C15), "c16_session_chunks": (c16_session_chunks, C16), "d20_term_recovery": (d20_term_recovery, D20), "d21_answers": (d21_answers, D21), "d21_prompts": (d21_prompts, D21_PROMPTS), "d17_exposed": (d17_exposed, D17),
    "c4_cluster_index": (c4_cluster_index, None), "c1_kmeans": (c1_kmeans, None), "c9_partition": (c9_partition, C9), "c11_dirichlet": (c11_dirichlet, None), "c6_profiles": (c6_profiles, C6), "c10_nearest": (c10_nearest, C10), "c12_centroid_leak": (c12_centroid_leak, C12),
}
