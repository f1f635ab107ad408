"""Retrieval, lexical scoring, fusion and reranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine, norm, widen
from ..sources.shared import checkpointed
from .routing import small

#: Stated questions are broadcast up to this many; beyond it they meet the documents in shuffled parts.
BROADCAST_QUESTIONS = 20_000


def score_documents(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of every question (query_id, vec) with every document (doc_id, source_id, vec).

    The stated questions are the small side, broadcast when their counted number allows; documents stay where they are.
    More questions are dealt to parts, and each document goes to every part.
    """
    q = questions.select("query_id", widen(F.col("vec")).alias("qv")).withColumn("qn", norm(F.col("qv")))
    d = docs.select("doc_id", "source_id", widen(F.col("vec")).alias("dv")).withColumn("dn", norm(F.col("dv")))
    n = questions.count()
    score = F.round(cosine(F.col("qv"), F.col("dv"), F.col("qn"), F.col("dn")), 6)
    if n <= BROADCAST_QUESTIONS:
        both = d.crossJoin(F.broadcast(q))
    else:
        parts = math.ceil(n / BROADCAST_QUESTIONS)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        both = d.withColumn("part", every).join(q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "part")
    return both.select("query_id", "source_id", "doc_id", score.alias("score"))


def top_n(scored: DataFrame, keys: list[str], n: int, order: list | None = None) -> DataFrame:
    """The n best rows per key with their rank; Spark keeps each task's own n before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.desc("score"), F.col("doc_id")])))
    return scored.withColumn("rank", place).where(F.col("rank") <= n)


def clamped_top_n(n: int) -> int:
    """What a server gives at most: a request for n passages, from 1 to 20."""
    return min(max(n, 1), 20)


def bm25_counts(pool: DataFrame, queries: DataFrame, *more: str) -> DataFrame:
    """Each pooled passage (query_id, doc_id, text) with its length and its counts of the query's terms, in one pass.

    queries: query_id, terms. Terms count once. Result: query_id, doc_id, len, tf (array, by the terms' order), and more
    columns of pool. Checkpointed, since statistics and scores both read it: texts are tokenised once.
    """
    terms = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    words = pool.join(small(terms), "query_id", "left").withColumn("t", tokens(F.col("text")))
    tf = F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda w: F.size(F.filter("t", lambda x: x == w)))
    return checkpointed(words.select("query_id", "doc_id", *more, F.size("t").alias("len"), tf.alias("tf")))


def bm25(counts: DataFrame, *more: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi scores of bm25_counts(): query_id, doc_id, bm25. Statistics are the pool's own; no term at all scores 0."""
    stats = counts.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = counts.select("query_id", F.posexplode("tf").alias("p", "c")).groupBy("query_id", "p").agg(F.sum((F.col("c") > 0).cast("long")).alias("df"))
    idf = df.join(stats, "query_id").select("query_id", "p", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = idf.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "idf"))), lambda x: x["idf"]).alias("idf"))
    facts = stats.join(idf, "query_id", "left")
    average = F.when(F.col("avg_len") == 0, F.lit(1.0)).otherwise(F.col("avg_len"))
    length = k1 * (1 - b + b * F.col("len") / average)
    part = F.zip_with("tf", "idf", lambda c, i: F.coalesce(i * c * (k1 + 1) / (c + length), F.lit(0.0)))
    score = F.aggregate(F.coalesce(part, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)
    return counts.join(small(facts), "query_id").select("query_id", "doc_id", *more, F.round(score, 6).alias("bm25"))


def bm25_corpus(docs: DataFrame, questions: DataFrame, per_question: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The per_question best documents (doc_id, text) of the whole corpus for each question (query_id, terms): query_id, doc_id, bm25, rank.

    An inverted-index join: only counts of words that some question has leave a document's row.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    words = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    totals = words.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))
    tf = words.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    tf = checkpointed(tf)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, average = F.col("n"), F.when(F.col("avg_len") == 0, F.lit(1.0)).otherwise(F.col("avg_len"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / average))
    weights = tf.join(small(df), "term").crossJoin(F.broadcast(totals)).select("doc_id", "term", part.alias("w"))
    scores = weights.join(small(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("bm25"))
    return top_n(scores, ["query_id"], per_question, [F.desc("bm25"), F.col("doc_id")])


def hybrid(pool: DataFrame, weight: float = 0.5) -> DataFrame:
    """pool (query_id, doc_id, cosine, bm25) with score: raw cosine for weight 0 or a pool of one, else summed z-scores.

    Means and population deviations are aggregates joined back, so a pool of any size is spread over tasks; a deviation
    of 1e-12 or less gives 0.
    """
    if weight == 0:
        return pool.withColumn("score", F.round("cosine", 6))
    stats = pool.groupBy("query_id").agg(F.count("*").alias("_n"), *(f(c).alias(f"_{k}_{c}") for c in ("cosine", "bm25") for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: F.when(F.col(f"_s_{c}") <= 1e-12, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    score = F.when(F.col("_n") < 2, F.col("cosine")).otherwise(z("cosine") + F.lit(weight) * z("bm25"))
    return pool.join(small(stats), "query_id").withColumn("score", F.round(score, 6)).select(*pool.columns, "score")


def hashed_cosine(words: Column, question: Column, buckets: int = 256) -> Column:
    """Cosine of a text's hashed word counts with a question's (an array of counts by bucket), within the row.

    Words' buckets are sorted, so that equal ones follow each other and a fold of four numbers gives the squared length.
    """
    bucket = lambda w: F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("m:"), w), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("square"), F.lit(0.0).alias("dot"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), (s["square"] + 2 * run - 1).alias("square"), (s["dot"] + F.get(question, x)).alias("dot"))

    size = F.sqrt(F.aggregate(question, F.lit(0.0), lambda s, q: s + q * q))
    done = F.aggregate(F.array_sort(F.transform(words, bucket)), start, step)
    return F.transform(F.array(done), lambda s: F.when((s["square"] == 0) | (size == 0), 0.0).otherwise(s["dot"] / F.sqrt(s["square"].cast("double")) / size))[0]


def reciprocal_rank_fusion(ranked: DataFrame, knn: int, k: int = 60, text: str = "text") -> DataFrame:
    """Fusion of candidates (query_id, doc_id, text, distance): sorted by rising distance over all lists, one row per text.

    A text's last place gives 1 / (k + place + 1); the knn best stay. k = 0 takes the knn nearest rows as they are.
    Result: query_id, key (the text's hash), score, rank. Ties of distance go to the smaller doc_id.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id")) - 1
    placed = ranked.select("query_id", "doc_id", F.sha2(F.col(text), 256).alias("key"), place.alias("position"))
    if k == 0:
        return placed.where(F.col("position") < knn).select("query_id", "key", (-F.col("position")).cast("double").alias("score"), (F.col("position") + 1).alias("rank"))
    last = placed.groupBy("query_id", "key").agg(F.max("position").alias("position"))
    scored = last.select("query_id", "key", F.round(1.0 / (F.col("position") + k + 1), 9).alias("score"))
    return top_n(scored, ["query_id"], knn, [F.desc("score"), F.col("key")])


def open_clusters(probes: DataFrame, members: DataFrame) -> DataFrame:
    """All passages of the probed clusters: probes (query_id, source_id, cluster) joined with members (source_id, cluster, doc_id)."""
    return probes.where(F.col("cluster").isNotNull()).join(members, ["source_id", "cluster"])


def inverted_lists(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """docs (doc_id, vec) with list_id, the nearest centroid (list_id, vec) by Euclidean distance: an index of lists."""
    c = centroids.select(F.col("list_id"), widen(F.col("vec")).alias("c"))
    far = F.aggregate(F.zip_with(widen(F.col("vec")), F.col("c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = docs.crossJoin(small(c)).select("doc_id", F.struct(F.round(far, 9).alias("d"), "list_id").alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"))
    return docs.join(near.select("doc_id", F.col("x.list_id").alias("list_id")), "doc_id")


def probe_lists(queries: DataFrame, centroids: DataFrame, index: DataFrame, nprobe: int, knn: int) -> DataFrame:
    """The knn nearest documents of each query (query_id, vec) among its nprobe nearest lists: query_id, doc_id, distance, rank."""
    square = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 9)
    q = queries.select("query_id", widen(F.col("vec")).alias("qv"))
    lists = centroids.agg(F.array_sort(F.collect_list(F.struct("list_id", widen(F.col("vec")).alias("vec")))).alias("lists"))
    order = F.array_sort(F.transform("lists", lambda c: F.struct(square(F.col("qv"), c["vec"]).alias("d"), c["list_id"].alias("list_id"))))
    asked = q.crossJoin(F.broadcast(lists)).select("query_id", "qv", F.explode(F.slice(order, 1, nprobe)).alias("l")).select("query_id", "qv", "l.list_id")
    found = asked.join(index.select("list_id", "doc_id", widen(F.col("vec")).alias("dv")), "list_id").select("query_id", "doc_id", square(F.col("qv"), F.col("dv")).alias("distance"))
    return top_n(found, ["query_id"], knn, [F.col("distance"), F.col("doc_id")])


def passages_held(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """Pairs (doc_id, item_id) of documents (doc_id, text) and passages (item_id, text) that they hold, in any case.

    The words after a passage's first are whole words wherever it occurs: documents' runs of as many words meet them in
    an equi-join and the hits are verified. Passages of fewer than words + 2 words are looked for in every document, which
    is for a bounded number of them.
    """
    cut = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    p = passages.select("item_id", F.lower("text").alias("passage"), cut(F.col("text")).alias("w"))
    long = p.where(F.size("w") >= words + 2).select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, words), " ")).alias("k"))
    d = docs.select("doc_id", F.lower("text").alias("body")).withColumn("w", cut(F.col("body")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - words + 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    met = checkpointed(d.select("doc_id", F.explode(F.array_distinct(runs)).alias("k")).join(small(long), "k").select("doc_id", "item_id", "passage"))
    hits = d.select("doc_id", "body").join(small(met), "doc_id").where(F.contains("body", "passage")).select("doc_id", "item_id")
    short = small(p.where(F.size("w") < words + 2).select("item_id", "passage"), 10_000)
    return hits.unionByName(d.join(short, F.contains("body", "passage")).select("doc_id", "item_id")).distinct()
