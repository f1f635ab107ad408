"""Retrieval by probed clusters, recall and release of opened clusters, samples, and what is known of each node."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..operators import clusters as c
from ..operators import inverted, logs
from ..operators import metrics as m
from ..operators import retrieval as k
from ..operators import routing as r
from ..operators.quantiles import percentiles
from ..operators.running import rank_by_hash
from .analytics import A5, QUESTIONS, question_log, relevant, routed
from .retrieval import SCORED, scored, topics
from .routing import BASE, PLANES, centroids, count_bucket, grades, questions, read, vectors
from .tables import folder


def members(spark, sf):
    """Passages of each published cluster: source_id, cluster, doc_id, vec."""
    return vectors(spark, sf).select(F.col("shard").alias("source_id"), F.col("label").alias("cluster"), F.col("vec_id").alias("doc_id"), "vec")


def probes(spark, sf, n):
    """The n best clusters of all nodes for every topic."""
    plan = r.probe_plan(r.centroid_arrays(topics(spark, sf), centroids(spark, sf)), centroids(spark, sf).select("source_id").distinct(), n)
    return plan.where("kind = 'real'").select("query_id", "source_id", F.col("centroid_ix").alias("cluster"))


def opened(spark, sf, n=4):
    """Passages of the probed clusters with their cosine: query_id, source_id, cluster, doc_id, score."""
    pool = k.open_clusters(probes(spark, sf, n), members(spark, sf)).join(r.small(topics(spark, sf).withColumnRenamed("vec", "q")), "query_id")
    return pool.select("query_id", "source_id", "cluster", "doc_id", F.round(v.cosine(F.col("q"), F.col("vec")), 6).alias("score"))


OPENED = f"""{SCORED}, hits AS (SELECT a.query_id, c.source_id, c.centroid_ix AS cluster, round(list_cosine_similarity(a.q, c.vec), 6) AS s FROM asked a, centroids c),
probes AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_id, cluster) <= 4),
opened AS (SELECT p.query_id, p.source_id, p.cluster, f.doc_id, f.score FROM probes p JOIN embeddings e ON (e.vec_id % 12)::INT = p.source_id AND e.label = p.cluster JOIN found f ON f.query_id = p.query_id AND f.doc_id = e.vec_id)"""


def k14_blind_retrieve(spark, sf):
    """Four probed clusters a question, their passages ranked together, ten kept."""
    return k.top_n(opened(spark, sf), ["query_id"], 10).select("query_id", "source_id", "doc_id", "score", "rank")


K14 = f"WITH {OPENED} SELECT query_id, source_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM opened QUALIFY rank <= 10"


def k3_rerank_pools(spark, sf):
    """Three best passages of every node's opened pool."""
    return k.top_n(opened(spark, sf), ["query_id", "source_id"], 3).select("query_id", "source_id", "doc_id", "rank")


K3 = f"WITH {OPENED} SELECT query_id, source_id, doc_id, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, doc_id)::INT AS rank FROM opened QUALIFY rank <= 3"


def k15_private_retrieve(spark, sf):
    """Each node opens its two nearest clusters and one other by a hash, and returns its best passage of the wanted ones."""
    near = r.centroid_arrays(topics(spark, sf), centroids(spark, sf), product=True).select("query_id", F.explode("scored").alias("s"))
    order = F.array_sort(F.transform("s.scores", lambda x: F.struct((-x["score"]).alias("k"), x["centroid_ix"].alias("c"))))
    ranked = near.select("query_id", F.col("s.source_id").alias("source_id"), F.posexplode(order).alias("p", "x")).select("query_id", "source_id", "p", F.col("x.c").alias("cluster"))
    key = F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("source_id").cast("string"), F.col("cluster").cast("string")), 256)
    other = ranked.where("p >= 2").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy(key))).where("n = 1").select("query_id", "source_id", "cluster", F.lit(False).alias("wanted"))
    fetched = ranked.where("p < 2").select("query_id", "source_id", "cluster", F.lit(True).alias("wanted")).unionByName(other)
    pool = k.open_clusters(fetched, members(spark, sf)).join(r.small(topics(spark, sf).withColumnRenamed("vec", "q")), "query_id")
    pool = pool.select("query_id", "source_id", "wanted", "doc_id", F.round(v.cosine(F.col("q"), F.col("vec")), 6).alias("score"))
    best = k.top_n(pool.where("wanted"), ["query_id", "source_id"], 1).select("query_id", "source_id", "doc_id", "score")
    return best.join(pool.groupBy("query_id", "source_id").agg(F.count("*").alias("delivered")), ["query_id", "source_id"])


K15 = f"""WITH {SCORED}, d AS (SELECT a.query_id, c.source_id, c.centroid_ix AS cluster, row_number() OVER (PARTITION BY a.query_id, c.source_id ORDER BY round(list_inner_product([x / sqrt(list_inner_product(a.q, a.q)) FOR x IN a.q], c.vec), 6) DESC, c.centroid_ix) AS p FROM asked a, centroids c),
o AS (SELECT query_id, source_id, cluster, false AS wanted FROM d WHERE p > 2 QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY sha256(query_id || ':' || source_id || ':' || cluster)) = 1),
f AS (SELECT query_id, source_id, cluster, true AS wanted FROM d WHERE p <= 2 UNION ALL SELECT * FROM o), pool AS (SELECT f.query_id, f.source_id, wanted, s.doc_id, s.score FROM f JOIN embeddings e ON (e.vec_id % 12)::INT = f.source_id AND e.label = f.cluster JOIN found s ON s.query_id = f.query_id AND s.doc_id = e.vec_id)
SELECT b.query_id, b.source_id, b.doc_id, b.score, n.delivered FROM (SELECT * FROM pool WHERE wanted QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, doc_id) = 1) b JOIN (SELECT query_id, source_id, count(*) AS delivered FROM pool GROUP BY ALL) n USING (query_id, source_id)"""


def k8_cross_node_rerank(spark, sf):
    """Each node's five best by its own product score, all rescored by cosine in the shared space, six kept."""
    docs = members(spark, sf).crossJoin(r.small(topics(spark, sf).withColumnRenamed("vec", "q")))
    own = docs.select("query_id", "source_id", "doc_id", F.round(v.dot(F.col("q"), F.col("vec")), 6).alias("own"), F.round(v.cosine(F.col("q"), F.col("vec")), 6).alias("score"))
    cited = k.top_n(own, ["query_id", "source_id"], 5, [F.desc("own"), F.col("doc_id")]).drop("rank")
    return k.top_n(cited, ["query_id"], 6).select("query_id", "source_id", "doc_id", "score", "rank")


K8 = f"""WITH {SCORED}, own AS (SELECT f.*, round(list_inner_product(a.q, e.embedding::DOUBLE[]), 6) AS own FROM found f JOIN asked a USING (query_id) JOIN embeddings e ON e.vec_id = f.doc_id),
cited AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY own DESC, doc_id) <= 5) SELECT query_id, source_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM cited QUALIFY rank <= 6"""


def k2_server_cap(spark, sf):
    """What nodes return for requests of 0, 5 and 50 passages: from 1 to 20 each; gated ones refuse."""
    s = scored(spark, sf).where("source_id <> 7")
    parts = [k.top_n(s, ["query_id", "source_id"], k.clamped_top_n(n)).groupBy("source_id").agg(F.count("*").alias("returned")).withColumn("asked", F.lit(n)) for n in (0, 5, 50)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


K2 = f"WITH {SCORED}, r AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, doc_id) AS rank FROM found WHERE source_id <> 7) SELECT source_id, asked, count(*) AS returned FROM r, (VALUES (0, 1), (5, 5), (50, 20)) c(asked, cap) WHERE rank <= cap GROUP BY ALL"


def k10_inverted_lists(spark, sf):
    """Ten nearest by distance among the three nearest lists of a written index over label means."""
    docs = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vec")
    path = folder(spark, "lists")
    inverted.write_lists(docs, topics(spark, sf).select(F.col("query_id").alias("list_id"), "vec"), path)
    asked = v.mean_vectors(vectors(spark, sf), ["shard"]).withColumnRenamed("shard", "query_id")
    return inverted.search_lists(spark, path, asked, 3, 10)


def k10_trained_lists(spark, sf):
    """The same over lists that are trained on the vectors, as many as the root of their number; every fiftieth vector asks."""
    docs = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vec")
    path = folder(spark, "lists")
    inverted.write_lists(docs, inverted.train_lists(docs), path)
    return inverted.search_lists(spark, path, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 8, 10)


_SQUARE = "round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip({a}, {b})]), 9)"
K10 = f"""WITH {SCORED}, ix AS (SELECT e.vec_id AS doc_id, a.query_id AS list_id, e.embedding::DOUBLE[] AS vec FROM embeddings e, asked a QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {_SQUARE.format(a="e.embedding::DOUBLE[]", b="a.q")}, a.query_id) = 1),
m AS (SELECT shard AS query_id, list(x ORDER BY i) AS q FROM (SELECT shard, i, avg(x) AS x FROM elems GROUP BY shard, i) GROUP BY shard), p AS (SELECT m.query_id, m.q, a.query_id AS list_id FROM m, asked a QUALIFY row_number() OVER (PARTITION BY m.query_id ORDER BY {_SQUARE.format(a="m.q", b="a.q")}, a.query_id) <= 3),
f AS (SELECT p.query_id, ix.doc_id, {_SQUARE.format(a="p.q", b="ix.vec")} AS distance FROM p JOIN ix USING (list_id)) SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INT AS rank FROM f QUALIFY rank <= 10"""


def k13_corpus_selection(spark, sf):
    """Documents among the three best by Okapi score for any benchmark passage, and how many passages want each."""
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), t.tokens(F.col("text")).alias("terms"))
    return k.bm25_corpus(read(spark, sf, "documents").select("doc_id", "text"), q, 3).groupBy("doc_id").agg(F.count("*").alias("wanted"))


def k13_block_maxima(spark, sf):
    """The same from written postings: only blocks of documents whose largest weights can reach the third best are opened."""
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), t.tokens(F.col("text")).alias("terms"))
    path = folder(spark, "postings")
    inverted.write_postings(read(spark, sf, "documents").select("doc_id", "text"), path)
    return inverted.search_postings(spark, path, q, 3).groupBy("doc_id").agg(F.count("*").alias("wanted"))


_STOP = ", ".join(f"'{w}'" for w in t.LEXICAL_STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))"
K13 = f"""WITH w AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w), q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / coalesce(nullif(a, 0), 1))))::DOUBLE, 6) AS b FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id)
SELECT doc_id, count(*) AS wanted FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY b DESC, doc_id) <= 3) GROUP BY doc_id"""


def k17_seeded_sample(spark, sf):
    """Twenty documents of every language in the order of a seeded hash."""
    d = read(spark, sf, "documents").select("lang", "doc_id", F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return rank_by_hash(d, ["lang"], "h").where("place <= 20").select("lang", "doc_id", "place")


K17 = "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('11:' || doc_id)) AS place FROM documents QUALIFY place <= 20"


def k18_required_first(spark, sf):
    """A corpus of sixty documents a language: all that are labelled toxic, and fillers in the order of a seeded hash."""
    need = read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("required"))
    d = read(spark, sf, "documents").select("lang", "doc_id", F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256).alias("h")).join(need, "doc_id", "left").withColumn("required", F.coalesce("required", F.lit(False)))
    n = d.where("required").groupBy("lang").agg(F.count("*").alias("n"))
    filler = rank_by_hash(d.where("not required"), ["lang"], "h").join(r.small(n), "lang", "left").where(F.col("place") <= F.lit(60) - F.coalesce("n", F.lit(0)))
    return d.where("required").select("lang", "doc_id", "required").unionByName(filler.select("lang", "doc_id", "required"))


K18 = """WITH d AS (SELECT lang, doc_id, coalesce(toxic = 1, false) AS required FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT lang, count(*) AS n FROM d WHERE required GROUP BY lang),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id)) AS p FROM d WHERE NOT required) SELECT lang, doc_id, required FROM d WHERE required UNION ALL SELECT lang, doc_id, required FROM f LEFT JOIN n USING (lang) WHERE p <= 60 - coalesce(n, 0)"""


def j4_relevant_nodes(spark, sf):
    """Nodes that hold a relevant document of each question, and how many questions have none and are dropped."""
    qrels = read(spark, sf, "labels").where("quality = 1").join(read(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select(F.col("lang").alias("query_id"), "source")
    asked = read(spark, sf, "documents").select(F.col("lang").alias("query_id")).unionByName(read(spark, sf, "documents").select(F.concat(F.col("lang"), F.lit("-other")).alias("query_id"))).distinct()
    have = qrels.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("nodes"))
    return asked.join(have, "query_id", "left").select("query_id", F.coalesce("nodes", F.lit("")).alias("nodes"), F.col("nodes").isNull().alias("dropped"))


J4 = """WITH q AS (SELECT DISTINCT lang AS query_id FROM documents UNION SELECT DISTINCT lang || '-other' FROM documents), h AS (SELECT lang AS query_id, string_agg(DISTINCT source, ',' ORDER BY source) AS nodes FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY lang)
SELECT query_id, coalesce(nodes, '') AS nodes, nodes IS NULL AS dropped FROM q LEFT JOIN h USING (query_id)"""


def j6_chunked_envelopes(spark, sf):
    """Texts cut into 2,048-character chunks under tags, looked up by tag and put together again in order."""
    size = 2048
    d = read(spark, sf, "documents").select("doc_id", "text", F.greatest(F.lit(1), F.ceil(F.char_length("text") / size)).cast("int").alias("n"))
    tag = lambda i: F.sha2(F.concat_ws(":", F.lit("tag"), F.col("doc_id").cast("string"), i.cast("string")), 256)
    table = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(tag(F.col("i")).alias("tag"), F.col("text").substr(F.col("i") * size + 1, F.lit(size)).alias("chunk"))
    asked = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).withColumn("tag", tag(F.col("i")))  # one more than there is: the first miss
    back = asked.join(table, "tag").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk"))), lambda x: x["chunk"]), "").alias("text"))
    return back.select("doc_id", "chunks", F.md5("text").alias("digest"))


J6 = "SELECT doc_id, greatest(1, ceil(length(text) / 2048.0))::BIGINT AS chunks, md5(text) AS digest FROM documents"


def flips(bits, radius):
    """Masks of all codes within a Hamming radius."""
    return [sum(1 << i for i in some) for n in range(radius + 1) for some in combinations(range(bits), n)]


def bucket_hits(spark, sf, radius=1):
    """Documents that share a bucket with each topic within a few flipped bits: query_id, doc_id."""
    codes = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), v.simhash(F.col("vec"), PLANES).alias("code"))
    masks = F.array(*(F.lit(x).cast("long") for x in flips(len(PLANES), radius)))
    asked = topics(spark, sf).select("query_id", F.explode(F.transform(masks, lambda x: v.simhash(F.col("vec"), PLANES).bitwiseXOR(x))).alias("code"))
    return asked.join(codes, "code").select("query_id", "doc_id").distinct()


def j7_bucket_join(spark, sf):
    return bucket_hits(spark, sf).groupBy("query_id").agg(F.count("*").alias("envelopes"), F.lit(1 + len(PLANES)).alias("probes"))


_CODE = " + ".join(f"CASE WHEN list_inner_product({{e}}, {p}::DOUBLE[]) > 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(PLANES))
BUCKETS = f"dc AS (SELECT vec_id AS doc_id, ({_CODE.format(e='embedding::DOUBLE[]')})::BIGINT AS code FROM embeddings), qc AS (SELECT query_id, ({_CODE.format(e='q')})::BIGINT AS code FROM asked), bucket AS (SELECT query_id, doc_id FROM qc JOIN dc ON bit_count(xor(qc.code, dc.code)) <= 1)"
J7 = f"WITH {SCORED}, {BUCKETS} SELECT query_id, count(*) AS envelopes, {1 + len(PLANES)} AS probes FROM bucket GROUP BY query_id"


def v12_multi_probe(spark, sf):
    """Documents that each topic meets when its code's bits are flipped up to twice, and the probes that takes."""
    parts = [bucket_hits(spark, sf, n).groupBy("query_id").agg(F.count("*").alias("envelopes")).select(F.lit(n).alias("radius"), "query_id", "envelopes", F.lit(len(flips(len(PLANES), n))).alias("probes")) for n in (0, 2)]
    return parts[0].unionByName(parts[1])


V12 = f"WITH {SCORED}, dc AS (SELECT ({_CODE.format(e='embedding::DOUBLE[]')})::BIGINT AS code FROM embeddings), qc AS (SELECT query_id, ({_CODE.format(e='q')})::BIGINT AS code FROM asked) SELECT radius, query_id, count(*) AS envelopes, CASE radius WHEN 0 THEN 1 ELSE 37 END AS probes FROM qc CROSS JOIN (VALUES (0), (2)) v(radius) JOIN dc ON bit_count(xor(qc.code, dc.code)) <= radius GROUP BY radius, query_id"


def recall_row(name, delivered, truth, asked, probes_):
    """Any-hit recall, mean and 95th percentile of what is delivered, and probes, of one method."""
    hit = delivered.join(truth.withColumn("good", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.coalesce("good", F.lit(0))).alias("hit"))
    every = asked.join(hit, "query_id", "left").na.fill(0, ["n", "hit"])
    p95 = percentiles(every, [], "n", {"p95": 0.95}).select(F.round("p95", 6).alias("p95"))
    return every.agg(F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("n"), 6).alias("envelopes")).crossJoin(F.broadcast(p95)).select(F.lit(name).alias("method"), "recall", "envelopes", "p95", F.lit(probes_).alias("probes"))


def a12_recall(spark, sf):
    """Buckets, probed clusters and dense search compared: the relevant documents of a topic are its twelve with the smallest ids of its label."""
    asked = topics(spark, sf).select("query_id")
    truth = vectors(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 12").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    rows = [recall_row("bucket", bucket_hits(spark, sf), truth, asked, 1 + len(PLANES)), recall_row("cluster", opened(spark, sf).select("query_id", "doc_id"), truth, asked, 4), recall_row("dense", k.top_n(scored(spark, sf), ["query_id"], 10).select("query_id", "doc_id"), truth, asked, 0)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


A12 = f"""WITH {OPENED}, {BUCKETS}, truth AS (SELECT label AS query_id, vec_id AS doc_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 12),
got AS (SELECT 'bucket' AS method, 9 AS probes, query_id, doc_id FROM bucket UNION ALL SELECT 'cluster', 4, query_id, doc_id FROM opened UNION ALL SELECT 'dense', 0, query_id, doc_id FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10)),
per AS (SELECT m.method, m.probes, a.query_id, count(g.doc_id) AS n, coalesce(max((t.doc_id IS NOT NULL)::INT), 0) AS hit FROM (VALUES ('bucket', 9), ('cluster', 4), ('dense', 0)) m(method, probes) CROSS JOIN asked a LEFT JOIN got g ON g.method = m.method AND g.query_id = a.query_id LEFT JOIN truth t ON t.query_id = g.query_id AND t.doc_id = g.doc_id GROUP BY ALL)
SELECT method, round(avg(hit), 6) AS recall, round(avg(n), 6) AS envelopes, round(quantile_cont(n, 0.95), 6) AS p95, probes FROM per GROUP BY method, probes"""


def a13_release(spark, sf):
    """What opening clusters releases: records unlocked, against a prompt of three and a list of ten, and the share that is relevant."""
    pool = opened(spark, sf).join(vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    per = pool.groupBy("query_id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("query_id")).cast("int")).alias("p"))
    p95 = percentiles(per, [], "n", {"p95": 0.95}).select(F.round("p95", 6).alias("p95"))
    return per.agg(F.round(F.avg("n"), 6).alias("unlocked"), F.round(F.avg("n") / F.avg(F.least("n", F.lit(3))), 6).alias("ratio"), F.round(F.avg("n") - F.avg(F.least("n", F.lit(10))), 6).alias("excess"), F.round(F.avg("p"), 6).alias("precision")).crossJoin(F.broadcast(p95))


A13 = f"WITH {OPENED}, p AS (SELECT o.query_id, count(*) AS n, avg((label = o.query_id)::INT) AS p FROM opened o JOIN embeddings ON vec_id = doc_id GROUP BY o.query_id) SELECT round(avg(n), 6) AS unlocked, round(quantile_cont(n, 0.95), 6) AS p95, round(avg(n) / avg(least(n, 3)), 6) AS ratio, round(avg(n) - avg(least(n, 10)), 6) AS excess, round(avg(p), 6) AS precision FROM p"


def a6_graded_ndcg(spark, sf):
    """Graded nDCG at ten, 0 where no grade is above 0."""
    g = grades(spark, sf).withColumn("grade", F.when(F.col("grade") >= 0.12, F.col("grade")).otherwise(0.0)).withColumnRenamed("source_id", "item")
    return m.graded_metrics(routed(spark, sf), g, 10).select("query_id", F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"))


A6 = A5.replace("WHERE rank <= 5", "WHERE rank <= 10").replace("WHERE r <= 5", "WHERE r <= 10").replace("FROM embeddings JOIN share USING (label)", "FROM embeddings JOIN (SELECT source_id, label, CASE WHEN grade >= 0.12 THEN grade ELSE 0 END AS grade FROM share) USING (label)").rsplit("SELECT query_id, round(CASE WHEN idcg > 0", 1)[0] + "SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM got JOIN ideal USING (query_id)"


def a17_cluster_bootstrap(spark, sf):
    """Interval of the difference between two rankers, averaged within each cluster of questions first."""
    rel, label = relevant(spark, sf), vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.concat_ws(":", F.col("label"), F.pmod("vec_id", F.lit(5))).alias("cluster"))
    arrays = r.centroid_arrays(questions(spark, sf), centroids(spark, sf))
    one, two = (m.binary_metrics(r.ranked_sources(r.aggregate_arrays(arrays, how)).select("query_id", F.col("source_id").alias("item"), "rank"), rel, 5).select("query_id", F.col("ndcg").alias(n)) for how, n in (("max", "a"), ("mean", "b")))
    per = one.join(two, "query_id", "full").join(label, "query_id").groupBy(F.col("cluster").alias("unit")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return c.paired_bootstrap(per, 2_000)


def a27_contact_summary(spark, sf):
    """What left the device for each source: contacts, bytes, times, disclosed passages, probes and errors, from the log's maps."""
    return logs.privacy_summary(question_log(spark, sf)).withColumn("ms", F.round("ms", 6))


A27 = f"WITH {QUESTIONS} SELECT 'node_' || node AS node, count(*) AS contacts, round(avg(ms), 6) AS ms, sum(asked) AS request_bytes, sum(got) AS response_bytes, sum(disclosed)::BIGINT AS disclosed, sum(probes)::BIGINT AS probes, sum(err)::BIGINT AS errors FROM per GROUP BY node"


def a28_node_status(spark, sf):
    """Each source's trust and observations, coarse size, collections and public clusters."""
    e = read(spark, sf, "events").groupBy(F.pmod("user_id", F.lit(12)).cast("int").alias("source_id")).agg(F.round((1 + F.sum(F.col("value") / 100)) / (F.count("*") + 2) + 1e-9, 6).alias("trust"), F.count("*").alias("observations"))
    d = vectors(spark, sf).withColumn("collection", F.when(F.col("label") < 5, "public").otherwise("clinical")).groupBy(F.col("shard").alias("source_id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections"), F.countDistinct(F.when(F.col("label") < 5, F.col("label"))).alias("public_clusters"))
    return d.join(r.small(e), "source_id", "left").select("source_id", count_bucket(F.col("n")).alias("bucket"), "collections", "public_clusters", F.coalesce("trust", F.lit(0.5)).alias("trust"), F.coalesce("observations", F.lit(0)).alias("observations"))


A28 = """WITH e AS (SELECT (user_id % 12)::INT AS source_id, round((1 + sum(value / 100)) / (count(*) + 2) + 1e-9, 6) AS trust, count(*) AS observations FROM events GROUP BY 1),
d AS (SELECT (vec_id % 12)::INT AS source_id, count(*) AS n, string_agg(DISTINCT CASE WHEN label < 5 THEN 'public' ELSE 'clinical' END, ',' ORDER BY CASE WHEN label < 5 THEN 'public' ELSE 'clinical' END) AS collections, count(DISTINCT CASE WHEN label < 5 THEN label END) AS public_clusters FROM embeddings GROUP BY 1)
SELECT source_id, CASE WHEN n <= 100 THEN '1-100' WHEN n <= 1000 THEN '101-1000' WHEN n <= 10000 THEN '1001-10000' WHEN n <= 100000 THEN '10001-100000' ELSE '100000+' END AS bucket, collections, public_clusters, coalesce(trust, 0.5) AS trust, coalesce(observations, 0) AS observations FROM d LEFT JOIN e USING (source_id)"""


def a29_agreement(spark, sf):
    """Share of topics and sources whose best passage stays the same when the question is perturbed."""
    q, docs = topics(spark, sf), members(spark, sf).select("source_id", "doc_id", "vec")
    best = lambda asked, n: k.score_documents(asked, docs).groupBy("query_id", "source_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias(n)).select("query_id", "source_id", (-F.col(f"{n}.d")).alias(n))
    both = best(q, "a").join(best(v.perturb(q.withColumn("vec", v.normalise(F.col("vec"))), "vec", 0.1, 9, "query_id"), "b"), ["query_id", "source_id"])
    return both.groupBy("source_id").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("agreement"), F.count("*").alias("questions"))


def f3_public_only(spark, sf):
    """Five best of every source's public passages: the others never enter the ranking."""
    public = vectors(spark, sf).where("label < 5").select(F.col("vec_id").alias("doc_id"), F.col("shard").alias("source_id"), "vec")
    return k.top_n(k.score_documents(topics(spark, sf), public), ["query_id", "source_id"], 5)


F3 = f"WITH {SCORED} SELECT f.*, row_number() OVER (PARTITION BY f.query_id, f.source_id ORDER BY f.score DESC, f.doc_id)::INT AS rank FROM found f JOIN embeddings e ON e.vec_id = f.doc_id WHERE e.label < 5 QUALIFY rank <= 5"


def f5_restricted_centroids(spark, sf):
    """Restricted clusters that each role may see, in order of their ids; public ones are no part of it."""
    cl = centroids(spark, sf).select("source_id", F.col("centroid_ix").alias("id"), F.when(F.col("centroid_ix") < 5, "public").when(F.col("centroid_ix") < 8, "research").otherwise("clinical").alias("collection"))
    policy = spark.createDataFrame([("nurse", "clinical"), ("analyst", "research"), ("admin", "clinical"), ("admin", "research"), ("guest", "public")], "role string, collection string")
    seen = cl.where("collection <> 'public'").join(r.small(policy), "collection")
    return seen.groupBy("role", "source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


F5 = f"""WITH {BASE}, policy(role, collection) AS (VALUES ('nurse', 'clinical'), ('analyst', 'research'), ('admin', 'clinical'), ('admin', 'research'), ('guest', 'public')),
c AS (SELECT source_id, centroid_ix AS id, CASE WHEN centroid_ix < 5 THEN 'public' WHEN centroid_ix < 8 THEN 'research' ELSE 'clinical' END AS collection FROM centroids) SELECT role, source_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM c JOIN policy USING (collection) WHERE collection <> 'public' GROUP BY role, source_id"""


def f10_registrations(spark, sf):
    """Every registration accepted or rejected: a bad signature, another key than the first accepted one, a version that doesn't rise."""
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("version"), F.when(F.col("event_type") == "error", "other").otherwise("own").alias("key"), (F.col("value") <= 60).alias("signed"))
    first = e.where("signed").groupBy("user_id").agg(F.min_by("key", F.struct("ts", "event_id")).alias("held"))
    rows = e.join(first, "user_id", "left").withColumn("valid", F.col("signed") & (F.col("key") == F.col("held")))
    before = F.max(F.when(F.col("valid"), F.col("version"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(~F.col("signed"), "bad_signature").when(F.col("key") != F.col("held"), "key_change").when(F.col("version") <= before, "stale_version").otherwise("accepted")
    return rows.select("user_id", reason.alias("outcome")).groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


F10 = """WITH e AS (SELECT user_id, event_id, ts, json_extract_string(props, '$.k')::INT AS version, CASE WHEN event_type = 'error' THEN 'other' ELSE 'own' END AS key, value <= 60 AS signed FROM events), f AS (SELECT user_id, arg_min(key, struct_pack(t := ts, e := event_id)) AS held FROM e WHERE signed GROUP BY user_id),
r AS (SELECT e.*, held, max(CASE WHEN signed AND key = held THEN version END) OVER (PARTITION BY e.user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e LEFT JOIN f USING (user_id))
SELECT user_id, CASE WHEN NOT signed THEN 'bad_signature' WHEN key <> held THEN 'key_change' WHEN version <= b THEN 'stale_version' ELSE 'accepted' END AS outcome, count(*) AS n FROM r GROUP BY ALL"""


def s18_audit(spark, sf):
    """A question's decoys by its record: what was dispatched besides the genuine sources, in order and with repeats.

    The genuine ones are a session's three smallest, so a decoy is above the third. Each day is put in order apart and then
    only its ids are gathered. Missing times and ids come last.
    """
    e = read(spark, sf, "events").select(F.col("user_id").alias("session"), F.to_date("ts").alias("day"), F.struct(F.col("ts").isNull().alias("undated"), "ts", F.col("event_id").isNull().alias("unnamed"), "event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("int") % 12).alias("source_id"))
    third = e.groupBy(F.col("session").alias("of")).agg(F.collect_set("source_id").alias("kinds")).select("of", F.get(F.array_sort("kinds"), F.lit(2)).alias("third"))
    days = e.groupBy("session", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "source_id"))), lambda x: x["source_id"]).alias("dispatched"))
    decoys = F.transform(F.filter("dispatched", lambda x: x > F.col("third")), lambda x: x.cast("string"))
    parts = days.join(third, F.col("session").eqNullSafe(F.col("of"))).select("session", "day", F.array_join(decoys, ",").alias("part"))
    shown = F.sort_array(F.collect_list(F.when(F.col("part") != "", F.struct(F.col("day").isNull().alias("undated"), "day", "part"))))
    return parts.groupBy("session").agg(F.array_join(F.transform(shown, lambda x: x["part"]), ",").alias("decoys"))


S18 = "WITH l AS (SELECT user_id AS session, list((json_extract_string(props, '$.k')::INT % 12)::INT ORDER BY ts, event_id) AS d FROM events GROUP BY user_id), g AS (SELECT *, list_sort(list_distinct(d))[1:3] AS g FROM l) SELECT session, array_to_string([x FOR x IN d IF NOT list_contains(g, x)], ',') AS decoys FROM g"

QUERIES = {
    "k2_server_cap": (k2_server_cap, K2), "k3_rerank_pools": (k3_rerank_pools, K3), "k8_cross_node_rerank": (k8_cross_node_rerank, K8), "k10_inverted_lists": (k10_inverted_lists, K10), "k10_trained_lists": (k10_trained_lists, None), "k13_block_maxima": (k13_block_maxima, K13), "k13_corpus_selection": (k13_corpus_selection, K13), "k14_blind_retrieve": (k14_blind_retrieve, K14), "k15_private_retrieve": (k15_private_retrieve, K15),
    "k17_seeded_sample": (k17_seeded_sample, K17), "k18_required_first": (k18_required_first, K18), "j4_relevant_nodes": (j4_relevant_nodes, J4), "j6_chunked_envelopes": (j6_chunked_envelopes, J6), "j7_bucket_join": (j7_bucket_join, J7), "v12_multi_probe": (v12_multi_probe, V12), "a6_graded_ndcg": (a6_graded_ndcg, A6), "a12_recall": (a12_recall, A12),
    "a13_release": (a13_release, A13), "a17_cluster_bootstrap": (a17_cluster_bootstrap, None), "a27_contact_summary": (a27_contact_summary, A27), "a28_node_status": (a28_node_status, A28), "a29_agreement": (a29_agreement, None), "f3_public_only": (f3_public_only, F3), "f5_restricted_centroids": (f5_restricted_centroids, F5),
    "f10_registrations": (f10_registrations, F10), "s18_audit": (s18_audit, S18),
}
