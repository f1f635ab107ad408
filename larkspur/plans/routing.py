"""Routing queries over the vectors: shards of embeddings are the sources, every vector is a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import folds
from ..operators import routing as r
from ..sources.shared import checkpointed

SHARDS = 12


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.pmod("vec_id", F.lit(SHARDS)).cast("int").alias("shard"), v.widen(F.col("embedding")).alias("vec"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One centroid per shard and label: what sources publish, computed once and kept."""
    c = v.mean_vectors(vectors(spark, sf), ["shard", "label"])
    return checkpointed(c.select(F.col("shard").alias("source_id"), F.col("label").alias("centroid_ix"), "vec"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "vec")




BASE = f"""
elems AS (SELECT vec_id, label, (vec_id % {SHARDS})::INT AS shard, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centroids AS (
  SELECT shard AS source_id, label AS centroid_ix, list(x ORDER BY i) AS vec
  FROM (SELECT shard, label, i, avg(x) AS x FROM elems GROUP BY shard, label, i) GROUP BY shard, label
),
questions AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec FROM embeddings),
scored AS (
  SELECT q.query_id, c.source_id, c.centroid_ix,
    round(list_inner_product(q.vec, c.vec) / coalesce(nullif(sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(c.vec, c.vec)), 0), 1), 6) AS score
  FROM questions q, centroids c
),
best AS (SELECT query_id, source_id, max(score) AS score FROM scored GROUP BY query_id, source_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id)::INT AS rank FROM best)
"""


def with_base(sql: str) -> str:
    return f"WITH {BASE} {sql}"


def scored(spark, sf):
    """All scores of each question in its own row."""
    return r.centroid_arrays(questions(spark, sf), centroids(spark, sf))


def best(spark, sf):
    return r.aggregate_scores(scored(spark, sf))


def v1_cosine(spark, sf):
    """Cosine of each vector with its label's mean."""
    e = vectors(spark, sf)
    mean = v.mean_vectors(e, ["label"]).withColumnRenamed("vec", "mean")
    return e.join(r.small(mean), "label").select("vec_id", F.round(v.cosine(F.col("vec"), F.col("mean")), 6).alias("cosine"))


V1 = f"""WITH {BASE}, means AS (SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS x FROM elems GROUP BY label, i) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS cosine FROM embeddings JOIN means USING (label)"""


def v2_normalise(spark, sf):
    """Vectors at length 1, with every seventh zero and every eleventh tiny: zeros stay, tiny ones only grow without a least length."""
    scale = F.when(F.col("vec_id") % 7 == 0, 0.0).when(F.col("vec_id") % 11 == 0, 1e-13).otherwise(1.0)
    e = vectors(spark, sf).withColumn("vec", F.transform("vec", lambda x: x * scale))
    n = v.normalise(F.col("vec"))
    return e.select("vec_id", F.round(v.norm(n), 6).alias("norm"), F.round(n[0], 6).alias("first"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(v.norm(v.normalise(F.col("vec"), 1e-12)), 6).alias("guarded"))


V2 = """WITH s AS (SELECT vec_id, [x::DOUBLE * CASE WHEN vec_id % 7 = 0 THEN 0.0::DOUBLE WHEN vec_id % 11 = 0 THEN 1e-13::DOUBLE ELSE 1.0::DOUBLE END FOR x IN embedding] AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM s), u AS (SELECT vec_id, [x / CASE WHEN n = 0 THEN 1 ELSE n END FOR x IN e] AS u, [x / greatest(n, 1e-12) FOR x IN e] AS w FROM n)
SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(u[1], 6) + 0.0::DOUBLE AS first, round(list_sum(u), 6) + 0.0::DOUBLE AS total, round(sqrt(list_inner_product(w, w)), 6) AS guarded FROM u"""


def v4_mean_vector(spark, sf):
    return centroids(spark, sf).select("source_id", "centroid_ix", F.posexplode("vec").alias("pos", "x")).select("source_id", "centroid_ix", "pos", F.round("x", 6).alias("x"))


V4 = "SELECT shard AS source_id, label AS centroid_ix, (i - 1)::INT AS pos, round(avg(x), 6) AS x FROM elems GROUP BY shard, label, i"


def v9_quantise(spark, sf):
    s = v.quantise_scale(F.col("vec"))
    q = vectors(spark, sf).select("vec_id", "vec", s.alias("scale")).withColumn("q", v.quantise_int8(F.col("vec"), F.col("scale")))
    return q.select("vec_id", F.round("scale", 9).alias("scale"), F.aggregate("q", F.lit(0), lambda s, x: s + x).cast("long").alias("q_sum"), F.array_max("q").alias("q_max"), F.round(F.element_at("q", 1) * F.col("scale"), 8).alias("back"))


V9 = """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, greatest(list_max([abs(x) FOR x IN embedding::DOUBLE[]]), 1e-12) / 127.0 AS scale FROM embeddings),
q AS (SELECT *, [round_even(x / scale, 0)::INT FOR x IN e] AS q FROM s)
SELECT vec_id, round(scale, 9) AS scale, list_sum(q)::BIGINT AS q_sum, list_max(q) AS q_max, round(q[1] * scale, 8) AS back FROM q"""


def v10_fixed_point(spark, sf):
    f = v.fixed_point(F.col("vec"))
    return vectors(spark, sf).select("vec_id", F.element_at(f, 1).alias("first"), F.element_at(f, -1).alias("last"))


V10 = """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, round_even(e[1] / CASE WHEN n = 0 THEN 1 ELSE n END * 1000000.0, 0)::BIGINT AS first, round_even(e[-1] / CASE WHEN n = 0 THEN 1 ELSE n END * 1000000.0, 0)::BIGINT AS last FROM n"""

#: Fixed planes of the hash query: the sign pattern of small integers.
PLANES = [[float(((i * (k + 3)) % 7) - 3) for i in range(64)] for k in range(8)]


def v11_simhash(spark, sf):
    """Vectors per code of one table, and how many codes within Hamming distance 1 of it are in use."""
    codes = vectors(spark, sf).select(v.simhash(F.col("vec"), PLANES).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    flips = F.array(*(F.lit(1 << k).cast("long") for k in range(len(PLANES))))
    near = codes.select("code", F.explode(F.transform(flips, lambda m: F.col("code").bitwiseXOR(m))).alias("other"))
    hits = near.join(codes.select(F.col("code").alias("other"), F.col("n").alias("m")), "other").groupBy("code").agg(F.sum("m").alias("probed"))
    return codes.join(hits, "code", "left").select("code", "n", F.coalesce("probed", F.lit(0)).cast("long").alias("probed"))


V11 = """WITH codes AS (SELECT code, count(*) AS n FROM (SELECT (%s)::BIGINT AS code FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings)) GROUP BY code)
SELECT c.code, c.n, coalesce(sum(o.n), 0)::BIGINT AS probed FROM codes c LEFT JOIN codes o ON bit_count(xor(c.code, o.code)) = 1 GROUP BY c.code, c.n""" % " + ".join(
    f"CASE WHEN list_inner_product(e, {p}::DOUBLE[]) > 0 THEN {1 << k} ELSE 0 END" for k, p in enumerate(PLANES)
)


def v13_specificity(spark, sf):
    """1 less the normalised entropy of a question's shifted scores over the sources, within its row."""
    s = r.aggregate_arrays(scored(spark, sf)).select("query_id", F.transform("sources", lambda x: x["score"]).alias("s"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    x = s.select("query_id", F.transform("s", lambda y: y - F.array_min("s") + 1e-6).alias("x"))
    p = x.select("query_id", F.size("x").alias("n"), F.transform("x", lambda y: y / total(F.col("x"))).alias("p"))
    h = total(F.transform("p", lambda y: y * F.log(y)))
    return p.select("query_id", F.round(F.when(F.col("n") <= 1, 0.0).otherwise(1 + h / F.log("n")), 6).alias("specificity"))


V13 = with_base(""", x AS (SELECT query_id, score - min(score) OVER (PARTITION BY query_id) + 1e-6 AS x FROM best),
p AS (SELECT query_id, x / sum(x) OVER (PARTITION BY query_id) AS p FROM x)
SELECT query_id, round(CASE WHEN count(*) <= 1 THEN 0 ELSE 1 + sum(p * ln(p)) / ln(count(*)) END, 6) AS specificity FROM p GROUP BY query_id""")


def v14_irrelevance(spark, sf):
    s = r.aggregate_arrays(scored(spark, sf)).withColumn("s", F.transform("sources", lambda x: x["score"])).withColumns({"low": F.array_min("s"), "high": F.array_max("s")})
    each = s.select("query_id", "low", "high", F.explode("sources").alias("x"))
    span = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    return each.select("query_id", "x.source_id", F.round(1 - (F.col("x.score") - F.col("low")) / span, 6).alias("irrelevance"))


V14 = with_base("""SELECT query_id, source_id, round(1 - (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1), 6) AS irrelevance FROM best WINDOW w AS (PARTITION BY query_id)""")


def r1_aggregate_scores(spark, sf):
    s = scored(spark, sf)
    parts = [r.aggregate_scores(s, m).select("query_id", "source_id", F.lit(m).alias("method"), "score") for m in ("max", "mean", "top_r_mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


R1 = with_base("""SELECT query_id, source_id, 'max' AS method, score FROM best
UNION ALL SELECT query_id, source_id, 'mean', round(avg(score), 8) FROM scored GROUP BY query_id, source_id
UNION ALL SELECT query_id, source_id, 'top_r_mean', round(avg(score), 8) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC) AS n FROM scored) WHERE n <= 3 GROUP BY query_id, source_id""")


def r2_cosine_router(spark, sf):
    """The flagship: sources by their best centroid for every question, three each."""
    return r.cosine_router(questions(spark, sf), centroids(spark, sf), "max", 3).select("query_id", "source_id", "score", "rank")


R2 = with_base("SELECT query_id, source_id, score, rank FROM ranked WHERE rank <= 3")


def r2_top_k_zero(spark, sf):
    return r.cosine_router(questions(spark, sf), centroids(spark, sf), "max", 0).groupBy("source_id", "rank").agg(F.count("*").alias("n"))


R2_ALL = with_base("SELECT source_id, rank, count(*) AS n FROM ranked GROUP BY source_id, rank")


def shard_table(spark, sf):
    return centroids(spark, sf).select("source_id").distinct()


def r3_random_router(spark, sf):
    return r.random_router(questions(spark, sf), shard_table(spark, sf), "seed", 2)


R3 = with_base("""SELECT query_id, source_id, rank FROM (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256('seed:' || query_id || ':' || source_id))::INT AS rank
FROM questions, (SELECT DISTINCT source_id FROM centroids)) WHERE rank <= 2""")


def r4_broadcast_router(spark, sf):
    return r.broadcast_router(questions(spark, sf), shard_table(spark, sf))


R4 = with_base("SELECT query_id, source_id FROM questions, (SELECT DISTINCT source_id FROM centroids)")


def grades(spark, sf):
    """Share of a shard's vectors with the question's label."""
    e = vectors(spark, sf)
    share = e.groupBy("shard", "label").agg(F.count("*").alias("n")).withColumn("grade", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("shard")), 6))
    return e.select(F.col("vec_id").alias("query_id"), "label").join(r.small(share.select(F.col("shard").alias("source_id"), "label", "grade")), "label").select("query_id", "source_id", "grade")


GRADES = """share AS (SELECT source_id, label, round(n / sum(n) OVER (PARTITION BY source_id), 6) AS grade FROM (SELECT (vec_id % 12)::INT AS source_id, label, count(*) AS n FROM embeddings GROUP BY ALL)),
grades AS (SELECT vec_id AS query_id, source_id, grade FROM embeddings JOIN share USING (label))"""


def r5_oracle_router(spark, sf):
    return r.oracle_router(questions(spark, sf), grades(spark, sf), shard_table(spark, sf), 3).select("query_id", "source_id", "score", "rank")


R5 = f"WITH {GRADES} SELECT query_id, source_id, grade AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, source_id)::INT AS rank FROM grades) WHERE rank <= 3"


def evidence(spark, sf):
    """Trust, observations and cost of each source, from the event stream."""
    e = read(spark, sf, "events")
    return e.groupBy(F.pmod("user_id", F.lit(SHARDS)).cast("int").alias("source_id")).agg(F.round(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)) * 2, 6).alias("trust"), F.count("*").alias("observations"))


EVIDENCE = "evidence AS (SELECT (user_id % 12)::INT AS source_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) * 2, 6) AS trust, count(*) AS observations FROM events GROUP BY 1)"


def r11_topic_stable_sample(spark, sf):
    pool = r.broadcast_router(questions(spark, sf), shard_table(spark, sf)).join(vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return r.topic_stable_sample(pool, F.col("label"), 3, ["query_id"]).select("query_id", "source_id", "rank")


R11 = with_base("""SELECT query_id, source_id, rank FROM (SELECT q.vec_id AS query_id, s.source_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY sha256(q.label || ':' || s.source_id))::INT AS rank
FROM embeddings q, (SELECT DISTINCT source_id FROM centroids) s) WHERE rank <= 3""")


def supplier_cells(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("grp"))
    return r.build_cells(s, 7)


CELLS = """dealt AS (SELECT s_suppkey AS source_id, s_nationkey AS grp, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier),
placed AS (SELECT *, row_number() OVER (ORDER BY turn, grp) - 1 AS place, count(*) OVER () AS total FROM dealt),
cells AS (SELECT source_id, grp, least(place // 7, greatest(total // 7 - 1, 0))::INT AS cell FROM placed)"""


def r15_cell_cover(spark, sf):
    """Per region, whole cells in the order of its suppliers by balance while at most 20 members fit; others are skipped."""
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    c = supplier_cells(spark, sf)
    size = c.groupBy("cell").agg(F.count("*").alias("size"))
    wanted = s.join(c, F.col("s_suppkey") == c["source_id"]).groupBy("n_regionkey", "cell").agg(F.max(F.struct("s_acctbal", (-F.col("s_suppkey")).alias("k"))).alias("first")).join(size, "cell")
    item = F.struct((-F.col("first.s_acctbal")).alias("o"), (-F.col("first.k")).alias("k"), F.col("cell").cast("string").alias("id"), F.col("size").cast("decimal(18,6)").alias("cost"), F.lit(False).alias("protected"))
    out = wanted.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(item)).alias("items")).select("n_regionkey", r.skip_greedy(F.col("items"), F.lit(20)).alias("s"))
    return out.select(F.col("n_regionkey").alias("region"), F.array_join("s.kept", ",").alias("cells"), F.col("s.spent").cast("long").alias("members"))


R15 = f"""WITH RECURSIVE {CELLS}, size AS (SELECT cell, count(*) AS size FROM cells GROUP BY cell),
first AS (SELECT n_regionkey, cell, s_acctbal, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN cells ON source_id = s_suppkey
  QUALIFY row_number() OVER (PARTITION BY n_regionkey, cell ORDER BY s_acctbal DESC, s_suppkey) = 1),
items AS (SELECT n_regionkey, cell, size, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM first JOIN size USING (cell)),
fold AS (SELECT DISTINCT n_regionkey, 0::BIGINT AS k, 0::BIGINT AS spent, ''::VARCHAR AS cells FROM items
  UNION ALL SELECT f.n_regionkey, i.k, CASE WHEN spent + size <= 20 THEN spent + size ELSE spent END,
    CASE WHEN spent + size <= 20 THEN f.cells || CASE WHEN f.cells = '' THEN '' ELSE ',' END || i.cell ELSE f.cells END
  FROM fold f JOIN items i ON i.n_regionkey = f.n_regionkey AND i.k = f.k + 1)
SELECT n_regionkey AS region, cells, spent AS members FROM fold QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY k DESC) = 1"""


def r18_constraints(spark, sf):
    """Suppliers of each nation by weighted score under hard constraints, three each."""
    w = {"relevance": 1.0, "trust": 0.5, "authorized": 0.2, "exposure": 0.3, "communication": 0.1, "latency": 0.1, "hijack": 0.4}
    s = read(spark, sf, "supplier")
    f = s.select(
        F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("source_id"), (F.pmod("s_suppkey", F.lit(97)) / 97.0).alias("relevance"), ((F.col("s_acctbal") + 1000) / 12000.0).alias("trust"),
        F.when(F.pmod("s_suppkey", F.lit(5)) == 0, 0.0).otherwise(1.0).alias("authorized"), (F.pmod("s_suppkey", F.lit(7)) / 7.0).alias("exposure"), (F.pmod("s_suppkey", F.lit(11)) / 11.0).alias("communication"),
        (F.pmod("s_suppkey", F.lit(13)) / 13.0).alias("latency"), (F.pmod("s_suppkey", F.lit(3)) / 3.0).alias("hijack"),
    )
    ok = f.where("authorized = 1 and trust >= 0.25").withColumn("score", F.round(r.candidate_score(w), 6))
    return r.rank(ok, 3).select("query_id", "source_id", "score", "rank")


R18 = """WITH f AS (SELECT s_nationkey AS query_id, s_suppkey AS source_id, (s_acctbal + 1000) / 12000.0 AS trust, s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0 AND (s_acctbal + 1000) / 12000.0 >= 0.25),
s AS (SELECT query_id, source_id, round((k % 97) / 97.0::DOUBLE + trust * 0.5::DOUBLE + 0.2 - ((k % 7) / 7.0::DOUBLE * 0.3 + (k % 11) / 11.0::DOUBLE * 0.1 + (k % 13) / 13.0::DOUBLE * 0.1 + (k % 3) / 3.0::DOUBLE * 0.4), 6) AS score FROM f)
SELECT query_id, source_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id)::INT AS rank FROM s) WHERE rank <= 3"""


def r21_exposure_budget(spark, sf):
    """Per customer, orders kept in order of date within a budget; urgent ones are protected and charged."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") / 1000, 2).alias("cost"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    g = folds.granted(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("cost"), 900, F.col("urgent"))
    return g.groupBy("o_custkey").agg(F.sum(F.col("granted").cast("int")).cast("int").alias("kept"), F.count("*").cast("int").alias("asked"), F.round(F.sum(F.when(F.col("granted"), F.col("cost").cast("decimal(18,6)")).otherwise(0)).cast("double"), 2).alias("spent"))


R21 = """WITH RECURSIVE items AS (SELECT o_custkey, round(o_totalprice / 1000, 2)::DECIMAL(18,6) AS cost, o_orderpriority LIKE '1%' AS protected, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
fold AS (SELECT DISTINCT o_custkey, 0::BIGINT AS k, 0::DECIMAL(18,6) AS spent, 0 AS kept FROM items
  UNION ALL SELECT f.o_custkey, i.k, (CASE WHEN protected OR spent + cost <= 900 THEN spent + cost ELSE spent END)::DECIMAL(18,6), CASE WHEN protected OR spent + cost <= 900 THEN kept + 1 ELSE kept END
  FROM fold f JOIN items i ON i.o_custkey = f.o_custkey AND i.k = f.k + 1)
SELECT o_custkey, kept, k::INT AS asked, round(spent::DOUBLE, 2) AS spent FROM fold QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC) = 1"""


def r22_topic_key(spark, sf):
    """The best centroid of every question as its topic."""
    return scored(spark, sf).select("query_id", topic_key(F.col("scored")).alias("topic"))


def topic_key(scores):
    each = F.flatten(F.transform(scores, lambda s: F.transform(s["scores"], lambda c: F.struct((-c["score"]).alias("k"), s["source_id"].alias("s"), c["centroid_ix"].alias("c")))))
    return F.when(F.size(each) > 0, F.concat_ws(":", F.array_min(each)["s"].cast("string"), F.array_min(each)["c"].cast("string"))).otherwise("no-sources")


R22 = with_base("SELECT query_id, source_id || ':' || centroid_ix AS topic FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, centroid_ix) = 1")


def r23_assign_clusters(spark, sf):
    """The two clusters of each source that a question probes, by product with its unit vector."""
    s = r.centroid_arrays(questions(spark, sf), centroids(spark, sf), product=True).select("query_id", F.explode("scored").alias("s"))
    order = F.array_sort(F.transform("s.scores", lambda c: F.struct((-c["score"]).alias("k"), c["centroid_ix"].alias("centroid_ix"))))
    each = s.select("query_id", F.col("s.source_id").alias("source_id"), F.posexplode(F.slice(order, 1, 2)).alias("p", "c"))
    return each.select("query_id", "source_id", "c.centroid_ix", (-F.col("c.k")).alias("score"), (F.col("p") + 1).alias("rank"))


R23 = with_base(""", s AS (SELECT q.query_id, c.source_id, c.centroid_ix, round(list_inner_product([x / sqrt(list_inner_product(q.vec, q.vec)) FOR x IN q.vec], c.vec), 6) AS score FROM questions q, centroids c)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, centroid_ix)::INT AS rank FROM s) WHERE rank <= 2""")


def r24_probe_plan(spark, sf):
    return r.probe_plan(scored(spark, sf), shard_table(spark, sf), 4).select("query_id", "source_id", "slot", "kind", "centroid_ix")


R24 = with_base(""", top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, centroid_ix) AS r FROM scored QUALIFY r <= 4),
real AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id, source_id ORDER BY r) AS slot, centroid_ix FROM top),
slots AS (SELECT query_id, source_id, slot FROM questions, (SELECT DISTINCT source_id FROM centroids), range(1, 5) t(slot))
SELECT s.query_id, s.source_id, s.slot::INT AS slot, CASE WHEN r.centroid_ix IS NULL THEN 'dummy' ELSE 'real' END AS kind, r.centroid_ix FROM slots s LEFT JOIN real r USING (query_id, source_id, slot)""")


def t_access(spark, sf):
    """Collections that each role may read: public, and what the policy gives it of what a source has."""
    d = read(spark, sf, "documents").select("source", F.element_at(F.array(F.lit("public"), F.lit("research"), F.lit("clinical")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("collection"))
    policy = spark.createDataFrame([("nurse", "clinical"), ("analyst", "research"), ("admin", "clinical"), ("admin", "research"), ("guest", "none")], "role string, collection string")
    have = d.groupBy("source", "collection").agg(F.count("*").alias("n"))
    allowed = policy.unionByName(policy.select("role", F.lit("public").alias("collection")).distinct())
    return have.join(F.broadcast(allowed), "collection").groupBy("source", "role").agg(F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("permitted"), F.sum("n").alias("readable"))


ACCESS = """WITH d AS (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'research' ELSE 'clinical' END AS collection FROM documents),
policy(role, collection) AS (VALUES ('nurse', 'clinical'), ('analyst', 'research'), ('admin', 'clinical'), ('admin', 'research'), ('guest', 'none')),
allowed AS (SELECT * FROM policy UNION SELECT role, 'public' FROM policy)
SELECT source, role, string_agg(DISTINCT collection, ',' ORDER BY collection) AS permitted, count(*) AS readable FROM d JOIN allowed USING (collection) GROUP BY source, role"""


def f7_exclusion_reasons(spark, sf):
    """Sources that a question may not use, and why; the budget's and the cells' reasons are in r10 and r9."""
    known = evidence(spark, sf).withColumn("authorized", F.pmod("source_id", F.lit(4)) != 3)
    mean = v.mean_vectors(vectors(spark, sf), ["shard"]).withColumnRenamed("shard", "source_id")
    s = F.col("source_id")
    rows = mean.join(known, "source_id", "left").select("source_id", "authorized", "trust", F.when(s == 8, F.slice("vec", 1, 5)).otherwise(F.col("vec")).alias("vec"), F.when(s == 1, None).when(s == 2, F.slice("vec", 1, 3)).otherwise(F.col("vec")).alias("described"), F.when(s == 4, "other").otherwise("m").alias("described_by"))
    return r.gate(rows, 0.35, 64, "m").select("source_id", "reason")


F7 = f"""WITH {EVIDENCE} SELECT s.source_id, CASE WHEN s.source_id % 4 = 3 OR e.source_id IS NULL THEN 'unauthorized_or_missing_evidence' WHEN e.trust < 0.35 THEN 'insufficient_trust' WHEN s.source_id = 8 THEN 'invalid_profile' WHEN s.source_id IN (1, 4) THEN 'missing_or_incompatible_description' WHEN s.source_id = 2 THEN 'invalid_description_embedding' END AS reason
FROM (SELECT DISTINCT (vec_id % 12)::INT AS source_id FROM embeddings) s LEFT JOIN evidence e USING (source_id)"""


def f11_plausibility(spark, sf):
    """Cosine of each source's mean with the mean of all others' unit means."""
    mean = v.mean_vectors(vectors(spark, sf), ["shard"]).select("shard", v.normalise(F.col("vec")).alias("u"))
    parts = mean.select("shard", F.posexplode("u").alias("pos", "x"))
    total = parts.groupBy("pos").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    rest = parts.join(r.small(total), "pos").withColumn("o", (F.col("t") - F.col("x")) / (F.col("n") - 1))
    out = rest.groupBy("shard").agg((F.sum(F.col("x") * F.col("o")) / F.sqrt(F.sum(F.col("o") * F.col("o")))).alias("c"), F.max("n").alias("n"))
    return out.select(F.col("shard").alias("source_id"), F.round("c", 6).alias("plausibility"), ((F.col("n") > 3) & (F.round("c", 6) >= 0.95)).alias("rejected"))


F11 = f"""WITH {BASE}, m AS (SELECT shard, i, avg(x) AS x FROM elems GROUP BY shard, i), n AS (SELECT shard, sqrt(sum(x * x)) AS n FROM m GROUP BY shard),
u AS (SELECT m.shard, i, x / n AS x FROM m JOIN n USING (shard)), o AS (SELECT shard, x, (sum(x) OVER (PARTITION BY i) - x) / (count(*) OVER (PARTITION BY i) - 1) AS o, count(*) OVER (PARTITION BY i) AS k FROM u)
SELECT shard AS source_id, round(sum(x * o) / sqrt(sum(o * o)), 6) AS plausibility, max(k) > 3 AND round(sum(x * o) / sqrt(sum(o * o)), 6) >= 0.95 AS rejected FROM o GROUP BY shard"""


def count_bucket(n):
    """Coarse document counts: exact ones give a source away."""
    return F.when(n <= 0, "0").when(n <= 100, "1-100").when(n <= 1000, "101-1000").when(n <= 10000, "1001-10000").when(n <= 100000, "10001-100000").otherwise("100000+")


def f12_count_bucket(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", count_bucket(F.col("n")).alias("bucket"))


F12 = "SELECT source, CASE WHEN n = 0 THEN '0' WHEN n <= 100 THEN '1-100' WHEN n <= 1000 THEN '101-1000' WHEN n <= 10000 THEN '1001-10000' WHEN n <= 100000 THEN '10001-100000' ELSE '100000+' END AS bucket FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"


def f13_penalised(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.avg(F.col("value") / 100).alias("m"), F.count("*").alias("n"))
    return e.select("user_id", F.round(r.penalised_trust(F.col("m"), F.col("n"), 50), 6).alias("trust"))


F13 = "SELECT user_id, round(CASE WHEN n >= 50 THEN m ELSE n / 50.0 * m + (1 - n / 50.0) * 0.5 END, 6) AS trust FROM (SELECT user_id, avg(value / 100) AS m, count(*)::DOUBLE AS n FROM events GROUP BY user_id)"

QUERIES = {
    "r2_cosine_router": (r2_cosine_router, R2), "v1_cosine": (v1_cosine, V1), "v2_normalise": (v2_normalise, V2), "v4_mean_vector": (v4_mean_vector, with_base(V4)), "v9_quantise": (v9_quantise, V9),
    "v10_fixed_point": (v10_fixed_point, V10), "v11_simhash": (v11_simhash, V11), "v13_specificity": (v13_specificity, V13), "v14_irrelevance": (v14_irrelevance, V14),
    "r1_aggregate_scores": (r1_aggregate_scores, R1), "r2_top_k_zero": (r2_top_k_zero, R2_ALL), "r3_random_router": (r3_random_router, R3), "r4_broadcast_router": (r4_broadcast_router, R4),
    "r5_oracle_router": (r5_oracle_router, R5), "r11_topic_stable_sample": (r11_topic_stable_sample, R11),
    "r14_build_cells": (supplier_cells, f"WITH {CELLS} SELECT source_id, grp, cell FROM cells"), "r15_cell_cover": (r15_cell_cover, R15), "r18_constraints": (r18_constraints, R18),
    "r21_exposure_budget": (r21_exposure_budget, R21), "r22_topic_key": (r22_topic_key, R22), "r23_assign_clusters": (r23_assign_clusters, R23), "r24_probe_plan": (r24_probe_plan, R24),
    "f2_permitted_collections": (t_access, ACCESS), "f7_exclusion_reasons": (f7_exclusion_reasons, F7), "f11_plausibility": (f11_plausibility, F11), "f12_count_bucket": (f12_count_bucket, F12), "f13_penalised_trust": (f13_penalised, F13),
}
