"""Selection queries: greedy and budgeted dispatch, cells, policies, metadata ranking, learned and forged profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import learned
from ..operators import routing as r
from ..sources.shared import checkpointed
from .routing import BASE, EVIDENCE, centroids, evidence, questions, read, scored, shard_table, vectors, with_base


def known(spark, sf):
    """Trust, observations and cost of every shard, with the defaults of those that the log doesn't name."""
    k = shard_table(spark, sf).join(evidence(spark, sf), "source_id", "left")
    return k.select("source_id", F.coalesce("trust", F.lit(0.5)).alias("trust"), F.coalesce("observations", F.lit(0)).alias("observations"), (1.0 + F.pmod("source_id", F.lit(3)) / 2.0).alias("cost"))


KNOWN = f"""{EVIDENCE}, known AS (SELECT source_id, coalesce(trust, 0.5) AS trust, coalesce(observations, 0) AS observations, 1.0::DOUBLE + (source_id % 3) / 2.0::DOUBLE AS cost
FROM (SELECT DISTINCT source_id FROM centroids) LEFT JOIN evidence USING (source_id))"""


def as_array(sources, *columns):
    """A table of sources as one row with one array, to meet every question in its row."""
    return sources.agg(F.array_sort(F.collect_list(F.struct("source_id", *columns))).alias("known"))


def with_known(rows, facts, *columns):
    """rows with sources: array<struct<source_id, score>> widened by what is known of each source.

    What is broadcast has one element per source, as each row's own array has.
    """

    def fact(x):
        return r.let(F.get(F.filter("known", lambda k: k["source_id"] == x["source_id"]), F.lit(0)), lambda k: F.struct(x["source_id"].alias("source_id"), x["score"].alias("score"), *(k[c].alias(c) for c in columns)))

    return rows.crossJoin(F.broadcast(as_array(facts, *columns))).withColumn("sources", F.transform("sources", fact)).drop("known")


def pools(spark, sf):
    """Questions with topic and their scored sources."""
    labels = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    return r.aggregate_arrays(scored(spark, sf)).join(labels, "query_id")


def sent_rows(sent):
    return sent.select("query_id", F.explode("sent").alias("x")).select("query_id", F.col("x.source_id").cast("int").alias("source_id"), "x.role")


def r8_dispatch(spark, sf):
    """Trust gate, six candidates, sorted again by trust, two genuine and topic-stable decoys up to four; unit costs."""
    p = with_known(pools(spark, sf), known(spark, sf).withColumn("cost", F.lit(1.0)), "trust", "cost")
    return sent_rows(r.select_dispatch(p, 6, 2, 4, 4.0, minimum_trust=0.2, trust_weight=0.3))


R8 = f"""WITH {BASE}, {KNOWN},
pool AS (SELECT b.*, trust FROM best b JOIN known USING (source_id) WHERE trust >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) <= 6),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.3 * (trust - 0.5), 9) DESC) AS k FROM (SELECT * FROM pool ORDER BY query_id, score DESC, source_id)),
rest AS (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY sha256(e.label || ':' || source_id)) AS d FROM placed p JOIN embeddings e ON vec_id = query_id WHERE k > 2)
SELECT query_id, source_id, 'genuine' AS role FROM placed WHERE k <= 2 UNION ALL SELECT query_id, source_id, 'decoy' FROM rest WHERE d <= 2"""


def _lists(sent):
    named = lambda role: F.array_join(F.array_sort(F.transform(F.filter("sent", lambda x: x["role"] == role), lambda x: x["source_id"].cast("int"))), ",")
    out = F.array_join(F.array_sort(F.transform("excluded", lambda x: F.concat_ws(":", x["source_id"], x["reason"]))), ",")
    return sent.select("query_id", named("genuine").alias("genuine"), named("decoy").alias("decoys"), out.alias("excluded"), F.col("spent").cast("double").alias("spent"), "stop_reason")


def r10_stop_reasons(spark, sf):
    """Dispatch with unequal costs: what fits, what is turned away and why it ended."""
    p = with_known(pools(spark, sf), known(spark, sf), "trust", "cost")
    return _lists(r.select_dispatch(p, 7, 2, 4, 5.0, minimum_trust=0.38))


R10 = f"""WITH RECURSIVE {BASE}, {KNOWN},
pool AS (SELECT b.query_id, source_id, cost, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS k FROM best b JOIN known USING (source_id) WHERE trust >= 0.38 QUALIFY k <= 7),
one AS (SELECT query_id, 0::BIGINT AS k, NULL::INT AS source_id, 0.0::DOUBLE AS spent, 0 AS g, ''::VARCHAR AS act FROM (SELECT DISTINCT query_id FROM best)
  UNION ALL SELECT o.query_id, p.k, p.source_id, CASE WHEN g < 2 AND spent + cost <= 5 THEN spent + cost ELSE spent END, CASE WHEN g < 2 AND spent + cost <= 5 THEN g + 1 ELSE g END, CASE WHEN g >= 2 THEN 'left' WHEN spent + cost <= 5 THEN 'genuine' ELSE 'out' END
  FROM one o JOIN pool p ON p.query_id = o.query_id AND p.k = o.k + 1),
rest AS (SELECT o.query_id, o.source_id, cost, row_number() OVER (PARTITION BY o.query_id ORDER BY sha256(label || ':' || o.source_id)) AS k FROM one o JOIN known USING (source_id) JOIN embeddings ON vec_id = o.query_id WHERE act = 'left'),
two AS (SELECT query_id, 0::BIGINT AS k, NULL::INT AS source_id, max(spent) AS spent, max(g) AS n, ''::VARCHAR AS act FROM one GROUP BY query_id
  UNION ALL SELECT t.query_id, x.k, x.source_id, CASE WHEN n < 4 AND spent + cost <= 5 THEN spent + cost ELSE spent END, CASE WHEN n < 4 AND spent + cost <= 5 THEN n + 1 ELSE n END, CASE WHEN n >= 4 THEN 'left' WHEN spent + cost <= 5 THEN 'decoy' ELSE 'out' END
  FROM two t JOIN rest x ON x.query_id = t.query_id AND x.k = t.k + 1),
acts AS (SELECT query_id, source_id, act FROM one WHERE k > 0 UNION ALL SELECT query_id, source_id, act FROM two WHERE k > 0),
low AS (SELECT source_id || ':insufficient_trust' AS x FROM known WHERE trust < 0.38),
per AS (SELECT t.query_id, max(spent) AS spent, max(n) AS n FROM two t GROUP BY t.query_id)
SELECT p.query_id, coalesce((SELECT string_agg(source_id::VARCHAR, ',' ORDER BY source_id) FROM acts a WHERE a.query_id = p.query_id AND act = 'genuine'), '') AS genuine,
  coalesce((SELECT string_agg(source_id::VARCHAR, ',' ORDER BY source_id) FROM acts a WHERE a.query_id = p.query_id AND act = 'decoy'), '') AS decoys,
  coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT source_id || ':exposure_budget' AS x FROM acts a WHERE a.query_id = p.query_id AND act = 'out' UNION ALL SELECT x FROM low)), '') AS excluded, spent,
  CASE WHEN (SELECT count(*) FROM known WHERE trust >= 0.38) = 0 THEN 'no_eligible_sources' WHEN n >= 4 THEN 'max_sources' WHEN EXISTS (SELECT 1 FROM acts a WHERE a.query_id = p.query_id AND act = 'out') THEN 'exposure_budget' WHEN n = 0 THEN 'no_candidates' ELSE 'candidates_exhausted' END AS stop_reason FROM per p"""


def cells_of_shards(spark, sf, minimum_trust):
    """Cells of two shards, dealt across three groups, with their eligible members and cost."""
    k = known(spark, sf)
    cells = r.build_cells(k.select("source_id", F.pmod("source_id", F.lit(3)).alias("grp")), 2)
    ok = cells.join(k, "source_id").where(F.col("trust") >= minimum_trust)
    members = ok.groupBy("cell").agg(F.array_sort(F.collect_list(F.col("source_id").cast("string"))).alias("members"), F.sum("cost").alias("cell_cost"))
    return k.join(cells.where(F.col("source_id") != 5).select("source_id", "cell"), "source_id", "left").join(members, "cell", "left")


def r9_cells_policy(spark, sf):
    """Whole cells or nothing: a second genuine source of a taken cell is promoted; a shard without a cell is told apart."""
    p = with_known(pools(spark, sf), cells_of_shards(spark, sf, 0.2), "trust", "cost", "cell", "members", "cell_cost")
    return _lists(r.select_dispatch(p, 6, 3, 4, 6.0, minimum_trust=0.2, decoys="cells"))


R9 = f"""WITH RECURSIVE {BASE}, {KNOWN}, turns AS (SELECT source_id, source_id % 3 AS grp, row_number() OVER (PARTITION BY source_id % 3 ORDER BY source_id) AS turn FROM known),
placed AS (SELECT source_id, row_number() OVER (ORDER BY turn, grp) - 1 AS place, count(*) OVER () AS total FROM turns), cells AS (SELECT source_id, least(place // 2, greatest(total // 2 - 1, 0))::INT AS cell FROM placed),
facts AS (SELECT c.cell, list(source_id ORDER BY source_id) AS members, sum(cost) AS cell_cost FROM cells c JOIN known USING (source_id) WHERE trust >= 0.2 GROUP BY c.cell),
pool AS (SELECT b.query_id, b.source_id, c.cell, members, cell_cost, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b.source_id) AS k FROM best b JOIN known USING (source_id) LEFT JOIN (SELECT * FROM cells WHERE source_id <> 5) c ON c.source_id = b.source_id LEFT JOIN facts f ON f.cell = c.cell WHERE trust >= 0.2 QUALIFY k <= 6),
fold AS (SELECT query_id, 0::BIGINT AS k, 0.0::DOUBLE AS spent, []::INT[] AS genuine, []::INT[] AS sent, []::INT[] AS taken, []::VARCHAR[] AS out FROM (SELECT DISTINCT query_id FROM best)
  UNION ALL SELECT f.query_id, p.k,
    CASE WHEN len(genuine) < 3 AND p.cell IS NOT NULL AND NOT list_contains(taken, p.cell) AND spent + cell_cost <= 6 AND len(sent) + len(members) <= 4 THEN spent + cell_cost ELSE spent END,
    CASE WHEN len(genuine) < 3 AND p.cell IS NOT NULL AND (list_contains(taken, p.cell) OR (spent + cell_cost <= 6 AND len(sent) + len(members) <= 4)) THEN list_append(genuine, p.source_id) ELSE genuine END,
    CASE WHEN len(genuine) < 3 AND p.cell IS NOT NULL AND NOT list_contains(taken, p.cell) AND spent + cell_cost <= 6 AND len(sent) + len(members) <= 4 THEN list_concat(sent, members) ELSE sent END,
    CASE WHEN len(genuine) < 3 AND p.cell IS NOT NULL AND NOT list_contains(taken, p.cell) AND spent + cell_cost <= 6 AND len(sent) + len(members) <= 4 THEN list_append(taken, p.cell) ELSE taken END,
    CASE WHEN len(genuine) >= 3 THEN out WHEN p.cell IS NULL THEN list_append(out, p.source_id || ':no_cell') WHEN NOT list_contains(taken, p.cell) AND NOT (spent + cell_cost <= 6 AND len(sent) + len(members) <= 4) THEN list_append(out, p.source_id || ':exposure_budget') ELSE out END
  FROM fold f JOIN pool p ON p.query_id = f.query_id AND p.k = f.k + 1),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1), low AS (SELECT coalesce(list(source_id || ':insufficient_trust'), []) AS x FROM known WHERE trust < 0.2)
SELECT query_id, array_to_string(list_sort(genuine), ',') AS genuine, array_to_string(list_sort([x FOR x IN sent IF NOT list_contains(genuine, x)]), ',') AS decoys, array_to_string(list_sort(list_concat(low.x, out)), ',') AS excluded, spent,
  CASE WHEN (SELECT count(*) FROM known WHERE trust >= 0.2) = 0 THEN 'no_eligible_sources' WHEN len(sent) >= 4 THEN 'max_sources' WHEN len([x FOR x IN out IF x LIKE '%exposure_budget']) > 0 THEN 'exposure_budget' WHEN len(sent) = 0 THEN 'no_candidates' ELSE 'candidates_exhausted' END AS stop_reason FROM done, low"""


def smart_candidates(spark, sf):
    """Questions with their eligible sources: clipped relevance, trust less a penalty for few observations, cost, overlaps."""
    k = known(spark, sf).withColumn("trust", F.round(F.greatest(F.lit(0.0), F.col("trust") - 0.5 / F.sqrt(F.col("observations") + 1)), 9)).where("trust >= 0.1")
    facts = k.join(r.source_overlap(centroids(spark, sf)), "source_id")
    rows = with_known(r.source_arrays(questions(spark, sf), centroids(spark, sf), clip=True), facts, "trust", "cost", "others")
    return rows.withColumn("sources", F.transform(F.filter("sources", lambda x: x["trust"].isNotNull()), lambda x: F.struct(x["source_id"].alias("source_id"), x["score"].alias("relevance"), x["trust"].alias("trust"), x["cost"].alias("cost"), x["others"].alias("others"))))


def _picks(out):
    each = F.transform("picks", lambda p: F.concat_ws(":", p["source_id"], F.format_number(p["gain"], 5)))
    return out.select("query_id", F.array_join(each, ",").alias("picks"), F.col("spent").cast("double").alias("spent"), "stop_reason")


def r6_smart_router(spark, sf):
    """Greedy gain per cost with redundancy for every question, three sources within a budget of four."""
    return _picks(r.smart_route(smart_candidates(spark, sf), budget=4.0, max_sources=3))


def _smart_sql(weight: str, floor: float | None, least: float) -> str:
    """Three greedy steps spelled out; each picks by ratio, gain and id."""
    score = "round(relevance * trust * (1 - {w} * {red}), 12)"
    sql = f"""WITH {BASE}, {KNOWN}, able AS (SELECT source_id, round(greatest(0, trust - 0.5 / sqrt(observations + 1)), 9) AS trust, cost FROM known WHERE round(greatest(0, trust - 0.5 / sqrt(observations + 1)), 9) >= 0.1),
u AS (SELECT source_id, [x / sqrt(list_inner_product(vec, vec)) FOR x IN vec] AS u FROM centroids), overlap AS (SELECT a.source_id AS a, b.source_id AS b, round(greatest(0, least(1, max(list_inner_product(a.u, b.u)))), 9) AS o FROM u a, u b GROUP BY ALL),
c0 AS (SELECT query_id, source_id, max(greatest(0, least(1, score))) AS relevance, any_value(trust) AS trust, any_value(cost) AS cost, 0.0::DOUBLE AS red FROM scored JOIN able USING (source_id) GROUP BY query_id, source_id),
s0 AS (SELECT query_id, 0.0::DOUBLE AS spent, NULL::DOUBLE AS first, NULL::VARCHAR AS stop, ''::VARCHAR AS picks FROM questions)"""
    for k in range(1, 4):
        g = score.format(w=weight, red="red")
        low = f"WHEN ratio < {floor} * coalesce(first, ratio) THEN 'relative_score_floor'" if floor else ""
        sql += f""",
g{k} AS (SELECT c.*, {g} AS gain, round({g} / cost, 12) AS ratio, s.spent + cost <= 4 AS fits FROM c{k - 1} c JOIN s{k - 1} s USING (query_id) WHERE s.stop IS NULL),
b{k} AS (SELECT * FROM g{k} WHERE gain > {least} AND fits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, gain DESC, source_id) = 1),
t{k} AS (SELECT s.*, b.source_id, b.gain, b.ratio, b.cost, CASE WHEN s.stop IS NOT NULL THEN s.stop WHEN NOT EXISTS (SELECT 1 FROM c{k - 1} c WHERE c.query_id = s.query_id) THEN 'candidates_exhausted' WHEN NOT EXISTS (SELECT 1 FROM g{k} g WHERE g.query_id = s.query_id AND gain > {least}) THEN 'insufficient_gain' WHEN b.source_id IS NULL THEN 'exposure_budget' {low} END AS why
  FROM s{k - 1} s LEFT JOIN b{k} b USING (query_id)),
s{k} AS (SELECT query_id, CASE WHEN why IS NULL THEN spent + cost ELSE spent END AS spent, coalesce(first, ratio) AS first, why AS stop, CASE WHEN why IS NULL THEN picks || CASE WHEN picks = '' THEN '' ELSE ',' END || source_id || ':' || printf('%.5f', gain) ELSE picks END AS picks FROM t{k}),
c{k} AS (SELECT c.query_id, c.source_id, relevance, trust, c.cost, greatest(red, coalesce(o, 0)) AS red FROM c{k - 1} c JOIN t{k} t USING (query_id) LEFT JOIN overlap ON a = t.source_id AND b = c.source_id WHERE t.why IS NOT NULL OR c.source_id <> t.source_id)"""
    return sql + " SELECT query_id, picks, spent, coalesce(stop, 'max_sources') AS stop_reason FROM s3"


def r7_relative_policy(spark, sf):
    """The relative policy: no redundancy, an end below 0.8 of the first ratio, and why each question's selection ended."""
    return _picks(r.smart_route(smart_candidates(spark, sf), budget=4.0, max_sources=3, minimum_gain=0.02, policy="relative", score_floor=0.8))


def r12_random_sample(spark, sf):
    """Four sources per question in the order of a seeded hash: a sample that another run repeats."""
    return r.random_router(questions(spark, sf), shard_table(spark, sf), "sample-11", 4)


R12 = with_base("""SELECT query_id, source_id, rank FROM (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256('sample-11:' || query_id || ':' || source_id))::INT AS rank
FROM questions, (SELECT DISTINCT source_id FROM centroids)) WHERE rank <= 4""")


def r16_cell_groups(spark, sf):
    """Groups that suppliers are dealt by: the first policy label, or the name before its last underscore."""
    s = read(spark, sf, "supplier").select(F.concat(F.lit("node_"), F.col("s_nationkey"), F.lit("_"), F.col("s_suppkey")).alias("id"), F.array_compact(F.array(F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "eu"), F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "phi"))).alias("labels"))
    return s.select("id", r.cell_group(F.col("id"), F.col("labels")).alias("grp"))


R16 = "SELECT 'node_' || s_nationkey || '_' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'eu' WHEN s_suppkey % 2 = 0 THEN 'phi' ELSE 'node_' || s_nationkey END AS grp FROM supplier"

WEIGHTS = {"relevance": 1.0, "trust": 0.5, "authorized": 0.2, "exposure": 0.3, "communication": 0.1, "latency": 0.1, "hijack": 0.4}


def features(spark, sf):
    """Candidate features of every shard, from the log."""
    k = known(spark, sf)
    m = lambda n: F.pmod("source_id", F.lit(n)) / float(n)
    return k.select("source_id", "trust", F.when(F.pmod("source_id", F.lit(6)) == 5, 0.0).otherwise(1.0).alias("authorized"), m(7).alias("exposure"), m(5).alias("communication"), m(4).alias("latency"), m(3).alias("hijack"))


FEATURES = f"""{KNOWN}, features AS (SELECT source_id, trust, CASE WHEN source_id % 6 = 5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS authorized, (source_id % 7) / 7.0::DOUBLE AS exposure, (source_id % 5) / 5.0::DOUBLE AS communication, (source_id % 4) / 4.0::DOUBLE AS latency, (source_id % 3) / 3.0::DOUBLE AS hijack FROM known),
valued AS (SELECT query_id, source_id, score, round(score + 0.5 * trust + 0.2 * authorized - (0.3 * exposure + 0.1 * communication + 0.1 * latency + 0.4 * hijack), 9) AS value, authorized, trust, exposure FROM best JOIN features USING (source_id))"""


def r17_candidate_scores(spark, sf):
    """Weighted benefits less weighted costs of every source for every question."""
    rows = r.aggregate_scores(scored(spark, sf)).withColumnRenamed("score", "relevance").join(r.small(features(spark, sf)), "source_id")
    return rows.select("query_id", "source_id", F.round(r.candidate_score(WEIGHTS), 9).alias("value"))


R17 = f"WITH {BASE}, {FEATURES} SELECT query_id, source_id, value FROM valued"


def r19_pipeline(spark, sf):
    """The composed router: eight coarse candidates, hard constraints and score, two genuine, decoys to four, exposure budget."""
    rows = with_known(pools(spark, sf), features(spark, sf), "trust", "authorized", "exposure", "communication", "latency", "hijack")
    out = r.privacy_pipeline(rows, WEIGHTS, coarse_k=8, top_k=2, m=4, minimum_trust=0.2, budget=1.2)
    return out.select("query_id", F.array_join("genuine", ",").alias("genuine"), F.array_join(F.array_sort("dispatched"), ",").alias("dispatched"))


R19 = f"""WITH RECURSIVE {BASE}, {FEATURES}, coarse AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) <= 8),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, source_id) AS k FROM coarse WHERE authorized = 1 AND trust >= 0.2 QUALIFY k <= 2),
d AS (SELECT c.*, 2 + row_number() OVER (PARTITION BY query_id ORDER BY sha256(label || ':' || source_id)) AS k FROM coarse c JOIN embeddings ON vec_id = query_id WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = c.query_id AND g.source_id = c.source_id)),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY query_id),
items AS (SELECT query_id, source_id, exposure, true AS mine, k FROM g UNION ALL SELECT d.query_id, source_id, exposure, false, k - 2 + coalesce(n, 0) FROM d LEFT JOIN n USING (query_id) WHERE k - 2 <= 4 - coalesce(n, 0)),
fold AS (SELECT query_id, 0::BIGINT AS k, 0::DECIMAL(18,6) AS spent, []::INT[] AS kept FROM questions
  UNION ALL SELECT f.query_id, i.k, (CASE WHEN mine OR spent + exposure::DECIMAL(18,6) <= 1.2 THEN spent + exposure::DECIMAL(18,6) ELSE spent END)::DECIMAL(18,6), CASE WHEN mine OR spent + exposure::DECIMAL(18,6) <= 1.2 THEN list_append(kept, i.source_id) ELSE kept END FROM fold f JOIN items i ON i.query_id = f.query_id AND i.k = f.k + 1),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1)
SELECT d.query_id, coalesce((SELECT string_agg(source_id::VARCHAR, ',' ORDER BY k) FROM g WHERE g.query_id = d.query_id), '') AS genuine, array_to_string(list_sort(kept::VARCHAR[]), ',') AS dispatched FROM done d"""


def fine_centroids(spark, sf):
    """Centroids of finer clusters: label and third of each shard's vectors."""
    c = v.mean_vectors(vectors(spark, sf).withColumn("part", F.pmod(F.floor(F.col("vec_id") / 12), F.lit(3))), ["shard", "label", "part"])
    return c.select(F.col("shard").alias("source_id"), (F.col("label") * 3 + F.col("part")).cast("int").alias("centroid_ix"), "vec")


def r30_fine_routing(spark, sf):
    """Sources by the best of their many cluster centroids instead of their few routing ones."""
    return r.cosine_router(questions(spark, sf), fine_centroids(spark, sf), "max", 3)


R30 = f"""WITH {BASE}, fine AS (SELECT shard AS source_id, k, list(x ORDER BY i) AS vec FROM (SELECT shard, label * 3 + (vec_id // 12) % 3 AS k, i, avg(x) AS x FROM elems GROUP BY ALL) GROUP BY shard, k),
fs AS (SELECT q.query_id, f.source_id, max(round(list_inner_product(q.vec, f.vec) / coalesce(nullif(sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(f.vec, f.vec)), 0), 1), 6)) AS score FROM questions q, fine f GROUP BY ALL)
SELECT query_id, source_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id)::INT AS rank FROM fs QUALIFY rank <= 3"""


def r31_metadata_ranking(spark, sf):
    """Fixed ranking by centroid, by description and by a mix of both; no abstaining, ties by id."""
    e = vectors(spark, sf)
    means = v.mean_vectors(e, ["shard"]).select(F.col("shard").alias("source_id"), F.lit(0).alias("centroid_ix"), "vec")  # stands for the description's vector
    one, two = (r.source_arrays(questions(spark, sf), c, clip=True) for c in (centroids(spark, sf), means))
    both = one.join(two.withColumnRenamed("sources", "described"), "query_id")
    mixed = {
        "centroid": F.col("sources"),
        "description": F.col("described"),
        "combined": F.zip_with("sources", "described", lambda a, b: F.struct(a["source_id"].alias("source_id"), F.round(0.7 * a["score"] + 0.3 * b["score"], 8).alias("score"))),
    }
    rows = both.select("query_id", F.explode(F.create_map(*(x for k, c in mixed.items() for x in (F.lit(k), F.slice(r.by_score(c), 1, 3))))).alias("mode", "top"))
    return rows.select("query_id", "mode", F.posexplode("top").alias("p", "x")).select("query_id", "mode", "x.source_id", "x.score", (F.col("p") + 1).alias("rank"))


R31 = f"""WITH {BASE}, a AS (SELECT query_id, source_id, max(greatest(0, least(1, score))) AS c FROM scored GROUP BY ALL), m AS (SELECT shard AS source_id, list(x ORDER BY i) AS vec FROM (SELECT shard, i, avg(x) AS x FROM elems GROUP BY shard, i) GROUP BY shard),
d AS (SELECT query_id, m.source_id, greatest(0, least(1, round(list_inner_product(q.vec, m.vec) / coalesce(nullif(sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(m.vec, m.vec)), 0), 1), 6))) AS d FROM questions q, m),
x AS (SELECT query_id, source_id, 'centroid' AS mode, c AS score FROM a UNION ALL SELECT query_id, source_id, 'description', d FROM d UNION ALL SELECT query_id, source_id, 'combined', round(0.7 * c + 0.3 * d, 8) FROM a JOIN d USING (query_id, source_id))
SELECT query_id, mode, source_id, score, row_number() OVER (PARTITION BY query_id, mode ORDER BY x.score DESC, source_id)::INT AS rank FROM x QUALIFY rank <= 3"""


def r32_policies(spark, sf):
    """Contacts of each named policy by source: every policy of the registry over the same questions."""
    cells = r.build_cells(shard_table(spark, sf).withColumn("grp", F.col("source_id")), 4).select("source_id", "cell")
    n = vectors(spark, sf).groupBy(F.col("shard").alias("source_id"), "label").agg(F.count("*").alias("n"))
    facts = cells.join(n.groupBy("source_id").agg(F.collect_list(F.struct("label", "n")).alias("counts")), "source_id")
    p = with_known(pools(spark, sf), facts, "cell", "counts")
    grade = lambda x: F.coalesce(F.get(F.filter(x["counts"], lambda c: c["label"] == F.col("topic")), F.lit(0))["n"], F.lit(0))
    p = p.withColumn("sources", F.transform("sources", lambda x: F.struct(x["source_id"].alias("source_id"), x["score"].alias("score"), x["cell"].alias("cell"), grade(x).alias("grade"))))
    parts = [r.dispatch(name, p, max_nodes=4, genuine_k=2, coarse_k=8).select(F.lit(name).alias("policy"), "source_id") for name in r.POLICIES]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("policy", "source_id").agg(F.count("*").alias("contacts"))


R32 = f"""WITH {BASE}, placed AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT source_id FROM centroids)),
cells AS (SELECT source_id, least(place // 4, greatest(total // 4 - 1, 0)) AS cell FROM placed), top AS (SELECT r.*, cell, label FROM ranked r JOIN cells USING (source_id) JOIN embeddings ON vec_id = query_id),
stable AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256(label || ':' || source_id)) AS k FROM top WHERE rank BETWEEN 3 AND 8),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('random_decoys:' || query_id || ':' || source_id)) AS k FROM top WHERE rank BETWEEN 3 AND 8),
far AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('random_any:' || query_id || ':' || source_id)) AS k FROM top WHERE rank > 2),
dealt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('random:' || query_id || ':' || source_id)) AS k FROM top),
held AS (SELECT (vec_id % 12)::INT AS source_id, label, count(*) AS n FROM embeddings GROUP BY ALL), good AS (SELECT query_id, source_id FROM (SELECT query_id, t.source_id, coalesce(n, 0) AS n FROM top t LEFT JOIN held h ON h.source_id = t.source_id AND h.label = t.label) QUALIFY n = max(n) OVER (PARTITION BY query_id) AND row_number() OVER (PARTITION BY query_id ORDER BY n DESC, source_id) <= 4),
best1 AS (SELECT query_id, cell FROM top WHERE rank = 1), taken AS (SELECT DISTINCT query_id, cell FROM top WHERE rank <= 2),
x AS (SELECT 'broadcast' AS policy, source_id FROM top UNION ALL SELECT 'random', source_id FROM dealt WHERE k <= 4 UNION ALL SELECT 'oracle', source_id FROM good
UNION ALL SELECT 'cosine@g', source_id FROM top WHERE rank <= 2 UNION ALL SELECT 'cosine@K', source_id FROM top WHERE rank <= 4
UNION ALL SELECT 'sticky_decoys', source_id FROM top WHERE rank <= 2 UNION ALL SELECT 'sticky_decoys', source_id FROM stable WHERE k <= 2
UNION ALL SELECT 'random_decoys', source_id FROM top WHERE rank <= 2 UNION ALL SELECT 'random_decoys', source_id FROM near WHERE k <= 2
UNION ALL SELECT 'random_any', source_id FROM top WHERE rank <= 2 UNION ALL SELECT 'random_any', source_id FROM far WHERE k <= 2
UNION ALL SELECT 'cells_1', t.source_id FROM top t JOIN best1 b ON b.query_id = t.query_id AND b.cell = t.cell UNION ALL SELECT 'cells_2', t.source_id FROM top t JOIN taken b ON b.query_id = t.query_id AND b.cell = t.cell)
SELECT policy, source_id, count(*) AS contacts FROM x GROUP BY policy, source_id"""


def r34_mean_attacker(spark, sf):
    """Contacts won by a source that publishes the unit mean of all questions, and by the honest ones, at three contacts."""
    every = v.mean_vectors(vectors(spark, sf).withColumn("all", F.lit(1)), ["all"]).select(F.lit(-1).alias("source_id"), F.lit(0).alias("centroid_ix"), v.normalise(F.col("vec")).alias("vec"))
    out = r.cosine_router(questions(spark, sf), centroids(spark, sf).unionByName(every), "max", 3)
    return out.groupBy("source_id").agg(F.count("*").alias("contacts"), F.round(F.avg("rank"), 6).alias("mean_rank"))


R34 = f"""WITH {BASE}, m AS (SELECT list(x ORDER BY i) AS vec FROM (SELECT i, avg(x) AS x FROM elems GROUP BY i)),
a AS (SELECT query_id, source_id, score FROM best UNION ALL SELECT query_id, -1, round(list_inner_product(q.vec, m.vec) / coalesce(nullif(sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(m.vec, m.vec)), 0), 1), 6) FROM questions q, m),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM a QUALIFY rank <= 3) SELECT source_id, count(*) AS contacts, round(avg(rank), 6) AS mean_rank FROM k GROUP BY source_id"""


def r33_forged_profile(spark, sf):
    """Contacts per source when shard 3 publishes one question's vector as all its centroids, in a new version."""
    e = vectors(spark, sf)
    target = e.groupBy().agg(F.min_by("vec", "vec_id").alias("forged"))
    forged = r.forge_profile(centroids(spark, sf).withColumn("version", F.lit(1)), 3, target)
    out = r.cosine_router(questions(spark, sf), forged, "max", 2)
    return out.join(r.small(forged.groupBy("source_id").agg(F.max("version").alias("version"))), "source_id").groupBy("source_id", "version").agg(F.count("*").alias("contacts"))


R33 = f"""WITH {BASE}, t AS (SELECT embedding::DOUBLE[] AS vec FROM embeddings ORDER BY vec_id LIMIT 1),
a AS (SELECT query_id, source_id, score FROM best WHERE source_id <> 3 UNION ALL SELECT query_id, 3, round(list_inner_product(q.vec, t.vec) / coalesce(nullif(sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(t.vec, t.vec)), 0), 1), 6) FROM questions q, t)
SELECT source_id, CASE WHEN source_id = 3 THEN 2 ELSE 1 END AS version, count(*) AS contacts FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) <= 2) GROUP BY source_id"""


def r26_learned_router(spark, sf):
    """The learned router's selections by source: how many questions it sends there, and how many of these are right.

    A question should go to the sources that hold any of its topic's fifteen nearest vectors. Half of the questions, by hash, are
    learned from, a quarter checks the states of the training; figures are those of all questions and of the last quarter. Where
    vectors tell nothing of their topics, as in the synthetic tables, what is learned is how often each source is right.
    """
    from .policies import r27_router_labels

    held = r27_router_labels(spark, sf).groupBy(F.col("query_id").alias("label")).agg(F.collect_set(F.col("source_id").cast("long")).alias("held"))
    q = checkpointed(vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "label", "vec").join(r.small(held), "label", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(4))))
    mean = v.mean_vectors(vectors(spark, sf), ["shard"]).select(F.col("shard").cast("long").alias("source_id"), "vec")
    router = learned.train(q.where("part < 2"), q.where("part = 2"), mean, epochs=20, seed=11)
    p = router.probabilities(q).join(q.select("query_id", "held", "part"), "query_id")
    sent, right = (F.col("p") > 0.5).cast("int"), F.coalesce(F.array_contains("held", F.col("source_id")), F.lit(False)).cast("int")
    out = p.select("source_id", sent.alias("sent"), right.alias("right"), (F.col("part") == 3).cast("int").alias("last"))
    correct = (F.col("sent") == F.col("right")).cast("int")
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("sent").alias("selected"), F.sum("right").alias("held"), F.sum(correct).alias("correct"), F.sum("last").alias("held_out"), F.sum(correct * F.col("last")).alias("held_out_correct"))


def t7_feedback(spark, sf):
    """Routing whose dispatch moves the trust that the next question sees: each label's questions in order are a run."""
    e = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("run"))
    s = r.aggregate_scores(scored(spark, sf)).join(e, "query_id")
    stream = s.select("run", F.col("query_id").alias("seq"), "source_id", F.greatest(F.lit(0.0), F.col("score")).alias("relevance"), F.when(F.pmod("source_id", F.lit(4)) == 0, 0.2).otherwise(0.9).alias("signal"))
    return r.feedback_loop(stream, 2).groupBy("run", "source_id").agg(F.count("*").alias("contacts"), F.round(F.max_by("trust", "seq"), 6).alias("trust"))


def v5_perturbed(spark, sf):
    """Moments of noise on questions: mean and deviation of what was added, by label; sigma 0 adds nothing."""
    e = vectors(spark, sf).select("vec_id", "label", "vec", F.col("vec").alias("noisy"))
    added = lambda df, sigma: df.select("label", F.lit(sigma).alias("sigma"), F.explode(F.zip_with("noisy", "vec", lambda a, b: a - b)).alias("d"))
    both = added(v.perturb(e, "noisy", 0.3, 7, "vec_id"), 0.3).unionByName(added(v.perturb(e, "noisy", 0.0, 7, "vec_id"), 0.0))
    return both.groupBy("label", "sigma").agg((F.abs(F.avg("d")) < 0.05).alias("centred"), F.round(F.stddev_pop("d"), 1).alias("sd"), F.count("*").alias("n"))


V5 = """SELECT label, sigma, true AS centred, CASE WHEN sigma = 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS sd, sum(len(embedding))::BIGINT AS n FROM embeddings, (VALUES (0.3::DOUBLE), (0.0::DOUBLE)) s(sigma) GROUP BY label, sigma"""

QUERIES = {
    "r6_smart_router": (r6_smart_router, _smart_sql("0.5", None, 0.0)), "r7_relative_policy": (r7_relative_policy, _smart_sql("0.0", 0.8, 0.02)), "r8_dispatch": (r8_dispatch, R8), "r9_cells_policy": (r9_cells_policy, R9), "r10_stop_reasons": (r10_stop_reasons, R10),
    "r12_random_sample": (r12_random_sample, R12), "r16_cell_groups": (r16_cell_groups, R16), "r17_candidate_scores": (r17_candidate_scores, R17), "r19_pipeline": (r19_pipeline, R19), "r26_learned_router": (r26_learned_router, None),
    "r30_fine_routing": (r30_fine_routing, R30), "r31_metadata_ranking": (r31_metadata_ranking, R31), "r32_policies": (r32_policies, R32), "r33_forged_profile": (r33_forged_profile, R33), "r34_mean_attacker": (r34_mean_attacker, R34),
    "t7_feedback": (t7_feedback, None), "v5_perturbed": (v5_perturbed, V5),
}
