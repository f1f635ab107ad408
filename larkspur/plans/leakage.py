"""Leakage queries: sessions, exemptions, planted passages, enumeration and defences, over the routed questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import metrics as m
from ..operators import routing as r
from ..operators.running import running
from .analytics import relevant
from .retrieval import SCORED, topics
from .retrieval import scored as passages
from .routing import BASE, GRADES, centroids, questions, read, scored, vectors
from .selection import R8, r8_dispatch


def asked_sessions(spark, sf):
    """Sessions of five questions each (session, length, topic, source_id): three contacts a question, labelled by its first one's label."""
    e = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "label")
    top = F.transform(F.slice(r.by_score(F.col("sources")), 1, 3), lambda x: x["source_id"])
    rows = r.aggregate_arrays(scored(spark, sf)).select("query_id", F.explode(top).alias("source_id")).withColumns({"session": F.floor(F.col("query_id") / 5), "length": (F.pmod("query_id", F.lit(5)) + 1).cast("int")})
    label = e.groupBy(F.floor(F.col("query_id") / 5).alias("session")).agg(F.min_by("label", "query_id").alias("topic"))
    return rows.join(label, "session")


SESSIONS = f"""{BASE}, topics AS (SELECT vec_id // 5 AS session, arg_min(label, vec_id) AS topic FROM embeddings GROUP BY 1),
log AS (SELECT query_id // 5 AS session, (query_id % 5 + 1)::INT AS length, topic, source_id FROM ranked JOIN topics ON session = query_id // 5 WHERE rank <= 3),
train AS (SELECT * FROM log WHERE session % 2 = 0), test AS (SELECT * FROM log WHERE session % 2 = 1), n AS (SELECT topic, count(DISTINCT session * 10 + length)::DOUBLE AS n FROM train GROUP BY topic), k AS (SELECT DISTINCT source_id FROM train),
c AS (SELECT topic, source_id, count(*) AS c FROM train GROUP BY ALL), p AS (SELECT n.topic, k.source_id, (coalesce(c, 0) + 1.0::DOUBLE) / (n + 2.0) AS p, n FROM n CROSS JOIN k LEFT JOIN c ON c.topic = n.topic AND c.source_id = k.source_id),
ll AS (SELECT q.session, q.length, q.truth, p.topic, sum(CASE WHEN t.source_id IS NULL THEN ln(1 - p) ELSE ln(p) END) AS ll, any_value(n) AS n FROM (SELECT DISTINCT session, length, topic AS truth FROM test) q CROSS JOIN p LEFT JOIN test t ON t.session = q.session AND t.length = q.length AND t.source_id = p.source_id GROUP BY ALL),
cum AS (SELECT session, length, truth, topic, round(sum(ll) OVER (PARTITION BY session, topic ORDER BY length) + ln(n / (SELECT sum(n) FROM n)), 6) AS score, round(ll + ln(n / (SELECT sum(n) FROM n)), 6) AS alone FROM ll)"""


def _halves(spark, sf):
    log = asked_sessions(spark, sf)
    return log.where("session % 2 = 0"), log.where("session % 2 = 1")


def l7_session_attack(spark, sf):
    """Accuracy of naming a session's topic from its first questions: one prior, and a likelihood for each question so far."""
    train, test = _halves(spark, sf)
    score = m.session_attack(train, test)
    guess = score.groupBy("session", "length").agg(F.max(F.struct("score", (-F.col("topic")).alias("t"))).alias("g"))
    truth = test.select("session", "topic").distinct()
    return guess.join(truth, "session").groupBy("length").agg(F.round(F.avg((-F.col("g.t") == F.col("topic")).cast("int")), 6).alias("accuracy"), F.count("*").alias("sessions"))


L7 = f"WITH {SESSIONS}, g AS (SELECT * FROM cum QUALIFY row_number() OVER (PARTITION BY session, length ORDER BY score DESC, topic) = 1) SELECT length, round(avg((topic = truth)::INT), 6) AS accuracy, count(*) AS sessions FROM g GROUP BY length"


def l10_evaluate(spark, sf):
    """The attacker on single questions: accuracy, macro F1, top-three accuracy and chance."""
    train, test = _halves(spark, sf)
    cases = test.withColumn("session", F.col("session") * 10 + F.col("length")).withColumn("length", F.lit(1))
    score = m.session_attack(train, cases).select("session", "topic", "score")
    return m.evaluate(score, cases.select("session", F.col("topic").alias("truth")).distinct(), 3)


L10 = f"""WITH {SESSIONS}, r AS (SELECT session, length, truth, topic, row_number() OVER (PARTITION BY session, length ORDER BY alone DESC, topic) AS k FROM cum), x AS (SELECT truth, max(CASE WHEN k = 1 THEN topic END) AS guess, max((k <= 3 AND topic = truth)::INT) AS near FROM r GROUP BY session, length, truth),
l AS (SELECT truth AS label FROM x UNION SELECT guess FROM x), f AS (SELECT label, (SELECT count(*) FROM x WHERE truth = label) AS t, (SELECT count(*) FROM x WHERE guess = label) AS q, (SELECT count(*) FROM x WHERE truth = label AND guess = label) AS b FROM l)
SELECT round(sum(b)::DOUBLE / sum(t), 6) AS accuracy, round(avg(2.0::DOUBLE * b / (t + q)), 6) AS macro_f1, round(1.0::DOUBLE / count(CASE WHEN t > 0 THEN 1 END), 6) AS chance, (SELECT round(avg(near), 6) FROM x) AS top_k, (SELECT count(*) FROM x) AS cases FROM f"""


def l13_floors(spark, sf):
    """What guessing without any contact gives: the most frequent topic's share, and one source of all."""
    _, test = _halves(spark, sf)
    n = test.select("session", "topic").distinct().groupBy("topic").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    k = test.agg(F.countDistinct("source_id").alias("sources"))
    return n.crossJoin(k).select(F.round(F.col("most") / F.col("all"), 6).alias("majority"), F.round(1 / F.col("sources"), 6).alias("chance"), F.col("all").alias("sessions"))


L13 = f"WITH {SESSIONS}, t AS (SELECT topic, count(DISTINCT session) AS n FROM test GROUP BY topic) SELECT round(max(n)::DOUBLE / sum(n), 6) AS majority, round(1.0::DOUBLE / (SELECT count(DISTINCT source_id) FROM test), 6) AS chance, sum(n)::BIGINT AS sessions FROM t"


def l5_repeated_topics(spark, sf):
    """Precision of naming a topic's relevant sources by contacts, over topics that occur at least twice."""
    e = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    top = F.slice(r.by_score(F.col("sources")), 1, 4)
    log = r.aggregate_arrays(scored(spark, sf)).select("query_id", F.explode(top).alias("x")).select("query_id", "x.source_id").join(e, "query_id")
    often = e.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 2")
    truth = relevant(spark, sf).join(e, "query_id").select("topic", F.col("item").alias("source_id")).distinct().join(often, "topic").select("topic", "source_id")
    size = truth.groupBy("topic").agg(F.count("*").alias("size"))
    c = log.groupBy("topic", "source_id").agg(F.count("*").alias("n"), F.min("query_id").alias("first"))
    guess = c.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "first", "source_id"))).join(size, "topic").where("k <= size")
    each = guess.join(truth.withColumn("hit", F.lit(1)), ["topic", "source_id"], "left").groupBy("topic").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("p"))
    return each.agg(F.round(F.avg("p"), 6).alias("precision"), F.count("*").alias("topics"))


L5 = f"""WITH {BASE}, {GRADES}, often AS (SELECT label AS topic FROM embeddings GROUP BY label HAVING count(*) >= 2), t AS (SELECT DISTINCT label AS topic, source_id FROM grades JOIN embeddings ON vec_id = query_id JOIN often ON topic = label WHERE grade >= 0.1), z AS (SELECT topic, count(*) AS size FROM t GROUP BY topic),
c AS (SELECT label AS topic, source_id, count(*) AS n, min(query_id) AS first FROM ranked JOIN embeddings ON vec_id = query_id WHERE rank <= 4 GROUP BY ALL), g AS (SELECT c.topic, c.source_id, size, row_number() OVER (PARTITION BY c.topic ORDER BY n DESC, first, c.source_id) AS k FROM c JOIN z USING (topic)),
e AS (SELECT g.topic, avg((t.source_id IS NOT NULL)::INT) AS p FROM g LEFT JOIN t ON t.topic = g.topic AND t.source_id = g.source_id WHERE k <= size GROUP BY g.topic) SELECT round(avg(p), 6) AS precision, count(*) AS topics FROM e"""


def observed(spark, sf):
    """Contacts in order with their role and what each showed, and the trust before and after with and without the exemption of decoys."""
    s = r.aggregate_scores(scored(spark, sf))
    log = r8_dispatch(spark, sf).join(s, ["query_id", "source_id"]).withColumn("signal", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 3))
    real = F.when(F.col("role") == "genuine", 1).otherwise(0)
    both = running(log, ["source_id"], F.floor(F.col("query_id") / 1000), ["query_id"], {"s": F.col("signal"), "n": F.lit(1), "gs": F.col("signal") * real, "gn": real})
    trust = lambda s, n: F.round((1 + s) / (n + 2), 9)
    return both.select(
        "query_id", "source_id", "role", trust(F.col("s"), F.col("n")).alias("after"), trust(F.col("s") - F.col("signal"), F.col("n") - 1).alias("before"),
        trust(F.col("gs"), F.col("gn")).alias("after_exempt"), trust(F.col("gs") - F.col("signal") * real, F.col("gn") - real).alias("before_exempt"), F.col("n").alias("seen"), (F.col("n") - F.col("gn")).alias("skipped"),
    )


OBSERVED = f"""{R8.replace("WITH ", "", 1).rsplit("SELECT query_id, source_id, 'genuine'", 1)[0].rstrip()}, sent AS (SELECT query_id, source_id, 'genuine' AS role FROM placed WHERE k <= 2 UNION ALL SELECT query_id, source_id, 'decoy' FROM rest WHERE d <= 2),
seen AS (SELECT query_id, source_id, role, round(greatest(0, least(1, score)), 3) AS signal, (role = 'genuine')::INT AS real FROM sent JOIN best USING (query_id, source_id)),
run AS (SELECT *, sum(signal) OVER w AS s, count(*) OVER w AS n, sum(signal * real) OVER w AS gs, sum(real) OVER w AS gn FROM seen WINDOW w AS (PARTITION BY source_id ORDER BY query_id)),
obs AS (SELECT query_id, source_id, role, round((1 + s) / (n + 2), 9) AS after, round((1 + s - signal) / (n + 1), 9) AS before, round((1 + gs) / (gn + 2), 9) AS after_exempt, round((1 + gs - signal * real) / (gn - real + 2), 9) AS before_exempt, n AS seen, n - gn AS skipped FROM run)"""


def l14_exemption(spark, sf):
    """Precision and recall of taking contacts whose trust stayed the same for decoys, with and without the exemption."""
    o = observed(spark, sf)
    parts = [o.select("query_id", F.lit(name).alias("condition"), F.col("role"), (F.round(F.col(a), 7) == F.round(F.col(b), 7)).alias("same")) for name, a, b in (("exempt", "after_exempt", "before_exempt"), ("all", "after", "before"))]
    decoy = F.col("role") == "decoy"
    per = parts[0].unionByName(parts[1]).groupBy("condition", "query_id").agg(F.sum(F.col("same").cast("int")).alias("guessed"), F.sum((F.col("same") & decoy).cast("int")).alias("hit"), F.sum(decoy.cast("int")).alias("decoys"))
    precision = F.when(F.col("guessed") == 0, 0.0).otherwise(F.col("hit") / F.col("guessed"))
    recall = F.when(F.col("guessed") == 0, F.when(F.col("decoys") == 0, 1.0).otherwise(0.0)).otherwise(F.when(F.col("decoys") == 0, 1.0).otherwise(F.col("hit") / F.col("decoys")))
    return per.groupBy("condition").agg(F.round(F.avg(precision), 6).alias("precision"), F.round(F.avg(recall), 6).alias("recall"), F.count("*").alias("questions"))


L14 = f"""WITH {OBSERVED}, x AS (SELECT 'exempt' AS condition, query_id, role, round(after_exempt, 7) = round(before_exempt, 7) AS same FROM obs UNION ALL SELECT 'all', query_id, role, round(after, 7) = round(before, 7) FROM obs),
p AS (SELECT condition, query_id, sum(same::INT) AS g, sum((same AND role = 'decoy')::INT) AS h, sum((role = 'decoy')::INT) AS d FROM x GROUP BY ALL)
SELECT condition, round(avg(CASE WHEN g = 0 THEN 0.0 ELSE h / g END), 6) AS precision, round(avg(CASE WHEN g = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END WHEN d = 0 THEN 1.0 ELSE h / d END), 6) AS recall, count(*) AS questions FROM p GROUP BY condition"""


def t4_decoy_exemption(spark, sf):
    """Each source's trust at the end when decoy contacts are skipped, and how many were."""
    last = observed(spark, sf).groupBy("source_id").agg(F.max_by("after_exempt", "query_id").alias("t"), F.max_by("skipped", "query_id").alias("skipped"), F.max("seen").alias("contacts"))
    return last.select("source_id", F.round("t", 6).alias("trust"), "skipped", "contacts")


T4 = f"WITH {OBSERVED} SELECT source_id, round(arg_max(after_exempt, query_id), 6) AS trust, arg_max(skipped, query_id)::BIGINT AS skipped, max(seen) AS contacts FROM obs GROUP BY source_id"


def l15_heavy_means(spark, sf):
    """Mean trust at the end of sources contacted more as decoys, and of those contacted more as genuine."""
    per = observed(spark, sf).groupBy("source_id").agg(F.sum((F.col("role") == "decoy").cast("int")).alias("d"), F.sum((F.col("role") == "genuine").cast("int")).alias("g"), F.max_by("after", "query_id").alias("trust"))
    kind = F.when(F.col("d") > F.col("g"), "decoy_heavy").when(F.col("g") > F.col("d"), "genuine_heavy").otherwise("even")
    return per.groupBy(kind.alias("kind")).agg(F.round(F.avg("trust"), 6).alias("trust"), F.count("*").alias("sources"))


L15 = f"""WITH {OBSERVED}, p AS (SELECT source_id, sum((role = 'decoy')::INT) AS d, sum((role = 'genuine')::INT) AS g, arg_max(after, query_id) AS trust FROM obs GROUP BY source_id)
SELECT CASE WHEN d > g THEN 'decoy_heavy' WHEN g > d THEN 'genuine_heavy' ELSE 'even' END AS kind, round(avg(trust), 6) AS trust, count(*) AS sources FROM p GROUP BY 1"""


def l16_recovery_by_noise(spark, sf):
    """Share of vectors whose noisy copy still leads to their own nearest topic, by the amount of noise."""
    e = vectors(spark, sf).select("vec_id", "vec")
    means = topics(spark, sf).agg(F.collect_list(F.struct("query_id", F.col("vec").alias("q"))).alias("all"))
    near = lambda col: F.array_max(F.transform("all", lambda t: F.struct(F.round(v.cosine(F.col(col), t["q"]), 9).alias("s"), (-t["query_id"]).alias("t"))))["t"]
    out = None
    for sigma in (0.0, 0.25, 1.0):
        noisy = v.perturb(e.withColumn("noisy", v.normalise(F.col("vec"))), "noisy", sigma, 3, "vec_id").crossJoin(F.broadcast(means))
        row = noisy.select((near("vec") == near("noisy")).cast("int").alias("same")).agg(F.round(F.avg("same"), 6).alias("recovered"), F.count("*").alias("n")).withColumn("sigma", F.lit(sigma))
        out = row if out is None else out.unionByName(row)
    return out


def l18_planted_passage(spark, sf):
    """Whether a planted passage reaches the evidence: one aimed at all questions at once, among each source's best passage."""
    best = passages(spark, sf).groupBy("query_id", "source_id").agg(F.max("score").alias("score"))
    aimed = v.mean_vectors(vectors(spark, sf).withColumn("all", F.lit(1)), ["all"]).select(v.normalise(F.col("vec")).alias("a"))
    q = topics(spark, sf).crossJoin(F.broadcast(aimed)).select("query_id", F.lit(-1).alias("source_id"), F.round(v.cosine(F.col("vec"), F.col("a")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id"))
    rank = best.unionByName(q).withColumn("rank", place).where("source_id = -1")
    return rank.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("rank") <= 2).cast("int")), 6).alias("cited_top2"), F.round(F.avg(F.lit(1.0)), 6).alias("cited_all"), F.round(F.avg("rank"), 6).alias("mean_rank"))


L18 = f"""WITH {SCORED}, b AS (SELECT query_id, source_id, max(score) AS score FROM found GROUP BY ALL), m AS (SELECT list(x ORDER BY i) AS a FROM (SELECT i, avg(x) AS x FROM elems GROUP BY i)),
e AS (SELECT * FROM b UNION ALL SELECT query_id, -1, round(list_cosine_similarity(q, a), 6) FROM asked, m), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM e)
SELECT count(*) AS cases, round(avg((rank <= 2)::INT), 6) AS cited_top2, 1.0::DOUBLE AS cited_all, round(avg(rank), 6) AS mean_rank FROM r WHERE source_id = -1"""


def j12_attack_cases(spark, sf):
    """Planted passages against the topics that they aim at (none at the last one): a forged source at the attacked questions' mean
    among the published ones, four contacts a question; the passages are each label's first and last vector."""
    q = topics(spark, sf)
    e = vectors(spark, sf).where("label < 9")
    pick = lambda f, kind, k: e.groupBy("label").agg(f("vec", "vec_id").alias("vec")).select((F.col("label") * 2 + k).alias("attack_id"), F.col("label").alias("case_id"), "vec", F.lit(kind).alias("attack_type"))
    attacks = pick(F.min_by, "first", 0).unionByName(pick(F.max_by, "last", 1))
    aimed = attacks.select(F.col("case_id").alias("query_id")).join(r.small(q), "query_id")
    forged = v.mean_vectors(aimed.withColumn("all", F.lit(1)), ["all"]).select(F.lit("attacker").alias("source_id"), F.lit(0).alias("centroid_ix"), v.normalise(F.col("vec")).alias("vec"))
    name = F.concat(F.lit("shard_"), F.lpad(F.col("source_id").cast("string"), 2, "0")).alias("source_id")
    published = centroids(spark, sf).select(name, "centroid_ix", "vec").unionByName(forged)
    sent = r.cosine_router(q, published, "max", 4).select(F.col("query_id").alias("case_id"), "source_id")
    best = passages(spark, sf).groupBy("query_id", "source_id").agg(F.max("score").alias("score")).select(F.col("query_id").alias("case_id"), name, "score")
    return m.attack_cases(q.withColumnRenamed("query_id", "case_id"), attacks, best, sent, "attacker")


J12 = f"""WITH {SCORED}, b AS (SELECT query_id, 'shard_' || lpad(source_id::VARCHAR, 2, '0') AS source, max(score) AS score FROM found GROUP BY ALL),
t AS (SELECT label * 2 AS attack_id, label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS p, 'first' AS kind FROM embeddings WHERE label < 9 GROUP BY label UNION ALL SELECT label * 2 + 1, label, arg_max(embedding, vec_id)::DOUBLE[], 'last' FROM embeddings WHERE label < 9 GROUP BY label),
a AS (SELECT t.*, q, round(list_cosine_similarity(q, p), 6) AS planted FROM t JOIN asked USING (query_id)),
f AS (SELECT list(x ORDER BY i) AS vec FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a) GROUP BY i)),
c AS (SELECT 'shard_' || lpad(source_id::VARCHAR, 2, '0') AS source, vec FROM centroids UNION ALL SELECT 'attacker', vec FROM f),
sent AS (SELECT query_id, source FROM (SELECT query_id, source, max(round(list_cosine_similarity(q, vec), 6)) AS s FROM asked, c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source) <= 4),
e AS (SELECT attack_id, source, row_number() OVER (PARTITION BY attack_id ORDER BY CASE WHEN source = 'attacker' THEN planted ELSE score END DESC, source) AS r FROM a JOIN sent USING (query_id) LEFT JOIN b USING (query_id, source)),
w AS (SELECT a.attack_id, kind, r FROM a LEFT JOIN (SELECT * FROM e WHERE source = 'attacker') x USING (attack_id))
SELECT k AS evidence_top_k, count(*) AS attack_cases, round(avg((r IS NOT NULL)::INT), 6) AS selected, round(avg((r IS NOT NULL AND (k = 0 OR r <= k))::INT), 6) AS cited, round(avg(r), 6) AS mean_rank, string_agg(DISTINCT kind, ',' ORDER BY kind) AS attack_types FROM w, (VALUES (0), (2)) n(k) GROUP BY k"""


def l19_enumeration(spark, sf):
    """Fewest questions, and days of a budget of six points, until two clusters a question have opened all of a source's."""
    n = centroids(spark, sf).groupBy("source_id").agg(F.count("*").alias("clusters"))
    queries = F.ceil(F.col("clusters") / 2)
    return n.select("source_id", "clusters", queries.alias("queries"), F.ceil(queries / F.floor(F.lit(6) / 2)).alias("days"))


L19 = "SELECT (vec_id % 12)::INT AS source_id, count(DISTINCT label) AS clusters, ceil(count(DISTINCT label) / 2.0)::BIGINT AS queries, ceil(ceil(count(DISTINCT label) / 2.0) / 3)::BIGINT AS days FROM embeddings GROUP BY 1"


def l20_defences(spark, sf):
    """How often an attacker with the mean of all questions is contacted: no defence, plausibility, trust, both."""
    e = vectors(spark, sf)
    mean = v.mean_vectors(e.withColumn("all", F.lit(1)), ["all"]).select(F.lit(-1).alias("source_id"), F.lit(0).alias("centroid_ix"), v.normalise(F.col("vec")).alias("vec"))
    published = centroids(spark, sf).unionByName(mean)
    units = v.mean_vectors(published, ["source_id"]).select("source_id", v.normalise(F.col("vec")).alias("u"))
    others = v.mean_vectors(units.where("source_id <> -1").withColumn("all", F.lit(1)), ["all"], "u").select(F.col("vec").alias("o"))
    plausible = units.where("source_id = -1").crossJoin(F.broadcast(others)).select((F.round(v.cosine(F.col("u"), F.col("o")), 6) < 0.95).alias("registered"))
    s = r.aggregate_scores(r.centroid_arrays(questions(spark, sf), published)).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("run")), "query_id")
    stream = s.select("run", F.col("query_id").alias("seq"), "source_id", F.greatest(F.lit(0.0), F.col("score")).alias("relevance"), F.when(F.col("source_id") == -1, 0.1).otherwise(0.9).alias("signal"))
    flat = stream.select("run", F.col("seq").alias("query_id"), "source_id", F.col("relevance").alias("score"))
    plain = r.rank(flat, 2).select("run", F.col("query_id").alias("seq"), "source_id")
    trusting = r.feedback_loop(stream, 2).select("run", "seq", "source_id")
    rate = lambda contacts, name, check: contacts.groupBy("seq").agg(F.max((F.col("source_id") == -1).cast("int")).alias("hit")).agg(F.avg("hit").alias("rate"), F.count("*").alias("questions")).crossJoin(F.broadcast(plausible)).select(F.lit(name).alias("condition"), F.round(F.when(F.lit(check) & ~F.col("registered"), 0.0).otherwise(F.col("rate")), 6).alias("selected"), "questions")
    parts = [rate(plain, "none", False), rate(plain, "plausibility", True), rate(trusting, "trust", False), rate(trusting, "both", True)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def l3_running_intersection(spark, sf):
    """How many sources every question of a topic so far was sent to, after each question."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    ordinal = running(e, ["topic"], F.floor(F.col("query_id") / 1000), ["query_id"], {"k": F.lit(1)})
    top = F.transform(F.slice(r.by_score(F.col("sources")), 1, 5), lambda x: x["source_id"])
    log = r.aggregate_arrays(scored(spark, sf)).select("query_id", F.explode(top).alias("source_id")).join(ordinal, "query_id")
    seen = running(log, ["topic", "source_id"], F.floor(F.col("query_id") / 1000), ["query_id"], {"seen": F.lit(1)})
    return seen.groupBy("topic", "query_id").agg(F.sum((F.col("seen") == F.col("k")).cast("int")).alias("always"))


L3 = f"""WITH {BASE}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), s AS (SELECT label AS topic, query_id, k, count(*) OVER (PARTITION BY label, source_id ORDER BY query_id) AS seen FROM ranked JOIN o ON vec_id = query_id WHERE rank <= 5)
SELECT topic, query_id, sum((seen = k)::INT)::BIGINT AS always FROM s GROUP BY topic, query_id"""

QUERIES = {
    "l3_running_intersection": (l3_running_intersection, L3), "l5_repeated_topics": (l5_repeated_topics, L5), "l7_session_attack": (l7_session_attack, L7), "l10_evaluate": (l10_evaluate, L10), "l13_floors": (l13_floors, L13), "l14_exemption": (l14_exemption, L14),
    "l15_heavy_means": (l15_heavy_means, L15), "l16_recovery_by_noise": (l16_recovery_by_noise, None), "l18_planted_passage": (l18_planted_passage, L18), "l19_enumeration": (l19_enumeration, L19), "j12_attack_cases": (j12_attack_cases, J12), "l20_defences": (l20_defences, None), "t4_decoy_exemption": (t4_decoy_exemption, T4),
}
