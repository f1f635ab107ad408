"""Further selection, session, trust and transport queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import routing as r
from .analytics import LOG, contacts, relevant, routed, sessions
from .routing import BASE, GRADES, read, scored, shard_table, vectors


def f1_policy_labels(spark, sf):
    """Sources whose labels are all allowed; none at all is public."""
    s = read(spark, sf, "supplier")
    labels = F.filter(F.array(F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "phi"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "eu"), F.when(F.pmod("s_suppkey", F.lit(5)) == 0, "trial")), lambda x: x.isNotNull())
    return s.select("s_suppkey", labels.alias("labels")).select("s_suppkey", F.size("labels").alias("labels"), (F.size(F.array_except("labels", F.array(F.lit("phi"), F.lit("eu")))) == 0).alias("authorized"))


F1 = "SELECT s_suppkey, ((s_suppkey % 2 = 0)::INT + (s_suppkey % 3 = 0)::INT + (s_suppkey % 5 = 0)::INT) AS labels, s_suppkey % 5 <> 0 AS authorized FROM supplier"


def f4_public_view(spark, sf):
    """What each source publishes from: its public documents, or all when it has none."""
    d = read(spark, sf, "documents").select("source", "n_chars", (F.pmod("doc_id", F.lit(3)) == 0).alias("public"))
    some = d.groupBy("source").agg(F.max("public").alias("any"))
    return d.join(r.small(some), "source").where("public OR NOT any").groupBy("source").agg(F.count("*").alias("published"), F.sum("n_chars").alias("chars"))


F4 = "WITH d AS (SELECT source, n_chars, doc_id % 3 = 0 AS public FROM documents) SELECT source, count(*) AS published, sum(n_chars)::BIGINT AS chars FROM (SELECT *, bool_or(public) OVER (PARTITION BY source) AS a FROM d) WHERE public OR NOT a GROUP BY source"


def f10_versions(spark, sf):
    """Registrations in order: a version that doesn't rise over the largest accepted one is rejected."""
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("version"))
    before = F.max("version").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("stale", F.coalesce(F.col("version") <= before, F.lit(False))).groupBy("user_id").agg(F.sum((~F.col("stale")).cast("int")).alias("accepted"), F.sum(F.col("stale").cast("int")).alias("rejected"), F.max("version").alias("current"))


F10 = "WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::INT AS version, max(json_extract_string(props, '$.k')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT user_id, sum((b IS NULL OR version > b)::INT)::BIGINT AS accepted, sum((b IS NOT NULL AND version <= b)::INT)::BIGINT AS rejected, max(version) AS current FROM e GROUP BY user_id"


def r20_exposure_cost(spark, sf):
    """Weighted exposure of each line's four factors, by supplier."""
    cost = 0.4 * F.col("l_quantity") / 50 + 0.3 * F.col("l_discount") * 10 + 0.2 * F.col("l_tax") * 10 + 0.1 * F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(cost), 6).alias("exposure"), F.count("*").alias("n"))


R20 = "SELECT l_suppkey, round(avg(0.4::DOUBLE * l_quantity / 50 + 0.3::DOUBLE * l_discount * 10 + 0.2::DOUBLE * l_tax * 10 + 0.1::DOUBLE * CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS exposure, count(*) AS n FROM lineitem GROUP BY l_suppkey"


def r27_router_labels(spark, sf):
    """Sources that hold any of a topic's fifteen nearest vectors."""
    from .retrieval import scored

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored(spark, sf).withColumn("r", place).where("r <= 15").groupBy("query_id", "source_id").agg(F.count("*").alias("held"))


def _r27_sql() -> str:
    from .retrieval import SCORED

    return f"WITH {SCORED} SELECT query_id, source_id, count(*) AS held FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 15) GROUP BY ALL"


def a11_selection_coverage(spark, sf):
    """Source recall and covered share of grades of each topic's questions at three contacts."""
    from .routing import grades

    hit = routed(spark, sf).where("rank <= 3").join(grades(spark, sf).withColumnRenamed("source_id", "item"), ["query_id", "item"])
    total = grades(spark, sf).groupBy("query_id").agg(F.sum("grade").alias("all"))
    per = hit.groupBy("query_id").agg(F.sum("grade").alias("got")).join(total, "query_id").join(vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return per.groupBy("label").agg(F.round(F.avg(F.col("got") / F.col("all")), 6).alias("coverage"), F.count("*").alias("questions"))


A11 = f"WITH {BASE}, {GRADES}, t AS (SELECT query_id, sum(grade) AS a FROM grades GROUP BY query_id), h AS (SELECT r.query_id, sum(grade) AS got FROM ranked r JOIN grades g ON g.query_id = r.query_id AND g.source_id = r.source_id WHERE rank <= 3 GROUP BY r.query_id) SELECT label, round(avg(got / a), 6) AS coverage, count(*) AS questions FROM h JOIN t USING (query_id) JOIN embeddings ON vec_id = query_id GROUP BY label"


def a23_role_fractions(spark, sf):
    """What each role gets: its ten best passages of a topic among the collections it may read, by collection."""
    from ..operators import retrieval as k
    from .retrieval import scored as passages

    policy = spark.createDataFrame([("nurse", "clinical"), ("analyst", "research"), ("admin", "clinical"), ("admin", "research"), ("nurse", "public"), ("analyst", "public"), ("admin", "public"), ("guest", "public")], "role string, collection string")
    e = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, "public").when(F.col("label") < 8, "research").otherwise("clinical").alias("collection"))
    s = passages(spark, sf).join(e, "doc_id").join(r.small(policy), "collection")
    n = k.top_n(s, ["role", "query_id"], 10).groupBy("role", "collection").agg(F.count("*").alias("n"))
    total = n.groupBy("role").agg(F.sum("n").alias("all"))
    return n.join(r.small(total), "role").select("role", "collection", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def _a23_sql() -> str:
    from .retrieval import SCORED

    return f"""WITH {SCORED}, policy(role, collection) AS (VALUES ('nurse', 'clinical'), ('analyst', 'research'), ('admin', 'clinical'), ('admin', 'research'), ('nurse', 'public'), ('analyst', 'public'), ('admin', 'public'), ('guest', 'public')),
e AS (SELECT vec_id, CASE WHEN label < 5 THEN 'public' WHEN label < 8 THEN 'research' ELSE 'clinical' END AS collection FROM embeddings), t AS (SELECT role, e.collection FROM found f JOIN e ON vec_id = doc_id JOIN policy p ON p.collection = e.collection QUALIFY row_number() OVER (PARTITION BY role, query_id ORDER BY score DESC, doc_id) <= 10),
n AS (SELECT role, collection, count(*) AS n FROM t GROUP BY ALL) SELECT role, collection, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY role), 6) AS share FROM n"""


def a11_clean_metrics(spark, sf):
    """Topics at three contacts: contacts, source recall, evidence coverage, document recall at ten among the contacted, empty selections."""
    from ..operators import retrieval as k
    from .retrieval import scored as passages
    from .retrieval import topics
    from .routing import centroids

    good = vectors(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 12").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), F.col("shard").alias("source_id"))
    chosen = r.ranked_sources(r.source_arrays(topics(spark, sf), centroids(spark, sf)), 3).select("query_id", "source_id", F.lit(1).alias("chosen"))
    shown = k.top_n(passages(spark, sf).join(chosen, ["query_id", "source_id"], "left_semi"), ["query_id"], 10).select("query_id", "doc_id", F.lit(1).alias("shown"))
    per = good.join(chosen, ["query_id", "source_id"], "left").join(shown, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        (F.countDistinct(F.when(F.col("chosen") == 1, F.col("source_id"))) / F.countDistinct("source_id")).alias("s"), F.avg(F.coalesce("chosen", F.lit(0))).alias("e"), F.avg(F.coalesce("shown", F.lit(0))).alias("d")
    )
    n = chosen.groupBy("query_id").agg(F.count("*").alias("contacts"))
    both = per.join(n, "query_id", "left").na.fill(0, ["contacts"])
    r6 = lambda c: F.round(F.avg(c), 6)
    return both.agg(r6("contacts").alias("contacts"), r6("s").alias("source_recall"), r6("e").alias("evidence_coverage"), r6("d").alias("document_recall"), r6((F.col("contacts") == 0).cast("int")).alias("empty"))


def _clean_sql() -> str:
    from .retrieval import SCORED

    return f"""WITH {SCORED}, good AS (SELECT label AS query_id, vec_id AS doc_id, (vec_id % 12)::INT AS source_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 12),
b AS (SELECT a.query_id, c.source_id, max(round(list_inner_product(a.q, c.vec) / coalesce(nullif(sqrt(list_inner_product(a.q, a.q)) * sqrt(list_inner_product(c.vec, c.vec)), 0), 1), 6)) AS s FROM asked a, centroids c GROUP BY ALL),
chosen AS (SELECT query_id, source_id FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_id) <= 3), shown AS (SELECT f.query_id, f.doc_id FROM found f JOIN chosen c ON c.query_id = f.query_id AND c.source_id = f.source_id QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.doc_id) <= 10),
p AS (SELECT g.query_id, count(DISTINCT c.source_id)::DOUBLE / count(DISTINCT g.source_id) AS s, avg((c.source_id IS NOT NULL)::INT) AS e, avg((h.doc_id IS NOT NULL)::INT) AS d FROM good g LEFT JOIN chosen c ON c.query_id = g.query_id AND c.source_id = g.source_id LEFT JOIN shown h ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY g.query_id)
SELECT round((SELECT avg(n) FROM (SELECT count(*) AS n FROM chosen GROUP BY query_id)), 6) AS contacts, round(avg(s), 6) AS source_recall, round(avg(e), 6) AS evidence_coverage, round(avg(d), 6) AS document_recall, 0.0::DOUBLE AS empty FROM p"""


def a19_budget_violations(spark, sf):
    """Selections beyond the exposure budget, empty ones and turned away sources, by why they ended."""
    from .selection import r10_stop_reasons

    s = r10_stop_reasons(spark, sf)
    return s.groupBy("stop_reason").agg(F.count("*").alias("n"), F.sum((F.col("spent") > 5).cast("int")).alias("violations"), F.round(F.avg((F.col("genuine") == "").cast("int")), 6).alias("empty"), F.round(F.avg(F.when(F.col("excluded") == "", 0).otherwise(F.size(F.split("excluded", ",")))), 6).alias("excluded"))


def _a19_sql() -> str:
    from .selection import R10

    return f"SELECT stop_reason, count(*) AS n, sum((spent > 5)::INT)::BIGINT AS violations, round(avg((genuine = '')::INT), 6) AS empty, round(avg(CASE WHEN excluded = '' THEN 0 ELSE len(string_split(excluded, ',')) END), 6) AS excluded FROM ({R10}) GROUP BY stop_reason"


def l4_inference_accuracy(spark, sf):
    """Precision of guessing a topic's relevant sources from its most contacted ones."""
    e = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    log = routed(spark, sf).where("rank <= 3").join(e, "query_id").groupBy("topic", "item").agg(F.count("*").alias("n"))
    truth = relevant(spark, sf).join(e, "query_id").select("topic", "item").distinct()
    size = truth.groupBy("topic").agg(F.count("*").alias("size"))
    guess = log.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "item"))).join(size, "topic").where("r <= size")
    return guess.join(truth.withColumn("hit", F.lit(1)), ["topic", "item"], "left").groupBy("topic").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("precision"), F.count("*").alias("guessed"))


L4 = f"""WITH {BASE}, {GRADES}, c AS (SELECT label AS topic, source_id, count(*) AS n FROM ranked JOIN embeddings ON vec_id = query_id WHERE rank <= 3 GROUP BY ALL),
t AS (SELECT DISTINCT label AS topic, source_id FROM grades JOIN embeddings ON vec_id = query_id WHERE grade >= 0.1), z AS (SELECT topic, count(*) AS size FROM t GROUP BY topic),
g AS (SELECT c.*, row_number() OVER (PARTITION BY c.topic ORDER BY n DESC, source_id) AS r, size FROM c JOIN z USING (topic))
SELECT g.topic, round(count(t.source_id)::DOUBLE / count(*), 6) AS precision, count(*) AS guessed FROM g LEFT JOIN t ON t.topic = g.topic AND t.source_id = g.source_id WHERE r <= size GROUP BY g.topic"""


def session_growth(spark, sf):
    """Distinct sources that each session has shown after every contact: what an attacker knows by length."""
    first = sessions_in_order(spark, sf).withColumn("new", (F.row_number().over(Window.partitionBy("session", "source_id").orderBy("seq")) == 1).cast("int"))
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    each = first.select("session", F.row_number().over(Window.partitionBy("session").orderBy("seq")).alias("length"), F.sum("new").over(w).alias("known"))
    return each.groupBy("length").agg(F.round(F.avg("known"), 6).alias("known"), F.count("*").alias("sessions"))


def sessions_in_order(spark, sf):
    return contacts(spark, sf).select("session", "source_id", "seq")


GROWTH = f"WITH {LOG}, f AS (SELECT session, seq, (row_number() OVER (PARTITION BY session, source_id ORDER BY seq) = 1)::INT AS new FROM log), e AS (SELECT row_number() OVER (PARTITION BY session ORDER BY seq)::INT AS length, sum(new) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS known FROM f) SELECT length, round(avg(known), 6) AS known, count(*) AS sessions FROM e GROUP BY length"


def l8_set_prior(spark, sf):
    """Expected accuracy of naming a session's topic at random among the topics of its sources."""
    s = sessions(spark, sf)
    per = s.select("source_id", "topic").distinct().groupBy("source_id").agg(F.collect_set("topic").alias("topics"))
    out = s.distinct().join(r.small(per), "source_id").groupBy("session", "topic").agg(F.size(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("n"))
    return out.select("session", F.round(1 / F.col("n"), 6).alias("expected"))


L8 = f"WITH {LOG}, s AS (SELECT DISTINCT session || ':' || topic AS session, topic, source_id FROM log) SELECT a.session, round(1.0::DOUBLE / count(DISTINCT b.topic), 6) AS expected FROM s a JOIN s b USING (source_id) GROUP BY a.session"


def t3_trust_signal(spark, sf):
    """Weighted mean of five signals of each line, by supplier; weights that sum to 0 give 0."""
    x = {"a": F.col("l_discount") * 10, "b": F.col("l_tax") * 12, "c": F.col("l_quantity") / 50, "d": F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0), "e": F.col("l_linenumber") / 7}
    one, none = m.trust_signal(dict(a=0.3, b=0.25, c=0.2, d=0.15, e=0.1), x.__getitem__), m.trust_signal(dict(a=0.0, e=0.0), x.__getitem__)
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(one), 6).alias("signal"), F.max(none).alias("unweighted"))


T3 = "SELECT l_suppkey, round(avg(l_discount * 10 * 0.3::DOUBLE + l_tax * 12 * 0.25::DOUBLE + l_quantity / 50 * 0.2::DOUBLE + CASE WHEN l_linestatus = 'F' THEN 0.15::DOUBLE ELSE 0 END + l_linenumber / 7.0::DOUBLE * 0.1::DOUBLE), 6) AS signal, 0.0::DOUBLE AS unweighted FROM lineitem GROUP BY l_suppkey"


def t5_trust_resets(spark, sf):
    """Trust of each user since the sign-up that last started it anew: one under another key than before, or under none."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    e = m.lives(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.when(k > 0, k), F.to_date("ts"))
    e = e.where("event_type <> 'signup'")
    return e.groupBy("user_id", "life").agg(F.round((1 + F.sum(F.col("value") / 100)) / (F.count("*") + 2) + 1e-9, 6).alias("trust"), F.count("*").alias("observations"))


T5 = """WITH e AS (SELECT *, nullif(json_extract_string(props, '$.k')::INT % 3, 0) AS k FROM events), s AS (SELECT event_id, (k IS NULL OR k IS DISTINCT FROM lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS new FROM e WHERE event_type = 'signup'),
l AS (SELECT e.*, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts, e.event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS life FROM e LEFT JOIN s USING (event_id))
SELECT user_id, life, round((1 + sum(value / 100)) / (count(*) + 2) + 1e-9, 6) AS trust, count(*) AS observations FROM l WHERE event_type <> 'signup' GROUP BY user_id, life"""


def x4_chunks(spark, sf):
    """16,384-byte chunks that each source's documents need, and the padding."""
    n = F.ceil(F.octet_length("text") / 16384)
    return read(spark, sf, "documents").groupBy("source").agg(F.sum(n).alias("chunks"), F.sum(n * 16384 - F.octet_length("text")).alias("padding"))


X4 = "SELECT source, sum(ceil(strlen(text) / 16384.0))::BIGINT AS chunks, sum(ceil(strlen(text) / 16384.0) * 16384 - strlen(text))::BIGINT AS padding FROM documents GROUP BY source"


def x9_tier(spark, sf):
    """Download or private lookup, by the size of each source's table."""
    size = F.sum(F.octet_length("text"))
    return read(spark, sf, "documents").groupBy("source").agg(size.alias("bytes")).select("source", "bytes", F.when(F.col("bytes") <= 100_000, "download").otherwise("lookup").alias("tier"))


X9 = "SELECT source, sum(strlen(text))::BIGINT AS bytes, CASE WHEN sum(strlen(text)) <= 100000 THEN 'download' ELSE 'lookup' END AS tier FROM documents GROUP BY source"


def s11_unregistered(spark, sf):
    """Shards that no contact of the log ever named."""
    from ..sources.readers import unregistered

    named = contacts(spark, sf).where("value > 300").select("source_id").distinct()
    return unregistered(vectors(spark, sf).select(F.col("shard").alias("source_id")), named)


S11 = f"WITH {LOG} SELECT (vec_id % 12)::INT AS source_id, count(*) AS documents FROM embeddings WHERE (vec_id % 12)::INT NOT IN (SELECT source_id FROM log WHERE value > 300) GROUP BY 1"


def lead_of_best_source(spark, sf):
    """How far each question's best source is ahead of its second."""
    two = r.ranked_sources(r.aggregate_arrays(scored(spark, sf)), 2).groupBy("query_id").agg(F.max("score").alias("a"), F.min("score").alias("b"), F.count("*").alias("n"))
    return two.select("query_id", F.round(F.col("a") - F.col("b"), 6).alias("lead"), "n")


LEAD = f"WITH {BASE} SELECT query_id, round(max(score) - min(score), 6) AS lead, count(*) AS n FROM ranked WHERE rank <= 2 GROUP BY query_id"


def r25_cover_plan(spark, sf):
    """Four dummy slots per shard and user-day: what cover rounds send."""
    days = read(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    plan = days.crossJoin(r.small(shard_table(spark, sf))).withColumn("slots", F.lit(4))
    return plan.groupBy("day").agg(F.sum("slots").alias("slots"), F.countDistinct("user_id").alias("users"))


R25 = "SELECT day, count(*) * 4 * (SELECT count(DISTINCT vec_id % 12) FROM embeddings) AS slots, count(*) AS users FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY day"

QUERIES = {
    "f1_policy_labels": (f1_policy_labels, F1), "f4_public_view": (f4_public_view, F4), "f10_versions": (f10_versions, F10), "lead_of_best_source": (lead_of_best_source, LEAD), "r20_exposure_cost": (r20_exposure_cost, R20),
    "r25_cover_plan": (r25_cover_plan, R25), "r27_router_labels": (r27_router_labels, _r27_sql()), "a11_selection_coverage": (a11_selection_coverage, A11), "a11_clean_metrics": (a11_clean_metrics, _clean_sql()), "a19_budget_violations": (a19_budget_violations, _a19_sql()), "a23_role_fractions": (a23_role_fractions, _a23_sql()),
    "l4_inference_accuracy": (l4_inference_accuracy, L4), "session_growth": (session_growth, GROWTH), "l8_set_prior": (l8_set_prior, L8), "t3_trust_signal": (t3_trust_signal, T3), "t5_trust_resets": (t5_trust_resets, T5),
    "x4_chunks": (x4_chunks, X4), "x9_tier": (x9_tier, X9), "s11_unregistered": (s11_unregistered, S11),
}
