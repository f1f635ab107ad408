"""Quality, leakage, trust and log queries over the routing results and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters, folds, logs
from ..operators import metrics as m
from ..operators import routing as r
from ..operators.running import running
from ..sources import readers
from ..sources.shared import shared_folder
from ..streaming.cover import cover_schedule, sent_ticks
from .routing import BASE, GRADES, grades, read, scored, shard_table


def routed(spark, sf):
    return r.ranked_sources(r.aggregate_arrays(scored(spark, sf))).select("query_id", F.col("source_id").alias("item"), "rank")


def relevant(spark, sf):
    """Sources with more than a tenth of their vectors of the question's label."""
    return grades(spark, sf).where("grade >= 0.1").select("query_id", F.col("source_id").alias("item"))


JUDGED = f"""{BASE}, {GRADES}, shown AS (SELECT query_id, source_id AS item, rank FROM ranked), relevant AS (SELECT query_id, source_id AS item FROM grades WHERE grade >= 0.1)"""


def a1_binary_metrics(spark, sf):
    return m.binary_metrics(routed(spark, sf), relevant(spark, sf), 5)


A1 = f"""WITH {JUDGED}, h AS (SELECT s.query_id, count(*) AS shown, count(r.item) AS found, min(CASE WHEN r.item IS NOT NULL THEN rank END) AS first, sum(CASE WHEN r.item IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM shown s LEFT JOIN relevant r USING (query_id, item) WHERE rank <= 5 GROUP BY s.query_id),
n AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
b AS (SELECT query_id, coalesce(shown, 0) AS shown, coalesce(found, 0) AS found, first, coalesce(dcg, 0) AS dcg, coalesce(n, 0) AS n FROM h FULL JOIN n USING (query_id))
SELECT query_id, round(CASE WHEN n = 0 THEN 1 ELSE found::DOUBLE / n END, 6) AS recall, round(CASE WHEN shown = 0 THEN 0 ELSE found::DOUBLE / shown END, 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
  round(CASE WHEN least(n, shown) = 0 THEN 0 ELSE dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, shown) + 1)]) END, 6) AS ndcg, round(found / 5.0::DOUBLE, 6) AS p_at_k, shown - found AS audit FROM b"""


def a5_graded_metrics(spark, sf):
    g = grades(spark, sf).withColumnRenamed("source_id", "item")
    return m.graded_metrics(routed(spark, sf), g, 5)


A5 = f"""WITH {JUDGED}, ideal AS (SELECT query_id, sum(grade / log2(r + 1)) AS idcg, max(grade) AS most, sum(grade) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, source_id) AS r FROM grades) WHERE r <= 5 GROUP BY query_id),
g AS (SELECT s.query_id, rank, coalesce(grade, 0) AS grade, most FROM shown s LEFT JOIN grades d ON d.query_id = s.query_id AND d.source_id = s.item JOIN ideal i ON i.query_id = s.query_id WHERE rank <= 5),
got AS (SELECT query_id, sum(grade / log2(rank + 1)) AS dcg, sum(grade) AS gain, min(CASE WHEN grade = most THEN rank END) AS first, max(CASE WHEN rank = 1 THEN (grade = most)::INT END) AS top FROM g GROUP BY query_id)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg END, 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr_best, coalesce(top, 0) AS top1_best, round(CASE WHEN ideal > 0 THEN gain / ideal END, 6) AS captured FROM got JOIN ideal USING (query_id)"""


def a14_group_summary(spark, sf):
    return m.summary(read(spark, sf, "events"), ["event_type"], "value")


A14 = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"


def a16_paired_bootstrap(spark, sf):
    """Interval of the difference between two rankers' reciprocal ranks."""
    rel = relevant(spark, sf)
    one = m.binary_metrics(routed(spark, sf), rel, 5).select("query_id", F.col("ndcg").alias("a"))
    mean = r.ranked_sources(r.aggregate_arrays(scored(spark, sf), "mean")).select("query_id", F.col("source_id").alias("item"), "rank")
    two = m.binary_metrics(mean, rel, 5).select("query_id", F.col("ndcg").alias("b"))
    return clusters.paired_bootstrap(one.join(two, "query_id", "full").select(F.col("query_id").alias("unit"), "a", "b"))


def a18_stream_thirds(spark, sf):
    """Mean value in the first, middle and last third of every user's events."""
    third = F.ntile(3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf, "events").select("user_id", "value", third.alias("third")).groupBy("user_id", "third").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


A18 = "SELECT user_id, third, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT user_id, value, ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS third FROM events) GROUP BY user_id, third"


def question_log(spark, sf):
    """Orders as questions, their suppliers' groups as contacted sources: records with maps, written as JSON lines and read back."""
    line = read(spark, sf, "lineitem").withColumn("node", F.concat(F.lit("node_"), F.pmod("l_suppkey", F.lit(12)).cast("string")))
    per = line.groupBy("l_orderkey", "node").agg(F.sum("l_quantity").alias("ms"), F.count("*").alias("n"), F.sum(F.round("l_extendedprice")).alias("price"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("back"), F.max((F.col("l_quantity") == 50).cast("int")).alias("full"))
    maps = lambda c: F.map_from_entries(F.collect_list(F.struct("node", c)))
    by = per.groupBy("l_orderkey").agg(maps(F.col("ms")).alias("contact_ms"), maps(F.col("n") * 100.0).alias("request"), maps(F.col("price")).alias("response"), maps(F.col("back")).alias("disclosed"), maps(F.col("n")).alias("probes"), F.sum("ms").alias("all"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("full") == 1, F.struct("node", F.lit("timeout").alias("e")))), lambda x: x.isNotNull())).alias("errors"))
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("mode"))
    stage = F.create_map(F.lit("embed"), F.lit(3.0), F.lit("routing"), F.lit(2.0), F.lit("total"), F.col("all") + 5.0)
    log = by.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").cast("string").alias("query_id"), "mode", stage.alias("stage_ms"), "contact_ms", "request", "response", "disclosed", "probes", "errors")
    path = f"{shared_folder(spark)}/question-log-{uuid.uuid4().hex}"
    readers.append_log(log, path)
    return spark.read.schema(logs.RECORD).json(path)


def a20_transport(spark, sf):
    """Times and bytes by mode from the log's maps."""
    out = logs.transport(question_log(spark, sf))
    return out.select("mode", "questions", "errors", *(F.round(c, 6).alias(c) for c in ("contacts", "total_ms", "total_p95", "contact_ms", "contact_p95", "request_bytes", "response_bytes")))


QUESTIONS = """per AS (SELECT l_orderkey, o_orderpriority AS mode, l_suppkey % 12 AS node, sum(l_quantity) AS ms, count(*) * 100.0::DOUBLE AS asked, sum(round(l_extendedprice)) AS got, sum((l_returnflag = 'R')::INT) AS disclosed, count(*) AS probes, max((l_quantity = 50)::INT) AS err
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
A20 = f"""WITH {QUESTIONS}, q AS (SELECT l_orderkey, mode, count(*) AS contacts, sum(ms) + 5 AS total, sum(asked) AS asked, sum(got) AS got, sum(err) AS errors FROM per GROUP BY l_orderkey, mode),
c AS (SELECT mode, round(avg(ms), 6) AS contact_ms, round(quantile_cont(ms, 0.95), 6) AS contact_p95 FROM per GROUP BY mode)
SELECT q.mode, count(*) AS questions, sum(errors)::BIGINT AS errors, round(avg(contacts), 6) AS contacts, round(avg(total), 6) AS total_ms, round(quantile_cont(total, 0.95), 6) AS total_p95, any_value(contact_ms) AS contact_ms, any_value(contact_p95) AS contact_p95, round(avg(asked), 6) AS request_bytes, round(avg(got), 6) AS response_bytes FROM q JOIN c USING (mode) GROUP BY q.mode"""


def a21_modelled_latency(spark, sf):
    """Each question's device time and its slowest source: round trip, work and transfer."""
    out = logs.modelled_latency(question_log(spark, sf))
    return out.select(F.col("query_id").cast("long").alias("l_orderkey"), F.round("latency", 6).alias("latency"), F.col("contacts").cast("long").alias("contacts"))


A21 = f"WITH {QUESTIONS} SELECT l_orderkey, round(5 + max(40.0::DOUBLE + ms + got * 8000.0::DOUBLE / 1e8), 6) AS latency, count(*) AS contacts FROM per GROUP BY l_orderkey"


def a24_scorecard(spark, sf):
    """Configurations by axis: mean value per event type and month, blank where there is none; the types are those of the data."""
    e = read(spark, sf, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), "event_type", "value")
    return m.scorecard(e, "month", "event_type", "value")


A24 = "SELECT strftime(ts, '%Y-%m') AS month, " + ", ".join(f"round(avg(CASE WHEN event_type = '{k}' THEN value END), 6) AS \"{k}\"" for k in ["click", "error", "purchase", "signup", "view"]) + " FROM events GROUP BY 1"


def a25_majority_topic(spark, sf):
    """Each user's most frequent event type; ties go to the one first seen."""
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    return c.withColumn("r", place).where("r = 1").select("user_id", F.col("event_type").alias("topic"), "n")


A25 = "SELECT user_id, event_type AS topic, n FROM (SELECT user_id, event_type, count(*) AS n, min(struct_pack(t := ts, e := event_id)) AS first FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1"


def a26_accuracy_rollup(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return d.rollup("lang").agg(F.round(F.avg("quality"), 6).alias("accuracy"), F.count("*").alias("n")).select(F.coalesce("lang", F.lit("all")).alias("subset"), "accuracy", "n")


A26 = "SELECT coalesce(lang, 'all') AS subset, round(avg(quality), 6) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)"


def contacts(spark, sf):
    """The event stream as contacts: user's session, topic, source by the property k, order."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("topic"), F.pmod(k, F.lit(12)).cast("int").alias("source_id"), F.col("event_id").alias("query_id"), F.struct("ts", "event_id").alias("seq"), "value", "ts")


LOG = "log AS (SELECT user_id AS session, event_type AS topic, (json_extract_string(props, '$.k')::INT % 12)::INT AS source_id, event_id AS query_id, struct_pack(t := ts, e := event_id) AS seq, value, ts FROM events)"


def l1_source_inference(spark, sf):
    return m.source_inference(contacts(spark, sf), 3)


L1 = f"WITH {LOG}, c AS (SELECT topic, source_id, count(*) AS n, min(seq) AS first FROM log GROUP BY ALL), q AS (SELECT topic, count(DISTINCT query_id) AS q FROM log GROUP BY topic) SELECT topic, source_id, n, rank, round(n::DOUBLE / q, 6) AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first)::INT AS rank FROM c) JOIN q USING (topic) WHERE rank <= 3"


def l3_intersection(spark, sf):
    """Routed sources that every question of a topic was sent to, five contacts each."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    log = routed(spark, sf).where("rank <= 5").join(e, "query_id").select("topic", "query_id", F.col("item").alias("source_id"))
    seen = log.groupBy("topic", "source_id").agg(F.countDistinct("query_id").alias("seen"))
    return seen.join(m.intersection(log).withColumn("always", F.lit(True)), ["topic", "source_id"], "left").select("topic", "source_id", "seen", F.coalesce("always", F.lit(False)).alias("always"))


L3 = f"WITH {BASE}, s AS (SELECT label AS topic, source_id, count(*) AS seen FROM ranked JOIN embeddings ON vec_id = query_id WHERE rank <= 5 GROUP BY ALL), n AS (SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY label) SELECT topic, source_id, seen, seen = n AS always FROM s JOIN n USING (topic)"


def sessions(spark, sf):
    c = contacts(spark, sf)
    return c.select(F.concat_ws(":", F.col("session").cast("string"), "topic").alias("session"), "topic", "source_id")


def l6_history_attacker(spark, sf):
    """Topic of every session guessed from the sources that it contacted."""
    s = sessions(spark, sf)
    score = m.bernoulli_attack(s, s)
    guess = score.groupBy("session").agg(F.max(F.struct("score", F.col("topic").alias("guess"))).alias("g"))
    return guess.select("session", F.col("g.guess").alias("guess"), F.col("g.score").alias("score"))


L6_CORE = f"""{LOG}, s AS (SELECT DISTINCT session || ':' || topic AS session, topic, source_id FROM log), n AS (SELECT topic, count(DISTINCT session)::DOUBLE AS n FROM s GROUP BY topic), k AS (SELECT DISTINCT source_id FROM s),
c AS (SELECT topic, source_id, count(*) AS c FROM s GROUP BY ALL), p AS (SELECT n.topic, k.source_id, (coalesce(c, 0) + 1.0::DOUBLE) / (n + 2.0) AS p, n FROM n CROSS JOIN k LEFT JOIN c ON c.topic = n.topic AND c.source_id = k.source_id),
a AS (SELECT x.session, p.topic, round(sum(CASE WHEN s.source_id IS NULL THEN ln(1 - p) ELSE ln(p) END) + ln(max(n) / (SELECT count(DISTINCT session) FROM s)), 6) AS score FROM (SELECT DISTINCT session FROM s) x CROSS JOIN p LEFT JOIN s ON s.session = x.session AND s.source_id = p.source_id GROUP BY x.session, p.topic),
g AS (SELECT session, topic AS guess, score FROM a QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, topic DESC) = 1)"""
L6 = f"WITH {L6_CORE} SELECT session, guess, score FROM g"


def l9_macro_f1(spark, sf):
    g = l6_history_attacker(spark, sf)
    return m.macro_f1(g.select(F.split("session", ":")[1].alias("truth"), "guess"))


L9 = f"""WITH {L6_CORE}, x AS (SELECT split_part(session, ':', 2) AS truth, guess FROM g), l AS (SELECT truth AS label FROM x UNION SELECT guess FROM x),
f AS (SELECT label, (SELECT count(*) FROM x WHERE truth = label) AS t, (SELECT count(*) FROM x WHERE guess = label) AS q, (SELECT count(*) FROM x WHERE truth = label AND guess = label) AS b FROM l)
SELECT round(sum(b)::DOUBLE / sum(t), 6) AS accuracy, round(avg(2.0::DOUBLE * b / (t + q)), 6) AS macro_f1, round(1.0::DOUBLE / count(CASE WHEN t > 0 THEN 1 END), 6) AS chance FROM f"""


def l12_source_attack(spark, sf):
    """Most contacted source of each session; a tie's credit is shared."""
    c = contacts(spark, sf).groupBy("session", "source_id").agg(F.count("*").alias("n"))
    top = c.withColumn("most", F.max("n").over(Window.partitionBy("session"))).where("n = most")
    return top.groupBy("session").agg(F.min("source_id").alias("guess"), F.round(1 / F.count("*"), 6).alias("credit"), F.max("n").alias("n"))


L12 = f"WITH {LOG}, c AS (SELECT session, source_id, count(*) AS n FROM log GROUP BY ALL) SELECT session, min(source_id) AS guess, round(1.0::DOUBLE / count(*), 6) AS credit, max(n) AS n FROM (SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY session)) GROUP BY session"


def l11_dispatch_overlap(spark, sf):
    """Mean Jaccard of all pairs of questions' dispatched sets within each topic: equal sets are counted once and weighed."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    top = F.array_sort(F.transform(F.slice(r.by_score(F.col("sources")), 1, 3), lambda x: x["source_id"]))
    sets = r.aggregate_arrays(scored(spark, sf)).select("query_id", top.alias("s")).join(e, "query_id")
    return m.overlap_within(sets, ["topic"], "s")


L11 = f"""WITH {BASE}, s AS (SELECT query_id, list(source_id) AS s FROM ranked WHERE rank <= 3 GROUP BY query_id), q AS (SELECT label AS topic, query_id, s FROM s JOIN embeddings ON vec_id = query_id)
SELECT a.topic, round(avg(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))), 6) AS jaccard, count(*) AS pairs FROM q a JOIN q b ON a.topic = b.topic AND a.query_id < b.query_id GROUP BY a.topic"""


def j10_first_pairs(spark, sf):
    """The same over each topic's first forty questions only, pair by pair."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    first = e.withColumn("ix", F.row_number().over(Window.partitionBy("topic").orderBy("query_id"))).where("ix <= 40")
    top = F.transform(F.slice(r.by_score(F.col("sources")), 1, 3), lambda x: x["source_id"])
    sets = r.aggregate_arrays(scored(spark, sf)).select("query_id", top.alias("s")).join(first, "query_id")
    pairs = sets.join(sets.select("topic", F.col("ix").alias("jx"), F.col("s").alias("o")), "topic").where("ix < jx")
    return pairs.groupBy("topic").agg(F.round(F.avg(m.jaccard(F.col("s"), F.col("o"))), 6).alias("jaccard"), F.count("*").alias("pairs"))


J10 = f"""WITH {BASE}, s AS (SELECT query_id, list(source_id) AS s FROM ranked WHERE rank <= 3 GROUP BY query_id), q AS (SELECT label AS topic, query_id, s, row_number() OVER (PARTITION BY label ORDER BY query_id) AS ix FROM s JOIN embeddings ON vec_id = query_id QUALIFY ix <= 40)
SELECT a.topic, round(avg(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))), 6) AS jaccard, count(*) AS pairs FROM q a JOIN q b ON a.topic = b.topic AND a.ix < b.ix GROUP BY a.topic"""


def t1_evidence_trust(spark, sf):
    log = contacts(spark, sf).withColumn("signal", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)))
    return m.evidence_trust(log, ["source_id"], "signal", ["seq"], F.to_date("ts")).select("query_id", "source_id", "trust")


T1 = f"WITH {LOG} SELECT query_id, source_id, round((1 + sum(least(1, greatest(0, value / 100))) OVER w) / (count(*) OVER w + 2) + 1e-9, 6) AS trust FROM log WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def t2_bounded_trust(spark, sf):
    """Exponential trust of every user, clamped at each event."""
    e = read(spark, sf, "events").withColumn("s", (F.col("value") - 20) / 40)
    return m.bounded_trust(e, ["user_id"], "s", ["ts", "event_id"], F.to_date("ts"), 0.2)


T2 = """SELECT user_id, round(list_reduce(list_prepend(0.5::DOUBLE, list((value - 20) / 40 ORDER BY ts, event_id)), lambda s, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, s * 0.8::DOUBLE + x * 0.2::DOUBLE))), 6) AS trust FROM events GROUP BY user_id"""


def t6_legacy_signal(spark, sf):
    """Best citation of each source and topic, 0 without any."""
    c = contacts(spark, sf)
    grid = c.select("topic").distinct().crossJoin(r.small(shard_table(spark, sf)))
    return grid.join(c.groupBy("topic", "source_id").agg(F.max("value").alias("s")), ["topic", "source_id"], "left").select("topic", "source_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("signal"))


T6 = f"WITH {LOG} SELECT t.topic, s.source_id, round(coalesce(max(value), 0), 6) AS signal FROM (SELECT DISTINCT topic FROM log) t CROSS JOIN (SELECT DISTINCT (vec_id % 12)::INT AS source_id FROM embeddings) s LEFT JOIN log USING (topic, source_id) GROUP BY ALL"


def t8_linkability(spark, sf):
    """Share of a topic's earlier queries that chose the same source."""
    c = contacts(spark, sf)
    both = running(running(c, ["topic"], F.to_date("ts"), ["seq"], {"all": F.lit(1)}), ["topic", "source_id"], F.to_date("ts"), ["seq"], {"same": F.lit(1)})
    return both.select("query_id", F.round((F.col("same") - 1) / F.greatest(F.lit(1), F.col("all") - 1), 6).alias("linkability"))


T8 = f"WITH {LOG} SELECT query_id, round(count(*) OVER (PARTITION BY topic, source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 6) AS linkability FROM log"


def t9_daily_budget(spark, sf):
    """Points that each user is granted per day within 120; a request that doesn't fit is refused and not charged."""
    e = read(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", F.round("value", 2).alias("cost"))
    g = folds.granted(e, ["user_id", "day"], ["ts", "event_id"], F.col("cost"), 120)
    return g.groupBy("user_id", "day").agg(F.count("*").cast("int").alias("asked"), F.sum(F.col("granted").cast("int")).cast("int").alias("granted"), F.round(F.sum(F.when(F.col("granted"), F.col("cost").cast("decimal(18,6)")).otherwise(0)).cast("double"), 2).alias("spent"))


T9 = """SELECT user_id, day, len(c) AS asked, r.n::INT AS granted, round(r.s::DOUBLE / 100, 2) AS spent FROM (
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(round(value * 100)::BIGINT ORDER BY ts, event_id) AS c,
  list_reduce(list_prepend({'s': 0::BIGINT, 'n': 0::BIGINT}, list({'s': round(value * 100)::BIGINT, 'n': 0::BIGINT} ORDER BY ts, event_id)), lambda a, x: CASE WHEN a.s + x.s <= 12000 THEN {'s': a.s + x.s, 'n': a.n + 1} ELSE a END) AS r FROM events GROUP BY user_id, day)"""


def t10_cover_traffic(spark, sf):
    """The tick at which each user's question is sent when one goes per hour: the first free one after it is asked."""
    return sent_ticks(_asked(spark, sf)).select(F.col("device").alias("user_id"), F.col("question").alias("event_id"), "tick")


def _asked(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("question"), "ts")


T10 = "SELECT user_id, event_id, (j + max(arrived - j) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS tick FROM (SELECT *, floor(epoch(ts) / 3600)::BIGINT AS arrived, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events)"


def t10_cover_rounds(spark, sf):
    """Rounds of every user from the first question to the log's last hour: all, with a question, as cover; and what still waits."""
    asked = _asked(spark, sf)
    until = asked.agg(F.max(F.floor(F.unix_timestamp("ts") / 3600))).first()[0]
    sent = cover_schedule(asked, int(until or 0)).groupBy("device").agg(F.count("*").alias("rounds"), F.count("question").alias("questions"), F.count_if(F.col("kind") == "cover").alias("covers"))
    n = asked.groupBy("device").agg(F.count("*").alias("n"))
    return n.join(sent, "device").select(F.col("device").alias("user_id"), "rounds", "questions", "covers", (F.col("n") - F.col("questions")).alias("waiting"))


T10_ROUNDS = f"""WITH t AS ({T10}), e AS (SELECT user_id, min(floor(epoch(ts) / 3600)::BIGINT) AS first FROM events GROUP BY user_id), u AS (SELECT max(floor(epoch(ts) / 3600)::BIGINT) AS until FROM events),
c AS (SELECT user_id, any_value(until) - any_value(first) + 1 AS rounds, count(*) FILTER (tick <= until) AS questions, count(*) FILTER (tick > until) AS waiting FROM t JOIN e USING (user_id), u GROUP BY user_id)
SELECT user_id, rounds, questions, rounds - questions AS covers, waiting FROM c"""


def t11_cache_refresh(spark, sf):
    """How often each user's cached table is fetched: whenever the key's epoch (day) differs from the last seen."""
    e = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("epoch"), "ts", "event_id")
    last = F.lag("epoch").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("new", (last.isNull() | (last != F.col("epoch"))).cast("int")).groupBy("user_id").agg(F.sum("new").alias("fetches"), F.count("*").alias("uses"))


T11 = "SELECT user_id, sum((l IS NULL OR l <> d)::INT)::BIGINT AS fetches, count(*) AS uses FROM (SELECT user_id, ts::DATE AS d, lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) GROUP BY user_id"


def s17_newest_wins(spark, sf):
    """Each user's and type's latest row."""
    e = read(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", F.col("x.event_id").alias("event_id"), F.round("x.value", 6).alias("value"))


S17 = "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def s14_embedding_cache(spark, sf):
    """Texts by cache key: how many rows ask for each distinct key, and whether another row's copy serves them."""
    d = read(spark, sf, "documents")
    key = F.sha2(F.concat(F.lit("model|"), F.col("text")), 256)
    return d.groupBy(key.alias("key")).agg(F.count("*").alias("asked"), F.min("doc_id").alias("embedded"))


S14 = "SELECT sha256('model|' || text) AS key, count(*) AS asked, min(doc_id) AS embedded FROM documents GROUP BY 1"


def s19_resume(spark, sf):
    """Documents without a label yet: what a resumed run still has to do."""
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("todo"))


S19 = "SELECT lang, count(*) AS todo FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang"


def s1_corpus(spark, sf):
    """Title and text as one passage."""
    title, body = F.trim("source"), F.trim("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(F.when(title != "", F.concat_ws(". ", title, body)).otherwise(body)).alias("digest"))


S1 = "SELECT doc_id, md5(CASE WHEN trim(source) <> '' THEN trim(source) || '. ' || trim(text) ELSE trim(text) END) AS digest FROM documents"

QUERIES = {
    "a1_binary_metrics": (a1_binary_metrics, A1), "a5_graded_metrics": (a5_graded_metrics, A5), "a14_group_summary": (a14_group_summary, A14), "a16_paired_bootstrap": (a16_paired_bootstrap, None), "a18_stream_thirds": (a18_stream_thirds, A18),
    "a20_transport": (a20_transport, A20), "a21_modelled_latency": (a21_modelled_latency, A21), "a24_scorecard": (a24_scorecard, A24), "a25_majority_topic": (a25_majority_topic, A25), "a26_accuracy_rollup": (a26_accuracy_rollup, A26),
    "l1_source_inference": (l1_source_inference, L1), "l3_intersection": (l3_intersection, L3), "l6_history_attacker": (l6_history_attacker, L6), "l9_macro_f1": (l9_macro_f1, L9), "l11_dispatch_overlap": (l11_dispatch_overlap, L11), "j10_first_pairs": (j10_first_pairs, J10), "l12_source_attack": (l12_source_attack, L12),
    "t1_evidence_trust": (t1_evidence_trust, T1), "t2_bounded_trust": (t2_bounded_trust, T2), "t6_legacy_signal": (t6_legacy_signal, T6), "t8_linkability": (t8_linkability, T8), "t9_daily_budget": (t9_daily_budget, T9), "t10_cover_traffic": (t10_cover_traffic, T10), "t10_cover_rounds": (t10_cover_rounds, T10_ROUNDS), "t11_cache_refresh": (t11_cache_refresh, T11),
    "s1_corpus": (s1_corpus, S1), "s14_embedding_cache": (s14_embedding_cache, S14), "s17_newest_wins": (s17_newest_wins, S17), "s19_resume": (s19_resume, S19),
}
