"""Retrieval quality, leakage and stream-state operators as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .quantiles import percentiles
from .routing import small
from .running import running


def hits(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """The first k of each ranked list (query_id, item, rank) with hit: whether the judgements hold it."""
    return ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "item", F.lit(1).alias("hit")), ["query_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def binary_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision, rr, ndcg, p_at_k and audit (items that are not relevant) of every query in either table.

    Recall of no relevant items is 1; precision divides by the window's length, p_at_k by k; the ideal of nDCG has as
    many items as are relevant and in the window.
    """
    h = hits(ranked, relevant, k).groupBy("query_id").agg(
        F.count("*").alias("shown"), F.sum("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    both = h.join(n, "query_id", "full").na.fill(0, ["shown", "found", "n"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", "shown")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    r6 = lambda c: F.round(c, 6)
    return both.select(
        "query_id",
        r6(F.when(F.col("n") == 0, 1.0).otherwise(F.col("found") / F.col("n"))).alias("recall"),
        r6(F.when(F.col("shown") == 0, 0.0).otherwise(F.col("found") / F.col("shown"))).alias("precision"),
        r6(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        r6(F.when(F.least("n", "shown") == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal)).alias("ndcg"),
        r6(F.col("found") / k).alias("p_at_k"),
        (F.col("shown") - F.col("found")).alias("audit"),
    )


def graded_metrics(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """ndcg (linear gains, null when the best is 0), rr_best, top1_best and captured gain (null when the ideal is 0)."""
    g = ranked.where(F.col("rank") <= k).join(grades, ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item"))).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("r") + 1)).alias("idcg"), F.max("grade").alias("most"), F.sum("grade").alias("ideal"))
    got = g.join(ideal.select("query_id", "most"), "query_id").groupBy("query_id").agg(
        F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("grade").alias("gain"), F.min(F.when(F.col("grade") == F.col("most"), F.col("rank"))).alias("first"), F.max(F.when(F.col("rank") == 1, (F.col("grade") == F.col("most")).cast("int"))).alias("top")
    )
    both = got.join(ideal, "query_id")
    return both.select(
        "query_id", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr_best"), F.coalesce("top", F.lit(0)).alias("top1_best"), F.round(F.when(F.col("ideal") > 0, F.col("gain") / F.col("ideal")), 6).alias("captured")
    )


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least, most, population deviation and exact percentiles of a metric, for groups of any size."""
    facts = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most"), F.round(F.stddev_pop(value), 6).alias("sd"),
    )
    ranks = percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95}).select(*(F.col(k).alias(f"p_{k}") for k in keys), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return facts.join(small(ranks), [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys]).drop(*(f"p_{k}" for k in keys))


def scorecard(df: DataFrame, row: str, axis: str, value: str, most: int = 1_000) -> DataFrame:
    """Mean value per row and axis value, one column for each axis value that occurs, blank where there is none.

    More than most different axis values are an error, since they would be columns.
    """
    found = [r[0] for r in df.select(axis).distinct().where(F.col(axis).isNotNull()).orderBy(axis).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} columns")
    return df.groupBy(row).pivot(axis, found).agg(F.round(F.avg(value), 6))


def source_inference(log: DataFrame, n: int) -> DataFrame:
    """The sources most contacted per topic (topic, source_id, seq): ties go to the one first observed."""
    c = log.groupBy("topic", "source_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    total = log.groupBy("topic").agg(F.countDistinct("query_id").alias("queries"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "first"))
    return c.withColumn("rank", place).where(F.col("rank") <= n).join(total, "topic").select("topic", "source_id", "n", "rank", F.round(F.col("n") / F.col("queries"), 6).alias("frequency"))


def intersection(log: DataFrame) -> DataFrame:
    """Sources contacted by every query of a topic."""
    total = log.groupBy("topic").agg(F.countDistinct("query_id").alias("queries"))
    each = log.groupBy("topic", "source_id").agg(F.countDistinct("query_id").alias("seen"))
    return each.join(total, "topic").where("seen = queries").select("topic", "source_id")


def bernoulli_attack(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Log score of every topic for every test session by its contacted sources: session, topic, score.

    Bernoulli likelihoods (c + a) / (n + 2a) over all trained sources, unseen ones ignored, with an unsmoothed prior. The
    score is the sum over all sources of log(1 - p) plus, for contacted ones, log(p / (1 - p)): absent sources cost no row.
    """
    n = train.groupBy("topic").agg(F.countDistinct("session").alias("n"))
    total = train.select("session").distinct().count()
    known = train.select("source_id").distinct()
    c = train.groupBy("topic", "source_id").agg(F.countDistinct("session").alias("c"))
    p = n.crossJoin(small(known)).join(c, ["topic", "source_id"], "left").withColumn("p", (F.coalesce("c", F.lit(0)) + alpha) / (F.col("n") + 2 * alpha))
    base = p.groupBy("topic").agg((F.sum(F.log(1 - F.col("p"))) + F.log(F.max("n") / F.lit(float(max(total, 1))))).alias("base"))
    odds = p.select("topic", "source_id", F.log(F.col("p") / (1 - F.col("p"))).alias("odds"))
    met = test.select("session", "source_id").distinct().join(small(odds), "source_id").groupBy("session", "topic").agg(F.sum("odds").alias("odds"))
    all_ = test.select("session").distinct().crossJoin(small(base)).join(met, ["session", "topic"], "left")
    return all_.select("session", "topic", F.round(F.col("base") + F.coalesce("odds", F.lit(0.0)), 6).alias("score"))


def session_attack(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Log score of every topic for every test session after each of its questions: session, length, topic, score.

    Both tables: session, length (the question's place from 1), topic, source_id (one row a contact). The prior counts
    once, each question adds its Bernoulli likelihood over all trained sources; unseen sources are ignored.
    """
    question = F.struct("session", "length")
    n = train.groupBy("topic").agg(F.countDistinct(question).alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    known = train.select("source_id").distinct()
    c = train.groupBy("topic", "source_id").agg(F.countDistinct(question).alias("c"))
    p = n.crossJoin(small(known)).join(c, ["topic", "source_id"], "left").withColumn("p", (F.coalesce("c", F.lit(0)) + alpha) / (F.col("n") + 2 * alpha))
    base = p.groupBy("topic").agg(F.sum(F.log(1 - F.col("p"))).alias("base"), F.max("n").alias("n")).crossJoin(F.broadcast(total)).select("topic", "base", F.log(F.col("n") / F.col("all")).alias("prior"))
    odds = p.select("topic", "source_id", F.log(F.col("p") / (1 - F.col("p"))).alias("odds"))
    asked = test.select("session", "length", "source_id").distinct()
    met = asked.join(small(odds), "source_id").groupBy("session", "length", "topic").agg(F.sum("odds").alias("odds"))
    each = asked.select("session", "length").distinct().crossJoin(small(base)).join(met, ["session", "length", "topic"], "left")
    so_far = F.sum(F.col("base") + F.coalesce("odds", F.lit(0.0))).over(Window.partitionBy("session", "topic").orderBy("length"))
    return each.select("session", "length", "topic", F.round(so_far + F.col("prior"), 6).alias("score"))


def evaluate(scores: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """accuracy, macro_f1, chance, top_k (the truth among the k best) and cases of scores (session, topic, score) and truth (session, truth)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "topic"))
    ranked = scores.withColumn("k", place).where(F.col("k") <= k).join(truth, "session")
    per = ranked.groupBy("session", "truth").agg(F.min_by("topic", "k").alias("guess"), F.max((F.col("topic") == F.col("truth")).cast("int")).alias("near"))
    return macro_f1(per).crossJoin(per.agg(F.round(F.avg("near"), 6).alias("top_k"), F.count("*").alias("cases")))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Accuracy and macro F1 of (truth, guess); a label in neither column is not counted."""
    t = pairs.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("t"))
    g = pairs.groupBy(F.col("guess").alias("label")).agg(F.count("*").alias("g"))
    b = pairs.where("truth = guess").groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("b"))
    f = t.join(g, "label", "full").join(b, "label", "left").na.fill(0).select(F.col("b").alias("right"), F.col("t").alias("size"), (2 * F.col("b") / (F.col("t") + F.col("g"))).alias("f1"))
    return f.agg(F.round(F.sum("right") / F.sum("size"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(1 / F.count(F.when(F.col("size") > 0, 1)), 6).alias("chance"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; two empty ones are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def overlap_within(sets: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean Jaccard over all pairs of rows of a key, and the number of pairs: keys, jaccard, pairs.

    Equal sets (sorted arrays) are grouped first and a pair of different ones weighs the product of their counts, n
    (n - 1) / 2 one with itself, so what is paired is the sets that occur, not the rows.
    """
    n = sets.groupBy(*keys, column).agg(F.count("*").alias("n"))
    other = n.select(*keys, F.col(column).alias("o"), F.col("n").alias("m"))
    different = n.join(other, keys).where(F.col(column) < F.col("o")).select(*keys, (F.col("n") * F.col("m")).alias("w"), jaccard(F.col(column), F.col("o")).alias("j"))
    same = n.select(*keys, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("w"), F.lit(1.0).alias("j"))
    return different.unionByName(same).groupBy(*keys).agg(F.round(F.sum(F.col("w") * F.col("j")) / F.sum("w"), 6).alias("jaccard"), F.sum("w").alias("pairs")).where("pairs > 0")


def bounded_trust(log: DataFrame, keys: list[str], signal: str, order: list[str], coarse: Column, alpha: float, start: float = 0.5) -> DataFrame:
    """Exponential trust per key after all its signals in order, clamped to [0, 1] at every step: keys, trust.

    A step is x -> clamp(a x + b), and steps one after another are again such a map with its own bounds. Each range
    (coarse never falls along the order) folds its rows to one map, and the key's maps are applied in order, so no array
    holds a key's whole history.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    clamp = lambda x, low, high: F.greatest(low, F.least(high, x))
    start_map = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def after(m: Column, s: Column) -> Column:
        step = lambda x: clamp(x * (1 - alpha) + s * alpha, F.lit(0.0), F.lit(1.0))
        return F.struct((m["a"] * (1 - alpha)).alias("a"), (m["b"] * (1 - alpha) + s * alpha).alias("b"), step(m["low"]).alias("low"), step(m["high"]).alias("high"))

    ranged = log.select(*keys, coarse.alias("_range"), F.struct(*order, F.col(signal).cast("double").alias("_s")).alias("x"))
    maps = ranged.groupBy(*keys, "_range").agg(F.array_sort(F.collect_list("x")).alias("x")).select(*keys, "_range", F.aggregate("x", start_map, lambda m, x: after(m, x["_s"])).alias("m"))
    each = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "m"))).alias("x"))
    return each.select(*keys, F.round(F.aggregate("x", F.lit(float(start)), lambda s, x: clamp(s * x["m"]["a"] + x["m"]["b"], x["m"]["low"], x["m"]["high"])), 6).alias("trust"))


def evidence_trust(log: DataFrame, keys: list[str], signal: str, order: list[str], coarse: Column) -> DataFrame:
    """log with trust after each row: (1 + sum of signals) / (rows + 2), which the running update equals.

    Sums run over ranges first (see running()). The added billionth makes exact halves round up in any order of summation.
    """
    both = running(log, keys, coarse, order, {"_signals": F.col(signal), "_rows": F.lit(1)})
    return both.withColumn("trust", F.round((1 + F.col("_signals")) / (F.col("_rows") + 2) + 1e-9, 6)).withColumn("observations", F.col("_rows")).drop("_signals", "_rows")


def lives(log: DataFrame, key: str, order: list[str], registers: Column, identity: Column, coarse: Column) -> DataFrame:
    """log with life: how often its key's trust has started anew up to each row.

    A registration starts it anew unless it carries the same signing identity as the key's registration before; a missing
    identity never is the same. Only registrations meet in one window, the rest count them by ranges (running()).
    """
    marked = log.withColumns({"_registers": F.coalesce(registers, F.lit(False)), "_identity": identity})
    before = F.lag("_identity").over(Window.partitionBy(key).orderBy(*order))
    fresh = marked.where("_registers").withColumn("_new", F.when(F.coalesce(F.col("_identity") == before, F.lit(False)), 0).otherwise(1))
    both = fresh.unionByName(marked.where("not _registers").withColumn("_new", F.lit(0)))
    return running(both, [key], coarse, order, {"life": F.col("_new")}).drop("_registers", "_identity", "_new")


def trust_signal(weights: dict[str, float], field=F.col) -> Column:
    """Weighted mean of signals; weights that sum to 0 give 0."""
    total = sum(weights.values())
    return sum((field(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0)) / total if total else F.lit(0.0)


def attack_cases(cases: DataFrame, attacks: DataFrame, evidence: DataFrame, dispatched: DataFrame, attacker: str, top_ks: tuple[int, ...] = (0, 2)) -> DataFrame:
    """How planted passages fare, per number of passages that stay (0: all): evidence_top_k, attack_cases, selected, cited,
    mean_rank (when selected), attack_types.

    cases: case_id, vec. attacks: attack_id, case_id, vec (of the planted passage), attack_type; an attack on a case that
    isn't there is left out, several on one case count each. evidence: case_id, source_id, score (an honest source's best
    passage). dispatched: case_id, source_id. Each contacted source gives its best passage, the attacker the planted one.
    """
    joined = attacks.join(small(cases.select("case_id", F.col("vec").alias("asked"))), "case_id").select("attack_id", "case_id", "attack_type", F.round(cosine(F.col("asked"), F.col("vec")), 6).alias("planted"))
    contacts = joined.join(dispatched, "case_id").join(evidence, ["case_id", "source_id"], "left").withColumn("score", F.when(F.col("source_id") == attacker, F.col("planted")).otherwise(F.col("score")))
    place = F.row_number().over(Window.partitionBy("attack_id").orderBy(F.desc("score"), "source_id"))
    found = contacts.where("score is not null").withColumn("rank", place).where(F.col("source_id") == attacker).select(F.col("attack_id").alias("a"), "rank")
    each = joined.join(found, F.col("attack_id") == F.col("a"), "left")
    parts = [
        each.agg(
            F.lit(k).alias("evidence_top_k"), F.count("*").alias("attack_cases"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("selected"),
            F.round(F.avg(F.coalesce((F.col("rank") <= k) if k else F.col("rank").isNotNull(), F.lit(False)).cast("int")), 6).alias("cited"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.array_join(F.array_sort(F.collect_set("attack_type")), ",").alias("attack_types"),
        )
        for k in top_ks
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
