"""Source ranking and budgeted selection."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clip01, cosine, dot, is_finite, norm, normalise, widen

#: Sources' centroids are broadcast up to this many rows; beyond it each question meets them in a shuffled join.
BROADCAST_CENTROIDS = 200_000
#: Tables of sources (names, trust, means) are broadcast up to this many rows.
BROADCAST_SOURCES = 500_000


#: Bytes that a broadcast side may have, whatever its number of rows.
BROADCAST_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: text by its length, arrays of numbers by their elements, other nested values as JSON."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if kind.startswith("array<") and "<" not in kind[6:] and "string" not in kind:
            return F.greatest(F.size(c), F.lit(0)) * 8
        if "<" in kind:
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)

    return sum((one(f.name, f.dataType.simpleString()) for f in df.schema), F.lit(0)).cast("long")


def small(df: DataFrame, most: int = BROADCAST_SOURCES) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes allow it; else Spark chooses the join."""
    n, size = df.limit(most + 1).select(row_bytes(df).alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= BROADCAST_BYTES else df


def published(centroids: DataFrame) -> DataFrame:
    """All centroids (source_id, centroid_ix, vec) as one row: an array of sources with their centroids and norms, in order."""
    c = centroids.select("source_id", "centroid_ix", widen(F.col("vec")).alias("vec")).withColumn("norm", norm(F.col("vec")))
    each = c.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("centroid_ix", "vec", "norm"))).alias("centroids"))
    return each.agg(F.array_sort(F.collect_list(F.struct("source_id", "centroids"))).alias("sources"))


def centroid_arrays(queries: DataFrame, centroids: DataFrame, clip: bool = False, product: bool = False) -> DataFrame:
    """Queries (query_id, vec) with scored: array<struct<source_id, scores array<struct<centroid_ix, score>>>>, in order.

    What sources publish is small beside the questions: as one broadcast row it meets every question in a map, and all
    of a question's scores are in its own row, so ranking needs no shuffle. Beyond BROADCAST_CENTROIDS the centroids go
    through a join by parts of the table instead and are gathered per question; the rows are the same. product scores by
    the product of the question's unit vector with the centroid as it is.
    """
    asked = widen(F.col("vec"))
    q = queries.select("query_id", (normalise(asked) if product else asked).alias("qv")).withColumn("qn", norm(F.col("qv")))

    def score(c: Column) -> Column:
        s = dot(F.col("qv"), c["vec"]) if product else cosine(F.col("qv"), c["vec"], F.col("qn"), c["norm"])
        return F.round(clip01(s) if clip else s, 6)

    inner = lambda x: F.transform(x["centroids"], lambda c: F.struct(c["centroid_ix"].alias("centroid_ix"), score(c).alias("score")))
    n, elements = centroids.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    parts = max(math.ceil(n / BROADCAST_CENTROIDS), math.ceil(elements * 8 / BROADCAST_BYTES))
    if parts <= 1:
        rows = q.crossJoin(F.broadcast(published(centroids)))
        return rows.select("query_id", F.transform("sources", lambda x: F.struct(x["source_id"].alias("source_id"), inner(x).alias("scores"))).alias("scored"))
    dealt = centroids.withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(parts)))
    sources = dealt.select("part", "source_id", "centroid_ix", widen(F.col("vec")).alias("vec")).withColumn("norm", norm(F.col("vec"))).groupBy("part", "source_id").agg(F.array_sort(F.collect_list(F.struct("centroid_ix", "vec", "norm"))).alias("centroids"))
    asked = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    each = asked.join(sources, "part").select("query_id", F.struct("source_id", inner(F.struct("centroids")).alias("scores")).alias("x"))
    return each.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("scored"))


def centroid_scores(queries: DataFrame, centroids: DataFrame, clip: bool = False) -> DataFrame:
    """Cosine of each query with every centroid: one row per pair (query_id, source_id, centroid_ix, score)."""
    each = centroid_arrays(queries, centroids, clip).select("query_id", F.explode("scored").alias("s"))
    return each.select("query_id", F.col("s.source_id").alias("source_id"), F.explode("s.scores").alias("c")).select("query_id", "source_id", "c.centroid_ix", "c.score")


def _aggregate(scores: Column, method: str, top_r: int) -> Column:
    s = F.transform(scores, lambda x: x["score"])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    if method == "max":
        out = F.array_max(s)
    elif method == "mean":
        out = mean(s)
    elif method == "top_r_mean":
        out = mean(F.slice(F.sort_array(s, asc=False), 1, top_r))
    else:
        raise ValueError(f"no such method: {method}")
    return F.round(out, 8)


def source_arrays(queries: DataFrame, centroids: DataFrame, method: str = "max", top_r: int = 3, clip: bool = False) -> DataFrame:
    """Queries with sources: array<struct<source_id, score>>, one score per source; see aggregate_scores()."""
    return aggregate_arrays(centroid_arrays(queries, centroids, clip), method, top_r)


def aggregate_arrays(scored: DataFrame, method: str = "max", top_r: int = 3) -> DataFrame:
    one = lambda x: F.struct(x["source_id"].alias("source_id"), _aggregate(x["scores"], method, top_r).alias("score"))
    return scored.select("query_id", F.transform("scored", one).alias("sources"))


def aggregate_scores(scored: DataFrame, method: str = "max", top_r: int = 3) -> DataFrame:
    """One score per query and source, from centroid_arrays(): max, mean, or the mean of the top_r largest."""
    return aggregate_arrays(scored, method, top_r).select("query_id", F.explode("sources").alias("x")).select("query_id", "x.source_id", "x.score")


def by_score(sources: Column) -> Column:
    """An array of structs with score and source_id by falling score; ties go to the smaller source_id."""
    keyed = F.transform(sources, lambda x: F.struct((-x["score"]).alias("k"), x["source_id"].alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def ranked_sources(sources: DataFrame, top_k: int = 0) -> DataFrame:
    """Rank 1, 2, ... per query of source_arrays() by falling score, within each row; top_k 0 keeps all."""
    order = by_score(F.col("sources"))
    each = sources.select("query_id", F.posexplode(F.slice(order, 1, top_k) if top_k else order).alias("p", "x"))
    return each.select("query_id", "x.source_id", "x.score", (F.col("p") + 1).alias("rank"))


def rank(scores: DataFrame, top_k: int = 0, order: list | None = None) -> DataFrame:
    """Rank 1, 2, ... per query by falling score; top_k 0 keeps all. Ties go to the smaller source_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.col("source_id")])))
    out = scores.withColumn("rank", place)
    return out.where(F.col("rank") <= top_k) if top_k else out


def cosine_router(queries: DataFrame, centroids: DataFrame, method: str = "max", top_k: int = 3) -> DataFrame:
    return ranked_sources(source_arrays(queries, centroids, method), top_k)


def random_router(queries: DataFrame, sources: DataFrame, seed: str, top_k: int = 0) -> DataFrame:
    """An order of the sources that depends on the seed and the query alone."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col("query_id").cast("string"), F.col("source_id").cast("string")), 256)
    return rank(queries.select("query_id").crossJoin(small(sources.select("source_id"))).withColumn("key", key), top_k, [F.col("key")]).drop("key")


def broadcast_router(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source for every query."""
    return queries.select("query_id").crossJoin(small(sources.select("source_id")))


def oracle_router(queries: DataFrame, qrels: DataFrame, sources: DataFrame, top_k: int = 0) -> DataFrame:
    """Known sources that the judgements (query_id, source_id, grade) name, best first."""
    if "query_id" not in queries.columns:
        raise ValueError("query_id is required")
    known = qrels.join(queries.select("query_id"), "query_id", "left_semi").join(sources.select("source_id"), "source_id", "left_semi")
    return rank(known.withColumnRenamed("grade", "score"), top_k)


def penalised_trust(mean: Column, observations: Column, least: int = 10) -> Column:
    """Trust drawn to 0.5 while observations are few."""
    share = observations / float(least)
    return F.when(observations >= least, mean).otherwise(share * mean + (1 - share) * 0.5)


def candidate_score(weights: dict[str, float], field: Callable[[str], Column] = F.col) -> Column:
    """Weighted benefits less weighted costs of a candidate's features."""
    gains = [field(c) * F.lit(weights[c]) for c in ("relevance", "trust", "authorized")]
    costs = [field(c) * F.lit(weights[c]) for c in ("exposure", "communication", "latency", "hijack")]
    return gains[0] + gains[1] + gains[2] - (costs[0] + costs[1] + costs[2] + costs[3])


def gate(candidates: DataFrame, minimum_trust: float, width: int, model: str | None = None) -> DataFrame:
    """candidates with reason: why a source is left out, or null. Rejected rows stay.

    candidates: authorized, trust, vec, and with a model also described (a vector) and described_by (its model).
    """
    reason = F.when(~F.coalesce("authorized", F.lit(False)), "unauthorized_or_missing_evidence").when(F.col("trust") < minimum_trust, "insufficient_trust").when(~is_finite(F.col("vec"), width), "invalid_profile")
    if model is not None:
        reason = reason.when(F.col("described").isNull() | (F.coalesce("described_by", F.lit("")) != model), "missing_or_incompatible_description").when(~is_finite(F.col("described"), width), "invalid_description_embedding")
    return candidates.withColumn("reason", reason)


def skip_greedy(items: Column, budget: Column) -> Column:
    """Ids kept of an ordered array<struct<id,cost,protected>>: what doesn't fit is skipped, not charged; protected always stays and is charged."""
    empty = F.struct(F.lit(0).cast("decimal(18,6)").alias("spent"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = x["protected"] | ((s["spent"] + x["cost"]) <= budget)
        return F.when(fits, F.struct((s["spent"] + x["cost"]).cast("decimal(18,6)").alias("spent"), F.concat(s["kept"], F.array(x["id"])).alias("kept"))).otherwise(s)

    return F.aggregate(items, empty, step)


def build_cells(sources: DataFrame, size: int) -> DataFrame:
    """Anonymity cells of sources (source_id, grp): dealt in turn across groups, cut by size, a short last one merged.

    A source's place is the number of sources with an earlier turn, plus the groups before its own that still have a
    source at this turn: both follow from the groups' sizes, so no task orders all sources.
    """
    turn = F.row_number().over(Window.partitionBy("grp").orderBy("source_id"))
    dealt = sources.select("source_id", "grp", turn.alias("turn"))
    sizes = sources.groupBy("grp").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("grp", "n")).alias("sizes"), F.sum("n").alias("total"))
    earlier = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, g: s + F.least(g["n"], F.col("turn") - 1))
    level = F.size(F.filter("sizes", lambda g: (g["grp"] < F.col("grp")) & (g["n"] >= F.col("turn"))))
    placed = dealt.crossJoin(F.broadcast(sizes)).withColumn("place", earlier + level)
    last = F.greatest(F.floor(F.col("total") / size) - 1, F.lit(0))
    return placed.select("source_id", "grp", F.least(F.floor(F.col("place") / size), last).cast("int").alias("cell"))


def topic_stable_sample(pool: DataFrame, topic: Column, count: int, keys: list[str]) -> DataFrame:
    """count ids per key in the order of a hash of topic and id: the same for every query of a topic."""
    key = F.sha2(F.concat_ws(":", topic.cast("string"), F.col("source_id").cast("string")), 256)
    return pool.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("key"))).where(F.col("rank") <= count).drop("key")


def add_decoys(genuine: DataFrame, sources: DataFrame, topics: DataFrame, m: int) -> DataFrame:
    """Genuine sources of each query (query_id, source_id) and topic-stable decoys up to m in all: role tells which."""
    n = genuine.groupBy("query_id").agg(F.count("*").alias("have"))
    rest = topics.crossJoin(small(sources.select("source_id"))).join(genuine, ["query_id", "source_id"], "left_anti").join(n, "query_id")
    key = F.sha2(F.concat_ws(":", F.col("topic").cast("string"), F.col("source_id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(key))
    decoys = rest.withColumn("place", place).where(F.col("place") <= m - F.col("have"))
    return genuine.select("query_id", "source_id", F.lit("genuine").alias("role")).unionByName(decoys.select("query_id", "source_id", F.lit("decoy").alias("role")))


def probe_plan(scored: DataFrame, nodes: DataFrame, probes: int) -> DataFrame:
    """Global best clusters per query of centroid_arrays(), and equally many slots for every node.

    One row per query, node and slot; kind real with a cluster, or dummy. All within the query's row: no shuffle.
    """
    if probes < 1:
        raise ValueError("at least one probe")
    flat = F.flatten(F.transform("scored", lambda s: F.transform(s["scores"], lambda c: F.struct((-c["score"]).alias("k"), s["source_id"].alias("source_id"), c["centroid_ix"].alias("centroid_ix")))))
    best = scored.select("query_id", F.slice(F.array_sort(flat), 1, probes).alias("best"))
    slots = best.crossJoin(small(nodes.select("source_id"))).withColumn("mine", F.filter("best", lambda c: c["source_id"] == F.col("source_id")))
    each = slots.select("query_id", "source_id", "mine", F.explode(F.sequence(F.lit(1), F.lit(probes))).alias("slot"))
    return each.select("query_id", "source_id", "slot", F.get("mine", F.col("slot") - 1)["centroid_ix"].alias("centroid_ix")).withColumn("kind", F.when(F.col("centroid_ix").isNull(), "dummy").otherwise("real"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_overlap(centroids: DataFrame) -> DataFrame:
    """Per source (source_id) others: array<struct<source_id, overlap>>, the largest cosine of their centroids, clipped to [0, 1].

    A join of what sources publish with itself: one broadcast side after a size check.
    """
    c = centroids.select("source_id", normalise(widen(F.col("vec"))).alias("u"))
    other = c.select(F.col("source_id").alias("other"), F.col("u").alias("w"))
    pairs = c.crossJoin(small(other, BROADCAST_CENTROIDS)).groupBy("source_id", "other").agg(F.round(clip01(F.max(dot(F.col("u"), F.col("w")))), 9).alias("overlap"))
    return pairs.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("source_id"), "overlap"))).alias("others"))


def smart_route(
    candidates: DataFrame, budget: float, max_sources: int, redundancy_weight: float = 0.5, minimum_gain: float = 0.0, policy: str = "overlap", score_floor: float = 0.8
) -> DataFrame:
    """Greedy gain per cost with redundancy, and why it ended: query_id, picks, spent, stop_reason.

    candidates: one row per query with sources: array<struct<source_id, relevance, trust, cost, others>> of eligible
    sources, others the overlaps with every source. gain = relevance x trust x (1 - weight x redundancy) must exceed
    minimum_gain; of those that the budget allows the largest gain per cost is taken, ties to the larger gain, then the
    smaller id; redundancy is the largest overlap with a chosen one. Policy relative has no redundancy and stops below
    score_floor times the first ratio. picks: array<struct<source_id, step, gain, ratio, redundancy, spent>>.

    Each query is a fold over its own array, at most max_sources steps: what sources publish is a bounded list. Costs
    are added as decimals; ratios and gains are compared at twelve digits.
    """
    if policy not in ("overlap", "relative"):
        raise ValueError(f"no such policy: {policy}")
    money = "decimal(18,6)"
    pick = "struct<source_id:string,step:int,gain:double,ratio:double,redundancy:double,spent:decimal(18,6)>"
    start = F.struct(
        F.transform("sources", lambda x: F.lit(0.0)).alias("redundancy"), F.transform("sources", lambda x: F.lit(True)).alias("left"), F.lit(0).cast(money).alias("spent"),
        F.array().cast(f"array<{pick}>").alias("picks"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("string").alias("stop"),
    )
    weight = redundancy_weight if policy == "overlap" else 0.0
    sources = F.col("sources")

    def step(s: Column, k: Column) -> Column:
        def gain(x: Column, i: Column) -> Column:
            g = F.round(x["relevance"] * x["trust"] * (1 - F.lit(weight) * F.get(s["redundancy"], i)), 12)
            fits = (s["spent"] + x["cost"].cast(money)) <= F.lit(budget).cast(money)
            return F.struct(F.round(g / x["cost"], 12).alias("ratio"), g.alias("gain"), (-i).alias("order"), F.get(s["left"], i).alias("left"), fits.alias("fits"))

        def choose(scored: Column) -> Column:
            some = F.filter(scored, lambda c: c["left"] & (c["gain"] > minimum_gain))
            return let(some, lambda some: let(F.array_max(F.filter(some, lambda c: c["fits"])), lambda best: take(some, best)))

        def take(some: Column, best: Column) -> Column:
            first = F.coalesce(s["first"], best["ratio"])
            low = F.lit(policy == "relative") & (best["ratio"] < score_floor * first)
            stop = F.when(~F.exists(s["left"], lambda y: y), F.lit("candidates_exhausted")).when(F.size(some) == 0, "insufficient_gain").when(best.isNull(), "exposure_budget").when(low, "relative_score_floor")
            at = -best["order"]
            chosen = F.get(sources, at)
            spent = (s["spent"] + chosen["cost"].cast(money)).cast(money)
            overlap = lambda i: F.coalesce(F.get(F.filter(chosen["others"], lambda o: o["source_id"] == F.get(sources, i)["source_id"]), F.lit(0))["overlap"], F.lit(0.0))
            redundancy = F.transform(s["redundancy"], lambda r, i: F.greatest(r, overlap(i))) if policy == "overlap" else s["redundancy"]
            added = F.struct(chosen["source_id"].cast("string").alias("source_id"), k.alias("step"), best["gain"].alias("gain"), best["ratio"].alias("ratio"), F.get(s["redundancy"], at).alias("redundancy"), spent.alias("spent"))
            after = F.struct(redundancy.alias("redundancy"), F.transform(s["left"], lambda y, i: y & (i != at)).alias("left"), spent.alias("spent"), F.concat(s["picks"], F.array(added.cast(pick))).alias("picks"), first.alias("first"), F.lit(None).cast("string").alias("stop"))
            ended = F.struct(*(s[c].alias(c) for c in ("redundancy", "left", "spent", "picks", "first")), stop.alias("stop"))
            return F.when(stop.isNotNull(), ended).otherwise(after)

        return F.when(s["stop"].isNotNull(), s).otherwise(let(F.transform(sources, gain), choose))

    steps = F.sequence(F.lit(1), F.lit(max_sources)) if max_sources else F.array().cast("array<int>")
    done = candidates.withColumn("s", F.aggregate(steps, start, step))
    reason = F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no_eligible_sources").when(F.size("s.picks") >= max_sources, "max_sources").otherwise(F.coalesce("s.stop", F.lit("candidates_exhausted")))
    return done.select("query_id", F.col("s.picks").alias("picks"), F.col("s.spent").alias("spent"), reason.alias("stop_reason"))


_SENT = "struct<source_id:string,role:string>"
_OUT = "struct<source_id:string,reason:string>"


def _fold_state() -> Column:
    return F.struct(F.lit(0).cast("decimal(18,6)").alias("spent"), F.array().cast(f"array<{_SENT}>").alias("sent"), F.array().cast(f"array<{_OUT}>").alias("out"), F.array().cast("array<int>").alias("cells"))


def _next_state(s: Column, cost: Column | None = None, sent: Column | None = None, out: Column | None = None, cell: Column | None = None) -> Column:
    spent = s["spent"] if cost is None else (s["spent"] + cost).cast("decimal(18,6)")
    grow = lambda old, new, kind: old if new is None else F.concat(old, new.cast(f"array<{kind}>"))
    return F.struct(spent.alias("spent"), grow(s["sent"], sent, _SENT).alias("sent"), grow(s["out"], out, _OUT).alias("out"), grow(s["cells"], cell, "int").alias("cells"))


def _pair(x: Column, word: str) -> Column:
    return F.array(F.struct(x.cast("string").alias("a"), F.lit(word).alias("b")))


def select_dispatch(
    pools: DataFrame, coarse_k: int, genuine_k: int, max_sources: int, budget: float, minimum_trust: float = 0.0, trust_weight: float = 0.0, decoys: str = "topic_stable"
) -> DataFrame:
    """What is dispatched for each query, and why no more: query_id, sent, excluded, spent, stop_reason.

    pools: query_id, topic, sources: array<struct<source_id, score, trust, cost[, cell, members, cell_cost]>>. Sources
    under the minimum trust are excluded; the coarse_k best by score (0: all) are candidates, sorted again by score +
    weight x (trust - 0.5); the first genuine_k that fit the budget are genuine (one that doesn't fit is skipped, not
    charged), others follow as decoys in the order of a hash of topic and id. decoys "cells" sends the whole cell
    (members: array<string> of eligible sources, cell_cost) of each genuine source or nothing of it; a second genuine
    source of a taken cell is promoted. Reasons: max_sources, exposure_budget, no_candidates, candidates_exhausted, in this
    precedence, before them max_sources_zero and no_eligible_sources.

    One fold per row over what sources publish: no shuffle. sent: array<struct<source_id, role>>.
    """
    if decoys not in ("topic_stable", "cells"):
        raise ValueError(f"no such decoys: {decoys}")
    money = "decimal(18,6)"
    limit, genuine_k = F.lit(budget).cast(money), min(genuine_k, max_sources)
    low = F.filter("sources", lambda x: x["trust"] < minimum_trust)
    eligible = F.filter("sources", lambda x: x["trust"] >= minimum_trust)
    ordered = by_score(eligible)
    pool = F.slice(ordered, 1, coarse_k) if coarse_k else ordered
    if trust_weight > 0:
        keyed = F.transform(pool, lambda x, i: F.struct((-F.round(x["score"] + trust_weight * (x["trust"] - 0.5), 9)).alias("k"), i.alias("i"), x.alias("x")))
        pool = F.transform(F.array_sort(keyed), lambda y: y["x"])
    df = pools.select("query_id", "topic", F.size("sources").alias("all"), F.transform(low, lambda x: F.struct(x["source_id"].cast("string").alias("source_id"), F.lit("insufficient_trust").alias("reason"))).alias("low"), F.size(eligible).alias("eligible"), pool.alias("pool"))
    count = lambda s, role: F.size(F.filter(s["sent"], lambda y: y["role"] == role))

    def genuine(s: Column, x: Column) -> Column:
        cost = x["cost"].cast(money)
        return F.when(count(s, "genuine") >= genuine_k, s).when((s["spent"] + cost) > limit, _next_state(s, out=_pair(x["source_id"], "exposure_budget"))).otherwise(_next_state(s, cost, _pair(x["source_id"], "genuine")))

    def decoy(s: Column, x: Column) -> Column:
        cost = x["cost"].cast(money)
        return F.when(F.size(s["sent"]) >= max_sources, s).when((s["spent"] + cost) > limit, _next_state(s, out=_pair(x["source_id"], "exposure_budget"))).otherwise(_next_state(s, cost, _pair(x["source_id"], "decoy")))

    def cell(s: Column, x: Column) -> Column:
        sid = x["source_id"].cast("string")
        mine = F.transform(x["members"], lambda m: F.struct(m.alias("a"), F.when(m == sid, "genuine").otherwise("decoy").alias("b")))
        promoted = F.transform(s["sent"], lambda y: F.struct(y["source_id"].alias("source_id"), F.when(y["source_id"] == sid, "genuine").otherwise(y["role"]).alias("role")))
        again = F.struct(s["spent"].alias("spent"), promoted.alias("sent"), s["out"].alias("out"), s["cells"].alias("cells"))
        cost = x["cell_cost"].cast(money)
        full = ((s["spent"] + cost) > limit) | (F.size(s["sent"]) + F.size(x["members"]) > max_sources)
        return (
            F.when(count(s, "genuine") >= genuine_k, s).when(x["cell"].isNull(), _next_state(s, out=_pair(sid, "no_cell"))).when(F.array_contains(s["cells"], x["cell"]), again)
            .when(full, _next_state(s, out=_pair(sid, "exposure_budget"))).otherwise(_next_state(s, cost, mine, cell=F.array(x["cell"])))
        )

    if decoys == "cells":
        df = df.withColumn("s", F.aggregate("pool", _fold_state(), cell))
    else:
        df = df.withColumn("s", F.aggregate("pool", _fold_state(), genuine))
        key = lambda x: F.sha2(F.concat_ws(":", F.col("topic").cast("string"), x["source_id"].cast("string")), 256)
        gone = F.concat(F.transform("s.sent", lambda y: y["source_id"]), F.transform("s.out", lambda y: y["source_id"]))
        rest = F.filter("pool", lambda x: ~F.array_contains(gone, x["source_id"].cast("string")))
        df = df.withColumn("rest", F.transform(F.array_sort(F.transform(rest, lambda x: F.struct(key(x).alias("k"), x.alias("x")))), lambda y: y["x"]))
        df = df.withColumn("s", F.aggregate("rest", F.col("s"), decoy))
    blocked = F.exists("s.out", lambda y: y["reason"] == "exposure_budget")
    n = F.size("s.sent")
    reason = (
        F.when(F.coalesce(F.col("all"), F.lit(0)) <= 0, "no_candidates").when(F.lit(max_sources == 0), "max_sources_zero").when(F.col("eligible") == 0, "no_eligible_sources")
        .when(n >= max_sources, "max_sources").when(blocked, "exposure_budget").when(n == 0, "no_candidates").otherwise("candidates_exhausted")
    )
    return df.select("query_id", F.col("s.sent").alias("sent"), F.concat("low", "s.out").alias("excluded"), F.col("s.spent").alias("spent"), reason.alias("stop_reason"))


def _hashed(sources: Column, *before: Column) -> Column:
    """Source ids of an array of structs in the order of a hash of what comes before and the id."""
    key = lambda x: F.sha2(F.concat_ws(":", *before, x["source_id"].cast("string")), 256)
    return F.transform(F.array_sort(F.transform(sources, lambda x: F.struct(key(x).alias("k"), x["source_id"].alias("source_id")))), lambda y: y["source_id"])


def _ids(sources: Column) -> Column:
    return F.transform(sources, lambda x: x["source_id"])


#: Names of the policies that dispatch() knows.
POLICIES = ("broadcast", "random", "oracle", "cosine@g", "cosine@K", "sticky_decoys", "random_decoys", "random_any", "cells_1", "cells_2")


def dispatch(policy: str, pools: DataFrame, max_nodes: int, genuine_k: int, coarse_k: int) -> DataFrame:
    """(query_id, source_id) that a named policy contacts, within each question's row.

    pools: query_id, topic, sources: array<struct<source_id, score[, grade, cell]>>. oracle takes the best graded, cells_n
    the whole cells of the n best, the decoy policies pad genuine_k sources to max_nodes: from the topic-stable order of
    the coarse_k candidates, from those in a hashed order, or from all sources.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    sources, q = F.col("sources"), F.col("query_id").cast("string")
    ranking = by_score(sources)
    coarse = F.slice(ranking, 1, coarse_k) if coarse_k else ranking
    genuine = _ids(F.slice(coarse, 1, genuine_k))
    rest = lambda of: F.filter(of, lambda x: ~F.array_contains(genuine, x["source_id"]))
    pad = lambda ids: F.concat(genuine, F.slice(ids, 1, max(0, max_nodes - genuine_k)))
    if policy == "broadcast":
        ids = _ids(sources)
    elif policy == "random":
        ids = F.slice(_hashed(sources, F.lit(policy), q), 1, max_nodes)
    elif policy == "oracle":
        best = F.array_max(F.transform(sources, lambda x: x["grade"]))
        ids = F.slice(F.array_sort(_ids(F.filter(sources, lambda x: x["grade"] == best))), 1, max_nodes)
    elif policy == "cosine@g":
        ids = genuine
    elif policy == "cosine@K":
        ids = _ids(F.slice(coarse, 1, max_nodes))
    elif policy == "sticky_decoys":
        ids = pad(_hashed(rest(coarse), F.col("topic").cast("string")))
    elif policy in ("random_decoys", "random_any"):
        ids = pad(_hashed(rest(coarse if policy == "random_decoys" else sources), F.lit(policy), q))
    else:
        taken = F.transform(F.slice(coarse, 1, int(policy.rpartition("_")[2])), lambda x: x["cell"])
        ids = _ids(F.filter(sources, lambda x: F.array_contains(taken, x["cell"])))
    return pools.select("query_id", F.explode(ids).alias("source_id"))


def privacy_pipeline(pools: DataFrame, weights: dict[str, float], coarse_k: int, top_k: int, m: int, minimum_trust: float, budget: float) -> DataFrame:
    """The composed router: query_id, genuine, dispatched (arrays of ids).

    pools: query_id, topic, sources: array<struct<source_id, score, trust, authorized, exposure, communication, latency,
    hijack>>, scored by questions that are already perturbed where wanted (vectors.perturb). coarse_k candidates by score;
    authorized ones of enough trust by weighted score, top_k genuine; topic-stable decoys of the candidates up to m;
    then the exposure budget, under which genuine sources always stay and are charged.
    """
    ordered = by_score(F.col("sources"))
    df = pools.withColumn("coarse", F.slice(ordered, 1, coarse_k) if coarse_k else ordered)
    value = lambda x: candidate_score(weights, lambda c: x["score" if c == "relevance" else c])
    able = F.filter("coarse", lambda x: (x["authorized"] == 1) & (x["trust"] >= minimum_trust))
    best = F.array_sort(F.transform(able, lambda x: F.struct((-F.round(value(x), 9)).alias("k"), x["source_id"].alias("source_id"))))
    df = df.withColumn("genuine", _ids(F.slice(best, 1, top_k)))
    others = F.filter("coarse", lambda x: ~F.array_contains("genuine", x["source_id"]))
    df = df.withColumn("decoys", F.slice(_hashed(others, F.col("topic").cast("string")), F.lit(1), F.greatest(F.lit(0), m - F.size("genuine"))))
    cost = lambda i: F.coalesce(F.get(F.filter("coarse", lambda x: x["source_id"] == i), F.lit(0))["exposure"], F.lit(0.0)).cast("decimal(18,6)")
    item = lambda protected: lambda i: F.struct(i.cast("string").alias("id"), cost(i).alias("cost"), F.lit(protected).alias("protected"))
    items = F.concat(F.transform("genuine", item(True)), F.transform("decoys", item(False)))
    return df.select("query_id", "genuine", skip_greedy(items, F.lit(budget).cast("decimal(18,6)"))["kept"].alias("dispatched"))


def cell_group(source_id: Column, labels: Column) -> Column:
    """The group that a source is dealt by: its first policy label, or its id before the last underscore."""
    return F.coalesce(F.get(labels, F.lit(0)), F.regexp_replace(source_id, "_[^_]*$", ""))


def forge_profile(centroids: DataFrame, source_id: object, target: DataFrame) -> DataFrame:
    """centroids (source_id, centroid_ix, vec, version) with one source's all replaced by the single vector of target (forged)."""
    mine = F.col("source_id") == source_id
    both = centroids.crossJoin(F.broadcast(target.limit(1)))
    return both.select("source_id", "centroid_ix", F.when(mine, widen(F.col("forged"))).otherwise(widen(F.col("vec"))).alias("vec"), F.when(mine, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def feedback_loop(stream: DataFrame, top_k: int) -> DataFrame:
    """Routing in which each query's dispatch updates the trust that the next one sees.

    stream: run, seq, source_id, relevance, signal (what a contact would show). One run is sequential by nature, runs
    (conditions, seeds) are dealt to tasks: a run's questions, each with its candidates, stream through in order, and each
    source's trust is all that is kept. Returns run, seq, source_id, score, trust (after the contact).
    """
    from .folds import fold_rows

    each = stream.groupBy("run", "seq").agg(F.array_sort(F.collect_list(F.struct(F.col("source_id"), F.col("relevance").cast("double").alias("relevance"), F.col("signal").cast("double").alias("signal")))).alias("candidates"))

    def step(trust: dict, values: tuple) -> tuple[dict, list]:
        scored = []
        for c in values[0]:
            total, seen = trust.get(c["source_id"], (0.0, 0))
            scored.append((-round(c["relevance"] * ((1 + total) / (2 + seen)), 9), len(scored), c))
        out = []
        for score, _, c in sorted(scored, key=lambda x: x[:2])[:top_k]:
            total, seen = trust.get(c["source_id"], (0.0, 0))
            trust[c["source_id"]] = (total + c["signal"], seen + 1)
            out.append({"source_id": c["source_id"], "score": -score, "trust": (1 + total + c["signal"]) / (3 + seen)})
        return trust, out

    kind = stream.schema["source_id"].dataType.simpleString()
    done = fold_rows(each, ["run"], ["seq"], {"candidates": F.col("candidates")}, dict, step, f"sent array<struct<source_id:{kind},score:double,trust:double>>")
    return done.select("run", "seq", F.explode("sent").alias("x")).select("run", "seq", "x.*")
