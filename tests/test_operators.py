import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.functions import vectors as v
from larkspur.operators import clusters, metrics, retrieval, routing, running


def test_zero_vectors_score_zero_and_noise_needs_a_sigma(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0]), (2, [3.0, 4.0], [3.0, 4.0])], "k int, a array<double>, b array<double>")
    got = {r[0]: (r[1], list(r[2])) for r in df.select("k", v.cosine(F.col("a"), F.col("b")), v.normalise(F.col("a"))).collect()}
    assert got[1] == (0.0, [0.0, 0.0]) and got[2][0] == pytest.approx(1.0) and got[2][1] == pytest.approx([0.6, 0.8])
    assert v.perturb(df, "a", 0.0, 1, "k") is df
    with pytest.raises(ValueError):
        v.perturb(df, "a", -1.0, 1, "k")
    big = spark.range(2000).select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("a"))
    x = np.array([r["a"] for r in v.perturb(big, "a", 2.0, 7, "id").collect()])
    assert abs(x.mean()) < 0.15 and abs(x.std() - 2) < 0.1


def test_rank_keeps_all_for_zero_and_breaks_ties_by_id(spark):
    s = spark.createDataFrame([(1, i, 0.5) for i in (3, 1, 2)], "query_id int, source_id int, score double")
    assert [r["source_id"] for r in routing.rank(s, 0).orderBy("rank").collect()] == [1, 2, 3]
    assert routing.rank(s, 1).count() == 1
    with pytest.raises(ValueError):
        routing.aggregate_arrays(s, "median")
    with pytest.raises(ValueError):
        routing.dispatch("nothing", s, 1, 1, 1)
    with pytest.raises(ValueError):
        routing.probe_plan(s, s, 0)


def test_skip_greedy_skips_and_protects(spark):
    rows = [([("a", 0.4, False), ("b", 0.8, False), ("c", 0.5, False), ("d", 2.0, True)],)]
    df = spark.createDataFrame(rows, "x array<struct<id:string,cost:double,protected:boolean>>")
    df = df.select(F.col("x").cast("array<struct<id:string,cost:decimal(18,6),protected:boolean>>").alias("x"))
    r = df.select(routing.skip_greedy(F.col("x"), F.lit(1)).alias("s")).collect()[0]["s"]
    assert r["kept"] == ["a", "c", "d"] and float(r["spent"]) == pytest.approx(2.9)


def smart(spark, rows, **more):
    overlap = lambda a, b: max(0.0, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))))
    item = [(s, rel, trust, cost, [(o[0], overlap(v, o[4])) for o in rows]) for s, rel, trust, cost, v in rows]
    df = spark.createDataFrame([(1, item)], "query_id int, sources array<struct<source_id:string,relevance:double,trust:double,cost:double,others:array<struct<source_id:string,overlap:double>>>>")
    r = routing.smart_route(df, **more).collect()[0]
    return [p["source_id"] for p in r["picks"]], r["stop_reason"]


def test_smart_route_discounts_what_is_alike_and_tells_why_it_ends(spark):
    rows = [("a", 0.9, 1.0, 1.0, [1.0, 0.0]), ("b", 0.85, 1.0, 1.0, [1.0, 0.01]), ("c", 0.6, 1.0, 1.0, [0.0, 1.0]), ("d", 0.9, 1.0, 5.0, [0.0, 1.0])]
    assert smart(spark, rows, budget=2.0, max_sources=5, redundancy_weight=1.0) == (["a", "c"], "exposure_budget")
    assert smart(spark, rows, budget=0.5, max_sources=5) == ([], "exposure_budget")
    assert smart(spark, rows, budget=9.0, max_sources=1) == (["a"], "max_sources")
    assert smart(spark, rows, budget=99.0, max_sources=9, redundancy_weight=0.0) == (["a", "b", "c", "d"], "candidates_exhausted")
    assert smart(spark, rows, budget=99.0, max_sources=9, minimum_gain=0.95) == ([], "insufficient_gain")
    assert smart(spark, rows, budget=99.0, max_sources=9, policy="relative", score_floor=0.8) == (["a", "b"], "relative_score_floor")
    assert smart(spark, [], budget=1.0, max_sources=2) == ([], "no_eligible_sources")
    with pytest.raises(ValueError):
        smart(spark, rows, budget=1.0, max_sources=1, policy="none")


def sent(spark, sources, **more):
    df = spark.createDataFrame([(1, "t", sources)], "query_id int, topic string, sources array<struct<source_id:string,score:double,trust:double,cost:double,cell:int,members:array<string>,cell_cost:double>>")
    r = routing.select_dispatch(df, **more).collect()[0]
    return [(x["source_id"], x["role"]) for x in r["sent"]], {x["source_id"]: x["reason"] for x in r["excluded"]}, r["stop_reason"]


def test_dispatch_reasons_and_their_precedence(spark):
    one = [("a", 0.9, 0.5, 1.0, 0, ["a", "c"], 2.0), ("b", 0.8, 0.5, 3.0, 1, ["b"], 3.0), ("c", 0.7, 0.5, 1.0, 0, ["a", "c"], 2.0), ("d", 0.6, 0.1, 1.0, None, None, None)]
    more = {"coarse_k": 0, "genuine_k": 2, "max_sources": 3, "budget": 2.0, "minimum_trust": 0.2}
    assert sent(spark, one, **more) == ([("a", "genuine"), ("c", "genuine")], {"d": "insufficient_trust", "b": "exposure_budget"}, "exposure_budget")
    assert sent(spark, one, **{**more, "max_sources": 2})[2] == "max_sources"
    assert sent(spark, one, **{**more, "max_sources": 0})[::2] == ([], "max_sources_zero")
    assert sent(spark, [], **more) == ([], {}, "no_candidates")
    assert sent(spark, one, **{**more, "minimum_trust": 0.9})[2] == "no_eligible_sources"
    assert sent(spark, one, **{**more, "budget": 9.0, "max_sources": 9})[2] == "candidates_exhausted"
    low = [(s, x, 0.9 if s == "c" else t, *z) for s, x, t, *z in one]
    assert sent(spark, low, **{**more, "genuine_k": 1, "max_sources": 1, "trust_weight": 1.0})[0] == [("c", "genuine")]
    assert sent(spark, one, **{**more, "decoys": "cells", "max_sources": 4}) == ([("a", "genuine"), ("c", "genuine")], {"d": "insufficient_trust", "b": "exposure_budget"}, "exposure_budget")
    assert sent(spark, one, **{**more, "decoys": "cells", "genuine_k": 1, "max_sources": 4})[0] == [("a", "genuine"), ("c", "decoy")]
    assert sent(spark, one, **{**more, "decoys": "cells", "minimum_trust": 0.0, "budget": 9.0, "genuine_k": 4, "max_sources": 9})[1] == {"d": "no_cell"}
    with pytest.raises(ValueError):
        sent(spark, one, **{**more, "decoys": "none"})


def test_beyond_the_broadcast_bound_the_scores_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(20)], "query_id int, vec array<double>")
    c = spark.createDataFrame([(s, k, rng.standard_normal(4).tolist()) for s in range(6) for k in range(3)], "source_id int, centroid_ix int, vec array<double>")
    near = sorted(map(tuple, routing.cosine_router(q, c, "max", 2).collect()))
    monkeypatch.setattr(routing, "BROADCAST_CENTROIDS", 4)
    assert sorted(map(tuple, routing.cosine_router(q, c, "max", 2).collect())) == near


def test_feedback_moves_trust(spark):
    rows = [("r", q, s, 0.8 if s == "bad" else 0.75, 0.0 if s == "bad" else 1.0) for q in range(6) for s in ("bad", "good")]
    df = spark.createDataFrame(rows, "run string, seq int, source_id string, relevance double, signal double")
    got = [r["source_id"] for r in routing.feedback_loop(df, 1).orderBy("seq").collect()]
    assert got == ["bad", "good", "good", "good", "good", "good"]


def test_bm25_and_hybrid_literals(spark):
    pool = spark.createDataFrame([(1, 1, "heart attack the heart"), (1, 2, "lung cancer"), (1, 3, ""), (2, 9, "heart")], "query_id int, doc_id int, text string")
    q = spark.createDataFrame([(1, ["heart", "heart"])], "query_id int, terms array<string>")
    got = {r["doc_id"]: r["bm25"] for r in retrieval.bm25(retrieval.bm25_counts(pool, q)).collect()}
    idf = np.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3))), abs=1e-6) and got[2] == got[3] == got[9] == 0
    one = spark.createDataFrame([(1, 1, 0.4, 3.0)], "query_id int, doc_id int, cosine double, bm25 double")
    assert retrieval.hybrid(one).collect()[0]["score"] == 0.4
    two = spark.createDataFrame([(1, 1, 0.4, 3.0), (1, 2, 0.6, 3.0)], "query_id int, doc_id int, cosine double, bm25 double")
    assert sorted(r["score"] for r in retrieval.hybrid(two).collect()) == [-1.0, 1.0]
    assert sorted(r["score"] for r in retrieval.hybrid(two, 0).collect()) == [0.4, 0.6]


def test_hashed_cosine_equals_counts(spark):
    import hashlib

    bucket = lambda w: int(hashlib.sha256(f"m:{w}".encode()).hexdigest()[:8], 16) % 256
    texts, asked = ["a b a c", "", "x y z a"], "a c c"
    vec = lambda s: np.bincount([bucket(w) for w in s.split()], minlength=256).astype(float) if s else np.zeros(256)
    df = spark.createDataFrame([(s.split(), vec(asked).tolist()) for s in texts], "w array<string>, q array<double>")
    got = [r[0] for r in df.select(retrieval.hashed_cosine(F.col("w"), F.col("q"))).collect()]
    assert got == pytest.approx([float(vec(s) @ vec(asked) / (np.linalg.norm(vec(s)) * np.linalg.norm(vec(asked)))) if s else 0.0 for s in texts])


def test_fusion_takes_the_last_place_of_a_text(spark):
    rows = [(1, 1, "a", 0.1), (1, 2, "b", 0.2), (1, 3, "c", 0.3), (1, 4, "a", 0.4), (1, 5, "b", 0.15)]
    lists = spark.createDataFrame(rows, "query_id int, doc_id int, text string, distance double")
    got = [(r["rank"], r["score"]) for r in retrieval.reciprocal_rank_fusion(lists, 9).orderBy("rank").collect()]
    assert got == [(1, pytest.approx(1 / 63, abs=1e-9)), (2, pytest.approx(1 / 64, abs=1e-9)), (3, pytest.approx(1 / 65, abs=1e-9))]
    assert retrieval.reciprocal_rank_fusion(lists, 4, k=0).count() == 4


def test_passages_are_found_whole_short_and_cut_within_words(spark):
    docs = spark.createDataFrame([(1, "xx The quick brown fox jumps over dogs yy"), (2, "prefixthe quick  brown fox jumps over dogssuffix"), (3, "tiny thing"), (4, None), (5, "the quick brown fox jumps under")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "the QUICK brown fox jumps over dogs"), (2, "tiny"), (3, "the quick  brown fox jumps over dogs"), (4, "no such words here at all")], "item_id int, text string")
    assert sorted(map(tuple, retrieval.passages_held(docs, items).collect())) == [(1, 1), (2, 3), (3, 2)]


def test_running_totals_by_ranges_equal_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("t"), F.col("id"), (F.col("id") % 7).alias("x"))
    got = running.running(df, ["k"], F.floor(F.col("t") / 50), ["t", "id"], {"total": F.col("x"), "n": F.lit(1)})
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    wrong = got.join(df.select("id", F.sum("x").over(w).alias("t2"), F.count("*").over(w).alias("n2")), "id").where("total <> t2 or n <> n2")
    assert got.count() == 3000 and wrong.count() == 0
    tiles = spark.range(1, 18).select(running.tile(F.col("id"), F.lit(17), 5).alias("p")).groupBy("p").count().orderBy("p").collect()
    assert [r["count"] for r in tiles] == [4, 4, 3, 3, 3]


def test_bounded_trust_equals_a_fold_whatever_the_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(u, i, float(rng.normal(0.5, 2))) for u in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "u int, i int, s double")
    want = {}
    for u in range(4):
        x = 0.5
        for _, _, s in sorted(r for r in rows if r[0] == u):
            x = min(1, max(0, 0.7 * x + 0.3 * s))
        want[u] = x
    for width in (1, 7, 100):
        got = {r["u"]: r["trust"] for r in metrics.bounded_trust(df, ["u"], "s", ["i"], F.floor(F.col("i") / width), 0.3).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        metrics.bounded_trust(df, ["u"], "s", ["i"], F.col("i"), 0.0)


def test_overlap_counts_all_pairs(spark):
    sets = [[1, 2], [1, 2], [2, 3], [4]]
    df = spark.createDataFrame([(0, s) for s in sets], "k int, s array<int>")
    j = [len({*a} & {*b}) / len({*a} | {*b}) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    r = metrics.overlap_within(df, ["k"], "s").collect()[0]
    assert r["pairs"] == 6 and r["jaccard"] == pytest.approx(np.mean(j), abs=1e-6)


def test_metric_conventions(spark):
    shown = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id int, item string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (3, "q")], "query_id int, item string")
    got = {r["query_id"]: r for r in metrics.binary_metrics(shown, rel, 5).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["rr"] == 0.5 and got[1]["p_at_k"] == 0.2 and got[1]["precision"] == 0.5
    assert got[1]["ndcg"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-6)
    assert got[2]["recall"] == 1.0 and got[3]["precision"] == 0 and got[3]["recall"] == 0
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, guess string")
    f = metrics.macro_f1(pairs).collect()[0]
    assert f["accuracy"] == pytest.approx(2 / 3, abs=1e-6) and f["macro_f1"] == pytest.approx(2 / 3, abs=1e-6)


def test_clusters_are_whole_and_not_too_small(spark):
    rng = np.random.default_rng(1)
    rows = [("s", "public" if i % 3 else "clinical", i, rng.standard_normal(8).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "source_id string, collection string, doc_id int, vec array<double>")
    got = clusters.cluster_index(df).toPandas()
    assert sorted(got["doc_id"]) == list(range(90))
    assert got.groupby("cluster_id").size().min() >= 5 and got.groupby("cluster_id")["collection"].nunique().max() == 1
    ids = sorted(got["cluster_id"].unique())
    assert ids == list(range(len(ids))) and got.loc[got["collection"] == "public", "cluster_id"].max() < got.loc[got["collection"] == "clinical", "cluster_id"].min()


@pytest.mark.parametrize("spherical", [True, False])
def test_large_sources_get_the_clusters_that_small_ones_get(spark, monkeypatch, spherical):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 2}", "public" if i % 3 else "clinical", i, (rng.standard_normal(6) + 3 * np.eye(6)[i % 6]).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "source_id string, collection string, doc_id int, vec array<double>")
    run = (lambda: clusters.cluster_index(df)) if spherical else (lambda: clusters.kmeans_profiles(df, 5).select("source_id", "centroid_ix", "members", F.round(F.element_at("vec", 1), 9)))
    here = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(clusters, "LOCAL", 0)
    monkeypatch.setattr(clusters, "BLOCK", 64)
    assert sorted(map(tuple, run().collect())) == here
    if not spherical:
        assert all(sum(r[2] for r in here if r[0] == s) == 350 and sum(r[0] == s for r in here) == 5 for s in ("s0", "s1"))


def test_rounds_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 4))
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "source_id string, doc_id int, vec array<double>")
    order = [r["doc_id"] for r in df.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("h")).orderBy("h").collect()]
    centre = x[order[:3]]
    for _ in range(50):
        own = np.array([min(range(3), key=lambda c: ((v - centre[c]) ** 2).sum()) for v in x])
        centre = np.array([x[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(3)])
    got = clusters.kmeans_profiles(df, 3).orderBy("centroid_ix").collect()
    assert np.allclose([r["vec"] for r in got], centre) and [r["members"] for r in got] == np.bincount(own, minlength=3).tolist()


def test_small_clusters_join_their_nearest():
    total = np.array([[10.0, 0.0], [0.0, 1.0], [0.9, 0.1], [0.0, 6.0]])
    assert clusters._absorb(total, np.array([10, 1, 1, 6]), 3).tolist() == [0, 1, 0, 1]
    assert clusters._absorb(total, np.array([10, 0, 1, 6]), 1).tolist() == [0, -1, 1, 2]
    assert clusters._absorb(total[:1], np.array([1]), 5).tolist() == [0]


def test_bootstrap_finds_a_shift(spark):
    rng = np.random.default_rng(1)
    a = rng.random(500) + 0.5
    df = spark.createDataFrame([(i, float(x) + 0.05, float(x) + float(e)) for i, (x, e) in enumerate(zip(a, rng.normal(0, 0.05, 500), strict=True))], "unit int, a double, b double")
    r = clusters.paired_bootstrap(df, 400).collect()[0]
    assert r["low"] < 0.05 < r["high"] and r["low"] > 0 and r["p"] < 0.05 and 1 < r["ratio_low"] < r["ratio"] < r["ratio_high"] and r["n"] == 500
    assert clusters.paired_bootstrap(df.select("unit", "a", F.col("a").alias("b")), 50).collect()[0]["p"] == 1
    with pytest.raises(ValueError):
        clusters.paired_bootstrap(df.select("unit", "a", F.lit(None).cast("double").alias("b")))


def test_dirichlet_partition_is_whole_and_uneven(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("topic"))
    got = clusters.dirichlet_partition(df, 4, 0.3, seed=1).groupBy("topic", "client").count().collect()
    assert sum(r["count"] for r in got) == 6000 and all(0 <= r["client"] < 4 for r in got)
    shares = [max(r["count"] for r in got if r["topic"] == t) / 2000 for t in range(3)]
    assert max(shares) > 0.5
    even = clusters.dirichlet_partition(df, 4, 1e6, seed=1).groupBy("topic", "client").count().collect()
    assert len(even) == 12 and all(400 < r["count"] < 600 for r in even)


def test_chunks_recovery_and_letters(spark):
    long = " ".join(f"This is sentence {k}." for k in range(7))
    df = spark.createDataFrame([(1, long), (2, "Too short a text."), (3, None)], "k int, text string")
    got = {r["k"]: r["c"] for r in df.select("k", t.session_chunks(F.col("text")).alias("c")).collect()}
    assert len(got[1]) == 5 and " ".join(got[1]) == long and got[2] is None and got[3] is None
    pair = spark.createDataFrame([("a b", "B c"), ("", "x")], "a string, b string")
    assert [r[0] for r in pair.select(t.term_recovery(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]
    letters = [("The answer is B.",), ("none",), ("(C) since A",), ("D",), (" E or A",)]
    assert [r[0] for r in spark.createDataFrame(letters, "x string").select(t.answer_letter(F.col("x"))).collect()] == ["B", None, "C", "D", "A"]
