import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, threshold=0.9):
    x = np.asarray(x, np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= threshold
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        new = np.array([min(root[k], *root[near[k]]) if near[k].any() else root[k] for k in range(len(ids))])
        if (new == root).all():
            return {i: (int(near[k].sum()), int(root[k]), bool(root[k] == i)) for k, i in enumerate(ids)}
        root = new


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.near_duplicates(df).collect()}


def test_equals_brute_force_with_pairs_chains_and_a_crowded_group(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 64))
    for k in range(0, 200, 2):  # pairs about the threshold
        x[k + 1] = x[k] / np.linalg.norm(x[k]) * 8 + rng.standard_normal(64) * rng.uniform(0.2, 0.6)
    for k in range(301, 330):  # a chain
        x[k] = x[k - 1] + rng.standard_normal(64) * 0.35
    x[400:1000] = x[400] + rng.standard_normal((600, 64)) * 0.25  # a crowded group
    x[1000:1040] = x[1000]
    ids = [int(i) for i in rng.permutation(5000)[:1500]]
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(5)
    want, got = brute(ids, x), result(df)
    wrong = [i for i in ids if want[i] != got[i]]
    assert len(wrong) <= 0.002 * len(ids), [(i, want[i], got[i]) for i in wrong[:5]]


def planted(rng, n, pairs, width=64):
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, c in enumerate(rng.uniform(0.9, 0.93, pairs)):
        b = rng.standard_normal(width)
        b -= (b @ x[2 * k]) * x[2 * k]
        x[2 * k + 1] = c * x[2 * k] + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
    return x


def test_the_descent_finds_what_the_coarse_start_misses(spark):
    """6,000 vectors with 1,000 pairs about the threshold: recall 0.8 to 0.9 at the start, over 0.995 after the descent."""
    n, pairs = 6_000, 1_000
    x = planted(np.random.default_rng(11), n, pairs)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    vectors = e.staged(e.usable_vectors(table, "vec_id", "embedding"), "test")
    start = e.first_lists(e.coarse_start(vectors, n, 64, e.TABLES, seed=0))
    recall = lambda lists: e.links_of(lists, vectors, 0.9).where(f"b = a + 1 and a % 2 = 0 and a < {2 * pairs}").count() / pairs
    before, after = recall(start), recall(e.descend(start, vectors, 0.9))
    assert before < 0.92 and after > 0.995, (before, after)
    want, got = brute(list(range(n)), x), result(table)
    assert sum(want[i] != got[i] for i in want) <= 0.002 * n


def test_squares_that_overflow_or_vanish_link_all_the_same(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0000001e200]), (3, [1e-200, 1e-200]), (4, [-1e200, 1e200])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_copies_of_one_vector_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(e, "SALTED", 10)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(200, [-1.0, 0.0, 0.5])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (99, 0) for i in range(100)}, 200: (0, 200)}


def test_a_component_larger_than_a_block_is_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(32) + rng.standard_normal((500, 32)) * 0.28
    members = spark.createDataFrame([(i, 0, 1 + i % 3, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "rep long, component long, n long, x binary")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.9
    np.fill_diagonal(near, False)
    want = near @ np.array([1 + i % 3 for i in range(500)])
    got = {r["rep"]: r["linked"] for r in e.exact_counts(members, 0.9).collect()}
    assert [got[i] for i in range(500)] == want.tolist()


def test_unusable_vectors_repeats_and_clashing_names(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (8, one), (7, one), (9, [2.0, 0.1, 0.0]), (None, one), (10, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("a")).withColumn("x", F.lit(1)).withColumn("n", F.lit(None))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.near_duplicates(df).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5, 6, 10)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)}
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[9] == (2, 7, False) and got[None] == (0, None, True)
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        e.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def linked_groups(rng, size, width=64, spread=0.01):
    """Two tight groups whose members link with all of their own group, and with some of the other."""
    a = rng.standard_normal(width)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(width)
    b -= (b @ a) * a
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * b / np.linalg.norm(b)
    noise = rng.standard_normal((2, size, width)) * spread / np.sqrt(width)
    return np.concatenate([a + noise[0], b + noise[1]])


def test_two_linked_groups_beyond_the_lists_are_one_component(spark):
    size, rng = 400, np.random.default_rng(8)
    x = np.concatenate([linked_groups(rng, size), rng.standard_normal((400, 64))])
    ids = [int(i) for i in rng.permutation(5000)[: len(x)]]
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(5)
    want, got = brute(ids, x), result(df)
    assert len({want[i][1] for i in ids[: 2 * size]}) == 1
    assert got == want


def test_gaps_are_closed_through_members_only(spark):
    """No member links with the other group's centre; a single pair of members links the groups."""
    turn = lambda d: [np.cos(np.radians(d)), np.sin(np.radians(d)), 0.0]
    degrees = {1: 0, 2: 20, 3: 44, 4: 64, 5: 150, 6: 170}
    vectors = spark.createDataFrame([(i, 1, np.asarray(turn(d), "<f8").tobytes()) for i, d in degrees.items()], "rep long, n long, x binary")
    near = lambda a, b: (a, b, float(np.cos(np.radians(degrees[a] - degrees[b]))))
    graph = spark.createDataFrame([near(1, 2), near(3, 4), near(5, 6)], "a long, b long, cosine double")
    components = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "id long, component_id long")
    got = e.close_gaps(vectors.select("rep"), graph, vectors, components, 0.9).collect()
    assert {(r["a"], r["b"]) for r in got} == {(2, 3)}
