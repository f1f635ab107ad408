"""Vector codes: the tree against a full search, the codebooks against a plain loop, and rows that are out of the ordinary."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import vector_codes as v


def full_search(points, x):
    d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 64), st.sampled_from([1, 4, 8]), st.sampled_from([2, 9, 300, 1 << 20]))
def test_tree_equals_a_full_search_with_ties(seed, k, width, spread):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread, (k, width))
    x = np.concatenate([rng.integers(-2 * spread, 2 * spread, (200, width)), points, (points[: k // 2] + points[k - k // 2 :]) // 2])
    own, square, _ = v.Gnat(points).nearest(x)
    want, least = full_search(points, x)
    assert (own == want).all() and (square == least).all()


def test_subtrees_are_ruled_out():
    rng = np.random.default_rng(1)
    centre = rng.integers(-2000, 2000, (8, 4))
    points = (centre[:, None] + rng.integers(-40, 40, (8, 8, 4))).reshape(64, 4)
    x = (centre[:, None] + rng.integers(-60, 60, (8, 500, 4))).reshape(-1, 4)
    assert v.Gnat(points).nearest(x)[2] < 0.35 * len(points) * len(x)


def plain(rows, width):
    """The contract row by row; rows are (id, label, vector)."""
    kept = [(i, label, [int(np.floor(256 * np.float64(c))) for c in x]) for i, label, x in rows if x is not None and len(x) == width and all(c is not None and np.isfinite(c) for c in x)]
    step = width // 16
    cut = lambda x, p: x[p * step : (p + 1) * step]
    far = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:64]
    books = [[cut(x, p) for _, _, x in first] for p in range(16)]
    best = lambda x, p: min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(2):
        new = []
        for p in range(16):
            own = [(best(x, p), cut(x, p)) for _, _, x in kept]
            new.append([[sum(c) // len(c) for c in zip(*mine, strict=True)] if (mine := [x for k, x in own if k == e]) else books[p][e] for e in range(len(books[p]))])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, label, "".join(f"{best(x, p):02x}" for p in range(16)), sum(far(cut(x, p), books[p][best(x, p)]) for p in range(16))) for i, label, x in kept]
    return sorted(((i, code, error, sum(r[3] for r in coded if r[1] == label), digest) for i, label, code, error in coded), key=repr)


def test_equals_a_plain_loop_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), int(i) % 3 if i % 7 else None, [float(c) for c in rng.normal(0, 0.3, 32).astype(np.float32)]) for i in range(150)]
    rows += [rows[5], rows[5], (5, 1, rows[9][2]), (None, 1, rows[8][2]), (-4, 2, [0.25] * 32), (-3, 2, [0.25] * 32)]
    rows += [(900, 1, None), (901, 1, [None, *rows[0][2][1:]]), (902, 1, [float("nan"), *rows[0][2][1:]]), (903, 1, [float("inf"), *rows[0][2][1:]]), (904, 1, []), (905, 1, [0.5] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("clash")).withColumn("V", F.lit(1)).repartition(5)
    got = sorted((tuple(r) for r in v.compress(df).collect()), key=repr)
    assert got == plain(rows, 32)


def test_empty_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(1, 1, None), (2, None, []), (3, 1, [1.0] * 5)]):
        out = v.compress(spark.createDataFrame(rows, kind))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_components_too_large_for_long_distances_are_an_error(spark):
    with pytest.raises(ValueError):
        v.compress(spark.createDataFrame([(1, 1, [1e9] * 16)], "vec_id long, label int, embedding array<double>"))
