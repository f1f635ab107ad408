"""The learned router: gradients by finite differences, held-out accuracy on planted sources, its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import learned

SCHEMA = "query_id long, vec array<double>, held array<long>"


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(9, 7)), rng.integers(0, 2, 9).astype(float)
    theta = learned.start(7, 1) + 0.01 * rng.normal(size=len(learned.start(7, 1)))
    masks = [(rng.random((9, w)) >= 0.4) / 0.6 for w in learned.WIDTHS]
    for m in (None, masks):
        _, g = learned.gradient(theta, x, y, m)
        for k in rng.choice(len(theta), 60, replace=False):
            step = np.zeros(len(theta))
            step[k] = 1e-6
            slope = (learned.gradient(theta + step, x, y, m)[0] - learned.gradient(theta - step, x, y, m)[0]) / 2e-6
            assert abs(slope - g[k]) <= 1e-5 * max(1, abs(slope))
    assert sum(a * b for a, b in learned.shapes(7)) == len(theta) == len(g)


def planted(spark, n, seed):
    """Questions near one of four centres; a source holds a question's answer if the question is near its centre or the next one."""
    rng = np.random.default_rng(seed)
    centre = np.random.default_rng(0).normal(size=(4, 8))
    own = rng.integers(0, 4, n)
    vec = centre[own] + 0.5 * rng.normal(size=(n, 8))
    rows = [(k, v.tolist(), [int(o), int(o + 1) % 4]) for k, (o, v) in enumerate(zip(own, vec, strict=True))]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centre)], "source_id long, vec array<double>"), own


def test_router_learns_planted_sources(spark):
    training, sources, _ = planted(spark, 1500, 1)
    validation, _, _ = planted(spark, 300, 2)
    odd = spark.createDataFrame([(1, None, [0]), (2, [0.0] * 8, None), (3, [0.1] * 8, [77])], SCHEMA)
    losses: list = []
    router = learned.train(training.unionByName(odd), validation, sources, epochs=12, check_every=4, losses=losses)
    assert len(losses) == 12 and losses[-1] < 0.6 * losses[0] and router.auc > 0.97
    asked, _, own = planted(spark, 400, 3)
    p = router.probabilities(asked).collect()
    assert len(p) == 1600
    right = [(r["p"] > 0.5) == (r["source_id"] in (own[r["query_id"]], (own[r["query_id"]] + 1) % 4)) for r in p]
    assert np.mean(right) > 0.93
    # a plain pass over one question gives the same figures, and route() keeps those above the threshold
    one = np.array(asked.where("query_id = 7").first()["vec"])
    x = np.stack([np.concatenate([one, c, np.eye(4)[k]]) for k, c in enumerate(router.centroids)])
    want = 1 / (1 + np.exp(-learned.logits(router.theta, (x - router.mean) / router.scale)[0]))
    assert np.allclose(sorted((r["source_id"], r["p"]) for r in p if r["query_id"] == 7), list(enumerate(want)), atol=1e-12)
    assert router.route(asked).count() == sum(r["p"] > 0.5 for r in p)


def test_summed_steps_equal_one_block(spark, monkeypatch):
    """Without dropout the sums of many blocks in many tasks are the gradient of all rows at once."""
    monkeypatch.setattr(learned, "DROPOUT", 0.0)
    monkeypatch.setattr(learned, "BLOCK", 16)
    monkeypatch.setattr(learned, "SLOTS", 3)
    training, sources, own = planted(spark, 300, 5)
    path = f"{learned.shared_folder(spark)}/steps-{np.random.default_rng().integers(1 << 60)}"
    blocks, n = learned._packed(training, [0, 1, 2, 3], path)
    centre = np.array([r["vec"] for r in sources.orderBy("source_id").collect()])
    mean, spread = learned._moments(blocks, 8)
    q = np.array([r["vec"] for r in training.orderBy("query_id").collect()])
    assert n == 300 and np.allclose(mean, q.mean(axis=0)) and np.allclose(spread, q.std(axis=0))
    router = learned.Router([0, 1, 2, 3], centre, np.zeros(20), np.ones(20), learned.start(20, 4), 0.0)
    loss, g, rows = learned._step(blocks, router, 0, 0)
    y = np.array([[float(s in (o, (o + 1) % 4)) for s in range(4)] for o in own]).ravel()
    want = learned.gradient(router.theta, router.features(q), y)
    assert rows == 1200 and np.isclose(loss, want[0]) and np.allclose(g, want[1], atol=1e-8)


def test_curve_and_errors(spark):
    training, sources, own = planted(spark, 200, 6)
    path = f"{learned.shared_folder(spark)}/curve-{np.random.default_rng().integers(1 << 60)}"
    blocks, _ = learned._packed(training, [0, 1, 2, 3], path)
    centre = np.array([r["vec"] for r in sources.orderBy("source_id").collect()])
    router = learned.Router([0, 1, 2, 3], centre, np.zeros(20), np.ones(20), learned.start(20, 4), 0.0)
    q = np.array([r["vec"] for r in training.orderBy("query_id").collect()])
    p = learned.logits(router.theta, router.features(q))[0]
    y = np.array([[s in (o, (o + 1) % 4) for s in range(4)] for o in own]).ravel()
    above = (p[y][:, None] > p[~y]).mean() + (p[y][:, None] == p[~y]).mean() / 2
    assert abs(learned._auc(blocks, router) - above) < 0.02
    empty = training.where(F.lit(False))
    with pytest.raises(ValueError):
        learned.train(empty, training, sources)
    with pytest.raises(ValueError):
        learned.train(training, training, sources.where(F.lit(False)))
