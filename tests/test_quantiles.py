"""Exact percentiles by narrowing brackets, and resamples of exactly n, against numpy."""

import numpy as np
import pytest

from larkspur.operators import clusters, metrics
from larkspur.operators import quantiles as q

SHARES = {"least": 0.0, "low": 0.025, "half": 0.5, "p95": 0.95, "most": 1.0}


def groups():
    rng = np.random.default_rng(4)
    return {
        "normal": rng.normal(size=4000), "tail": np.exp(rng.normal(0, 60, 3000)), "equal": np.full(2500, 7.0), "two": np.repeat([1.0, 2.0], 1500), "steps": rng.integers(0, 5, 3000).astype(float),
        "few": rng.normal(size=9), "one": np.array([3.5]), "hot": np.r_[np.zeros(9000), rng.normal(size=200)], "tiny": rng.normal(size=3000) * 1e-300,
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(v)) for k, g in groups().items() for v in g] + [("blank", None), ("blank", float("nan")), (None, 1.0), (None, 2.0)]
    return spark.createDataFrame(rows, "kind string, v double").repartition(6).cache()


@pytest.mark.parametrize("gather", [10_000, 50])
def test_equals_numpy(spark, table, monkeypatch, gather):
    monkeypatch.setattr(q, "GATHER", gather)
    got = {r["kind"]: r for r in q.percentiles(table, ["kind"], "v", SHARES).collect()}
    for k, values in groups().items():
        for name, share in SHARES.items():
            assert got[k][name] == pytest.approx(np.percentile(values, 100 * share), rel=1e-12, abs=1e-305), (k, name)
    assert got[None]["half"] == 1.5 and got["blank"]["half"] is None and len(got) == len(groups()) + 2


def test_one_group_without_keys_and_no_rows(spark, table, monkeypatch):
    monkeypatch.setattr(q, "GATHER", 50)
    rows = table.where("kind = 'normal'")
    assert q.percentiles(rows, [], "v", {"m": 0.3}).first()["m"] == pytest.approx(np.percentile(groups()["normal"], 30), rel=1e-12)
    assert q.percentiles(rows.limit(0), ["kind"], "v", {"m": 0.3}).count() == 0
    with pytest.raises(ValueError):
        q.percentiles(rows, [], "v", {"m": 1.3})


def test_no_task_sorts_a_large_group(spark, table, monkeypatch):
    """What is gathered at the end are brackets, not groups."""
    monkeypatch.setattr(q, "GATHER", 50)
    seen = []
    whole = q._bracketed
    monkeypatch.setattr(q, "_bracketed", lambda *a: seen.append(whole(*a)) or seen[-1])
    q.percentiles(table.where("kind in ('normal', 'hot', 'tail')"), ["kind"], "v", {"m": 0.4}).collect()
    assert max(r["count"] for r in seen[-1].groupBy("kind", "rank").count().collect()) <= 50


def test_summary_keeps_its_columns(spark, table):
    got = {r["kind"]: r for r in metrics.summary(table, ["kind"], "v").collect()}
    assert got["few"]["p50"] == round(float(np.median(groups()["few"])), 6) and got["few"]["n"] == 9 and len(got) == len(groups()) + 2


@pytest.mark.parametrize("sizes", [[5], [3, 0, 9, 1], list(range(40))])
def test_every_resample_has_n_draws(sizes):
    share = q.resample_shares(sizes, 300, 6)
    drawn = np.stack([share(b) for b in range(len(sizes))])
    assert (drawn.sum(axis=0) == sum(sizes)).all() and (drawn >= 0).all() and not drawn[np.array(sizes) == 0].any()
    assert np.abs(drawn.mean(axis=1) - sizes).max() < 1.2


def test_interval_equals_plain_numpy_on_the_same_draws(spark, monkeypatch):
    monkeypatch.setattr(clusters, "blocks_for", lambda n: 7)
    rng = np.random.default_rng(1)
    a = rng.random(500)
    rows = [(k, float(x), float(x * 0.9 + y)) for k, (x, y) in enumerate(zip(a, rng.normal(0, 0.1, 500), strict=True))]
    df = spark.createDataFrame(rows, "unit long, a double, b double")
    got = clusters.paired_bootstrap(df, 600, seed=3).first()
    dealt = df.selectExpr("*", "cast(pmod(xxhash64(unit), 7) as int) as block").orderBy("block", "unit", "a", "b").collect()
    blocks = [np.array([[r["a"], r["b"]] for r in dealt if r["block"] == k]).reshape(-1, 2) for k in range(7)]
    share = q.resample_shares([len(b) for b in blocks], 600, 3)
    sums = np.zeros((600, 2))
    for k, block in enumerate(blocks):
        draws, step = share(k), max(1, (1 << 22) // len(block))
        for s in range(0, 600, step):
            gen = np.random.default_rng([3, 1, k, s])
            rows = gen.integers(0, len(block), int(draws[s : s + step].sum()))
            for r in range(s, min(600, s + step)):
                mine, rows = rows[: draws[r]], rows[draws[r] :]
                sums[r] += block[mine].sum(axis=0)
    diff = sums[:, 0] / 500 - sums[:, 1] / 500
    assert got["low"] == pytest.approx(np.percentile(diff, 2.5), abs=1e-9) and got["high"] == pytest.approx(np.percentile(diff, 97.5), abs=1e-9)
    assert got["n"] == 500 and got["p"] == pytest.approx(min(1, 2 * np.mean(diff <= 0 if got["diff"] > 0 else diff >= 0)))
