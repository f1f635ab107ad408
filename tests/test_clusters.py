"""k-means with bounds: the clusters of a plain loop with a small share of its products, in one task and in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import clusters


def plain(x, start, rounds, spherical):
    """Rounds in which every vector meets every centroid."""
    centre = x[start].copy()
    for _ in range(rounds):
        score = x @ centre.T - (0 if spherical else (centre * centre).sum(axis=1) / 2)
        own = score.argmax(axis=1)
        total = np.stack([x[own == k].sum(axis=0) for k in range(len(centre))])
        n = np.bincount(own, minlength=len(centre))
        moved = total / np.maximum(n, 1)[:, None]
        if spherical:
            moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        moved = np.where(n[:, None] > 0, moved, centre)
        still, centre = np.abs(moved - centre).max() <= 1e-12, moved
        if still:
            break
    return own, centre


@pytest.mark.parametrize("spherical", [True, False])
@pytest.mark.parametrize("local", [20_000, 0])
def test_bounds_give_the_clusters_of_a_plain_loop(spark, monkeypatch, spherical, local):
    monkeypatch.setattr(clusters, "LOCAL", local)
    monkeypatch.setattr(clusters, "BLOCK", 256)
    monkeypatch.setattr(clusters, "PART", 16)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 8)) * 3
    x = (centre[rng.integers(0, 40, 1600)] + rng.normal(size=(1600, 8)) * 0.4).round(6)
    x[::200] = x[0]
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "source_id int, doc_id int, vec array<double>").repartition(5)
    order = [r["doc_id"] for r in df.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("h")).orderBy("h", "doc_id").collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if spherical else x
    own, centres = plain(unit, order[:40], 20, spherical)
    products: list = []
    members, found = clusters._fold(df, ["source_id"], F.lit(40), 20, spherical, 0, 0, products)
    got = {r["doc_id"]: r["cluster"] for r in members.collect()}
    assert [got[k] for k in range(len(x))] == own.tolist()
    vec = {r["cluster"]: r["vec"] for r in found.collect()}
    assert np.allclose([vec[k] for k in range(40)], centres, atol=1e-9)
    if not local:
        done, whole = map(sum, zip(*products, strict=True))
        assert products[0][0] == products[0][1] and done < 0.7 * whole and products[-1][0] < 0.5 * products[-1][1], products


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("ahead", [3, 1000])
def test_replayed_rounds_equal_one_task(monkeypatch, seed, ahead):
    """Rounds that see only the smallest clusters and a few neighbours of each merge as a scan of all clusters does."""
    rng = np.random.default_rng(seed)
    k, least = int(rng.integers(2, 40)), int(rng.integers(2, 9))
    n = rng.integers(0, 12, k) if seed % 3 else rng.integers(0, 4, k)
    total = rng.normal(size=(k, 3)).round(int(rng.integers(0, 4))) * np.maximum(n, 1)[:, None]
    want = clusters._absorb(total, n, least)
    now, size, into = total.copy(), n.copy(), np.arange(k)
    while True:
        order = sorted((int(size[c]), c) for c in range(k) if 0 < size[c] < least)
        asked = [(s, c, now[c]) for s, c in order[:ahead]]
        near = {}
        for _, c, t in asked:
            score = np.round(clusters._unit(now) @ clusters._unit(t), clusters.DIGITS)
            near[c] = [(score[x], x, now[x], int(size[x])) for x in sorted((x for x in range(k) if x != c and size[x]), key=lambda x: (-score[x], x))[: clusters.NEAR]]
        done = clusters._replayed(asked, near, 3, least, len(order) > ahead)
        if not done:
            break
        for c, target, t, s in done:
            now[c], size[c] = t, s
            if target >= 0:
                into[c] = target
    for _ in range(k):
        into = into[into]
    live = size > 0
    got = np.where(live[into], (np.cumsum(live) - 1)[into], -1)
    assert got.tolist() == want.tolist()


def test_merging_in_rounds_gives_the_clusters_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LOCAL", 0)
    monkeypatch.setattr(clusters, "BLOCK", 128)
    monkeypatch.setattr(clusters, "PART", 8)
    monkeypatch.setattr(clusters, "AHEAD", 20)
    rng = np.random.default_rng(4)
    rows = [(s, k, x.tolist()) for s, n in ((0, 240), (1, 30)) for k, x in enumerate(rng.normal(size=(n, 4)).round(3))]
    df = spark.createDataFrame(rows, "source_id int, doc_id int, vec array<double>")
    k = F.ceil(F.col("size") / 5)

    def run(merge):
        monkeypatch.setattr(clusters, "MERGE", merge)
        members, centres = clusters._fold(df, ["source_id"], k, 4, True, 5, 0)
        return sorted(map(tuple, members.collect())), sorted((r["source_id"], r["cluster"], [round(x, 9) for x in r["vec"]], r["n"]) for r in centres.collect())

    one, rounds = run(20_000), run(0)
    assert one == rounds and len(one[0]) == 270
    assert min(r[3] for r in one[1]) >= 5 and len(one[1]) < 48
