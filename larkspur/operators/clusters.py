"""Clustering of sources' documents and the indexes built from it.

k-means runs in rounds: vectors are assigned in blocks, sums and counts of each cluster are added up, and centroids move. A
source of up to LOCAL vectors takes its rounds within one task; for a larger one each round is a pass over its blocks, and
only sums of blocks meet. Both follow the same rules, so a source's size decides where the work is done, not its result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .quantiles import blocks_for, resample_shares, resample_sums

#: Vectors of a source whose rounds one task takes, vectors of one block, and centroids of one part.
LOCAL, BLOCK, PART = 20_000, 2_048, 1_024
#: Parts of a source's centroids that go to every block of it, to make bounds exact; with more, only their moves go.
TIGHT = 64
#: Centroids that move no further than this have settled.
STILL = 1e-12
#: Clusters of a source whose small ones are merged within one task; with more, small ones a round, and neighbours of each.
MERGE, AHEAD, NEAR = 20_000, 512, 4
#: Bytes of all groups' smallest clusters that are broadcast in a round.
HEADS = 128 << 20
#: Products of merging clusters are compared at this many digits, so that ties don't hang on how they are summed.
DIGITS = 12


def _nearest(x: np.ndarray, centre: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best centroid of each vector and its score: the product with unit centroids, or by Euclidean distance."""
    score = x @ centre.T - (0 if spherical else (centre * centre).sum(axis=1) / 2)
    best = score.argmax(axis=1)
    return best, score[np.arange(len(x)), best]


def _two_nearest(x: np.ndarray, centre: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _nearest(), and the score of the second best centroid."""
    score = x @ centre.T - (0 if spherical else (centre * centre).sum(axis=1) / 2)
    best, rows = score.argmax(axis=1), np.arange(len(x))
    first = score[rows, best]
    score[rows, best] = -np.inf
    return best, first, score.max(axis=1)


def _distance(x: np.ndarray, score: np.ndarray, spherical: bool) -> np.ndarray:
    """Euclidean distance of each vector from a centroid with that score; from none, infinite."""
    square = 2 - 2 * score if spherical else (x * x).sum(axis=1) - 2 * score
    return np.sqrt(np.maximum(square, 0))


def _undecided(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, shift: np.ndarray, level: bool, centre: np.ndarray | None, spherical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors whose nearest centroid may have changed, and bounds moved along with the centroids.

    upper is at least the distance from the own centroid, lower at most that from any other. Centroids that moved by shift
    change them by no more than that, and a vector whose bounds still leave a gap keeps its centroid without a product.
    Where they don't, one product with the own centroid makes upper exact again, if the centroids are at hand. The margin
    covers rounding. Without level (centroids that are not all of length 1) products don't follow distances, and nothing
    is decided.
    """
    if not level:
        return np.ones(len(x), bool), upper, lower
    upper, lower = upper + shift[own], lower - shift.max(initial=0.0)
    margin = 1e-7 * (1 + np.sqrt((x * x).sum(axis=1)))
    open_ = upper + margin >= lower
    if centre is not None:
        at = np.flatnonzero(open_ & np.isfinite(upper))
        mine = centre[own[at]]
        score = (x[at] * mine).sum(axis=1) - (0 if spherical else (mine * mine).sum(axis=1) / 2)
        upper[at] = _distance(x[at], score, spherical)
        open_[at] = upper[at] + margin[at] >= lower[at]
    return open_, upper, lower


def _level(centre: np.ndarray, spherical: bool) -> bool:
    return not spherical or bool((np.abs((centre * centre).sum(axis=1) - 1) <= 1e-9).all())


def _totals(x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of each cluster's vectors."""
    order = np.argsort(own, kind="stable")
    ids, first = np.unique(own[order], return_index=True)
    total, n = np.zeros((k, x.shape[1])), np.zeros(k, np.int64)
    if len(ids):
        total[ids] = np.add.reduceat(x[order], first, axis=0)
        n[ids] = np.diff(np.r_[first, len(own)])
    return total, n


def _moved(centre: np.ndarray, total: np.ndarray, n: np.ndarray, spherical: bool) -> np.ndarray:
    """Means of the clusters, of length 1 if spherical; an empty one keeps its centroid."""
    mean = total / np.maximum(n, 1)[:, None]
    if spherical:
        mean /= np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), STILL)
    return np.where(n[:, None] > 0, mean, centre)


def _absorb(total: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """New number of each cluster after those with fewer than least members have joined their nearest one.

    The smallest goes first, into the centroid with the largest product, whose sum grows by its own; all from sums and
    counts, so no member is looked at. Numbers close up.
    """
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), STILL)
    total, n, into = total.copy(), n.astype(np.int64).copy(), np.arange(len(n))
    live = n > 0
    while live.sum() > 1:
        size = np.where(live, n, np.iinfo(np.int64).max)
        small = int(size.argmin())
        if size[small] >= least:
            break
        near = np.where(live, np.round(unit(total) @ unit(total[small]), DIGITS), -np.inf)
        near[small] = -np.inf
        target = int(near.argmax())
        total[target] += total[small]
        n[target] += n[small]
        live[small] = False
        into[into == small] = target
    return np.where(np.isin(into, np.flatnonzero(live)), (np.cumsum(live) - 1)[into], -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), STILL)


def _replayed(asked: list[tuple], near: dict, width: int, least: int, more: bool) -> list[tuple]:
    """Merges of the smallest clusters as far as they are certain: (cluster, target or -1, total, n) of every changed cluster.

    asked: (n, cluster, total) of the smallest ones in order; near: the nearest others of each (score, cluster, total, n), all of them
    if under NEAR. Clusters that changed are compared anew; of those that didn't, the first that near lists is the nearest.
    The replay ends at a cluster that has changed itself, whose listed neighbours all have, or, with more, beyond what was asked.
    """
    heap, totals = [(n, c) for n, c, _ in asked], {c: t for _, c, t in asked}
    changed: dict = {}
    gone: dict = {}
    heapq.heapify(heap)
    while heap:
        n, j = heapq.heappop(heap)
        if j in gone or (j in changed and changed[j][1] != n):
            continue
        if j in changed or (more and (n, j) > asked[-1][:2]):
            break
        fresh = next((x for x in near[j] if x[1] not in changed and x[1] not in gone), None)
        if fresh is None and len(near[j]) >= NEAR:
            break
        found = [] if fresh is None else [(-fresh[0], fresh[1])]
        if changed:
            names = sorted(changed)
            score = np.round(_unit(np.stack([changed[c][0] for c in names])) @ _unit(totals[j]), DIGITS)
            found.append((-score.max(), names[int(score.argmax())]))
        if not found:
            break
        target = min(found)[1]
        total, size = changed[target] if target in changed else fresh[2:]
        changed[target] = (total + totals[j], size + n)
        gone[j] = target
        if size + n < least:
            heapq.heappush(heap, (size + n, target))
    return [*((j, t, np.zeros(width), 0) for j, t in gone.items()), *((c, -1, t, n) for c, (t, n) in changed.items())]


def _merged(parts: DataFrame, keys: list[str], group: str, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """_absorb() for groups of any number of clusters: parts (keys, part, total, n) after merging, and moves (keys, cluster, target).

    A round takes the AHEAD smallest clusters of each group, finds the NEAR nearest of each in blocks, and merges in order as far as
    these tell: see _replayed(). The first of a round always goes, so rounds end; what a task holds is bounded, whatever the number of clusters.
    """
    shape = f"{group}, cluster long, n long, total binary"

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                n, total = np.frombuffer(r.n, "<i8"), _matrix([r.total], width)
                rows += [(*(getattr(r, c) for c in keys), r.part * PART + k, n[k], total[k].tobytes()) for k in np.flatnonzero((n > 0) & (n < least))]
            yield pd.DataFrame(rows, columns=[*keys, "cluster", "n", "total"])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "cluster"])
        kept = frame.iloc[:AHEAD]
        return frame.iloc[[0]][keys].assign(ids=[kept["cluster"].to_numpy("<i8").tobytes()], totals=[b"".join(kept["total"])], ns=[kept["n"].to_numpy("<i8").tobytes()], more=len(frame) > AHEAD)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                name = tuple(getattr(r, c) for c in keys)
                ids, n, total = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.n, "<i8"), _matrix([r.total], width)
                here = np.arange(len(n)) + r.part * PART
                score = np.round(_unit(_matrix([r.totals], width)) @ _unit(total).T, DIGITS)
                score[(ids[:, None] == here) | (n == 0)] = -np.inf
                for k, j in enumerate(ids.tolist()):
                    best = np.lexsort((here, -score[k]))[:NEAR]
                    mine = [(score[k, b], int(here[b]), total[b], int(n[b])) for b in best if score[k, b] > -np.inf]
                    held[name, j] = sorted([*held.get((name, j), []), *mine], key=lambda x: (-x[0], x[1]))[:NEAR]
        rows = [(*name, j, s, c, t.tobytes(), n) for (name, j), best in held.items() for s, c, t, n in best]
        yield pd.DataFrame(rows, columns=[*keys, "asked", "score", "cluster", "total", "n"])

    def replay(key: tuple, asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        r = asked.iloc[0]
        ids, ns, totals = np.frombuffer(r["ids"], "<i8").tolist(), np.frombuffer(r["ns"], "<i8").tolist(), _matrix([r["totals"]], width)
        by: dict = {j: [] for j in ids}
        for x in found.sort_values(["score", "cluster"], ascending=[False, True]).itertuples(index=False):
            by[x.asked].append((x.score, x.cluster, np.frombuffer(x.total, "<f8"), x.n))
        rows = _replayed(list(zip(ns, ids, totals, strict=True)), by, width, least, bool(r["more"]))
        out = pd.DataFrame([(c, t, v.tobytes(), n) for c, t, v, n in rows], columns=["cluster", "target", "total", "n"])
        return pd.concat([asked.iloc[[0] * len(out)][keys].reset_index(drop=True), out], axis=1)

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[[*keys, "part"]].copy()
            totals, ns = [], []
            for r in frame.itertuples(index=False):
                total, n = _matrix([r.total], width).copy(), np.frombuffer(r.n, "<i8").copy()
                for x in () if r.changes is None else r.changes:
                    total[x["cluster"] - r.part * PART], n[x["cluster"] - r.part * PART] = np.frombuffer(x["total"], "<f8"), x["n"]
                totals.append(total.tobytes())
                ns.append(n.tobytes())
            yield out.assign(total=totals, n=ns)

    parts, moves = checkpointed(parts), None
    order = Window.partitionBy(*keys).orderBy("n", "cluster")
    while True:
        first = parts.mapInPandas(small, shape).withColumn("place", F.row_number().over(order)).where(F.col("place") <= AHEAD + 1)
        asked = checkpointed(first.groupBy(*keys).applyInPandas(pack, f"{group}, ids binary, totals binary, ns binary, more boolean"))
        size = asked.agg(F.coalesce(F.sum(F.octet_length("totals")), F.lit(0))).first()[0]
        heads = asked.select(*keys, "ids", "totals")
        found = parts.join(F.broadcast(heads) if size <= HEADS else heads, keys).mapInPandas(near, f"{group}, asked long, score double, cluster long, total binary, n long")
        best = found.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "asked").orderBy(F.desc("score"), "cluster"))).where(F.col("place") <= NEAR).drop("place")
        done = checkpointed(asked.groupBy(*keys).cogroup(best.groupBy(*keys)).applyInPandas(replay, f"{group}, cluster long, target long, total binary, n long"))
        if done.isEmpty():
            break
        new = done.where("target >= 0").select(*keys, "cluster", "target")
        moves = new if moves is None else moves.unionByName(new)
        changes = done.groupBy(*keys, F.floor(F.col("cluster") / PART).alias("part")).agg(F.collect_list(F.struct("cluster", "total", "n")).alias("changes"))
        parts = checkpointed(parts.join(changes, [*keys, "part"], "left").mapInPandas(update, f"{group}, part long, total binary, n binary"))
    if moves is None:
        return parts, parts.select(*keys, F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("target")).where(F.lit(False))
    moves = checkpointed(moves)
    while True:  # a target that was merged later leads on: chains halve each time
        on = moves.select(*keys, F.col("cluster").alias("target"), F.col("target").alias("_on"))
        longer = checkpointed(moves.join(on, [*keys, "target"], "left"))
        moves = longer.select(*keys, "cluster", F.coalesce("_on", "target").alias("target"))
        if longer.where("_on is not null").isEmpty():
            return parts, moves


def _matrix(packed: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(-1, width)


def _fold(docs: DataFrame, keys: list[str], k: Column, rounds: int, spherical: bool, least: int, seed: int, products: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters of each group of docs (keys, doc_id, vec): members (keys, doc_id, cluster), and centroids (keys, cluster, vec, n).

    k is an expression of size, the group's number of vectors. The first k vectors in the order of a hash of doc_id are
    the first centroids. least merges smaller clusters (0: none). Bounds on the distances tell which vectors can have changed
    their centroid; only these are multiplied with the centroids: see _undecided(). products, if given, gets the number of
    products and of all that there would be in each round of the groups too large for one task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    group = ", ".join(f"{c} {kinds[c]}" for c in keys)
    sizes = docs.groupBy(*keys).agg(F.count("*").alias("size")).withColumn("k", F.greatest(F.lit(1), F.least(k, F.col("size"))).cast("int"))
    named = docs.select(*keys, "doc_id", F.col("vec").cast("array<double>").alias("vec"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).join(sizes, keys)
    members = f"{group}, doc_id {kinds['doc_id']}, cluster int, vec array<double>, n long"

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "doc_id"]).reset_index(drop=True)
        x = np.stack([np.asarray(v, np.float64) for v in frame["vec"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), STILL) if spherical else x
        centre, own, shift = x[: int(frame["k"].iloc[0])], np.zeros(len(x), np.int64), np.zeros(1)
        upper, lower = np.full(len(x), np.inf), np.zeros(len(x))
        for _ in range(rounds):
            open_, upper, lower = _undecided(x, own, upper, lower, shift, _level(centre, spherical), centre, spherical)
            rows = np.flatnonzero(open_)
            for a in range(0, len(rows), BLOCK):
                part = rows[a : a + BLOCK]
                own[part], first, second = _two_nearest(x[part], centre, spherical)
                upper[part], lower[part] = _distance(x[part], first, spherical), _distance(x[part], second, spherical)
            total, n = _totals(x, own, len(centre))
            moved = _moved(centre, total, n, spherical)
            shift = np.sqrt(((moved - centre) ** 2).sum(axis=1))
            still, centre = np.abs(moved - centre).max() <= STILL, moved
            if still:
                break
        if least:
            new = _absorb(total, n, min(least, len(x)))
            own = new[own]
            total, n = _totals(x, own, new.max() + 1)
            centre = _moved(np.zeros_like(total), total, n, spherical)
        first = frame.iloc[[0] * len(centre)][keys].assign(doc_id=None, cluster=np.arange(len(centre), dtype=np.int32), vec=list(centre), n=n)
        return pd.concat([frame[[*keys, "doc_id"]].assign(cluster=own.astype(np.int32), vec=None, n=None), first], ignore_index=True)

    here = checkpointed(named.where(F.col("size") <= LOCAL).groupBy(*keys).applyInPandas(local, members))
    out = here.where("doc_id is not null").select(*keys, "doc_id", "cluster"), here.where("doc_id is null").select(*keys, "cluster", "vec", "n")
    large = named.where(F.col("size") > LOCAL)
    if large.isEmpty():
        return out
    far = _rounds(large, keys, group, kinds["doc_id"], rounds, spherical, least, products)
    return out[0].unionByName(far[0]), out[1].unionByName(far[1])


def _rounds(named: DataFrame, keys: list[str], group: str, id_kind: str, rounds: int, spherical: bool, least: int, products: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The rounds of groups too large for one task: see _fold(). Each round's centroids are checkpointed."""
    named = checkpointed(named)
    width = named.select(F.size("vec")).first()[0]

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.float64) for v in frame["vec"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), STILL) if spherical else x
        return frame.iloc[[0]][[*keys, "block", "size"]].assign(ids=[list(frame["doc_id"])], x=[x.tobytes()])

    dealt = named.withColumn("block", F.pmod("h", F.ceil(F.col("size") / BLOCK)))
    blocks = checkpointed(dealt.groupBy(*keys, "block").applyInPandas(block, f"{group}, block long, size long, ids array<{id_kind}>, x binary"))

    # the first k by hash, ranked by ranges of the hash: their counts, then places within them
    ranges = named.withColumn("range", F.shiftright("h", 52))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy(*keys, "range").agg(F.count("*").alias("c")).select(*keys, "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy(*keys, "range").orderBy("h", "doc_id")) - 1
    first = ranges.join(offsets, [*keys, "range"]).where(F.col("offset") < F.col("k")).withColumn("cluster", place).where(F.col("cluster") < F.col("k"))

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cluster")
        x = np.stack([np.asarray(v, np.float64) for v in frame["vec"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), STILL) if spherical else x
        return frame.iloc[[0]][[*keys, "part"]].assign(x=[x.tobytes()], total=[b""], n=[b""], shift=[np.zeros(len(x)).tobytes()], moved=np.inf, level=_level(x, spherical))

    shape = f"{group}, part long, x binary, total binary, n binary, shift binary, moved double, level boolean"
    centres = checkpointed(first.withColumn("part", F.floor(F.col("cluster") / PART)).groupBy(*keys, "part").applyInPandas(part, shape))
    bounds = f"{group}, block long, own binary, upper binary, lower binary"

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = [len(_matrix([x], width)) for x in frame["x"]]
            yield frame[[*keys, "block"]].assign(own=[np.zeros(k, "<i8").tobytes() for k in n], upper=[np.full(k, np.inf).tobytes() for k in n], lower=[np.zeros(k).tobytes() for k in n])

    def narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks with their moved bounds and the rows that are still open, with these rows' vectors."""
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                x, parts = _matrix([r.x], width), sorted(r.shifts, key=lambda s: s["part"])
                shift, centre = np.concatenate([np.frombuffer(s["shift"], "<f8") for s in parts]), None
                if all(s["x"] for s in parts):
                    centre = _matrix([s["x"] for s in parts], width)
                open_, upper, lower = _undecided(x, np.frombuffer(r.own, "<i8"), np.frombuffer(r.upper, "<f8"), np.frombuffer(r.lower, "<f8"), shift, r.level, centre, spherical)
                at = np.flatnonzero(open_)
                rows.append((*(getattr(r, c) for c in keys), r.block, r.own, upper.tobytes(), lower.tobytes(), at.astype("<i8").tobytes(), x[at].tobytes(), len(at), len(x)))
            yield pd.DataFrame(rows, columns=[*keys, "block", "own", "upper", "lower", "rows", "x", "open", "size"])

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                best, one, two = _two_nearest(_matrix([r.x], width), _matrix([r.c], width), spherical)
                rows.append((*(getattr(r, c) for c in keys), r.block, (best + r.part * PART).astype("<i8").tobytes(), one.tobytes(), two.tobytes()))
            yield pd.DataFrame(rows, columns=[*keys, "block", "best", "one", "two"])

    def best_of(key: tuple, old: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The block's bounds with its open rows settled: the best of all parts, and the second best of all."""
        own, upper, lower = (np.frombuffer(old[c].iloc[0], kind).copy() for c, kind in (("own", "<i8"), ("upper", "<f8"), ("lower", "<f8")))
        if len(found):
            at, x = np.frombuffer(old["rows"].iloc[0], "<i8"), _matrix(old["x"], width)
            best, one, two = (np.stack([np.frombuffer(b, kind) for b in found[c]]) for c, kind in (("best", "<i8"), ("one", "<f8"), ("two", "<f8")))
            order = np.lexsort((best, -one), axis=0)[0] if len(best) > 1 else np.zeros(best.shape[1], np.int64)
            each = np.arange(best.shape[1])
            first = one[order, each]
            rest = one.copy()
            rest[order, each] = -np.inf
            own[at], upper[at], lower[at] = best[order, each], _distance(x, first, spherical), _distance(x, np.maximum(rest.max(axis=0), two.max(axis=0)), spherical)
        return old.iloc[[0]][[*keys, "block"]].assign(own=[own.tobytes()], upper=[upper.tobytes()], lower=[lower.tobytes()])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums per part of the clusters, added up over the blocks that a task has before anything is shuffled."""
        held: dict = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                x, own = _matrix([r.x], width), np.frombuffer(r.own, "<i8")
                for p in np.unique(own // PART):
                    mine = own // PART == p
                    total, n = _totals(x[mine], own[mine] - p * PART, PART)
                    name = (*(getattr(r, c) for c in keys), int(p))
                    if name in held:
                        held[name][0][:] += total
                        held[name][1][:] += n
                    else:
                        held[name] = (total, n)
            if len(held) > 256:
                yield _sent(held)
                held = {}
        if held:
            yield _sent(held)

    def _sent(held: dict) -> pd.DataFrame:
        rows = []
        for name, (total, n) in held.items():
            used = np.flatnonzero(n)
            rows.append((*name, used.astype("<i8").tobytes(), total[used].tobytes(), n[used].tobytes()))
        return pd.DataFrame(rows, columns=[*keys, "part", "used", "total", "n"])

    def move(key: tuple, old: pd.DataFrame, added: pd.DataFrame) -> pd.DataFrame:
        centre = _matrix(old["x"], width)
        total, n = np.zeros(centre.shape), np.zeros(len(centre), np.int64)
        for r in added.sort_values(["used", "total"]).itertuples():
            used = np.frombuffer(r.used, "<i8")
            total[used] += _matrix([r.total], width)
            n[used] += np.frombuffer(r.n, "<i8")
        moved = _moved(centre, total, n, spherical)
        shift = np.sqrt(((moved - centre) ** 2).sum(axis=1))
        return old.iloc[[0]][[*keys, "part"]].assign(x=[moved.tobytes()], total=[total.tobytes()], n=[n.tobytes()], shift=[shift.tobytes()], moved=np.abs(moved - centre).max(), level=_level(moved, spherical))

    own = blocks.mapInPandas(begin, bounds)
    for _ in range(rounds):
        whole = F.when(F.count("*") <= TIGHT, F.collect_list(F.struct("part", "shift", "x"))).otherwise(F.collect_list(F.struct("part", "shift", F.lit(b"").alias("x"))))
        shifts = centres.groupBy(*keys).agg(whole.alias("shifts"), F.min("level").alias("level"))
        open_ = checkpointed(blocks.drop("size", "ids").join(own, [*keys, "block"]).join(shifts, keys).mapInPandas(narrow, f"{bounds}, rows binary, x binary, open long, size long"))
        if products is not None:
            k = centres.groupBy(*keys).agg(F.sum(F.octet_length("shift") / 8).alias("k"))
            products.append(tuple(open_.join(k, keys).agg(F.sum(F.col("open") * F.col("k")), F.sum(F.col("size") * F.col("k"))).first()))
        pairs = open_.where("open > 0").select(*keys, "block", "x").join(centres.select(*keys, "part", F.col("x").alias("c")), keys)
        found = pairs.mapInPandas(near, f"{group}, block long, best binary, one binary, two binary")
        own = checkpointed(open_.groupBy(*keys, "block").cogroup(found.groupBy(*keys, "block")).applyInPandas(best_of, bounds))
        added = blocks.join(own, [*keys, "block"]).mapInPandas(sums, f"{group}, part long, used binary, total binary, n binary")
        centres = checkpointed(centres.groupBy(*keys, "part").cogroup(added.groupBy(*keys, "part")).applyInPandas(move, shape))
        if centres.agg(F.max("moved")).first()[0] <= STILL:
            break

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total, n = _matrix(frame["total"], width), np.concatenate([np.frombuffer(b, "<i8") for b in frame["n"]])
        new, centre = np.arange(len(n)), _matrix(frame["x"], width)
        if least:
            new = _absorb(total, n, min(least, int(n.sum())))
            k = new.max() + 1
            merged, count = np.zeros((k, width)), np.zeros(k, np.int64)
            np.add.at(merged, new[new >= 0], total[new >= 0])
            np.add.at(count, new[new >= 0], n[new >= 0])
            centre, n = _moved(np.zeros_like(merged), merged, count, spherical), count
        rows = frame.iloc[[0] * (len(new) + len(centre))][keys].reset_index(drop=True)
        pad = [None] * len(new)
        return rows.assign(old=[*range(len(new)), *[None] * len(centre)], cluster=[*new.tolist(), *range(len(centre))], vec=[*pad, *centre], n=[*pad, *n.tolist()])

    listed = f"{group}, old long, cluster int, vec array<double>, n long"
    if least and width:
        k = centres.groupBy(*keys).agg(F.sum(F.octet_length("n") / 8).alias("k"))
        many = checkpointed(centres.join(k.where(F.col("k") > MERGE).select(*keys), keys, "left_semi"))
        numbers = centres.join(k.where(F.col("k") <= MERGE).select(*keys), keys, "left_semi").groupBy(*keys).applyInPandas(number, listed)
        if not many.isEmpty():
            numbers = numbers.unionByName(_renumbered(*_merged(many.select(*keys, "part", "total", "n"), keys, group, width, least), keys, group, width, spherical))
    else:
        numbers = centres.groupBy(*keys).applyInPandas(number, listed)
    numbers = checkpointed(numbers)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.concat([pd.DataFrame({**{c: getattr(r, c) for c in keys}, "doc_id": list(r.ids), "old": np.frombuffer(r.own, "<i8")}) for r in frame.itertuples(index=False)], ignore_index=True) if len(frame) else pd.DataFrame(columns=[*keys, "doc_id", "old"])

    found = blocks.join(own, [*keys, "block"]).select(*keys, "ids", "own").mapInPandas(each, f"{group}, doc_id {id_kind}, old long")
    members = found.join(numbers.where("old is not null").select(*keys, "old", "cluster"), [*keys, "old"]).select(*keys, "doc_id", "cluster")
    return members, numbers.where("old is null").select(*keys, "cluster", "vec", "n")


def _renumbered(parts: DataFrame, moves: DataFrame, keys: list[str], group: str, width: int, spherical: bool) -> DataFrame:
    """Clusters left after _merged() with closed-up numbers, and the new number of every old one: keys, old, cluster, vec, n."""

    def live(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                n, total = np.frombuffer(r.n, "<i8"), _matrix([r.total], width)
                centre = _moved(np.zeros_like(total), total, n, spherical)
                rows += [(*(getattr(r, c) for c in keys), r.part, r.part * PART + k, place, centre[k], n[k]) for place, k in enumerate(np.flatnonzero(n > 0))]
            yield pd.DataFrame(rows, columns=[*keys, "part", "old", "place", "vec", "n"])

    kept = checkpointed(parts.mapInPandas(live, f"{group}, part long, old long, place long, vec array<double>, n long"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = kept.groupBy(*keys, "part").agg(F.count("*").alias("c")).select(*keys, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    new = kept.join(offset, [*keys, "part"]).withColumn("cluster", (F.col("offset") + F.col("place")).cast("int"))
    own = new.select(*keys, "old", "cluster")
    led = moves.withColumnRenamed("cluster", "old").join(own.withColumnRenamed("old", "target"), [*keys, "target"]).select(*keys, "old", "cluster")
    empty = [F.lit(None).cast("array<double>").alias("vec"), F.lit(None).cast("long").alias("n")]
    return own.unionByName(led).select(*keys, "old", "cluster", *empty).unionByName(new.select(*keys, F.lit(None).cast("long").alias("old"), "cluster", "vec", "n"))


def cluster_index(docs: DataFrame, per_cluster: int = 10, least: int = 5, seed: int = 0) -> DataFrame:
    """Clusters of each source's documents (source_id, collection, doc_id, vec): source_id, collection, cluster_id, doc_id.

    Spherical k-means per collection, at most 25 rounds; k is a tenth of the documents, halves to even, one at least;
    clusters under `least` members are merged into their nearest. Numbers close up over collections, "public" first.
    """
    members, centres = _fold(docs, ["source_id", "collection"], F.bround(F.col("size") / per_cluster), 25, True, least, seed)
    groups = centres.groupBy("source_id", "collection").agg((F.max("cluster") + 1).alias("n"))
    before = Window.partitionBy("source_id").orderBy(F.when(F.col("collection") == "public", 0).otherwise(1), "collection").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("source_id", "collection", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return members.join(offsets, ["source_id", "collection"]).select("source_id", "collection", (F.col("cluster") + F.col("offset")).cast("int").alias("cluster_id"), "doc_id")


def kmeans_profiles(docs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Euclidean k-means centroids of each source (source_id, doc_id, vec): source_id, centroid_ix, vec, members."""
    _, centres = _fold(docs, ["source_id"], F.lit(k), 50, False, 0, seed)
    return centres.select("source_id", F.col("cluster").alias("centroid_ix"), "vec", F.col("n").alias("members"))


def cluster_members(docs: DataFrame, k: int, seed: int = 0, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Spherical clusters of each source's documents: members (source_id, doc_id, cluster) and centroids (source_id, cluster, vec, n)."""
    return _fold(docs, ["source_id"], F.lit(k), 25, True, least, seed)


def dirichlet_partition(docs: DataFrame, clients: int, alpha: float, seed: int = 0) -> DataFrame:
    """docs (doc_id, topic) with client: each topic's documents are spread over clients with proportions from a Dirichlet law.

    Proportions are gamma draws from a generator of the topic's own key, one row per topic; a document falls where the
    hash of its id does on the topic's cumulated proportions.
    """

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"topic": frame["topic"], "edges": [np.cumsum(np.random.default_rng([seed, int(h) & (2**63 - 1)]).dirichlet([alpha] * clients)).tolist() for h in frame["h"]]})

    topics = docs.select("topic").distinct().withColumn("h", F.xxhash64("topic"))
    edges = topics.mapInPandas(draw, f"topic {docs.schema['topic'].dataType.simpleString()}, edges array<double>")
    at = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    below = F.size(F.filter("edges", lambda e: e <= at))
    return docs.join(edges, "topic").withColumn("client", F.least(below, F.lit(clients - 1))).drop("edges")


def paired_bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """Intervals of the paired metrics' difference and ratio (unit, a, b), from resamples of n pairs: mean_a, mean_b, diff, low, high, ratio, ratio_low, ratio_high, p, n.

    A unit without one of the two values is an error. Each resample draws exactly n pairs with replacement. Pairs are dealt
    to blocks by a hash of the unit; how many of a resample's draws fall into a block follows from binomials that every
    task computes alike (resample_shares()), and a block's own draws from a generator of its own. Tasks add up their
    blocks, so what is shuffled is one row per task and resample, and the driver sees the blocks' sizes, 4,096 at most.
    """
    d = checkpointed(pairs.select("unit", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))
    broken, n = d.agg(F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("int")), F.count("*")).first()
    if broken:
        raise ValueError("a paired comparison needs both values of every unit")
    blocks = blocks_for(n)
    dealt = d.withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))
    sizes = [0] * blocks
    for r in dealt.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]
    share = resample_shares(sizes, resamples, seed)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = np.zeros((resamples, 2)), []

        def add() -> None:
            block, values = int(held[0]["block"].iloc[0]), np.concatenate([h[["a", "b"]].to_numpy() for h in held])
            total[:] += resample_sums(values, share(block), seed, block)

        for frame in frames:
            for _, part in frame.groupby("block", sort=True):
                if held and held[0]["block"].iloc[0] != part["block"].iloc[0]:
                    add()
                    held = []
                held.append(part)
        if held:
            add()
        yield pd.DataFrame({"r": np.arange(resamples, dtype=np.int32), "a": total[:, 0], "b": total[:, 1]})

    ordered = dealt.repartition("block").sortWithinPartitions("block", "unit", "a", "b").select("block", "a", "b")
    sums = ordered.mapInPandas(weigh, "r int, a double, b double").groupBy("r").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("w", F.lit(n)).where("w > 0")
    means = sums.select((F.col("a") / F.col("w")).alias("a"), (F.col("b") / F.col("w")).alias("b")).select((F.col("a") - F.col("b")).alias("m"), (F.col("a") / F.greatest("b", F.lit(1e-12))).alias("q"))
    at = lambda c, q, name: F.percentile(c, F.lit(q)).alias(name)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    spread = means.agg(at("m", 0.025, "low"), at("m", 0.975, "high"), at("q", 0.025, "ratio_low"), at("q", 0.975, "ratio_high"), share(F.col("m") <= 0).alias("below"), share(F.col("m") >= 0).alias("above"))
    point = d.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count("*").alias("n")).withColumns({"diff": F.col("mean_a") - F.col("mean_b"), "ratio": F.col("mean_a") / F.greatest("mean_b", F.lit(1e-12))})
    return point.crossJoin(spread).withColumn("p", F.least(F.lit(1.0), 2 * F.when(F.col("diff") > 0, F.col("below")).otherwise(F.col("above")))).drop("below", "above")
