"""Exact percentiles of groups of any size, by narrowing brackets around the ranks that count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .routing import small

#: A group, or a bracket around a rank, of up to so many values is sorted in one place.
GATHER = 10_000
#: Accuracy of the sketch that proposes splits, and how far around a rank they lie, in shares of a bracket.
SKETCH, MARGIN = 1_000, 0.004


def _interpolated(q: float, n: Column, lower: Column, upper: Column) -> Column:
    at = (n - 1) * F.lit(q)
    return lower + (upper - lower) * (at - F.floor(at))


def _sorted_at(values: Column, q: float) -> Column:
    n = F.size(values)
    at = F.floor((n - 1) * F.lit(q)).cast("int")
    return _interpolated(q, n, F.get(values, at), F.get(values, F.least(at + 1, n - 1)))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column per share: percentiles with linear interpolation, as numpy's default. Nulls and NaN don't count.

    Groups of up to GATHER values are sorted. For a larger one every rank that counts has a bracket of values, at first
    the group's least and largest. Each round a mergeable sketch proposes two values near the rank, the values below, at,
    between and above them are counted, and the part that holds the rank is the next bracket, which is smaller whatever
    the sketch says; once a bracket holds one value, or few enough to sort, its rank is read. So no task holds a group's
    values, and three or four rounds do for 10^12. A group without values gives nulls; null keys are a group.
    """
    if any(not 0 <= q <= 1 for q in shares.values()):
        raise ValueError("shares must be from 0 to 1")
    x = F.col(value).cast("double")
    named = df.select(*keys, F.when(~F.isnan(x), x).alias("x"))
    sizes = checkpointed(named.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in keys]
    if not sizes.where(F.col("n") > GATHER).limit(1).count():
        gathered = named.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        return gathered.select(*keys, *(_sorted_at(F.col("xs"), q).alias(name) for name, q in shares.items()))

    large = small(sizes.where(F.col("n") > GATHER).select(*keys).withColumn("large", F.lit(True)))
    joined = named.join(large, same(named, large)) if keys else named
    joined = joined.select(*(named[c] for c in keys), "x") if keys else joined
    few = sizes.where(F.col("n") <= GATHER).select(*keys)
    some = named.join(small(few), same(named, few), "left_semi") if keys else named.limit(0)
    gathered = some.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") >= 0)
    out = gathered.select(*keys, *(_sorted_at(F.col("xs"), q).alias(name) for name, q in shares.items()))

    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * F.lit(q)), F.ceil((F.col("n") - 1) * F.lit(q))) for q in shares.values()))))
    todo = sizes.where(F.col("n") > GATHER).select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    found = None
    for _ in range(64):
        todo = checkpointed(todo)
        ready = (F.col("inside") <= GATHER) | (F.col("low") == F.col("high"))
        done = todo.where(ready)
        found = done if found is None else found.unionByName(done)
        todo = todo.where(~ready)
        if not todo.limit(1).count():
            break
        todo = _narrowed(joined, todo, keys)
    values = _bracketed(joined, found.where("low < high"), keys).groupBy(*keys, "rank").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.any_value("below").alias("below"))
    read = values.select(*keys, "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("v")).unionByName(found.where("low = high").select(*keys, "rank", F.col("low").alias("v")))
    per = read.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    both = sizes.join(per, same(sizes, per)).select(*(sizes[c] for c in keys), "n", "at") if keys else sizes.crossJoin(F.broadcast(per))
    place = lambda q, f: F.element_at("at", f((F.col("n") - 1) * F.lit(q)))
    return both.select(*keys, *(_interpolated(q, F.col("n"), place(q, F.floor), place(q, F.ceil)).alias(name) for name, q in shares.items())).unionByName(out)


def _bracketed(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Values that lie in a bracket of their group, with its columns."""
    b = brackets.select(*(F.col(c).alias(f"b_{c}") for c in keys), "rank", "low", "high", "below", "inside")
    met = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in keys] + [F.col("x").between(F.col("low"), F.col("high"))]
    return values.join(small(b), met).select(*keys, "x", "rank", "low", "high", "below", "inside")


def _narrowed(values: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """The next bracket of each rank: below, at, between or above the two values that a sketch proposes."""
    inside = _bracketed(values, todo, keys)
    place = (F.col("rank") - F.any_value("below")) / F.any_value("inside")
    sketch = inside.groupBy(*keys, "rank").agg(F.percentile_approx("x", [k / 500 for k in range(501)], SKETCH).alias("s"), place.alias("at"))
    one = lambda shift: F.get("s", F.least(F.lit(500), F.greatest(F.lit(0), F.round((F.col("at") + shift) * 500).cast("int"))))
    splits = checkpointed(sketch.select(*(F.col(c).alias(f"s_{c}") for c in keys), F.col("rank").alias("s_rank"), one(-MARGIN).alias("a"), one(MARGIN).alias("b")))
    met = inside.join(small(splits), [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in keys] + [F.col("rank") == F.col("s_rank")])
    v, a, b = F.col("x"), F.col("a"), F.col("b")
    parts = {"under": v < a, "first": v == a, "middle": (v > a) & (v < b), "second": (v == b) & (a < b), "over": v > b}
    counted = met.groupBy(*keys, "rank").agg(
        F.any_value("below").alias("below"),
        *(F.sum(c.cast("long")).alias(f"n_{p}") for p, c in parts.items()), *(f(F.when(c, v)).alias(f"{n}_{p}") for p, c in parts.items() for n, f in (("low", F.min), ("high", F.max))),
    )
    start, before, choice = F.col("below"), F.lit(0), None
    for p in parts:
        piece = F.struct(F.col(f"low_{p}").alias("low"), F.col(f"high_{p}").alias("high"), (start + before).alias("below"), F.col(f"n_{p}").alias("inside"))
        before = before + F.col(f"n_{p}")
        holds = F.col("rank") < start + before
        choice = F.when(holds, piece) if choice is None else choice.when(holds, piece)
    return counted.select(*keys, "rank", choice.alias("c")).select(*keys, "rank", "c.*")


def resample_shares(sizes: list[int], resamples: int, seed: int):
    """How many of n = sum(sizes) draws fall into each block, for every resample: function of a block's number.

    The draws are split in halves of the blocks, and again, by binomials whose generators are keyed by the halves' ends, so
    any task computes its own block's numbers from about log2(blocks) of them, and all tasks agree: they sum to n.
    """
    import numpy as np

    total = np.r_[0, np.cumsum(sizes)]

    def of(block: int) -> np.ndarray:
        lo, hi, n = 0, len(sizes), np.full(resamples, total[-1], np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            all_, left = total[hi] - total[lo], total[mid] - total[lo]
            draws = np.random.default_rng([seed, 0, lo, hi]).binomial(n, left / all_ if all_ else 0.0)
            lo, hi, n = (lo, mid, draws) if block < mid else (mid, hi, n - draws)
        return n

    return of


def resample_sums(values, draws, seed: int, block: int):
    """Sums of the rows (n, columns) drawn for each resample, draws[r] of them with replacement: (resamples, columns)."""
    import numpy as np

    out, step = np.zeros((len(draws), values.shape[1])), max(1, (1 << 22) // max(1, len(values)))
    for a in range(0, len(draws), step):
        part = draws[a : a + step]
        rows = np.random.default_rng([seed, 1, block, a]).integers(0, len(values), int(part.sum()))
        ends = np.cumsum(part)
        for c in range(values.shape[1]):
            sums = np.r_[0.0, np.cumsum(values[rows, c])]
            out[a : a + step, c] = sums[ends] - sums[ends - part]
    return out


def blocks_for(n: int, per: int = 2_048, most: int = 4_096) -> int:
    """Into how many blocks n rows are dealt: their sizes are part of every task's closure, so they are bounded."""
    return max(1, min(most, math.ceil(n / per)))
