"""Running totals and ranks of keys that may hold very many rows: by ranges first, then within each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], coarse: Column, order: list, totals: dict[str, Column]) -> DataFrame:
    """df with a running total of each column so far (its own row included) per key in the given order.

    coarse is an expression that never falls along the order (a day of a time, the leading bits of a hash): totals of
    each range meet in one small window, and rows only in that of their own range, so a key that a third of all rows
    have is as many tasks as it has ranges.
    """
    ranged = df.withColumn("_range", coarse)
    sums = ranged.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in totals.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*keys, "_range"])
    return joined.withColumns({n: F.col(f"_{n}") + F.sum(c).over(within) for n, c in totals.items()}).drop("_range", *(f"_{n}" for n in totals))


def rank_by_hash(df: DataFrame, keys: list[str], key_hash: str, out: str = "place") -> DataFrame:
    """df with the place (from 1) of each row within its key in the order of a hexadecimal hash column."""
    return running(df, keys, F.substring(key_hash, 1, 3), [key_hash], {out: F.lit(1)})


def tile(place: Column, total: Column, parts: int) -> Column:
    """Part (from 1) of a place (from 1) when total rows are dealt to near-equal parts, the first ones one larger."""
    size, more = F.floor(total / parts), total % parts
    long = more * (size + 1)
    return F.when(place <= long, F.ceil(place / (size + 1))).otherwise(more + F.ceil((place - long) / F.greatest(size, F.lit(1)))).cast("int")
