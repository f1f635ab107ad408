"""Folds along an order where each row changes what follows, in constant memory however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs and budgets count in millionths.
UNIT = 1_000_000


def fold_rows(df: DataFrame, keys: list[str], order: list[str], reads: dict[str, Column], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, object]], out: str) -> DataFrame:
    """df with one more column `out` ("name type"): what step(state, values) gives for each row of a key in order, with the new state.

    Rows are shuffled by key and sorted (both spill), and stream through in Arrow batches; the state of the key at hand
    is all that is kept, across batches too, so no array or group holds a key's rows. reads are the values that step
    sees. Null keys are a key; rows that tie in order are told apart by no one, so the order should be full.
    """
    names = list(df.columns)
    width, extra = len(names), [f"_v{k}" for k in range(len(reads))]
    key_at = [names.index(c) for c in keys]
    full = df.withColumns(dict(zip(extra, reads.values(), strict=True)))
    name, kind = out.split(" ", 1)
    shape = full.withColumn(name, F.lit(None).cast(kind)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, None, False
        for frame in frames:
            found = []
            same = [frame.iloc[:, k].where(frame.iloc[:, k].notna(), None) for k in key_at]
            for now, values in zip(zip(*same, strict=True), zip(*(frame[c] for c in extra), strict=True), strict=True):
                if not begun or now != key:
                    key, state, begun = now, start(), True
                state, result = step(state, values)
                found.append(result)
            yield frame.assign(**{name: found})

    done = full.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, shape)
    return done.select(*(F.col(c) for c in names[:width]), name)


def granted(df: DataFrame, keys: list[str], order: list[str], cost: Column, budget: float, protected: Column | None = None, out: str = "granted") -> DataFrame:
    """df with whether each row fits what is left of its key's budget: one that doesn't is skipped and not charged.

    Protected rows always stay and are charged. A null cost is 0. Amounts are compared in millionths, exactly.
    """
    most = int(Decimal(str(budget)) * UNIT)
    micro = F.coalesce(F.round(cost.cast("decimal(28,6)") * UNIT).cast("long"), F.lit(0))

    def step(spent: int, values: tuple) -> tuple[int, bool]:
        fits = bool(values[1]) or spent + int(values[0]) <= most
        return (spent + int(values[0]) if fits else spent), fits

    safe = F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))
    return fold_rows(df, keys, order, {"cost": micro, "safe": safe}, int, step, f"{out} boolean")
