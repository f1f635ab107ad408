"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, by blocks of about the square root of their number."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / width).cast("int")), lambda b: total(F.slice(numbers, b * width + 1, width)))
    once = F.transform(F.array(F.struct(blocks.alias("b"), width.alias("w"))), lambda x: F.struct(F.transform(x["b"], lambda _, i: total(F.slice(x["b"], F.lit(1), i))).alias("o"), x["w"].alias("w")))
    at = lambda x, i: F.floor(i / x["w"]).cast("int")
    return F.get(F.transform(once, lambda x: F.transform(numbers, lambda _, i: F.get(x["o"], at(x, i)) + total(F.slice(numbers, at(x, i) * x["w"] + 1, i % x["w"])))), F.lit(0))
