"""Vector expressions over array<double> columns; float vectors are widened first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widen(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine with a zero norm read as 1, so that a zero vector scores 0."""
    product = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return dot(a, b) / F.when(product == 0, F.lit(1.0)).otherwise(product)


def normalise(v: Column, least: float = 0.0) -> Column:
    """v at length 1. A zero vector stays zero; with least, lengths below it count as least, so that tiny ones aren't blown up."""
    n = norm(v)
    size = F.greatest(n, F.lit(least)) if least else F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(v, lambda x: x / size)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def is_finite(v: Column, dim: int) -> Column:
    """Whether a vector has the dimension and no null, NaN or infinite component."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantise_scale(v: Column) -> Column:
    return F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(1e-12)) / 127.0


def quantise_int8(v: Column, scale: Column) -> Column:
    """Nearest eight-bit steps, halves to even."""
    return F.transform(v, lambda x: F.rint(x / scale).cast("int"))


def fixed_point(v: Column, scale: float = 1e6) -> Column:
    """Unit vector in whole millionths."""
    n = norm(v)
    return F.transform(v, lambda x: F.rint(x / F.when(n == 0, F.lit(1.0)).otherwise(n) * scale).cast("long"))


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per key: keys, vec. Partial sums per element are combined before the shuffle."""
    parts = df.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    ordered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return ordered.select(*keys, F.transform("s", lambda e: e["x"]).alias("vec"))


def hashed_features(docs: DataFrame, id_col: str, text_col: str, model: str = "m", buckets: int = 256) -> DataFrame:
    """Counts of hashed tokens, one row per document and bucket that occurs: id, bucket, n. Not normalised."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    each = docs.select(F.col(id_col), F.explode(tokens).alias("t"))
    bucket = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{model}:"), F.col("t")), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    return each.groupBy(id_col, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def simhash(v: Column, planes: list[list[float]]) -> Column:
    """Sign of each plane's product as a bit, first plane lowest. Up to 63 planes."""
    bits = [F.when(dot(v, F.array(*map(F.lit, p))) > 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, p in enumerate(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def embed_with(docs: DataFrame, embedder, id_col: str, text_col: str) -> DataFrame:
    """Vectors of a pluggable model: embedder maps a list of texts to a list of vectors, by Arrow batches."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist())))

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("vec"))


def perturb(df: DataFrame, vec: str, sigma: float, seed: int, *keys: str) -> DataFrame:
    """Gaussian noise on every component, drawn from a generator of the row's keys; sigma 0 copies, below 0 is an error."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return df

    @F.pandas_udf("array<double>")
    def noisy(v: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, np.float64) + sigma * np.random.default_rng([seed, k & (2**63 - 1)]).standard_normal(len(x)) for x, k in zip(v, key, strict=True)])

    return df.withColumn(vec, noisy(F.col(vec), F.xxhash64(*keys)))
