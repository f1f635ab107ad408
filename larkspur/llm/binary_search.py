"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bits of one word of a code.
WORD = 64
#: Flips of a round that are looked up at most, and queries that one scan of the codes answers.
MOST_FLIPS, SCANNED = 100_000, 50_000


def sign_code(vector: Column) -> Column:
    """The signs of a vector's components as an array of longs: the first component is the highest bit of the first word.

    A last word of fewer components has them in its lowest bits. Null for a null or empty vector and for one with a null
    or NaN component.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(vector)), F.lit(WORD))
    bit = lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    word = lambda a: F.aggregate(F.slice(vector, a, WORD), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(bit(x)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(starts, word))


def _segments(n_codes: int, words: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of the segments: a little fewer bits each than the number of codes has.

    A probe is a row of its own, a candidate only a comparison in the join; so a few candidates for each probe cost less
    than the many more probes that wider segments need.
    """
    width = max(8, min(24, round(math.log2(max(n_codes, 2)) - 1.5)))
    count = max(1, round(WORD / width))
    cuts = [WORD * k // count for k in range(count + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def _parts(code: Column, segments: list[tuple[int, int, int]]) -> Column:
    part = lambda w, a, n: F.shiftrightunsigned(F.get(code, F.lit(w)), a).bitwiseAND(F.lit((1 << n) - 1))
    return F.array(*(F.struct(F.lit(k).alias("segment"), part(*s).alias("value")) for k, s in enumerate(segments)))


def _distance(a: Column, b: Column, words: int) -> Column:
    apart = [F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(words)]
    return sum(apart[1:], apart[0])


def flips_of(segments: list[tuple[int, int, int]], radius: int) -> int:
    """Lookups of one query in the round of a radius."""
    return sum(math.comb(n, radius) for *_, n in segments)


def scan(codes: DataFrame, active: DataFrame, k: int, words: int, id_kind: str) -> DataFrame:
    """The k nearest rows (query_id, asked, id, distance, rank) of queries (query_id, asked) by comparison with every code.

    The queries go out in parts of SCANNED; a task keeps each query's k best over all its codes, so what it sends on does
    not follow their number.
    """
    spark = codes.sparkSession
    parts = max(1, math.ceil(active.count() / SCANNED))
    found = None
    for part in range(parts):
        mine = active.where(F.pmod(F.xxhash64("query_id", "asked"), F.lit(parts)) == part).select("query_id", "asked").toPandas()
        if not len(mine):
            continue
        asked = np.array(mine["asked"].tolist(), np.int64).reshape(-1, words)
        shared = spark.sparkContext.broadcast((mine["query_id"].tolist(), asked))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, asked = shared.value
            far, ids = np.full((len(asked), 0), 0, np.int16), np.zeros((len(asked), 0), object)
            for frame in frames:
                if not len(frame):
                    continue
                code = np.array(frame["code"].tolist(), np.int64).reshape(-1, words)
                count = frame["ids"].map(len).to_numpy()
                flat, owner = np.concatenate([np.asarray(x, object) for x in frame["ids"]]), np.repeat(np.arange(len(code)), count)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                best_far, best_ids = [], []
                for a in range(0, len(asked), 256):
                    d = np.bitwise_count((asked[a : a + 256, None, :] ^ code[None]).view(np.uint64)).sum(axis=2, dtype=np.int16)[:, owner]
                    take = np.argsort(d, axis=1, kind="stable")[:, :k]
                    both = np.concatenate([far[a : a + 256], np.take_along_axis(d, take, axis=1)], axis=1)
                    named = np.concatenate([ids[a : a + 256], flat[take]], axis=1)
                    for q in range(len(both)):
                        o = sorted(range(both.shape[1]), key=lambda j, q=q: (both[q, j], named[q, j]))
                        both[q], named[q] = both[q, o], named[q, o]
                    best_far.append(both[:, :k])
                    best_ids.append(named[:, :k])
                far, ids = np.concatenate(best_far), np.concatenate(best_ids)
            if far.shape[1]:
                q = np.repeat(np.arange(len(asked)), far.shape[1])
                yield pd.DataFrame({"query_id": [names[i] for i in q], "asked": [asked[i] for i in q], "id": ids.ravel().tolist(), "distance": far.ravel().astype(np.int32)})

        rows = codes.select("code", "ids").mapInPandas(run, f"query_id {id_kind}, asked array<long>, id {id_kind}, distance int")
        found = rows if found is None else found.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy("distance", "id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k)


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """The k rows of index nearest to each row of queries: query_id, rank, id, distance; ties go to the smaller id.

    Codes are longs or arrays of longs of one length (others raise a ValueError), cut into segments. A query looks up, in
    every segment, all values within radius r; whatever it has not met then differs by more than r in each segment, that
    is by segments * (r + 1) or more in all. r grows until the k-th verified distance is below that; the query is then
    done and leaves. Equal codes are indexed once with their k smallest ids, as no more of them can be in an answer, so a
    code that a third of all rows have is one entry. When a round would look up more values than there are codes (or
    more than MOST_FLIPS, so that what is broadcast is bounded), the queries that are left are compared with every code
    instead: the answer is the same.

    Rows with a null code or id are not indexed and not answered; a repeated id counts once for each of its codes; a
    query has fewer rows if the index has; an empty table gives an empty result; other columns are not read.
    """
    spark = index.sparkSession
    array = lambda df: F.col(code_col) if df.schema[code_col].dataType.typeName() == "array" else F.when(F.col(code_col).isNotNull(), F.array(F.col(code_col).cast("long")))
    rows = index.select(F.col(id_col).alias("id"), array(index).cast("array<long>").alias("code")).dropna().distinct()
    asked = queries.select(F.col(id_col).alias("query_id"), array(queries).cast("array<long>").alias("asked")).dropna().distinct()
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    codes = staged(smallest.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    n_codes, n_ids, least, most = codes.agg(F.count("*"), F.sum(F.size("ids")), F.min(F.size("code")), F.max(F.size("code"))).first()
    words, kept, id_kind = most or 1, min(k, n_ids or 0), rows.schema["id"].dataType.simpleString()
    active = staged(asked.withColumn("bound", F.lit(WORD * words + 1)), "active")
    lengths = active.agg(F.min(F.size("asked")), F.max(F.size("asked"))).first()
    if kept and lengths[0] is not None and {least, most, *lengths} != {words}:
        raise ValueError("codes must have one length")
    segments = _segments(n_codes, words)
    entries = staged(codes.select("code", "ids", F.explode(_parts(F.col("code"), segments)).alias("s")).select("s.segment", "s.value", "code", "ids"), "segments")
    best = spark.createDataFrame([], f"query_id {id_kind}, asked array<long>, id {id_kind}, distance int")
    answers, radius = None, 0
    order = Window.partitionBy("query_id", "asked").orderBy("distance", "id")
    while kept and active.limit(1).count():
        if flips_of(segments, radius) > min(n_codes, MOST_FLIPS):
            rest = scan(codes, active, kept, words, id_kind)
            answers = rest if answers is None else answers.unionByName(rest)
            break
        flips = [(s, sum(1 << b for b in bits)) for s, (*_, n) in enumerate(segments) for bits in combinations(range(n), radius)]
        masks = spark.createDataFrame(flips, "segment int, mask long")
        probes = active.select("query_id", "asked", "bound", F.explode(_parts(F.col("asked"), segments)).alias("s"))
        # MOST_FLIPS rows at most
        probes = probes.join(F.broadcast(masks), probes["s.segment"] == masks["segment"]).select("query_id", "asked", "bound", masks["segment"], F.col("s.value").bitwiseXOR(F.col("mask")).alias("value"))
        distance = _distance(F.col("asked"), F.col("code"), words)
        met = probes.join(entries, (probes["segment"] == entries["segment"]) & (probes["value"] == entries["value"]) & (distance <= F.col("bound")))
        found = met.select("query_id", "asked", "code", "ids", distance.alias("distance")).dropDuplicates(["query_id", "asked", "code"])
        found = found.select("query_id", "asked", F.explode("ids").alias("id"), "distance")
        ranked = best.unionByName(found).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
        ranked = staged(ranked, "nearest")
        last = ranked.groupBy("query_id", "asked").agg(F.max("rank").alias("n"), F.max("distance").alias("far"))
        sure = len(segments) * (radius + 1)  # anything not met yet is at least this far
        done = last.where((F.col("n") >= kept) & (F.col("far") < sure)) if radius < max(n for *_, n in segments) else last
        finished = ranked.join(done.select("query_id", "asked"), ["query_id", "asked"], "left_semi")
        answers = finished if answers is None else answers.unionByName(finished)
        open_ = active.drop("bound").join(done.select("query_id", "asked"), ["query_id", "asked"], "left_anti").join(last.where(F.col("n") >= kept), ["query_id", "asked"], "left")
        active = staged(open_.select("query_id", "asked", F.coalesce("far", F.lit(WORD * words + 1)).alias("bound")), "active")
        best = ranked.drop("rank").join(active.select("query_id", "asked"), ["query_id", "asked"], "left_semi")
        radius += 1
    if answers is None:
        return best.select("query_id", F.lit(0).alias("rank"), "id", "distance")
    return answers.select("query_id", "rank", "id", "distance")
