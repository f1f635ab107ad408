"""MinHash near-duplicate detection with tensored banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, shared_dir, staged

#: Two collections of BANDS short bands each; a table key joins one band of either, so BANDS * BANDS tables come from
#: 2 * BANDS * ROWS minhashes. At similarity s a pair meets in some table with (1 - (1 - s**ROWS)**BANDS)**2: 0.9999 at 0.8.
BANDS, ROWS = 10, 2
HASHES = 2 * BANDS * ROWS
#: Bounds for broadcasting the candidates' ids to the texts; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Entries of one table key that a batch sends on; of a key that more of its rows have, only the smallest id goes.
SENT = 64
#: Counters that order shingles from rare to frequent: a fixed size whatever the input.
COUNTER_BITS = 18
#: Signature agreement from which a table's pair is verified at once. What falls short is left to the exact search.
LIKELY = 26

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_TERM = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words between bytes 0x20 and 0x09-0x0D."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's shingles: all runs of width words, or all its words when fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out * _MULTIPLY + h[k : len(h) - n + 1 + k])
    return np.unique(mix(out + np.uint64(n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] * _FACTOR + _TERM) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0))
    return least.astype("<u4")


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """Tensored keys of all tables, one row for each signature."""
    s = signatures.astype(np.uint64)
    one, two = s[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS), s[:, BANDS * ROWS :].reshape(-1, BANDS, ROWS)
    fold = lambda x: mix(x[:, :, 0] * _MULTIPLY + x[:, :, 1])
    left, right = fold(one), fold(two)
    number = np.arange(BANDS * BANDS, dtype=np.uint64).reshape(1, BANDS, BANDS)
    return mix(left[:, :, None] * _MULTIPLY + right[:, None, :] + number).reshape(len(s), -1)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, same, sig = batch.column(0).to_pylist(), [], [], []
            for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                shingles = shingle_set(words, width)
                n.append(len(shingles))
                same.append(xxhash.xxh3_128_digest(b" ".join(words) if words else b"\0%d" % (i or 0)))
                sig.append(signature(shingles).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "same", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, same binary, signature binary")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (key, id): each key once with its smallest id, and (member, smallest) pairs of keys that several have."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    pivot = ids[first][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([ids, pivot], 1)[ids != pivot], axis=0)
    return keys[first], ids[first], pairs[:, 0], pairs[:, 1]


def _table_pairs(classes: DataFrame, parts: int) -> DataFrame:
    """Pairs (member, smallest member) of every table key that several classes have.

    Entries travel as packed arrays, a row for each range of keys. A batch combines its own entries of a key that more
    than SENT of its rows have, so a key that a third of all documents have sends one entry from each batch.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, HASHES)
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            keys = table_keys(sig)
            keys, ids = keys.ravel(), np.repeat(ids, keys.shape[1])
            _, slot, count = np.unique(keys, return_inverse=True, return_counts=True)
            many = (count > SENT)[slot]
            hot, least, member, pivot = _stars(keys[many], ids[many])
            keys, least = np.r_[keys[~many], hot], np.r_[ids[~many], least]
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, keys[o].tobytes(), least[o].tobytes(), False) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]
            spot = (pivot.astype(np.uint64) % np.uint64(parts)).astype(np.int32)
            rows += [(int(p), member[spot == p].tobytes(), pivot[spot == p].tobytes(), True) for p in np.unique(spot)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.bool_()))], names=["part", "x", "y", "done"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        def both(rows: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(rows["x"]), kind), np.frombuffer(b"".join(rows["y"]), np.int64)

        a, b = both(frame[frame["done"]], np.int64)
        _, _, member, pivot = _stars(*both(frame[~frame["done"]], np.uint64))
        pairs = np.unique(np.stack([np.r_[a, member], np.r_[b, pivot]], 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    packed = classes.select("rep", "signature").mapInArrow(spread, "part int, x binary, y binary, done boolean")
    return packed.groupBy("part").applyInPandas(meet, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of wanted (rep, same): rep, shingles (packed)."""
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if small else wanted, docs["doc_id"] == wanted["rep"]).select("rep", "same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (same, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = words_of(text)
                if xxhash.xxh3_128_digest(b" ".join(words)) == same:  # a repeated id may have other texts too
                    rows.append(k)
                    out.append(shingle_set(words, width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), batch.column(1).take(pa.array(rows, pa.int32())), pa.array(out, pa.binary())], names=["rep", "same", "shingles"])

    return texts.mapInArrow(run, "rep long, same binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose signatures agree in LIKELY places or more."""
    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, HASHES) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LIKELY))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _counters(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each counter are among the candidates."""
    size, chunk = 1 << COUNTER_BITS, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=size) if len(x) > 8 * chunk else 0
                if len(x) <= 8 * chunk:
                    np.add.at(total, (np.frombuffer(x, np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        parts = total.astype("<i8").reshape(-1, chunk)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in frame["counts"])
        return pd.DataFrame({"chunk": frame["chunk"][:1], "counts": [total.tobytes()]})

    rows = sets.select("shingles").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    out = np.zeros((size // chunk, chunk), np.int64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def _across(sets: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Every pair of candidates of different groups that can be similar enough, by their rarest shingles.

    Shingles are ordered from rare to frequent. Two sets that overlap enough share one of their first ones, the longer
    set's first 20 % (at percent 80) and the shorter's first ninth, and few come before the first that they share.
    """
    counters = _counters(sets)
    shared = sets.sparkSession.sparkContext.broadcast(counters)
    known = sets.join(grouped, sets["rep"] == grouped["id"], "left").select("rep", F.coalesce("component_id", "rep").alias("group"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, which, place, size, short = [], [], [], [], []
            for row, x in enumerate(batch.column(2).to_pylist()):
                x = np.frombuffer(x, np.uint64)
                n = len(x)
                ranked = x[np.lexsort((x, shared.value[(x >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))]
                long = n - -(-percent * n // 100) + 1
                brief = n - -(-2 * percent * n // (100 + percent)) + 1
                tokens.append(ranked[:long].view(np.int64))
                which += [row] * long
                place.append(np.arange(long))
                size += [n] * long
                short.append(np.arange(long) < brief)
            if tokens:
                take = pa.array(which, pa.int32())
                arrays = [pa.array(np.concatenate(tokens)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(place).astype(np.int32)), pa.array(size, pa.int32()), pa.array(np.concatenate(short))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "rep", "group", "at", "size", "short"])

    rows = known.mapInArrow(run, "token long, rep long, group long, at int, size int, short boolean")
    a, b = rows.alias("a"), rows.where("short").alias("b")
    need = F.ceil(F.lit(percent) * (F.col("a.size") + F.col("b.size")) / F.lit(100 + percent) - F.lit(1e-9))
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    longer = (F.col("b.size") < F.col("a.size")) | ((F.col("b.size") == F.col("a.size")) & (F.col("b.rep") < F.col("a.rep")))
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.group") != F.col("b.group")) & longer & (F.col("b.size") * 100 >= F.col("a.size") * percent) & (left >= need)
    return a.join(b, meet).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents link when 100 * |A & B| >= percent * |A | B| of their distinct shingles of `width` words.

    1. Equal word sequences form a class; one row of it goes on, so copies are never compared.
    2. Tensored minhash tables propose candidates and, for each key, pairs with its smallest member. Likely pairs are
       verified on full sets; verified links form groups.
    3. Candidates of different groups are compared by an exact search over their rarest shingles, then verified on
       full sets: a large bucket costs no pair within what already hangs together, and no cap is needed.

    A null or wordless text has an empty set and links with nothing. A null id links with nothing, is kept and has a
    null component. Rows of a repeated id are one node of the links. An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = staged(_sketches(texts, width), "sketches")
    classes = staged(
        sketches.where("n_shingles > 0 and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "classes"
    )
    n = classes.count()
    parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n * BANDS * BANDS / 2_000_000))
    pairs = staged(_table_pairs(classes, parts), "table-pairs")
    candidates = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = classes.select("rep", "same").join(candidates, "rep", "left_semi")
    sets = staged(_sets(texts, wanted, width).dropDuplicates(["rep", "same"]), "candidate-sets")
    first = staged(_verified(_likely(pairs, classes), sets, percent), "links")
    groups = staged(connected_components(first), "groups")
    second = _verified(_across(sets, groups, percent), sets, percent)
    repeats = sketches.where("doc_id is not null").join(classes.select("same", "rep"), "same").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    links = first.unionByName(second).unionByName(repeats.join(several, "a", "left_semi"))
    labels = staged(connected_components(links), "components")
    named = classes.select("same", "rep").join(labels, classes["rep"] == labels["id"], "left").select("same", F.coalesce("component_id", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "same").join(named, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
