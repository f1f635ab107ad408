"""Compression of vectors to codes: integer codebooks per part, searched with a geometric near-neighbour access tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Parts of a vector, entries of a part's codebook, and training rounds.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x); beyond LARGEST in size, squared distances might not fit a long.
SCALE, LARGEST = 256, 1 << 26
#: Split points of a tree node; a node of no more entries than this is a leaf.
DEGREE = 6
#: Vectors that one numpy pass works on.
SLICE = 4096
#: Sums by label are broadcast up to this many labels; more meet the rows in a join that adaptive execution may split.
BROADCAST_LABELS = 500_000


class Gnat:
    """A geometric near-neighbour access tree over integer points: exact nearest point, ties to the lower index.

    A node has split points, each other point hangs below its nearest one. For every split point i and subtree j the node
    stores the least and largest distance from i to the points of j, rounded outward. A query at distance d from i can't
    be nearer to any point of j than least - d or d - largest, again rounded outward: where this is strictly above the
    best distance so far the whole subtree is out for the query. Points at an equal distance are never ruled out, and all
    distances that decide are integers, so results equal those of a full search.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._node(np.arange(len(points)))

    def _node(self, ids: np.ndarray) -> tuple:
        if len(ids) <= DEGREE:
            return ids, None, None, []
        chosen, far = [0], self._square(self.points[ids], self.points[ids[0]])
        while len(chosen) < DEGREE:  # each next split point is the one farthest from those before
            far[chosen[-1]] = -1
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._square(self.points[ids], self.points[ids[chosen[-1]]]))
        splits, rest = ids[chosen], np.delete(ids, chosen)
        square = np.stack([self._square(self.points[rest], self.points[s]) for s in splits])
        own, dist = square.argmin(axis=0), np.sqrt(square.astype(np.float64))
        least, most, below = np.zeros((DEGREE, DEGREE)), np.zeros((DEGREE, DEGREE)), []
        for j in range(DEGREE):
            mine = own == j
            if mine.any():
                least[:, j], most[:, j] = np.nextafter(dist[:, mine].min(axis=1), -np.inf), np.nextafter(dist[:, mine].max(axis=1), np.inf)
                below.append((j, self._node(rest[mine])))
        return splits, least, most, below

    @staticmethod
    def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return (d * d).sum(axis=-1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest point of each row of x, its squared distance, and how many distances were computed."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.points))
        computed = 0

        def visit(node: tuple, rows: np.ndarray) -> None:
            nonlocal computed
            ids, least, most, below = node
            square = np.stack([self._square(x[rows], self.points[i]) for i in ids], axis=1)
            computed += square.size
            for k, i in enumerate(ids):
                d = square[:, k]
                nearer = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
                best[rows[nearer]], index[rows[nearer]] = d[nearer], i
            if not below:
                return
            dist = np.sqrt(square.astype(np.float64))
            low, high = np.nextafter(dist, -np.inf), np.nextafter(dist, np.inf)
            for j, child in below:
                bound = np.nextafter(np.maximum(least[:, j] - high, low - most[:, j]), -np.inf).max(axis=1)
                open_ = bound <= np.nextafter(np.sqrt(best[rows].astype(np.float64)), np.inf)
                if open_.any():
                    visit(child, rows[open_])

        if len(x) and len(self.points):
            visit(self.root, np.arange(len(x)))
        return index, best, computed


def usable(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vec: Column) -> Column:
    """Components as integers: floor(256 x)."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors by part: (rows, PARTS, width / PARTS)."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, PARTS, width // PARTS)


def train(ints: DataFrame, width: int) -> list[np.ndarray]:
    """Codebooks of ints (id, v): PARTS arrays of at most ENTRIES points.

    They start as the parts of the vectors with the smallest ids. A round assigns all parts; every task adds up its own
    parts per entry, and what meets in the shuffle and on the driver is PARTS * ENTRIES sums, however many rows there are.
    """
    first = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, width // PARTS)
    books = [start[:, p].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        trees = [Gnat(b) for b in books]

        def add(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((PARTS, ENTRIES, width // PARTS), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
            for _, x in _blocks(batches, 0, width):
                for p, tree in enumerate(trees):
                    own = tree.nearest(x[:, p])[0]
                    np.add.at(total[p], own, x[:, p])
                    np.add.at(n[p], own, 1)
            used = np.argwhere(n > 0)
            yield pa.RecordBatch.from_pydict({"p": used[:, 0].astype(np.int32), "e": used[:, 1].astype(np.int32), "n": n[n > 0], "s": total[n > 0].tolist()}, pa.schema({"p": pa.int32(), "e": pa.int32(), "n": pa.int64(), "s": pa.list_(pa.int64())}))

        sums = ints.select("v").mapInArrow(add, "p int, e int, n long, s array<long>").select("p", "e", "n", *(F.get("s", F.lit(k)).alias(f"s{k}") for k in range(width // PARTS)))
        for r in sums.groupBy("p", "e").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(width // PARTS))).collect():
            books[r["p"]][r["e"]] = [r[f"s{k}"] // r["n"] for k in range(width // PARTS)]
    return books


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all usable vectors: the id, code, error, label_error and codebooks_sha256.

    Each vector is cut into PARTS equal parts; a part's code is the index of its codebook's nearest entry, written as two
    hex digits; error is the sum of the squared distances, label_error the sum over all vectors of the label (null labels
    together). Codebooks are learnt from all vectors in ROUNDS rounds: see train().

    Vectors that are null or hold null or non-finite components are dropped. The width is the one that most vectors have
    among multiples of PARTS, the smaller of two equally common ones; vectors of another width are dropped. Repeated rows
    are rows of their own; null ids come last where the first vectors start the codebooks; ties of ids go by components,
    ties of distance to the lower entry. An empty table gives an empty result. Components above 2^18 are an error. Other
    columns are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = df.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(F.col(vec_col)).alias("v"))
    size = F.size("v")
    common = kept.where((size > 0) & (size % PARTS == 0)).groupBy(size.alias("w")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "w").first()
    out = f"{id_col} {kinds[id_col]}, code string, error long, label_error long, codebooks_sha256 string"
    if common is None:
        return df.sparkSession.createDataFrame([], out)
    width = common["w"]
    if common["most"] > LARGEST:
        raise ValueError("components are too large for integer distances")
    ints = kept.where(size == width)
    books = train(ints.select("id", "v"), width)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    trees = [Gnat(b) for b in books]
    kind = {f.name: f.dataType for f in kept.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 2, width):
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
            own = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            codes = [row.tobytes().hex() for row in own]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], names=["id", "label", "code", "error"])

    coded = staged(ints.mapInArrow(code, f"id {kind['id'].simpleString()}, label {kind['label'].simpleString()}, code string, error long"), "vector-codes")
    sums = staged(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
