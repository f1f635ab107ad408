"""Best-fit decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import id_encoder, tokenizer_path
from .common import staged

#: Ranks within a length are counted by groups of about this many pieces, so one very common length is no single group.
RANK_GROUP = 100_000


def cut_into_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document's ids: doc_id, piece, start, length, ids_crc32. The short piece of a long one is its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer_path(vocabulary))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A segment tree over remaining capacities: how many open bins have each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.most = [False] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, number of bins)

    def _mark(self, left: int) -> None:
        node = left + self.leaves
        self.most[node] = bool(self.bins[left])
        while node > 1:
            node //= 2
            self.most[node] = self.most[2 * node] or self.most[2 * node + 1]

    def put(self, left: int, first: int, n: int) -> None:
        self.bins[left].append((first, n))
        self._mark(left)

    def take(self, left: int, n: int) -> tuple[int, int]:
        """Up to n bins with this much left."""
        first, have = self.bins[left].pop()
        if have > n:
            self.bins[left].append((first + n, have - n))
        self._mark(left)
        return first, min(have, n)

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of size or more that an open bin has, in logarithmic time."""
        node = size + self.leaves
        if self.most[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.most[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.most[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for all pieces at once: (length, first rank, pieces, first bin, offset).

    Pieces of one length are interchangeable, so a run of them goes to a run of equally full bins in one step. A bin
    that just took a piece is the tightest while another fits, so each bin of a run is filled to the end before the
    next. The result is what one piece at a time gives; the number of steps depends on the capacity, not on the
    documents.
    """
    bins, plan, opened = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        rank, todo = 0, counts[size]
        while todo:
            left = bins.tightest(size)
            if left is None:
                # a new bin takes more pieces of the same length before any other is opened
                per = capacity // size
                full, rest = divmod(todo, per)
                for k in range(per):
                    n = full + (k < rest and not full)
                    if n:
                        plan.append((size, rank, n, opened, k * size))
                        rank += n
                        todo -= n
                made = full or 1
                room = capacity - (per if full else rest) * size
                if room:
                    bins.put(room, opened, made)
                opened += made
                continue
            per = left // size
            # the last bin of a run may take fewer pieces: it is a run of its own
            first, n = bins.take(left, max(todo // per, 1))
            each = min(per, todo)
            for k in range(each):
                plan.append((size, rank, n, first, capacity - left + k * size))
                rank += n
            todo -= n * each
            if left > each * size:
                bins.put(left - each * size, first, n)
    return plan


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised once, in a map, into a small staged table of pieces. Only the number of pieces of each length
    (capacity rows at most) reaches the driver, where the plan is made by runs; pieces then get their rank within
    their length (counted over groups of rows whose number follows that of the pieces, so a length that a third of
    all pieces have is split) and their place from the plan, whose size is bounded by the capacity.

    A null text counts as empty (its one piece holds the end id); null ids stay null; repeated rows are packed as
    often as they occur; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = staged(cut_into_pieces(docs, capacity, end_id, vocabulary, id_col, text_col), "pieces")
    groups = 16 + pieces.count() // RANK_GROUP
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = staged(pieces.groupBy("length", "group").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pd.DataFrame(best_fit_plan(counts, capacity), columns=["length", "rank", "n", "bin", "place"], dtype="int64")
    starts = plan.sort_values(["length", "rank"]).groupby("length").agg(list)
    lookup = {int(k): tuple(np.array(r[c], dtype=np.int64) for c in ("rank", "bin", "place")) for k, r in starts.iterrows()}
    shared = spark.sparkContext.broadcast(lookup)

    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(bases, ["length", "group"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for size, rows in frame.groupby("length").indices.items():
                first, bins, places = shared.value[int(size)]
                rank = frame["rank"].to_numpy()[rows]
                step = np.searchsorted(first, rank, side="right") - 1
                sequence[rows], offset[rows] = bins[step] + rank - first[step], places[step]
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select(*columns, "rank").mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
