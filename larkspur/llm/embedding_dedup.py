"""Near-duplicate vectors by NN-descent, with exact link counts."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, shared_dir, staged

#: Coarse buckets that the descent starts from: tables, vectors that a bucket should hold, the size from which one is
#: split, and neighbours that a vector takes from a bucket.
TABLES, BUCKET, LARGEST, FROM_BUCKET = 4, 48, 512, 8
#: Length of the neighbour lists at first and at most; vectors whose lists stay full are compared exactly (close_gaps).
NEIGHBOURS, MOST_NEIGHBOURS = 16, 64
#: Candidates that one neighbourhood offers to each member's list, and rounds of the descent.
OFFERS, ROUNDS = 2, 14
#: Share of the list entries that still changes when the descent ends; the audit tells whether that was too early.
SETTLED = 0.001
#: Tries with more tables and longer lists, vectors of the audit, and the recall that it asks for.
TRIES, AUDIT, RECALL = 3, 512, 0.998
#: What half-precision cosines may be off by.
ROUGH = 0.01
#: Vectors of one block of the exact counts, blocks of a component from which they grow, and rows that share one salted key.
BLOCK, BLOCKS, SALTED = 512, 32, 50_000
#: Vectors of one block when gaps are closed, and the fewest blocks that share the work.
GAP_BLOCK, GAP_BLOCKS = 16384, 8

log = logging.getLogger(__name__)


def _unit(packed: pd.Series) -> np.ndarray:
    """Packed float64 vectors as unit rows."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(v: np.ndarray) -> bytes:
    """A vector scaled by a power of two, so that no square overflows or vanishes and the cosines stay as they are."""
    x = np.asarray(v, "<f8")
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes()


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row per different usable vector: rep (smallest id), n (rows that have it), x (packed doubles).

    Unusable are null, empty and zero vectors and those with a null or non-finite component.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "x": [_packed(v) for v in frame["v"]]})

    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.mapInPandas(pack, "id long, x binary").groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def coarse_start(vectors: DataFrame, n: int, width: int, tables: int, seed: int) -> DataFrame:
    """Directed neighbours (u, v, c) that meet in a few buckets of random hyperplanes: where the descent starts.

    A crowded bucket is split by hash, and the descent joins its parts.
    """
    bits = max(1, min(24, round(math.log2(max(n, 2) / BUCKET))))
    coarse = max(0, min(bits - 1, round(math.log2(max(n, 2) / 2048))))
    planes = np.random.default_rng(seed).standard_normal((width, tables * bits))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for frame in frames:
            x = _unit(frame["x"])
            codes = ((x @ planes) > 0).reshape(len(x), tables, bits) @ weight
            short = x.astype("<f2")
            for t in range(tables):
                yield pd.DataFrame({"t": np.int32(t), "bucket": codes[:, t], "rep": frame["rep"], "f": [r.tobytes() for r in short]})

    dealt = vectors.select("rep", "x").mapInPandas(deal, "t int, bucket long, rep long, f binary")
    crowded = dealt.groupBy("t", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > LARGEST)
    parts = F.ceil(F.col("size") / LARGEST)
    split = dealt.join(crowded, ["t", "bucket"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rep", "t"), parts), F.lit(0)))
    group = F.when(F.col("size").isNull(), F.shiftrightunsigned("bucket", bits - coarse)).otherwise(F.xxhash64("bucket", "salt"))

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((frame["rep"], frame["salt"], frame["bucket"]))
        ids, bucket, salt = (frame[c].to_numpy()[order] for c in ("rep", "bucket", "salt"))
        x = np.frombuffer(b"".join(frame["f"].to_numpy()[order]), "<f2").reshape(len(ids), -1).astype(np.float32)
        cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]), True])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = x[a:b] @ x[a:b].T
                np.fill_diagonal(c, -2)
                kept = min(FROM_BUCKET, b - a - 1)
                best = np.argpartition(-c, kept - 1, axis=1)[:, :kept]
                i, j = np.repeat(np.arange(b - a), kept), best.ravel()
                out.append((ids[a:b][i], ids[a:b][j], c[i, j]))
        u, v, c = (np.concatenate(k) for k in zip(*out, strict=True))
        return pd.DataFrame({"u": u, "v": v, "c": c})

    grouped = split.withColumn("g", group).withColumn("many", F.col("size").isNotNull()).groupBy("t", "g", "many")
    return grouped.applyInPandas(near, "u long, v long, c float")


def _best(entries: DataFrame) -> DataFrame:
    """Each u's k nearest of entries (u, v, c, fresh, k); of an entry that occurs twice the older one stays."""
    once = entries.repartition("u").groupBy("u", "v").agg(F.max("c").alias("c"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
    top = once.withColumn("longest", F.max("k").over(Window.partitionBy("u"))).withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), "v")))
    return top.where("r <= longest").select("u", "v", "c", "fresh", F.col("longest").alias("k"))


def first_lists(start: DataFrame, keep: int = NEIGHBOURS) -> DataFrame:
    """Neighbour lists (u, v, c, fresh, k) of keep entries from start (u, v, c), in both directions."""
    both = start.unionByName(start.select(F.col("v").alias("u"), F.col("u").alias("v"), "c"))
    return staged(_best(both.withColumns({"fresh": F.lit(True), "k": F.lit(keep)})), "lists")


def descend(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """NN-descent: lists (u, v, c, fresh, k) refined through neighbours of neighbours until few entries change.

    A vector's neighbourhood is its list and whoever lists it, at most twice its list's length, new entries first.
    All members of it with a new pair are compared in one product; each is offered the OFFERS best others that its own
    list lacks the like of. A list full of links is saturated, and may hide more: it is made twice as long. Cosines are
    of half-precision vectors here; links are verified in double precision afterwards.
    """

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"v": frame["rep"], "h": [r.tobytes() for r in (_unit(frame["x"]) if len(frame) else np.zeros((0, 1))).astype("<f2")]})

    halves = staged(vectors.select("rep", "x").mapInPandas(short, "v long, h binary"), "halves")
    n = lists.count()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("u", kind="stable")
        u, v, fresh, worst = (frame[c].to_numpy() for c in ("u", "v", "fresh", "worst"))
        x = np.frombuffer(b"".join(frame["h"]), "<f2").reshape(len(u), -1)
        cuts = np.flatnonzero(np.r_[True, u[1:] != u[:-1], True])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1 and fresh[a:b].any():
                y = x[a:b].astype(np.float32)
                c = y @ y.T
                c[(c <= worst[a:b, None]) | ~(fresh[a:b, None] | fresh[a:b])] = -2
                np.fill_diagonal(c, -2)
                kept = min(OFFERS, b - a - 1)
                best = np.argpartition(-c, kept - 1, axis=1)[:, :kept]
                i, j = np.repeat(np.arange(b - a), kept), best.ravel()
                use = c[i, j] > -2
                out.append((v[a:b][i[use]], v[a:b][j[use]], c[i[use], j[use]]))
        p, q, c = (np.concatenate(k) for k in zip(*out, strict=True))
        return pd.DataFrame({"u": p, "v": q, "c": c}).drop_duplicates(["u", "v"])

    groups = max(2 * lists.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 50_000))
    for k in range(ROUNDS):
        facts = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("k").alias("k"))
        grown = F.when((F.col("n") >= F.col("k")) & (F.col("least") >= threshold), F.least(2 * F.col("k"), F.lit(MOST_NEIGHBOURS))).otherwise(F.col("k"))
        facts = facts.select("u", F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(F.lit(-1.0)).cast("float").alias("worst"), "k", grown.alias("next"))
        around = lists.select("u", "v", "fresh").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh"))
        around = around.repartition("u").groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        order = Window.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v", F.lit(k)))
        around = around.withColumns({"r": F.row_number().over(order), "any": F.max("fresh").over(Window.partitionBy("u"))})
        hood = around.where("any").join(facts.select("u", "k"), "u").where(F.col("r") <= 2 * F.col("k")).select("u", "v", "fresh")
        members = halves.join(facts.select(F.col("u").alias("v"), "worst"), "v")
        offers = hood.join(members, "v").groupBy(F.pmod(F.xxhash64("u"), F.lit(groups)).alias("g")).applyInPandas(compare, "u long, v long, c float")
        old = lists.drop("k").withColumn("fresh", F.lit(False)).unionByName(offers.withColumn("fresh", F.lit(True)))
        lists = staged(_best(old.join(facts.select("u", F.col("next").alias("k")), "u")), "lists")
        total, new, longer = lists.agg(F.count("*"), F.sum(F.col("fresh").cast("int")), F.sum((F.col("k") > NEIGHBOURS).cast("int"))).first()
        log.info("descent round %d: %s entries, %s new, %s in longer lists", k + 1, total, new, longer)
        if (new or 0) <= SETTLED * (total or 0):
            break
    return lists


def links_of(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Edges (a < b, cosine) of the lists whose cosine in double precision reaches the threshold."""
    near = lists.where(F.col("c") >= threshold - ROUGH).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return staged(with_cosine(near, vectors, threshold), "links")


def with_cosine(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with their cosine in double precision, those of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unit(pd.Series(batch.column(k).to_pylist())) if batch.num_rows else np.zeros((0, 1)) for k in (2, 3))
            c = (x * y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], names=["a", "b", "cosine"]).filter(pa.array(c >= least))

    left, right = (vectors.select(F.col("rep").alias(e), F.col("x").alias(f"x{e}")) for e in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long, cosine double")


def saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """Vectors (rep) whose lists are full of links, and may have dropped some."""
    full = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("k").alias("k"))
    return full.where((F.col("n") >= F.col("k")) & (F.col("least") >= threshold - ROUGH)).select(F.col("u").alias("rep"))


def close_gaps(asked: DataFrame, graph: DataFrame, vectors: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between asked vectors (rep) of different components: one or more for every two components that have any.

    Each asked vector joins the ball of one vector that it links with, or is a ball of its own. Every vector is
    compared with the centres of other components, in blocks, and with a ball's members only if the ball's angular
    radius allows a link. One link joins two components, so no more are looked for in a block; nothing else is skipped.
    """
    span = math.acos(threshold)
    close = graph.where(F.col("cosine") >= threshold)
    both = close.select(F.col("a").alias("rep"), F.col("b").alias("ball"), "cosine").unionByName(close.select(F.col("b").alias("rep"), F.col("a").alias("ball"), "cosine"))
    own = asked.select("rep", F.col("rep").alias("ball"), F.lit(1.0).alias("cosine"))
    joins = both.join(asked, "rep", "left_semi").unionByName(own).groupBy("rep").agg(F.min(F.struct(F.xxhash64("ball").alias("h"), "ball", "cosine")).alias("m"))
    named = vectors.join(components.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("rep", F.coalesce("component_id", "rep").alias("component"), "x")
    members = staged(joins.select("rep", "m.ball", "m.cosine").join(named, "rep"), "members")
    sizes = members.groupBy("ball").agg(F.count("*").alias("size"))
    members = members.join(sizes, "ball").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    balls = members.groupBy("ball", "chunk").agg(F.min("cosine").alias("least")).join(named.withColumnRenamed("rep", "ball"), "ball")
    balls = staged(balls, "balls")
    n_asked, n_balls = members.count(), balls.count()
    across, down = (max(1, min(GAP_BLOCKS, math.ceil(n / 256)), math.ceil(n / GAP_BLOCK)) for n in (n_asked, n_balls))
    left = members.select(F.lit(0).alias("side"), "rep", F.lit(0).alias("chunk"), "component", "x", F.lit(1.0).alias("least"), F.pmod(F.xxhash64("rep"), F.lit(across)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("j"))
    right = balls.select(F.lit(1).alias("side"), F.col("ball").alias("rep"), "chunk", "component", "x", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("ball", "chunk"), F.lit(down)).alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        p, q, out = frame[frame["side"] == 0], frame[frame["side"] == 1], []
        if len(p) and len(q):
            x, y, cp, cq = _unit(p["x"]), _unit(q["x"]), p["component"].to_numpy(), q["component"].to_numpy()
            reach = np.cos(np.minimum(np.pi, np.arccos(np.clip(q["least"].to_numpy(), -1, 1)) + span + 1e-6))
            pairs, linked = [], []
            for a in range(0, len(x), BLOCK):
                c = x[a : a + BLOCK] @ y.T
                r, s = np.nonzero((c >= reach) & (cp[a : a + BLOCK, None] < cq))
                pairs.append(np.stack([r + a, s], 1))
                linked.append(c[r, s] >= threshold)
            pairs, linked = np.concatenate(pairs), np.concatenate(linked)
            ends = pd.MultiIndex.from_arrays([cp[pairs[:, 0]], cq[pairs[:, 1]]])
            joined = np.zeros(len(pairs), bool)
            joined[np.flatnonzero(linked)[~ends[linked].duplicated()]] = True
            use = joined | ~ends.isin(ends[linked])
            r, s = pairs[use].T
            out = [p["rep"].to_numpy()[r], q["rep"].to_numpy()[s], q["chunk"].to_numpy()[s], joined[use]]
        return pd.DataFrame(dict(zip(["a", "ball", "chunk", "linked"], out or [[], [], [], []], strict=True))).assign(i=frame["i"].iloc[0])

    found = left.unionByName(right).groupBy("i", "j").applyInPandas(compare, "a long, ball long, chunk int, linked boolean, i long")
    found = staged(found, "gaps")
    open_ = found.where("not linked")
    here = members.select("ball", "chunk", F.lit(1).alias("side"), "rep", "component", "x").join(open_.select("ball", "chunk", "i").distinct(), ["ball", "chunk"])
    there = open_.select(F.col("a").alias("rep"), "ball", "chunk", "i", F.lit(0).alias("side")).join(members.select("rep", "component", "x"), "rep")
    group = F.pmod(F.xxhash64("ball", "chunk", "i"), F.lit(4096))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for _, part in frame.groupby(["ball", "chunk", "i"], sort=False):
            p, q = part[part["side"] == 0], part[part["side"] == 1]
            y, cp, b = _unit(q["x"]), p["component"].to_numpy(), q["rep"].to_numpy()
            for a in range(0, len(p), BLOCK):
                hit = (_unit(p["x"].iloc[a : a + BLOCK]) @ y.T) >= threshold
                rows = np.flatnonzero(hit.any(axis=1))
                rows = rows[np.unique(cp[a + rows], return_index=True)[1]]
                out.append(np.stack([p["rep"].to_numpy()[a + rows], b[hit[rows].argmax(axis=1)]], 1))
        pairs = np.concatenate(out)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    checked = here.unionByName(there, allowMissingColumns=True).withColumn("g", group).groupBy("g").applyInPandas(verify, "a long, b long")
    return staged(found.where("linked").select("a", F.col("ball").alias("b")).unionByName(checked), "closed")


def with_gaps_closed(asked: DataFrame, graph: DataFrame, vectors: DataFrame, links: DataFrame, components: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links and components with those that close_gaps adds."""
    more = close_gaps(asked, graph, vectors, components, threshold)
    if more.isEmpty():
        return links, components
    links = links.unionByName(more)
    return links, staged(connected_components(links), "components")


def exact_counts(members: DataFrame, threshold: float) -> DataFrame:
    """Links of each vector within its component (rep, component, n, x): rep, linked (rows that have a linked vector).

    All links lie within components. Small ones are counted many at a time, in groups whose number follows the members';
    a large one is cut into blocks, which grow with it up to GAP_BLOCK, and each pair of blocks is one product of two
    matrices: no pair of vectors is a row anywhere, and a vector is sent as often as its component has blocks.
    """
    groups = 64 + members.count() // 1_000
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    width = F.greatest(F.lit(BLOCK), F.least(F.lit(GAP_BLOCK), F.ceil(F.col("size") / BLOCKS)))
    blocks = F.ceil(F.col("size") / width).cast("int")
    sized = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = sized.select("rep", "component", "n", "x", "own", F.explode(others).alias("pair"), "blocks")
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", "pair.i", "pair.j"))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["component", "i", "j"], sort=False):
            x, n, ids, own, (i, j) = _unit(part["x"]), part["n"].to_numpy(np.float64), part["rep"].to_numpy(), part["own"].to_numpy(), part[["i", "j"]].iloc[0]
            rows, cols = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for a in range(0, len(rows), BLOCK):
                r = rows[a : a + BLOCK]
                hit = (x[r] @ x[cols].T) >= threshold
                hit &= r[:, None] != cols
                out.append((ids[r], hit @ n[cols]))
                if i != j:
                    out.append((ids[cols], n[r] @ hit))
        ids, linked = (np.concatenate(k) for k in zip(*out, strict=True))
        return pd.DataFrame({"rep": ids, "linked": linked.astype(np.int64)})

    rows = dealt.select(group.alias("g"), "rep", "component", "n", "x", "own", "pair.i", "pair.j")
    return rows.groupBy("g").applyInPandas(count, "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def audit(vectors: DataFrame, links: DataFrame, components: DataFrame, threshold: float) -> tuple[int, int]:
    """(links of a bounded sample of vectors by comparison with all, those whose ends share a component).

    Half of the sample are vectors that have a link, so that recall is measured on links; the others may show some that
    were missed altogether.
    """
    spark = vectors.sparkSession
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).distinct()
    linked = ends.orderBy(F.xxhash64("rep")).limit(AUDIT // 2)
    some = vectors.select("rep").orderBy(F.xxhash64("rep")).limit(AUDIT // 2)
    sample = vectors.join(F.broadcast(linked.unionByName(some).distinct()), "rep").select("rep", "x").toPandas()
    if not len(sample):
        return 0, 0
    shared = spark.sparkContext.broadcast((sample["rep"].to_numpy(), _unit(sample["x"])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked = shared.value
        for frame in frames:
            c = asked @ _unit(frame["x"]).T if len(frame) else np.zeros((len(ids), 0))
            i, j = np.nonzero((c >= threshold) & (ids[:, None] != frame["rep"].to_numpy()))
            yield pd.DataFrame({"a": ids[i], "b": frame["rep"].to_numpy()[j]})

    true = vectors.select("rep", "x").mapInPandas(run, "a long, b long")
    of = components.select("id", "component_id")
    both = true.join(of.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("component_id").alias("cb")), "b", "left")
    total, found = both.agg(F.count("*"), F.count(F.when(F.col("ca") == F.col("cb"), 1))).first()
    return total, found


def near_duplicates(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest id reachable by links, itself included), kept.

    Vectors of cosine threshold or more link, in double precision. Equal vectors go on as one. NN-descent starts from a
    few coarse buckets, which miss many links, and refines the neighbour lists through neighbours of neighbours; entries
    of threshold or more are links, and links form components. Vectors whose lists are full of links are then compared
    exactly across components (close_gaps). A bounded sample is audited against all vectors: while recall falls short,
    more buckets and lists twice as long join the descent, and if it still does after the last try all vectors are
    compared exactly. Links are counted exactly within components, so short lists change no count and nothing is capped.

    Unusable vectors (null, empty, zero, with a null or non-finite component) and null ids link with nothing and are
    kept, the latter with a null component. Usable vectors of different lengths raise a ValueError. Ids are integers or
    text that casts to such; other ids raise. Rows of a repeated id are nodes of one name. An empty table gives an empty
    result; other columns, such as labels, are not read.
    """
    spark = table.sparkSession
    shared_dir(spark)
    vectors = staged(usable_vectors(table, id_col, vector_col), "vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.length("x") / 8)).first()
    components = spark.createDataFrame([], "id long, component_id long")
    if n and vectors.select(F.length("x")).distinct().count() > 1:
        raise ValueError("vectors must have one length")
    lists = None
    for k in range(TRIES if n else 0):
        start = first_lists(coarse_start(vectors, n, int(width), TABLES * (1 + k), seed=k), NEIGHBOURS << k)
        if lists is not None:
            start = staged(_best(lists.withColumn("k", F.greatest("k", F.lit(NEIGHBOURS << k))).unionByName(start)), "lists")
        lists = descend(start, vectors, threshold)
        links = links_of(lists, vectors, threshold)
        components = staged(connected_components(links), "components")
        closed, components = with_gaps_closed(saturated(lists, threshold), links, vectors, links.select("a", "b"), components, threshold)
        total, found = audit(vectors, closed, components, threshold)
        log.info("audit of try %d: %d of %d links", k + 1, found, total)
        if found >= RECALL * total:
            break
    else:
        if n:
            closed, components = with_gaps_closed(vectors.select("rep"), links, vectors, closed, components, threshold)
    members = vectors.join(components, vectors["rep"] == components["id"]).select("rep", F.col("component_id").alias("component"), "n", "x")
    counted = exact_counts(members, threshold)
    named = vectors.join(counted, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    salts = F.ceil(F.col("n") / SALTED)
    named = named.select("x", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    named = named.select("x", "n_links", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    # a vector that very many rows have is joined in as many parts
    hot = vectors.where(F.col("n") > SALTED).select(F.xxhash64("x").alias("hx"), salts.alias("salts")).groupBy("hx").agg(F.min("salts").alias("salts"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["id"], "x": [None if v is None else _packed(v) for v in frame["v"]]})

    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v")).mapInPandas(pack, "vec_id long, x binary")
    # rows without a usable vector get keys of their own, so that they don't all meet in one task
    key = F.coalesce(F.col("x"), F.col("vec_id").cast("string").cast("binary"))
    rows = rows.withColumn("x", key).withColumn("hx", F.xxhash64("x")).join(F.broadcast(hot), "hx", "left")  # a row for each SALTED ones at most
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", F.lit(1))))
    out = rows.join(named, ["x", "salt"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    linked = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", linked.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
