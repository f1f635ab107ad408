"""Inverted indexes that are written once and read in part: trained vector lists, and postings with block maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import widen
from ..sources.shared import checkpointed
from .clusters import BLOCK, LOCAL, PART, STILL, _fold, _moved, _nearest, _totals
from .retrieval import top_n
from .routing import small

#: Vectors per list that the centroids are trained on at most, in the order of a hash of doc_id; all vectors are indexed.
TRAIN_PER_LIST = 256
#: Bytes of centroids that go to a task at a time; more make further passes over the vectors.
CENTROID_BYTES = 64 << 20
#: Probes of all queries that are broadcast to the lists; more meet them in a shuffled join.
BROADCAST_ASKED = 50_000
#: Folders of the written lists and postings, each with the lists or terms of a hash.
FOLDERS = 64


def train_lists(docs: DataFrame, nlist: int | None = None, rounds: int = 25, seed: int = 0) -> DataFrame:
    """Centroids (list_id, vec) of docs (doc_id, vec) by Euclidean k-means: nlist of them, by default the root of the number.

    Trained on at most TRAIN_PER_LIST vectors a list. An empty table gives none.
    """
    n = docs.count()
    nlist = nlist or max(1, round(n**0.5))
    share = min(1.0, nlist * TRAIN_PER_LIST / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else docs
    width = docs.agg(F.max(F.size("vec"))).first()[0] or 0
    if n * share > LOCAL and 8 * nlist * width <= CENTROID_BYTES // 4:
        return _trained(picked.select("doc_id", widen(F.col("vec")).alias("vec")), nlist, rounds, seed)
    _, centres = _fold(picked.select(F.lit(0).alias("source_id"), "doc_id", "vec"), ["source_id"], F.lit(nlist), rounds, False, 0, seed)
    return centres.select(F.col("cluster").alias("list_id"), "vec")


def _trained(docs: DataFrame, k: int, rounds: int, seed: int) -> DataFrame:
    """The rounds of _fold() for one group whose centroids fit a quarter of CENTROID_BYTES: list_id, vec.

    A round is one job over packed blocks: centroids go to the tasks, each task adds up its vectors by cluster, and the sums are
    added by parts of the clusters before the driver gets them, one vector a cluster. So what the driver keeps of jobs stays small.
    """
    spark = docs.sparkSession
    first = checkpointed(docs.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(k).select("vec"))  # else the driver merges every task's k
    centre = np.array([r["vec"] for r in first.collect()], np.float64)
    width = centre.shape[1]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), BLOCK):
                yield pd.DataFrame({"x": [np.stack([np.asarray(v, np.float64) for v in frame["vec"].iloc[a : a + BLOCK]]).tobytes()]})

    def add(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["total", "n"])  # the same sums in whatever order they come
        total, n = (sum(np.frombuffer(b, kind) for b in found[c]) for c, kind in (("total", "<f8"), ("n", "<i8")))
        return pd.DataFrame({"part": [key[0]], "total": [total.tobytes()], "n": [n.tobytes()]})

    blocks, shape = checkpointed(docs.select("vec").mapInPandas(pack, "x binary")), "part long, total binary, n binary"
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centre)

        def sums(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            c = sent.value
            total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for frame in frames:
                for packed in frame["x"]:
                    x = np.frombuffer(packed, "<f8").reshape(-1, width)
                    more, m = _totals(x, _nearest(x, c, False)[0], len(c))
                    total, n = total + more, n + m
            cuts = range(0, len(c) if n.any() else 0, PART)
            yield pd.DataFrame({"part": [a // PART for a in cuts], "total": [total[a : a + PART].tobytes() for a in cuts], "n": [n[a : a + PART].tobytes() for a in cuts]})

        added = sorted(blocks.mapInPandas(sums, shape).groupBy("part").applyInPandas(add, shape).collect())
        sent.destroy()
        total, n = np.frombuffer(b"".join(r["total"] for r in added), "<f8").reshape(-1, width), np.frombuffer(b"".join(r["n"] for r in added), "<i8")
        moved = _moved(centre, total, n, False)
        still, centre = np.abs(moved - centre).max() <= STILL, moved
        if still:
            break
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centre)], "list_id int, vec array<double>")


def assign_lists(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """docs with list_id, the centroid nearest to vec (ties to the smaller number), by matrix products in Arrow batches.

    Centroids go to the tasks CENTROID_BYTES at a time, each pass keeping the best so far, so their number is not bounded
    by a task's memory.
    """
    centroids = checkpointed(centroids.select("list_id", widen(F.col("vec")).alias("vec")))
    k, width = centroids.agg(F.max("list_id"), F.max(F.size("vec"))).first()
    out = docs.withColumn("list_id", F.lit(-1)).withColumn("_far", F.lit(float("inf")))
    if k is None:
        return out.drop("_far")
    per = max(1, CENTROID_BYTES // (8 * width))
    vec = docs.columns.index("vec")
    for a in range(0, k + 1, per):
        part = centroids.where(F.col("list_id").between(a, a + per - 1)).orderBy("list_id").collect()
        ids, c = np.array([r["list_id"] for r in part]), np.array([r["vec"] for r in part])
        half = (c * c).sum(axis=1) / 2

        def near(frames: Iterator[pd.DataFrame], ids=ids, c=c, half=half) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.stack([np.asarray(v, np.float64) for v in frame.iloc[:, vec]])
                    far = half - x @ c.T
                    best = far.argmin(axis=1)
                    least = far[np.arange(len(x)), best]
                    better = least < frame["_far"].to_numpy()
                    frame = frame.assign(list_id=np.where(better, ids[best], frame["list_id"]).astype(np.int32), _far=np.where(better, least, frame["_far"]))
                yield frame

        out = out.mapInPandas(near, out.schema)
    return out.drop("_far")


def write_lists(docs: DataFrame, centroids: DataFrame, path: str) -> None:
    """The index in a folder: centroids, and vectors (doc_id, vec, list_id) in folders by list, sorted by list."""
    centroids.write.parquet(f"{path}/centroids")
    listed = assign_lists(docs.select("doc_id", widen(F.col("vec")).alias("vec")), centroids).withColumn("folder", F.pmod("list_id", F.lit(FOLDERS)))
    listed.repartition("folder", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("folder", "list_id", "doc_id").write.partitionBy("folder").parquet(f"{path}/lists")


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def search_lists(spark: SparkSession, path: str, queries: DataFrame, nprobe: int, knn: int) -> DataFrame:
    """The knn nearest vectors of each query (query_id, vec) among its nprobe nearest lists: query_id, doc_id, distance, rank.

    Only folders that hold a probed list are read, as a filter on folders, and of their row groups those with such lists.
    """
    centres = spark.read.parquet(f"{path}/centroids")
    q = queries.select("query_id", widen(F.col("vec")).alias("qv"))
    near = top_n(q.crossJoin(small(centres.select("list_id", widen(F.col("vec")).alias("c")))).select("query_id", "qv", "list_id", F.round(_square(F.col("qv"), F.col("c")), 9).alias("d")), ["query_id"], nprobe, [F.col("d"), F.col("list_id")])
    asked = checkpointed(near.select("query_id", "qv", "list_id", F.pmod("list_id", F.lit(FOLDERS)).alias("folder")))
    folders = [r["folder"] for r in asked.select("folder").distinct().collect()]
    lists = spark.read.parquet(f"{path}/lists").where(F.col("folder").isin(folders))
    found = lists.join(small(asked, BROADCAST_ASKED), ["folder", "list_id"]).select("query_id", "doc_id", F.round(_square(F.col("qv"), F.col("vec")), 9).alias("distance"))
    return top_n(found, ["query_id"], knn, [F.col("distance"), F.col("doc_id")])


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _ends(s: Column, key) -> Column:
    """Places where runs of equal keys end in a sorted array."""
    return F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(key(F.get(s, i + 1)) != key(x), F.lit(True)), i)), lambda i: i.isNotNull())


def _packed(t: Column) -> Column:
    """A document's words by folder: array of (folder, terms), terms as "word count word count ..."; words hold no blanks.

    Words are sorted by folder, and the places where runs end tell counts and folders, so time follows the document's length.
    """
    once = lambda x, use: F.flatten(F.transform(F.array(x), use))  # noqa: E731  x is computed once for all its uses
    before = lambda e, k: F.coalesce(F.get(e, k - 1), F.lit(-1))
    words = F.sort_array(F.transform(t, lambda w: F.struct(_folder(w).alias("folder"), w.alias("term"))))

    def counts(s: Column, e: Column) -> Column:
        return F.transform(e, lambda i, k: F.struct(F.get(s, i)["folder"].alias("folder"), F.concat_ws(" ", F.get(s, i)["term"], (i - before(e, k)).cast("string")).alias("terms")))

    def folders(s: Column, e: Column) -> Column:
        joined = lambda i, k: F.array_join(F.transform(F.slice(s, before(e, k) + 2, i - before(e, k)), lambda x: x["terms"]), " ")
        return F.transform(e, lambda i, k: F.struct(F.get(s, i)["folder"].alias("folder"), joined(i, k).alias("terms")))

    found = once(words, lambda s: once(_ends(s, lambda x: x), lambda e: counts(s, e)))
    return once(found, lambda s: once(_ends(s, lambda x: x["folder"]), lambda e: folders(s, e)))


def write_postings(docs: DataFrame, path: str, per_block: int = 256, k1: float = 1.2, b: float = 0.75) -> None:
    """Okapi postings of docs (doc_id, text) in a folder: one row per term and block of documents, with its largest weight.

    Blocks are documents of one range of a hash, about per_block each. postings: term, block, docs (array of doc_id and
    weight); maxima: term, block, most. Weights are the scores' summands, with the corpus's own statistics. Both are in
    folders by a hash of the term. A document's counts are packed by folder in its own row and go through one shuffle, by
    folder and part of the blocks; the number of documents of each term comes along as a row before its blocks. Nothing is staged.
    """
    words = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    n, average = words.agg(F.count("*"), F.avg(F.size("t"))).first()
    blocks, parts = max(1, -(-n // per_block)), 8
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        # outer: else Spark puts a filter with the same computing before it
        packed = words.select("doc_id", F.size("t").alias("len"), F.inline_outer(_packed(F.col("t")))).where("folder is not null")
        terms = words.select(F.explode_outer(F.array_distinct("t")).alias("term")).where("term is not null")
    else:
        tf = words.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
        packed, terms = tf.select("doc_id", "len", _folder(F.col("term")).alias("folder"), F.concat_ws(" ", "term", F.col("tf").cast("string")).alias("terms")), tf.select("term")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    rows = packed.select("folder", F.pmod(block, F.lit(parts)).alias("part"), block.alias("block"), "doc_id", "len", "terms", F.lit(0).cast("long").alias("df"))
    df = terms.groupBy(F.col("term").alias("terms")).agg(F.count("*").alias("df")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("doc_id", "len")]
    df = df.select(_folder(F.col("terms")).alias("folder"), "part", F.lit(-1).alias("block"), *none, F.concat("terms", F.lit(" 0")).alias("terms"), "df")
    met = rows.unionByName(df).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "folder", "part")
    # words and counts in turn
    pairs = F.transform(F.array(F.split("terms", " ")), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2, F.lit(2)), lambda i: F.struct(F.get(s, i).alias("term"), F.get(s, i + 1).cast("int").alias("tf"))))
    each = met.select("folder", "part", "block", "doc_id", "len", "df", F.explode_outer(F.flatten(pairs)).alias("x")).select("folder", "part", "block", "doc_id", "len", "df", "x.term", "x.tf")
    listed = each.groupBy("folder", "part", "term", "block").agg(F.collect_list(F.when(F.col("block") >= 0, F.struct("doc_id", "tf", "len"))).alias("docs"), F.max("df").alias("df"))
    first = Window.partitionBy("folder", "part", "term").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = listed.withColumn("df", F.max("df").over(first)).where("block >= 0")
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = lambda x: F.col("idf") * x["tf"] * (k1 + 1) / (x["tf"] + k1 * (1 - b + b * x["len"] / F.lit(average or 1.0)))
    weighed = listed.withColumn("idf", idf).withColumn("docs", F.transform("docs", lambda x: F.struct(x["doc_id"].alias("doc_id"), weight(x).alias("w"))))
    out = weighed.select("term", "block", "docs", F.array_max("docs.w").alias("most"), "folder")
    out.sortWithinPartitions("folder", "term", "block").write.option("compression", "zstd").partitionBy("folder").parquet(f"{path}/postings")


def search_postings(spark: SparkSession, path: str, questions: DataFrame, per_question: int, first: int = 4, opened: list | None = None) -> DataFrame:
    """The per_question best documents of each question (query_id, terms) by Okapi score: query_id, doc_id, bm25, rank.

    The sum of a block's largest weights bounds every score in it. The `first` blocks with the highest bounds are opened,
    which gives a score that the k-th best has at least; then only blocks whose bound reaches it. A document lies in one
    block, so scores are whole and rows equal those of a full scan. opened, if given, gets the blocks opened and those there.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    asked = checkpointed(asked)
    folders = [r["folder"] for r in asked.select("folder").distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("folder").isin(folders))
    bounds = rows.select("folder", "term", "block", "most").join(small(asked), ["folder", "term"]).groupBy("query_id", "block").agg(F.sum("most").alias("bound"))
    ranked = checkpointed(top_n(bounds, ["query_id"], 1 << 30, [F.desc("bound"), F.col("block")]))

    def scores(blocks: DataFrame) -> DataFrame:
        wanted = asked.join(blocks.select("query_id", "block"), "query_id")
        met = rows.join(small(wanted), ["folder", "term", "block"]).select("query_id", F.explode("docs").alias("d"))
        return met.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.round(F.sum("d.w"), 6).alias("bm25"))

    order = [F.desc("bm25"), F.col("doc_id")]
    lead = checkpointed(top_n(scores(ranked.where(F.col("rank") <= first)), ["query_id"], per_question, order))
    reached = lead.where(F.col("rank") == per_question).select("query_id", F.col("bm25").alias("least"))
    # rounding may lift a score by half a unit of its last place
    rest = checkpointed(ranked.where(F.col("rank") > first).join(small(reached), "query_id", "left").where(F.col("bound") + 1e-6 >= F.coalesce("least", F.lit(0.0))))
    if opened is not None:
        opened.append((ranked.where(F.col("rank") <= first).count() + rest.count(), ranked.count()))
    return top_n(lead.drop("rank").unionByName(scores(rest)), ["query_id"], per_question, order)
