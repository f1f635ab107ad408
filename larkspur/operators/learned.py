"""A learned router: whether a source is worth asking, from the question's vector, the source's centroid and its place.

The network has three hidden layers of 128, 64 and 32 with layer norms, rectifiers and dropout, and one output. Questions stay in
Spark: they are packed into blocks, dealt to a few batches and written to the shared folder. A step reads one batch, every task
sums the gradients of its blocks, and the driver, which sees sixteen sums at most, takes the step. A block meets all sources
within its task, so pairs of questions and sources are never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Fixed values of the published router: widths, dropout, clipping, decay, rates.
WIDTHS, DROPOUT, CLIP, DECAY, LOW, HIGH = (128, 64, 32), 0.4, 1.0, 3e-5, 1e-3, 5e-3
#: Questions of a block, batches of an epoch, sums that reach the driver, bins of the validation's probabilities.
BLOCK, BATCHES, SLOTS, BINS = 256, 4, 16, 4_096
#: Bytes that the sources' centroids may have; they go to every task.
SOURCE_BYTES = 128 << 20
EPSILON = 1e-5


def shapes(width: int) -> list[tuple[int, int]]:
    """Matrices and vectors of the network in their order: per layer weights, bias, gain and shift; then the output's."""
    out, before = [], width
    for w in WIDTHS:
        out += [(before, w), (1, w), (1, w), (1, w)]
        before = w
    return [*out, (before, 1), (1, 1)]


def unpack(theta: np.ndarray, width: int) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in shapes(width):
        out.append(theta[at : at + a * b].reshape(a, b))
        at += a * b
    return out


def start(width: int, seed: int) -> np.ndarray:
    """Weights and biases uniform within one over the root of the inputs, gains 1, shifts 0."""
    draw, parts = np.random.default_rng(seed), []
    for k, (a, b) in enumerate(all_shapes := shapes(width)):
        within = k % 4 if k < 4 * len(WIDTHS) else k - 4 * len(WIDTHS)
        if within >= 2:
            parts.append(np.full(a * b, 1.0 if within == 2 else 0.0))
        else:
            bound = 1 / np.sqrt(all_shapes[k - within][0])
            parts.append(draw.uniform(-bound, bound, a * b))
    return np.concatenate(parts)


def logits(theta: np.ndarray, x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
    """The network's output for rows x and what the gradient needs; masks drop units and scale up the rest."""
    p, h, kept = unpack(theta, x.shape[1]), x, []
    for k in range(len(WIDTHS)):
        w, bias, gain, shift = p[4 * k : 4 * k + 4]
        z = h @ w + bias
        z = z - z.mean(axis=1, keepdims=True)
        spread = np.sqrt((z * z).mean(axis=1, keepdims=True) + EPSILON)
        level = z / spread
        a = level * gain + shift
        kept.append((h, level, spread, a > 0))
        h = np.maximum(a, 0)
        if masks is not None:
            h = h * masks[k]
    return (h @ p[-2] + p[-1])[:, 0], [*kept, h]


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of rows x with labels y, and its gradient."""
    out, kept = logits(theta, x, masks)
    p = unpack(theta, x.shape[1])
    d = (1 / (1 + np.exp(-out)) - y)[:, None]
    grads = [d.sum(axis=0), kept[-1].T @ d]
    d = d @ p[-2].T
    for k in reversed(range(len(WIDTHS))):
        h, level, spread, on = kept[k]
        d = (d * masks[k] if masks is not None else d) * on
        grads += [d.sum(axis=0), (d * level).sum(axis=0)]
        d = d * p[4 * k + 2]
        d = (d - d.mean(axis=1, keepdims=True) - level * (d * level).mean(axis=1, keepdims=True)) / spread
        grads += [d.sum(axis=0), h.T @ d]
        d = d @ p[4 * k].T
    return float((np.logaddexp(0, out) - y * out).sum()), np.concatenate([g.ravel() for g in reversed(grads)])


def rate(epoch: int, epochs: int) -> float:
    """Waves of twenty steps between the two rates, each half as high as the one before; low and falling in the last quarter."""
    if epoch >= 0.75 * epochs:
        return LOW * (1 - (epoch - 0.75 * epochs) / max(0.25 * epochs, 1)) + LOW / 20
    wave, at = divmod(epoch, 20)
    return LOW + (HIGH - LOW) * (1 - abs(at / 10 - 1)) / 2**wave


@dataclass
class Router:
    """Sources in order with their centroids, the features' mean and deviation, the network's parameters, the validation's figure."""

    sources: list
    centroids: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    auc: float

    def features(self, q: np.ndarray) -> np.ndarray:
        """Rows of all sources for the first question, then for the next."""
        n, s = len(q), len(self.sources)
        own = np.concatenate([self.centroids, np.eye(s)], axis=1)
        x = np.concatenate([np.repeat(q, s, axis=0), np.tile(own, (n, 1))], axis=1)
        return (x - self.mean) / self.scale

    def probabilities(self, questions: DataFrame) -> DataFrame:
        """questions (query_id, vec) with every source's probability: query_id, source_id, p. Null vectors are left out."""
        shared = questions.sparkSession.sparkContext.broadcast(self)
        kinds = {f.name: f.dataType.simpleString() for f in questions.schema}
        name = "long" if isinstance(self.sources[0], int) else "string"

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            router = shared.value
            for frame in frames:
                for at in range(0, len(frame), BLOCK):
                    part = frame.iloc[at : at + BLOCK]
                    out, _ = logits(router.theta, router.features(np.stack([np.asarray(v, np.float64) for v in part["vec"]])))
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy().repeat(len(router.sources)), "source_id": router.sources * len(part), "p": 1 / (1 + np.exp(-out))})

        asked = questions.where("vec is not null").select("query_id", F.col("vec").cast("array<double>").alias("vec"))
        return asked.mapInPandas(score, f"query_id {kinds['query_id']}, source_id {name}, p double")

    def route(self, questions: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Sources selected for each question: those with a probability above the threshold."""
        return self.probabilities(questions).where(F.col("p") > threshold)


def _packed(questions: DataFrame, sources: list, path: str) -> tuple[DataFrame, int]:
    """Questions (vec, held) as blocks of vectors and labels, written by batch: batch, block, n, x, y; and their number."""
    place = {s: k for k, s in enumerate(sources)}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                y = np.zeros((len(part), len(sources)), np.uint8)
                for row, held in zip(y, part["held"], strict=True):
                    row[[place[s] for s in (() if held is None else held) if s in place]] = 1
                yield pd.DataFrame({"n": [len(part)], "x": [np.stack([np.asarray(v, "<f8") for v in part["vec"]]).tobytes()], "y": [y.tobytes()]})

    mixed = questions.where("vec is not null").select(F.col("vec").cast("array<double>").alias("vec"), "held")
    mixed = mixed.repartition(max(BATCHES, mixed.count() // (8 * BLOCK)))
    blocks = mixed.mapInPandas(pack, "n long, x binary, y binary").withColumn("block", F.xxhash64("x", "y"))
    blocks.withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(BATCHES))).write.partitionBy("batch").parquet(path)
    kept = questions.sparkSession.read.schema("n long, x binary, y binary, block long, batch int").parquet(path)
    return kept, int(kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _moments(blocks: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every component of the questions."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width))
        for frame in frames:
            for x in frame["x"]:
                q = np.frombuffer(x, "<f8").reshape(-1, width)
                total += np.stack([q.sum(axis=0), (q * q).sum(axis=0)])
        yield pd.DataFrame({"at": np.arange(width), "s": total[0], "sq": total[1]})

    n = blocks.agg(F.sum("n")).first()[0]
    sums = blocks.mapInPandas(add, "at long, s double, sq double").groupBy("at").agg(F.sum("s"), F.sum("sq")).orderBy("at").collect()
    s = np.array([r[1] for r in sums]) / n
    return s, np.sqrt(np.maximum(np.array([r[2] for r in sums]) / n - s * s, 0))


def _step(blocks: DataFrame, router: Router, seed: int, step: int) -> tuple[float, np.ndarray, int]:
    """Loss, gradient and number of rows of a batch, summed by its tasks. Dropout follows the block and the step."""
    spark, s = blocks.sparkSession, len(router.sources)
    shared = spark.sparkContext.broadcast(router)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, loss, rows, total = shared.value, 0.0, 0, np.zeros(len(shared.value.theta))
        for frame in frames:
            for r in frame.itertuples(index=False):
                q = np.frombuffer(r.x, "<f8").reshape(int(r.n), -1)
                draw = np.random.default_rng([seed, step, int(r.block) & (2**63 - 1)])
                masks = [(draw.random((len(q) * s, w)) >= DROPOUT) / (1 - DROPOUT) for w in WIDTHS]
                one, g = gradient(at.theta, at.features(q), np.frombuffer(r.y, np.uint8).astype(float), masks)
                loss, rows, total = loss + one, rows + len(q) * s, total + g
        if rows:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % SLOTS], "loss": [loss], "n": [rows], "g": [total.tobytes()]})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.frombuffer(b, "<f8") for b in frame["g"]], axis=0)
        return frame.iloc[[0]][["slot"]].assign(loss=frame["loss"].sum(), n=frame["n"].sum(), g=[g.tobytes()])

    shape = "slot int, loss double, n long, g binary"
    sums = blocks.mapInPandas(add, shape)
    if blocks.rdd.getNumPartitions() > SLOTS:
        sums = sums.groupBy("slot").applyInPandas(merged, shape)
    rows = sorted(sums.collect(), key=lambda r: r["slot"])
    shared.destroy()
    if not rows:
        return 0.0, np.zeros(len(router.theta)), 0
    return sum(r["loss"] for r in rows), np.sum([np.frombuffer(r["g"], "<f8") for r in rows], axis=0), sum(r["n"] for r in rows)


def _auc(blocks: DataFrame, router: Router) -> float:
    """Area under the curve of the rows' probabilities in BINS equal bins, ties counted half; 0 with one kind of label only."""
    shared = blocks.sparkSession.sparkContext.broadcast(router)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, at = np.zeros((2, BINS), np.int64), shared.value
        for frame in frames:
            for r in frame.itertuples(index=False):
                out, _ = logits(at.theta, at.features(np.frombuffer(r.x, "<f8").reshape(int(r.n), -1)))
                bins = np.minimum((BINS / (1 + np.exp(-out))).astype(int), BINS - 1)
                y = np.frombuffer(r.y, np.uint8)
                np.add.at(total, (y, bins), 1)
        yield pd.DataFrame({"bin": np.arange(BINS), "no": total[0], "yes": total[1]})

    rows = blocks.mapInPandas(count, "bin long, no long, yes long").groupBy("bin").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).orderBy("bin").collect()
    shared.destroy()
    no, yes = (np.array([r[c] for r in rows], float) for c in ("no", "yes"))
    if no.sum() == 0 or yes.sum() == 0:
        return 0.0
    return float((yes * (np.cumsum(no) - no / 2)).sum() / (no.sum() * yes.sum()))


def train(training: DataFrame, validation: DataFrame, sources: DataFrame, epochs: int = 30, check_every: int = 5, seed: int = 0, losses: list | None = None) -> Router:
    """A router trained on questions (vec, held: array of the sources that they should go to), for sources (source_id, vec).

    Adam with decay and clipped gradients, one step a batch; of the states that are checked every few epochs the one with the largest
    area under the validation's curve is kept. Null vectors are left out, null held is none, unknown names in held are passed
    over, repeated questions count as often as they occur. No question or no source is an error, as are sources of over
    SOURCE_BYTES. losses, if given, gets each epoch's mean loss.
    """
    spark = training.sparkSession
    size = sources.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)) * 8).first()[0]
    if not 0 < size <= SOURCE_BYTES:
        raise ValueError("a router needs sources whose centroids fit into every task")
    known = sorted(((r["source_id"], r["vec"]) for r in sources.select("source_id", F.col("vec").cast("array<double>").alias("vec")).collect()), key=lambda r: r[0])
    names, centre = [r[0] for r in known], np.array([r[1] for r in known], np.float64)
    folder = f"{shared_folder(spark)}/router-{uuid.uuid4().hex}"
    blocks, n = _packed(training, names, f"{folder}/training")
    check, _ = _packed(validation, names, f"{folder}/validation")
    if not n:
        raise ValueError("a router needs questions to learn from")
    d, s = centre.shape[1], len(names)
    mean, spread = _moments(blocks, d)
    mean = np.concatenate([mean, centre.mean(axis=0), np.full(s, 1 / s)])
    spread = np.concatenate([spread, centre.std(axis=0), np.full(s, np.sqrt(1 / s * (1 - 1 / s)))])
    router = Router(names, centre, mean, np.where(spread > 0, spread, 1.0), start(2 * d + s, seed), 0.0)
    first, second, best, step = np.zeros_like(router.theta), np.zeros_like(router.theta), None, 0
    batches = [blocks.where(F.col("batch") == b) for b in range(BATCHES)]
    for epoch in range(epochs):
        loss, rows = 0.0, 0
        for k, batch in enumerate(batches):
            one, g, m = _step(batch, router, seed, epoch * BATCHES + k)
            if not m:
                continue
            step, loss, rows, g = step + 1, loss + one, rows + m, g / m
            g = g / max(1.0, float(np.linalg.norm(g)) / CLIP) + DECAY * router.theta
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            router.theta = router.theta - rate(epoch, epochs) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if losses is not None:
            losses.append(loss / rows)
        if (epoch + 1) % check_every == 0 or epoch + 1 == epochs:
            router.auc = _auc(check, router)
            if best is None or router.auc > best.auc + 1e-6:
                best = Router(**vars(router))
    return best
