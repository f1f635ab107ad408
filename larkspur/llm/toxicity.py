"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, and words between the starts of windows: half of each window overlaps the next, and every word but
#: the first and last few of a text is in two of them.
WINDOW, STRIDE = 32, 16
#: Buckets and sizes of the word and character-trigram inputs; units of either direction and of the attention.
WORD_BUCKETS, CHAR_BUCKETS, WIDE, UNITS, LOOK = 1 << 15, 1 << 14, 6, 8, 8
#: The training sample's bounds: labelled rows of either class, in hash order, and the longest text among them.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1_200, 2_400, 50_000
#: Bytes of text that are scored at a time.
STRETCH = 2_000_000
PASSES, MOST_PASSES, DOCS_A_STEP, RATE = 4, 24, 48, 0.01
#: Words whose states are kept at once while a step's gradient is summed, unless one text has more.
WORDS_A_PART = 12_000


def held_out(doc_id: int | None) -> bool:
    """Whether a row is kept from training: crc32 of the id as text has remainder 2 by 4."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Words:
    """The distinct words of some texts as inputs: a word bucket and the buckets of its character trigrams."""

    bucket: np.ndarray
    chars: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        raw = [b"^" + w.encode() + b"$" for w in words]
        lens = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        code = (flat[:-2] * np.uint32(0x9E3779B1) + flat[1:-1] * np.uint32(0x85EBCA77) + flat[2:] * np.uint32(0xC2B2AE3D)) if len(flat) > 2 else np.zeros(0, np.uint32)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        starts = np.cumsum(lens) - lens
        whole = np.zeros(len(flat), bool)
        whole[starts] = True
        whole = ~(whole[1:-1] | whole[2:]) if len(flat) > 2 else np.zeros(0, bool)  # trigrams within one word
        counts = lens - 2
        bucket = np.array([zlib.crc32(x) for x in raw], np.uint32) % WORD_BUCKETS
        return cls(bucket.astype(np.int64), ((code >> np.uint32(8)) % CHAR_BUCKETS).astype(np.int64)[whole], np.cumsum(counts) - counts, counts)


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; a text without words has one empty window."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def split_words(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct lower-case words and the word numbers of each text."""
    seen: dict[str, int] = {}
    put = seen.setdefault
    numbers = [np.array([put(w, len(seen)) for w in t.lower().split()], np.int64) for t in texts]
    return [*seen], numbers


def lay_out(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each window, word numbers by window with -1 for none, windows' text starts)."""
    owner, rows, starts = [], [], []
    at = np.arange(WINDOW)
    for k, x in enumerate(numbers):
        first = np.array(windows_of(len(x)))
        starts.append(len(owner))
        owner += [k] * len(first)
        place = first[:, None] + at
        rows.append(np.where(place < len(x), np.append(x, -1)[np.minimum(place, len(x))], -1))
    return np.array(owner), np.concatenate(rows), np.array(starts)


@dataclass
class Network:
    """Parameters, scoring and the gradient of the summed loss of some texts."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        d, h = 2 * WIDE, UNITS
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": make(WORD_BUCKETS, WIDE, scale=0.1), "char": make(CHAR_BUCKETS, WIDE, scale=0.1)}
        for way in "fb":
            p |= {f"x{way}": make(d, 3 * h, scale=d**-0.5), f"h{way}": make(h, 3 * h, scale=h**-0.5), f"b{way}": np.zeros(3 * h, np.float32)}
        return cls(p | {"look": make(2 * h, LOOK, scale=(2 * h) ** -0.5), "lookb": np.zeros(LOOK, np.float32), "pick": make(LOOK, scale=LOOK**-0.5), "out": make(2 * h, scale=(2 * h) ** -0.5), "outb": np.full(1, -1, np.float32)})

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of each distinct word: its own and the mean of its trigrams'."""
        if not len(words.bucket):
            return np.zeros((0, 2 * WIDE), np.float32)
        chars = np.add.reduceat(self.p["char"][words.chars], words.starts, axis=0) / words.counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][words.bucket], chars], axis=1)

    def _run(self, gates: np.ndarray, rows: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of one direction by window and word; a place without a word leaves the state as it is."""
        h, u = UNITS, self.p[f"h{way}"]
        state = np.zeros((len(rows), h), np.float32)
        out = np.zeros((len(rows), WINDOW, h), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x, from_state = gates[rows[:, t]], state @ u
            both = _sigmoid(x[:, : 2 * h] + from_state[:, : 2 * h])
            z, r = both[:, :h], both[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * from_state[:, 2 * h :])
            there = (rows[:, t] >= 0)[:, None]
            after = np.where(there, new + z * (state - new), state)
            if keep is not None:
                keep.append((t, state, z, r, new, from_state[:, 2 * h :], there))
            state = after
            out[:, t] = state
        return out

    def _gates(self, x: np.ndarray, way: str) -> np.ndarray:
        """Input parts of the gates of each distinct word; the row that -1 reaches is the last."""
        return np.concatenate([x @ self.p[f"x{way}"] + self.p[f"b{way}"], np.zeros((1, 3 * UNITS), np.float32)])

    def logits(self, words: Words, rows: np.ndarray) -> np.ndarray:
        x = self.inputs(words)
        gates = {way: self._gates(x, way) for way in "fb"}
        out = np.empty(len(rows), np.float32)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            states = np.concatenate([self._run(gates[way], part, way, None) for way in "fb"], axis=2)
            out[at : at + 4096] = self._pool(states, part)[0]
        return out

    def _pool(self, states: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        seen = np.tanh(states @ self.p["look"] + self.p["lookb"])
        e = np.where(rows >= 0, seen @ self.p["pick"], np.float32(-30))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        share = e / e.sum(axis=1, keepdims=True)
        pooled = (share[:, :, None] * states).sum(axis=1)
        return pooled @ self.p["out"] + self.p["outb"][0], pooled, share, seen

    def gradient(self, words: Words, numbers: list[np.ndarray], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradient: a text's logit is the log-sum-exp of its windows' logits."""
        p, h = self.p, UNITS
        owner, rows, starts = lay_out(numbers)
        x = self.inputs(words)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(self._gates(x, way), rows, way, kept[way]) for way in "fb"], axis=2)
        logit, pooled, share, seen = self._pool(states, rows)
        top = np.maximum.reduceat(logit, starts)
        mass = np.exp(logit - top[owner])
        total = np.add.reduceat(mass, starts)
        text = top + np.log(total)
        prob = _sigmoid(text)
        loss = -np.mean(np.where(labels, np.log(prob + 1e-7), np.log(1 - prob + 1e-7)))
        d = ((prob - labels) / len(labels))[owner] * mass / total[owner]
        d = d.astype(np.float32)
        g: dict[str, np.ndarray] = {"out": d @ pooled, "outb": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_share = (states @ d_pooled[:, :, None])[:, :, 0]
        d_e = share * (d_share - (share * d_share).sum(axis=1, keepdims=True)) * (rows >= 0)
        g["pick"] = np.einsum("nt,ntk->k", d_e, seen)
        d_seen = d_e[:, :, None] * p["pick"] * (1 - seen * seen)
        g["look"], g["lookb"] = np.einsum("ntj,ntk->jk", states, d_seen), d_seen.sum(axis=(0, 1))
        d_states = share[:, :, None] * d_pooled[:, None, :] + d_seen @ p["look"].T
        d_x = np.zeros_like(x)
        for way, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            d_gates, d_u, carry = np.zeros((len(x) + 1, 3 * h), np.float32), np.zeros_like(p[f"h{way}"]), np.zeros((len(rows), h), np.float32)
            for t, before, z, r, new, inner, there in reversed(kept[way]):
                carry = carry + d_states[:, t, side]
                d_new = np.where(there, carry * (1 - z), 0) * (1 - new * new)
                d_z = np.where(there, carry * (before - new), 0) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_from = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_gates, rows[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                d_u += before.T @ d_from
                carry = np.where(there, carry * z, carry) + d_from @ p[f"h{way}"].T
            d_gates = d_gates[:-1]
            g |= {f"h{way}": d_u, f"x{way}": x.T @ d_gates, f"b{way}": d_gates.sum(axis=0)}
            d_x += d_gates @ p[f"x{way}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.bucket, d_x[:, :WIDE])
        np.add.at(g["char"], words.chars, np.repeat(d_x[:, WIDE:] / words.counts[:, None], words.counts, axis=0))
        return float(loss), g


def _parts(group: np.ndarray, lengths: list[int]) -> Iterator[list[int]]:
    """Texts of a step in parts of WORDS_A_PART words, so that memory does not follow the longest texts."""
    part, size = [], 0
    for i in group:
        if part and size + lengths[i] > WORDS_A_PART:
            yield part
            part, size = [], 0
        part.append(i)
        size += lengths[i]
    if part:
        yield part


def train(texts: list[str], labels: np.ndarray, seed: int = 5) -> Network:
    """A network fitted to labelled texts by Adam.

    The first value of each input bucket starts at the smoothed log-odds of the label among the texts that have it, so
    that the recurrent part starts from something to look for.
    """
    net = Network.fresh(seed)
    if not len(texts) or len(set(labels.tolist())) < 2:
        net.p["out"][:] = 0
        return net
    counts = {k: np.zeros((2, len(net.p[k])), np.float64) for k in ("word", "char")}
    for text, y in zip(texts, labels, strict=True):
        words = Words.of([*dict.fromkeys(text.lower().split())])
        counts["word"][int(y), np.unique(words.bucket)] += 1
        counts["char"][int(y), np.unique(words.chars)] += 1
    sizes = np.array([(labels == 0).sum(), (labels == 1).sum()])
    for k, c in counts.items():
        odds = np.log((c[1] + 0.5) / (sizes[1] + 1)) - np.log((c[0] + 0.5) / (sizes[0] + 1))
        net.p[k][:, 0] = np.where(c.sum(axis=0) >= 3, np.clip(odds, -3, 5) / 2, 0)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    by_length = np.argsort([len(t) for t in texts], kind="stable")
    lengths = [t.count(" ") + t.count("\n") + 1 for t in texts]
    step = 0
    passes = max(PASSES, min(MOST_PASSES, 6_000 // len(texts)))
    size = min(DOCS_A_STEP, max(8, len(texts) // 60))
    for k in range(passes):
        groups = np.array_split(by_length if k % 2 else rng.permutation(len(texts)), -(-len(texts) // size))
        for j in rng.permutation(len(groups)):
            group = groups[j]
            step += 1
            g: dict[str, np.ndarray] = {}
            for part in _parts(group, lengths):
                seen, numbers = split_words([texts[i] for i in part])
                for name, grad in net.gradient(Words.of(seen), numbers, labels[part].astype(np.float32))[1].items():
                    g[name] = g.get(name, 0) + grad * np.float32(len(part) / len(group))
            rate = RATE * (1 - 0.9 * k / passes)
            for name, grad in g.items():
                np.clip(grad, -1, 1, out=grad)
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.01 * (grad * grad - second[name])
                net.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def score_texts(net: Network, texts: list[str]) -> np.ndarray:
    """The largest probability over all windows of each text."""
    out = np.zeros(len(texts))
    group: list[int] = []
    size = 0
    for k, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > STRETCH):
            seen, numbers = split_words([texts[i] for i in group])
            _, rows, starts = lay_out(numbers)
            logit = net.logits(Words.of(seen), rows)
            out[group] = _sigmoid(np.maximum.reduceat(logit, starts).astype(np.float64))
            group, size = [], 0
        if t is not None:
            group.append(k)
            size += len(t)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """Bounded sample of labelled texts that are not held out: text, toxic."""
    key = F.col(id_col).cast("string")
    usable = labels.select(F.col(id_col), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(F.pmod(F.crc32(key.cast("binary")), F.lit(4)) != 2)
    order = F.xxhash64(F.col(id_col))
    one = usable.where("toxic = 1").orderBy(order, id_col).limit(MOST_TOXIC)
    zero = usable.where("toxic = 0").orderBy(order, id_col).limit(MOST_CLEAN)
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MOST_BYTES)
    found = texts.join(F.broadcast(one.unionByName(zero)), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found.toPandas().sort_values(id_col).reset_index(drop=True)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    The network is fitted to a bounded sample of labelled rows (MOST_TOXIC, MOST_CLEAN, MOST_BYTES) and shared as one
    broadcast of fixed size; every whole text is then scored in all its overlapping windows, in a map over the rows,
    and has the score of its worst window. Label, language, source and id are no inputs of a score.

    A null or empty text is scored as one empty window. A null id is not held out. Repeated rows are scored each; with
    no usable labels every text has the same score, below the threshold; an empty table gives an empty result; other
    columns are not read.
    """
    sample = training_sample(docs, labels, id_col, text_col)
    net = train(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for batch in batches:
            s = score_texts(own, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores threshold or more; columns and nulls stay as they are. See score()."""
    sample = training_sample(docs, labels, id_col, text_col)
    net = train(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(score_texts(own, [t or "" for t in texts]) < threshold))

    return docs.mapInArrow(run, docs.schema)
