"""Removal of long repeated byte strings by a sampled, range-partitioned sparse suffix array."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, free_names, shared_dir, staged

#: Leading bytes by which suffixes are told apart, partitioned and sorted.
LEAD = 20
#: Bytes of text that one numpy pass works on (longer texts go through in overlapping stretches), that a task takes at
#: once when it combines leads, and whose leads meet in one group.
STRETCH, BATCH_BYTES, PART_BYTES = 1 << 18, 1 << 24, 1 << 24
#: Suffixes that a task gathers before it sends them off (neighbours' contexts are alike and compress well together), that
#: one bucket should hold, and that are compared at once unless one lead has more.
GATHERED, BUCKET_SUFFIXES, SLICE = 100_000, 120_000, 8_192
#: Suffixes whose windows are hashed at once.
WINDOW_ROWS = 4_096
#: Sampled suffixes a splitter, the fewest in all, and the most splitters that every task is sent (32 bytes each).
SAMPLED, LEAST_SAMPLE, MOST_SPLITTERS = 16, 50_000, 1 << 17

_M = 0x9E3779B97F4A7C15
_MULTIPLY = np.uint64(_M)
_BYTES = np.random.default_rng(11).integers(0, 2**64, (2, 256), dtype=np.uint64)
_NO_REPLY = 0xFFFF


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Anchors:
    """Suffixes worth comparing: in every window of min_bytes, the start of its least LEAD-byte string by hash.

    Equal windows have it at the same place, so two documents share a window only if they share the lead of a suffix
    that starts at such a place, with as much text before it. About one place in (min_bytes - LEAD) / 2 is one.
    """

    def __init__(self, min_bytes: int, stretch: int | None = None):
        self.size, self.wide, self.stretch = min_bytes, min_bytes - LEAD + 1, stretch or STRETCH
        n = self.stretch + 2 * min_bytes + 8
        self.up, self.down = _powers(_M, n), _powers(pow(_M, -1, 2**64), n)

    def __reduce__(self):
        return Anchors, (self.size, self.stretch)

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, place, first and last window start that it stands for, hash of the lead), for groups of stretches."""
        stretch: list[tuple[int, int, bytes]] = []
        total, half = 0, self.stretch // 2
        for k, raw in enumerate(texts):
            for a in range(0, max(1, len(raw) - self.size + 1), half):
                part = raw[a : a + half + self.size - 1]
                if len(part) < self.size:
                    continue
                if total + len(part) > self.stretch and stretch:
                    yield self._group(stretch)
                    stretch, total = [], 0
                stretch.append((k, a, part))
                total += len(part)
        if stretch:
            yield self._group(stretch)

    def _group(self, stretch: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        lens = np.array([len(x[2]) for x in stretch])
        base = np.concatenate([[0], np.cumsum(lens)])
        raw = np.frombuffer(b"".join(x[2] for x in stretch), np.uint8)
        n, size = len(raw), self.size
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[0][raw] * self.up[:n], out=prefix[1:])
        lead = _mix((prefix[LEAD:] - prefix[:-LEAD]) * self.down[: n - LEAD + 1])
        least = (lead & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(lead), dtype=np.uint64)
        step = 1
        while step * 2 <= self.wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < self.wide:
            least = np.minimum(least[: len(least) - (self.wide - step)], least[self.wide - step :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # of the window that starts there
        owner = np.repeat(np.arange(len(stretch), dtype=np.int32), lens)
        valid = owner[: len(at)] == owner[size - 1 : size - 1 + len(at)]
        starts = np.flatnonzero(valid)
        at = at[starts]
        new = np.r_[True, at[1:] != at[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        place = at[first]
        own = owner[place]
        shift = np.array([x[1] for x in stretch])[own] - base[own]
        number = np.array([x[0] for x in stretch])[own]
        return number, place + shift, starts[first] + shift, starts[last] + shift, lead[place]


def _pack(columns: list[np.ndarray], part: np.ndarray) -> Iterator[tuple]:
    """(part, bytes of each column) for each part that has entries."""
    if len(part):
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
        for a, b in zip(cuts, cuts[1:], strict=False):
            o = order[a:b]
            yield (int(part[o[0]]), *(c[o].tobytes() for c in columns))


def _part(rows: np.ndarray, parts: int) -> np.ndarray:
    return (rows.view(np.uint64) % np.uint64(parts)).astype(np.int32)


def _joined(values: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _shared_leads(texts: DataFrame, min_bytes: int, parts: int) -> DataFrame:
    """Per row the leads (32 bits of their hashes) that another row has too: row, leads.

    Each batch settles what its own rows share and sends every lead once, so a lead that a third of all documents
    have is as many entries as there are batches. Entries are packed arrays; rows travel in none of them.
    """

    anchors = Anchors(min_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 1, BATCH_BYTES, 60_000):
                ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
                found = [(x[4], x[0]) for x in anchors.of([(t or "").encode() for t in batch.column(1).to_pylist()])]
                if not found:
                    continue
                lead, number = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((number, lead))
                lead, number = lead[order], number[order]
                once = np.r_[True, (lead[1:] != lead[:-1]) | (number[1:] != number[:-1])]
                lead, number = lead[once], number[once]
                first = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
                count = np.diff(np.r_[first, len(lead)])
                several = np.repeat(count > 1, count)
                rows = []
                done = ids[number[several]]
                for p, r, x in _pack([done, (lead[several] >> np.uint64(32)).astype("<u4")], _part(done, parts)):
                    rows.append((p, True, r, b"", x))
                ask, who = lead[first], np.where(count > 1, _NO_REPLY, number[first]).astype("<u2")
                part = (ask % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    o = order[cuts[p] : cuts[p + 1]]
                    o = o[np.argsort(who[o], kind="stable")]
                    known, slot = np.unique(who[o], return_inverse=True)
                    named = ids[known[known != _NO_REPLY]]
                    slot = np.where(who[o] == _NO_REPLY, _NO_REPLY, slot).astype("<u2")
                    rows.append((int(p), False, named.tobytes(), slot.tobytes(), (ask[o] >> np.uint64(32)).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "done", "ids", "slots", "leads"])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        open_ = frame[~frame["done"]]
        rows = list(frame.loc[frame["done"], ["part", "ids", "leads"]].itertuples(index=False, name=None))
        if len(open_):
            who = []
            for ids, slots in zip(open_["ids"], open_["slots"], strict=True):
                named, slot = np.frombuffer(ids, "<i8"), np.frombuffer(slots, "<u2")
                who.append(np.append(named, 0)[np.minimum(slot, len(named))])
            who, asked, lead = np.concatenate(who), _joined(open_["slots"], "<u2") != _NO_REPLY, _joined(open_["leads"], "<u4")
            order = np.argsort(lead, kind="stable")
            ordered = lead[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            again = np.zeros(len(lead), bool)
            again[order] = ~(new & np.r_[new[1:], True])
            hit = again & asked
            rows += _pack([who[hit], lead[hit]], _part(who[hit], parts))
        return pd.DataFrame(rows, columns=["part", "ids", "leads"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        who, lead = _joined(frame["ids"], "<i8"), _joined(frame["leads"], "<u4")
        order = np.lexsort((lead, who))
        who, lead = who[order], lead[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        cuts = np.r_[first, len(who)]
        return pd.DataFrame({"row": who[first], "leads": [lead[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]})

    sent = texts.select("row", "text").mapInArrow(send, "part int, done boolean, ids binary, slots binary, leads binary")
    settled = sent.groupBy("part").applyInPandas(settle, "part int, ids binary, leads binary")
    return settled.groupBy("part").applyInPandas(gather, "row long, leads binary")


def _suffixes(batch: pa.RecordBatch, anchors: Anchors) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a batch (doc_id, row, text, leads) the suffixes with a shared lead.

    (context bytes, doc_id, row, place, least and most bytes before the place that a window may begin). A context is
    the text around the place that its windows can reach, with zeros beyond the text.
    """
    size, before = anchors.size, anchors.size - LEAD
    docs, rows = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
    texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
    leads = [np.frombuffer(x, "<u4") for x in batch.column(3).to_pylist()]
    for number, place, first, last, lead in anchors.of(texts):
        keep = np.zeros(len(number), bool)
        short = (lead >> np.uint64(32)).astype("<u4")
        edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            keep[a:b] = np.isin(short[a:b], leads[number[a]])
        number, place, first, last = number[keep], place[keep], first[keep], last[keep]
        if not len(number):
            continue
        context = np.zeros((len(number), before + size), np.uint8)
        edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            lo, hi = int(place[a:b].min()) - before, int(place[a:b].max()) + size
            raw = texts[number[a]]
            view = np.frombuffer(b"\0" * max(0, -lo) + raw[max(0, lo) : hi] + b"\0" * max(0, hi - len(raw)), np.uint8)
            context[a:b] = np.lib.stride_tricks.sliding_window_view(view, before + size)[place[a:b] - before - lo]
        yield context, docs[number], rows[number], place, (place - last).astype(np.uint8), (place - first).astype(np.uint8)


def _words(context: np.ndarray, before: int) -> list[np.ndarray]:
    """The lead as big-endian 8-byte characters, so that their order is the bytes' order."""
    lead = np.zeros((len(context), 8 * math.ceil(LEAD / 8)), np.uint8)
    lead[:, :LEAD] = context[:, before : before + LEAD]
    return list(np.ascontiguousarray(lead.view(">u8").T.astype(np.uint64)))


def multikey_sort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several characters each: sorts by one character, and only what ties by the next."""
    order = np.argsort(columns[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    for depth, column in enumerate(columns):
        if depth:
            tied = np.flatnonzero(np.r_[False, group[1:] == group[:-1]] | np.r_[group[1:] == group[:-1], False]) if len(group) else []
            if not len(tied):
                break
            inner = np.lexsort((column[order[tied]], group[tied]))
            order[tied] = order[tied][inner]
        value = column[order]
        group = np.cumsum(np.r_[False, (value[1:] != value[:-1]) | (group[1:] != group[:-1])]) if len(value) else group
    return order


def _bucket_of(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (rows of as many values as there are keys) that are not above each row."""
    out = np.searchsorted(splitters[:, 0], keys[0], side="left").astype(np.int64)
    tied = np.flatnonzero(np.isin(keys[0], splitters[:, 0]))  # the other keys decide
    if len(tied):
        columns = [np.r_[s, key[tied]] for s, key in zip(splitters.T, keys, strict=True)]
        row = np.arange(len(columns[0])) >= len(splitters)
        order = np.lexsort((row, *columns[::-1]))
        below = np.cumsum(~row[order])
        out[tied[order[row[order]] - len(splitters)]] = below[row[order]]
    return out


def _windows(context: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, tables: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix number, bytes before its place, hashes by each byte table) of all windows that suffixes stand for."""
    before, wide = size - LEAD, context.shape[1]
    up, down = _powers(_M, wide), _powers(pow(_M, -1, 2**64), wide)
    found = []
    for a in range(0, len(context), WINDOW_ROWS):
        c, least, count = context[a : a + WINDOW_ROWS], low[a : a + WINDOW_ROWS].astype(np.int64), high[a : a + WINDOW_ROWS].astype(np.int64) + 1
        count -= least
        n = np.repeat(np.arange(len(c)), count)
        o = np.arange(len(n)) - np.repeat(np.cumsum(count) - count - least, count)
        at, keys = before - o, []
        for t in range(tables):
            prefix = np.zeros((len(c), wide + 1), np.uint64)
            np.cumsum(_BYTES[t][c] * up, axis=1, out=prefix[:, 1:])
            keys.append(_mix((prefix[n, at + size] - prefix[n, at]) * down[at]) + o.astype(np.uint64) * _MULTIPLY)
        found.append((n + a, o.astype(np.uint8), *keys))
    n, o, *keys = (np.concatenate(x) for x in zip(*found, strict=True))
    return n, o, keys


def _confirmed(context: np.ndarray, n: np.ndarray, o: np.ndarray, partner: np.ndarray, size: int) -> bool:
    """Whether each window (o bytes before the place of suffix n) has the same bytes as that of its partner (-1: none)."""
    before = size - LEAD
    asked = np.flatnonzero(partner >= 0)
    n, o, partner = n[asked], o[asked], partner[asked]
    new = np.r_[True, (n[1:] != n[:-1]) | (partner[1:] != partner[:-1])] if len(n) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    reach = np.zeros((2, len(first)), np.int16)  # equal bytes before the place, and from it on
    for a in range(0, len(first), WINDOW_ROWS):
        f = first[a : a + WINDOW_ROWS]
        differ = context[n[f]] != context[partner[f]]
        for k, d in enumerate((differ[:, before - 1 :: -1] if before else differ[:, :0], differ[:, before:])):
            reach[k, a : a + len(f)] = np.where(d.any(axis=1), d.argmax(axis=1), d.shape[1]) if d.shape[1] else 0
    run = np.cumsum(new) - 1
    return bool(np.all((reach[0][run] >= o) & (reach[1][run] >= size - o.astype(np.int64))))


def _classes(context: np.ndarray, n: np.ndarray, o: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the different windows by their bytes."""
    view = np.lib.stride_tricks.sliding_window_view(context, size, axis=1)
    windows = np.ascontiguousarray(view[n, size - LEAD - o.astype(np.int64)]).view(f"V{size}").ravel()
    return np.unique(windows, return_inverse=True)[1].astype(np.uint64)


def _spans(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Unions (doc, row, start, end) of windows that overlap or touch."""
    if not len(rows):
        return [docs, rows, starts.astype("<i4"), starts.astype("<i4")]
    order = np.lexsort((starts, rows, docs))
    docs, rows, starts = docs[order], rows[order], starts[order]
    new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + size)])
    last = np.r_[new[1:], len(rows)] - 1
    return [docs[new], rows[new], starts[new].astype("<i4"), (starts[last] + size).astype("<i4")]


_SUFFIX = ("contexts", "docs", "rows", "places", "lows", "highs")


def _unpack(frame: pd.DataFrame, size: int) -> list[np.ndarray]:
    kinds = ("<i8", "<i8", "<i4", "u1", "u1")
    wide = 2 * size - LEAD
    raw = b"".join(pa.decompress(c, len(low) * wide, codec="zstd", asbytes=True) for c, low in zip(frame["contexts"], frame["lows"], strict=True))
    return [np.frombuffer(raw, "u1").reshape(-1, wide), *(_joined(frame[c], k) for c, k in zip(_SUFFIX[1:], kinds, strict=True))]


_FOUND = "ask boolean, part int, keys binary, more binary, docs binary, rows binary, starts binary, ends binary"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _compare(frames: DataFrame, splitters: np.ndarray, min_bytes: int, parts: int) -> DataFrame:
    """Bucket by bucket: spans that repeat (docs, rows, starts, ends), and windows to ask other buckets about (ask true).

    A lead on a splitter may lie in several buckets. Of its windows those that a smaller document of the bucket has too
    are settled; what is left of each different window is asked about, so that a passage that a third of all documents
    hold is a few entries a bucket.
    """
    heads = np.unique(splitters[:, 0])
    crossing = {tuple(s[:-1]) for s in splitters.tolist()}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = _unpack(frame, min_bytes)
        words = _words(found[0], min_bytes - LEAD)
        order = multikey_sort([*words, found[1].view(np.uint64) ^ np.uint64(1 << 63)])
        words = [w[order] for w in words]
        context, docs, rows, places, low, high = (x[order] for x in found)
        edges = np.flatnonzero(np.r_[True, np.any([w[1:] != w[:-1] for w in words], axis=0), True])
        first, last = edges[:-1], edges[1:] - 1
        crosses = np.zeros(len(first), bool)
        for g in np.flatnonzero(np.isin(words[0][first], heads)):
            crosses[g] = tuple(int(w[first[g]]) for w in words) in crossing
        out = []

        def settle(take: np.ndarray, ask: bool) -> None:
            c = context[take]
            n, o, (key, *more) = _windows(c, low[take], high[take], min_bytes, 2 if ask else 1)
            who, starts, same = docs[take][n], places[take][n].astype(np.int64) - o, key
            for exact in (False, True):
                sort = np.lexsort((who, same))
                head = np.r_[True, same[sort][1:] != same[sort][:-1]]
                heads = sort[head][np.cumsum(head) - 1]
                gone = who[sort] > who[heads]
                partner = np.full(len(n), -1, np.int64)
                partner[sort[gone]] = n[heads[gone]]
                if exact or _confirmed(c, n, o, partner, min_bytes):
                    break
                same = _classes(c, n, o, min_bytes)  # two different windows have one hash
            w = sort[gone]
            spans = _spans(who[w], rows[take][n[w]], starts[w], min_bytes)
            out.extend((False, p, b"", b"", *x) for p, *x in _pack(spans, _part(spans[1], parts)))
            if ask:
                w = sort[~gone]
                out.extend((True, *x, b"") for x in _pack([key[w], more[0][w], who[w], rows[take][n[w]], starts[w].astype("<i4")], _part(key[w], parts)))

        several = (docs[first] != docs[last]) & ~crosses  # neighbours of one document alone repeat nothing
        group = np.repeat(np.arange(len(first)), np.diff(edges))
        for ask, take in ((False, np.flatnonzero(several[group])), (True, np.flatnonzero(crosses[group]))):
            whole = np.flatnonzero(np.r_[True, group[take][1:] != group[take][:-1]]) if len(take) and not ask else np.arange(0, len(take), SLICE)
            a = 0
            while a < len(take):
                at = np.searchsorted(whole, a + SLICE)
                b = whole[at] if at < len(whole) else len(take)
                settle(take[a:b], ask)
                a = b
        return pd.DataFrame(out, columns=_NAMES)

    return frames.groupBy("bucket").applyInPandas(run, _FOUND)


def _across_buckets(asked: DataFrame, min_bytes: int, parts: int) -> DataFrame:
    """Spans of windows that a smaller document of another bucket has; windows are told by 128 bits of hashes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, more = _joined(frame["keys"], "<u8"), _joined(frame["more"], "<u8")
        docs, rows, starts = _joined(frame["docs"], "<i8"), _joined(frame["rows"], "<i8"), _joined(frame["starts"], "<i4")
        sort = np.lexsort((docs, more, key))
        head = np.r_[True, (key[sort][1:] != key[sort][:-1]) | (more[sort][1:] != more[sort][:-1])]
        w = sort[docs[sort] > docs[sort[head]][np.cumsum(head) - 1]]
        spans = _spans(docs[w], rows[w], starts[w].astype(np.int64), min_bytes)
        return pd.DataFrame(list(_pack(spans, _part(spans[1], parts))), columns=["part", "docs", "rows", "starts", "ends"])

    return asked.groupBy("part").applyInPandas(run, "part int, docs binary, rows binary, starts binary, ends binary")


def _splitters(texts: DataFrame, shared: DataFrame, anchors: Anchors, min_bytes: int) -> tuple[np.ndarray, int]:
    """Splitters over (lead, doc_id), and the parts by hash of the lead that each range between them is dealt to.

    Rows are sampled by hash, so that about SAMPLED suffixes a splitter come to the driver; there are at most
    MOST_SPLITTERS, and beyond them ranges are dealt on by hash.
    """
    names = [f"w{k}" for k in range(math.ceil(LEAD / 8))]
    suffixes = shared.agg(F.sum(F.length("leads") / 4)).first()[0] or 0
    buckets = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(suffixes / BUCKET_SUFFIXES))
    ranges = min(buckets, MOST_SPLITTERS)
    every = max(1, int(suffixes // (4 * max(LEAST_SAMPLE, SAMPLED * ranges))))
    some = F.pmod(F.xxhash64("row"), F.lit(every)) == 0

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, docs, *_ in _suffixes(batch, anchors):
                words = _words(context[::4], min_bytes - LEAD)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)) for w in words] + [pa.array(docs[::4])], names=[*names, "doc_id"])

    picked = texts.where(some).join(shared.where(some), "row").select("doc_id", "row", "text", "leads")
    got = picked.mapInArrow(sample, ", ".join(f"{c} long" for c in [*names, "doc_id"])).toPandas()
    keys = [got[c].to_numpy(np.int64).view(np.uint64) for c in names] + [got["doc_id"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)]
    order = multikey_sort(keys)
    picks = np.unique(np.linspace(0, len(order), ranges + 1)[1:-1].astype(np.int64)) if len(order) else np.zeros(0, np.int64)
    return np.unique(np.stack([k[order[picks]] for k in keys], 1), axis=0).reshape(-1, len(keys)), math.ceil(buckets / ranges)


def repeated_spans(texts: DataFrame, min_bytes: int) -> DataFrame:
    """Per row of texts (doc_id, row, text) that has any: doc_id, row and spans, packed (start, end) byte pairs in order."""
    anchors = Anchors(min_bytes)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PART_BYTES))
    shared = staged(_shared_leads(texts, min_bytes, parts), "shared-leads")
    splitters, dealt_on = _splitters(texts, shared, anchors, min_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at_splitter = np.unique(splitters[:, 0])

        def send() -> pa.RecordBatch:
            context, docs, rows, places, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words = _words(context, min_bytes - LEAD)
            order = np.argsort(words[0], kind="stable")
            context, docs, rows, places, low, high = (x[order] for x in (context, docs, rows, places, low, high))
            words = [w[order] for w in words]
            bucket = _bucket_of([*words, docs.view(np.uint64) ^ np.uint64(1 << 63)], splitters)
            if dealt_on > 1:  # a lead that may lie on a splitter is compared across buckets, so its documents may part
                apart = np.where(np.isin(words[0], at_splitter), docs.view(np.uint64), np.uint64(0))
                bucket = bucket * dealt_on + _part(_mix(words[0] * _MULTIPLY + _mix(words[1] * _MULTIPLY + apart)), dealt_on)
            packed = [(p, pa.compress(c, codec="zstd", asbytes=True), *more) for p, c, *more in _pack([context, docs, rows, places.astype("<i4"), low, high], bucket)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in packed], pa.int64() if not k else pa.binary()) for k in range(7)], names=["bucket", *_SUFFIX])

        for batch in batches:
            for found in _suffixes(batch, anchors):
                held.append(found)
                if sum(len(x[0]) for x in held) >= GATHERED:
                    yield send()
        if held:
            yield send()

    with_text = texts.join(shared, "row").select("doc_id", "row", "text", "leads")
    dealt = with_text.mapInArrow(deal, "bucket long, " + ", ".join(f"{c} binary" for c in _SUFFIX))
    compared = staged(_compare(dealt, splitters, min_bytes, parts), "compared")

    def union(frame: pd.DataFrame) -> pd.DataFrame:
        docs, rows, starts, ends = (_joined(frame[c], k) for c, k in zip(("docs", "rows", "starts", "ends"), ("<i8", "<i8", "<i4", "<i4"), strict=True))
        order = np.lexsort((starts, rows, docs))
        docs, rows, starts, ends = docs[order], rows[order], starts[order], ends[order].astype(np.int64)
        other = np.r_[False, (rows[1:] != rows[:-1]) | (docs[1:] != docs[:-1])]
        number = np.cumsum(other)
        reach = np.maximum.accumulate(ends + (number << 33)) - (number << 33)  # furthest end so far within the row
        new = np.flatnonzero(np.r_[True, other[1:] | (starts[1:] > reach[:-1])])
        last = np.r_[new[1:], len(rows)] - 1
        pairs = np.stack([starts[new], reach[last]], 1).astype("<i4")
        edges = np.flatnonzero(np.r_[True, np.diff(number[new]) != 0, True])
        head = new[edges[:-1]]
        return pd.DataFrame({"doc_id": docs[head], "row": rows[head], "spans": [pairs[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]})

    names = ["part", "docs", "rows", "starts", "ends"]
    found = compared.where("not ask").select(names).unionByName(_across_buckets(compared.where("ask"), min_bytes, parts))
    return found.groupBy("part").applyInPandas(union, "doc_id long, row long, spans binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def _kept(raw: bytes, spans: bytes | None) -> tuple[bytes, np.ndarray]:
    pairs = np.frombuffer(spans or b"", "<i4").reshape(-1, 2)
    edges = [0, *pairs.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), pairs


def removal_report(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (lower-case hex of the bytes that stay).

    A byte goes when a string of min_bytes that covers it also starts in a document with a smaller doc_id, as the texts
    were given. Suffixes at places that both documents of any such match must have (see Anchors) are kept when another
    row has their lead too, dealt to buckets by sampled splitters over (lead, doc_id), sorted there by multikey
    quicksort and compared with their neighbours; a lead that lies on splitters is compared across its buckets.

    Ids are integers or text that casts to such; other ids raise. A null text counts as empty. A null id is no document that others are compared with, and loses nothing. Rows of a
    repeated id don't remove each other's bytes. Texts shorter than min_bytes lose nothing. An empty table gives an
    empty result; other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    shared_dir(docs.sparkSession)
    spans = staged(repeated_spans(texts.where("doc_id is not null"), min_bytes), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, count, sha = [], [], [], []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                kept, pairs = _kept(raw, packed)
                n.append(len(raw))
                gone.append(len(raw) - len(kept))
                count.append(len(pairs))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its repeated strings cut from the text, all rows and columns kept; see removal_report().

    Only whole characters go: a character of which a span covers a part stays. A null text stays null.
    """
    texts = _texts(docs, id_col, text_col)
    shared_dir(docs.sparkSession)
    spans = staged(repeated_spans(texts.where("doc_id is not null"), min_bytes), "spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, packed: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, packed, strict=True):
            if t is None or p is None:
                out.append(t)
                continue
            raw = t.encode()
            inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
            pairs = np.frombuffer(p, "<i4").reshape(-1, 2).copy()
            for pair in pairs:
                while inside(pair[0]):
                    pair[0] += 1
                while pair[1] > pair[0] and inside(pair[1]):
                    pair[1] -= 1
            out.append(_kept(raw, pairs.tobytes())[0].decode())
        return pd.Series(out)

    one, two, cuts = free_names(docs, "doc", "row", "spans")
    keyed = docs.withColumn(one, F.col(id_col).cast("long")).withColumn(two, F.xxhash64(one, F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    joined = keyed.join(spans.select(F.col("doc_id").alias(one), F.col("row").alias(two), F.col("spans").alias(cuts)), [one, two], "left")
    changed = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col).cast("string"), F.col(cuts)))
    return joined.select(*(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
