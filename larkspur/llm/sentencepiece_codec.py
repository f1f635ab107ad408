"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of scored pieces."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO_CHARS, _Memo, tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class DoubleArray:
    """A double-array trie over strings: child of node s by code c is t = base[s] + c when check[t] == s."""

    def __init__(self, keys: list[str]):
        codes = {c: i for i, c in enumerate(sorted({c for k in keys for c in k}), 1)}
        self.codes = codes
        size = 2 * sum(map(len, keys)) + len(codes) + 2
        base, check, value, free = [0] * size, [-1] * (size + len(codes)), [-1] * size, 1
        check[0] = -2
        level: list[tuple[int, int, list[tuple[str, int]]]] = [(0, 0, sorted((k, i) for i, k in enumerate(keys)))]
        while level:
            node, depth, members = level.pop()
            children: dict[int, list[tuple[str, int]]] = {}
            for k, i in members:
                if len(k) == depth:
                    value[node] = i
                else:
                    children.setdefault(codes[k[depth]], []).append((k, i))
            if not children:
                continue
            least = min(children)
            while check[free] != -1:
                free += 1
            spot = max(free - least, 0)
            while any(check[spot + c] != -1 for c in children):
                spot += 1
            base[node] = spot
            for c in children:
                check[spot + c] = node
            level += [(spot + c, depth + 1, m) for c, m in children.items()]
        self.base, self.check, self.value = base, check, value


class Unigram:
    """Best segmentation of whole texts by summed log scores.

    Blanks become the mark and one mark is put before the text. No piece holds a mark after another character, so a
    best path always cuts before a run of marks that follows another character: words are solved apart and memoised.
    A character without a piece costs the least score less a penalty and is written as byte pieces (or as <unk> when
    the model has none). Ties go to the path whose last piece is longer. Scores are summed as doubles.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.ids = [i for i in range(n) if not special(i)]
        scores = [model.get_score(i) for i in self.ids]
        self.scores = scores
        self.trie = DoubleArray([self.text[i] for i in self.ids])
        self.missing = min(scores) - UNKNOWN_PENALTY
        self.kind = ["control" if model.is_control(i) else "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "piece" for i in range(n)]
        inner = any(MARK in self.text[i].lstrip(MARK) for i in self.ids)
        self.words = re.compile(r"[\s\S]+") if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo = _Memo(self._word)

    def _word(self, word: str) -> bytes:
        get, base, check, value, ids, scores = self.trie.codes.get, self.trie.base, self.trie.check, self.trie.value, self.ids, self.scores
        codes, n, missing = [get(c, 0) for c in word], len(word), self.missing
        best, size, last = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for at in range(n):
            here, single, node, end = best[at], False, 0, at
            while end < n:
                child = base[node] + codes[end]
                if check[child] != node:  # also for code 0, which no character of a piece has
                    break
                node, end = child, end + 1
                key = value[node]
                if key >= 0:
                    single |= end == at + 1
                    score = here + scores[key]
                    if score > best[end]:
                        best[end], size[end], last[end] = score, end - at, key
            if not single and here + missing > best[at + 1]:
                best[at + 1], size[at + 1], last[at + 1] = here + missing, 1, -1
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append([ids[last[at]]])
            else:
                raw = word[at - 1].encode()
                out.append([self.byte[b] for b in raw] if self.byte else [self.unknown])
            at -= size[at]
        return np.array([i for part in reversed(out) for i in part], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        memo, word = self.memo, self._word
        return b"".join(memo[w] if len(w) <= MEMO_CHARS else word(w) for w in self.words.findall(MARK + text.replace(" ", MARK)))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become blanks, the first blank goes, runs of byte pieces are read as UTF-8."""
        raw = bytearray()
        for i in ids:
            if self.kind[i] == "byte":
                raw.append(int(self.text[i][3:5], 16))
            elif self.kind[i] == "piece":
                raw += self.text[i].replace(MARK, " ").encode()
            elif self.kind[i] == "unknown":
                raw += " ⁇ ".encode()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(4)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: the id and ids, the best segmentation of the whole text as array<int>.

    A map over the rows, without a shuffle. A null or empty text gives an empty array; a null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = unigram(tokenizer_path(model))
        for batch in batches:
            ids = [codec.encode(x or "") for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: the id and the decoded text. Null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = unigram(tokenizer_path(model))
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """encode() and decode() of every whole text as one row per input row.

    n_pieces long, ids_crc32 long (unsigned, over little-endian 32-bit ids), n_byte_pieces long, round_trip boolean (the
    decoded text equals the input with U+2581 read as a blank, which the codec can't tell from one). Nulls as encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = unigram(tokenizer_path(model))
        byte = np.array([k == "byte" for k in codec.kind])
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [np.frombuffer(codec.encode(x), "<u4") for x in texts]
            same = [codec.decode(i.tolist()) == x.replace(MARK, " ") for i, x in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array([int(byte[i].sum()) for i in ids], pa.int64()), pa.array(same, pa.bool_())],
                names=[id_col, "n_pieces", "ids_crc32", "n_byte_pieces", "round_trip"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, n_byte_pieces long, round_trip boolean")
