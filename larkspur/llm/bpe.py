"""Byte-level BPE over whole texts: exact library ids, and exact token counts of every prefix.

A blank that stands before a non-blank character always begins a pre-token of the byte-level pattern, so a text can be
cut there and the pieces counted apart: words repeat, so many pieces come from a bounded memo table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

MEMO_ENTRIES = 500_000
MEMO_CHARS = 48
_ODD_BLANK = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Runs twice this long go to the library: the faster loop takes time with their square, and its pattern a stack with their length.
LONG_RUN = 2000
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """Pieces of a text: each but the first had one blank before it, which is left out here."""
    return _CUT.split(text) if _ODD_BLANK.search(text) else text.split(" ")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


def has_long_run(text: str) -> bool:
    """Whether some part of LONG_RUN characters, one after another through the text, is all blank or without any blank."""
    parts = (text[a : a + LONG_RUN] for a in range(0, len(text) - LONG_RUN + 1, LONG_RUN))
    return any(part.isspace() or part.split(None, 1) == [part] for part in parts)


class IdEncoder:
    """Ids of whole texts, equal to the tokenizers library's without added special tokens.

    The vocabulary file's pieces serve as ranks of a faster merge loop; a text that holds a special string or a very
    long run of letters or blanks goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        raw = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(raw[c] for c in t): i for t, i in self.lib.get_vocab(with_added_tokens=False).items() if t not in self.specials}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials) or (len(text) >= LONG_RUN and has_long_run(text)):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


class _Memo(dict):
    """Values by key from a function, cleared when it holds MEMO_ENTRIES."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Exact token counts of prefixes by dynamic programming.

    For a pre-token s, count[i] is the number of BPE tokens of s[:i]. The encoding of s[:i] ends in one token t, and
    without it is the encoding of s[: i - len(t)]; t is the only token ending there that, beside the last token of
    that shorter prefix, is left alone by the merges. So count[i] = count[i - len(t)] + 1, with the last token kept
    for the next steps; no prefix is encoded again. All tokens ending at each place come from one automaton pass.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.split = lib.pre_tokenizer.pre_tokenize_str
        specials = [t.content for t in lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.merge = Tokenizer.from_str(lib.to_str())
        self.merge.pre_tokenizer = _whole()
        vocab = {t: i for t, i in lib.get_vocab(with_added_tokens=False).items() if t not in specials}
        self.token = {i: t for t, i in vocab.items()}
        self.at = ahocorasick.Automaton()
        for (t, i), e in zip(vocab.items(), self.merge.encode_batch_fast([*vocab], add_special_tokens=False), strict=True):
            if len(e.ids) == 1:
                self.at.add_word(t, (len(t), i))
        self.at.make_automaton()
        self.mapped = {b: c for b, c in enumerate(byte_alphabet())}
        self.pairs = _Memo(self._stays)
        self.words = _Memo(self._word)
        self.pieces = _Memo(self.compute)
        self.tails = _Memo(self.compute)

    def _merged(self, mapped: str) -> list[int]:
        return self.merge.encode(mapped, add_special_tokens=False).ids

    def _stays(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        return self._merged(self.token[left] + self.token[right]) == [left, right]

    def prefix_counts(self, mapped: str) -> list[int]:
        """count[i] for every prefix of a pre-token given in the vocabulary's byte alphabet."""
        count, last, pairs = [0] * (len(mapped) + 1), [-1] * (len(mapped) + 1), self.pairs
        for end, (size, token) in self.at.iter(mapped):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start or pairs[last[start] << 32 | token]:
                    count[end] = count[start] + 1
                    last[end] = token
        return count

    def _word(self, letters: str) -> int:
        """Tokens of letters that stand after a blank: one pre-token."""
        return self.prefix_counts("Ġ" + letters.encode().decode("latin-1").translate(self.mapped))[-1]

    def sections(self, text: str) -> list[tuple[str, bool]]:
        """Parts of a text between special strings, and those strings themselves (True)."""
        if self.special is None or not self.special.search(text):
            return [(text, False)] if text else []
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*parts, (text[at:], False)] if x[0]]

    def compute(self, text: str) -> int:
        total = 0
        for part, special in self.sections(text):
            total += 1 if special else sum(self.prefix_counts(s)[-1] for s, _ in self.split(part))
        return total

    def piece(self, piece: str) -> int:
        """Tokens of a blank and then the piece."""
        letters = piece.rstrip(_SIGNS)
        if letters.isalpha():  # letters and signs are pre-tokens of their own
            if len(piece) > MEMO_CHARS:
                return self._word(letters) + self.compute(piece[len(letters) :])
            return self.words[letters] + (self.tails[piece[len(letters) :]] if len(letters) < len(piece) else 0)
        return self.pieces[" " + piece] if len(piece) <= MEMO_CHARS else self.compute(" " + piece)

    def count(self, text: str) -> int:
        first, *rest = cut(text)
        return (self.compute(first) if first else 0) + sum(map(self.piece, rest))

    def table(self, text: str) -> np.ndarray:
        """The exact count of every prefix of a text, by its bytes: entry i is for the first i bytes."""
        counts = [0]
        for part, special in self.sections(text):
            if special:
                counts += [counts[-1]] * (len(part.encode()) - 1) + [counts[-1] + 1]
                continue
            for s, _ in self.split(part):
                base = counts[-1]
                counts += [base + c for c in self.prefix_counts(s)[1:]]
        return np.array(counts, dtype=np.int64)

    def cut_at_budget(self, text: str, budget: int) -> int:
        """Largest number of leading bytes, whole characters only, whose count is within the budget."""
        raw = np.frombuffer(text.encode() + b" ", dtype=np.uint8)
        fits = np.flatnonzero((self.table(text) <= budget) & (raw & 0xC0 != 0x80))
        return int(fits[-1]) if len(fits) else 0


def _whole():
    """A pre-tokenizer that leaves its input in one piece."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(r"\A(?!.)."), behavior="isolated")


@lru_cache(4)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


@lru_cache(4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)
