import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, packing, sentencepiece_codec, token_counts

SCHEMA = "doc_id long, text string"
LETTERS = " \n\t\r\x1c\x85\xa0　'sd<|>endoftextabéß中🎉12½_-.ªⅧ▁"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 25))) + rng.choice(["", "", "<|endoftext|>", "<|endoftext|>  "]) for _ in range(n)]


def test_ids_and_counts_equal_the_library(spark, library):
    e, c = bpe.id_encoder(bpe.tokenizer_path("byte_bpe_50k.json")), bpe.prefix_counter(bpe.tokenizer_path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()["text"].tolist()
    for t in [*texts(3000), *docs, "a" * 5_000, " " * 3_000 + "x"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t).tolist() == ids and c.count(t) == len(ids), t


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "a" * 1_000_000, "\t " * 300_000, "\u4e2d\u6587" * 200_000, "!?" * 200_000])
def test_runs_of_a_million_characters_equal_the_library(library, text):
    e, c = bpe.id_encoder(bpe.tokenizer_path("byte_bpe_50k.json")), bpe.prefix_counter(bpe.tokenizer_path("byte_bpe_50k.json"))
    ids = library.encode(text, add_special_tokens=False).ids
    assert e.encode(text).tolist() == ids and c.count(text) == len(ids)
    u = sentencepiece_codec.unigram(bpe.tokenizer_path("piece_bpe_32k.model"))
    assert u.decode(np.frombuffer(u.encode(text), "<u4").tolist()) == text


def test_one_word_of_many_megabytes_is_packed_and_counted(spark, library):
    word = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(4_000_000))
    df = spark.createDataFrame([(1, word), (2, "a" + " " * 1_000_000 + "b")], SCHEMA)
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    assert n == {1: len(library.encode(word, add_special_tokens=False).ids), 2: len(library.encode("a" + " " * 1_000_000 + "b", add_special_tokens=False).ids)}
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {r["doc_id"]: r["n"] - 1 for r in packed} == n and all(r["most"] == 1024 for r in packed)


def test_every_prefix_of_a_word_has_its_exact_count(library):
    c = bpe.prefix_counter(bpe.tokenizer_path("byte_bpe_50k.json"))
    for word in ("antidisestablishmentarianism", "unbelievably", "xxxxxxxxxxxx", "internationalisation"):
        assert c.prefix_counts(word) == [0, *(len(library.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1))]
        assert c.table(word).tolist() == c.prefix_counts(word)


def test_truncation_within_a_budget(spark, library):
    docs = spark.createDataFrame([(1, "one two three four five é"), (2, None), (3, "")], SCHEMA)
    for budget in range(9):
        got = {r["doc_id"]: r["text"] for r in token_counts.truncate_to_budget(docs, budget).collect()}
        text = "one two three four five é"
        assert text.startswith(got[1]) and len(library.encode(got[1], add_special_tokens=False).ids) <= budget
        assert got[1] == text or len(library.encode(text[: len(got[1]) + 1], add_special_tokens=False).ids) > budget
        assert got[2] == got[3] == ""


def test_count_tokens_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "é"), (3, "é")], SCHEMA).withColumn("n_tokens", F.lit("x"))
    assert sorted(map(tuple, token_counts.count_tokens(df, limit=1).collect()), key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True), (3, 2, 1, False), (3, 2, 1, False)], key=str)
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_unigram_equals_the_library_and_decodes_back():
    import sentencepiece

    path = bpe.tokenizer_path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        # the same pieces and scores, with the model's kind set to unigram
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read() + bytes([0x12, 2, 0x18, 1]))
    u = sentencepiece_codec.unigram(path)
    for t in texts(3000, seed=2):
        ids = np.frombuffer(u.encode(t), "<u4").tolist()
        assert ids == library.encode(t), t
        assert u.decode(ids) == t.replace("▁", " ")


def test_unigram_on_tables(spark):
    df = spark.createDataFrame([(1, "Hello wide world"), (2, None), (None, ""), (1, "\x00🎉")], SCHEMA).withColumn("ids", F.lit("x"))
    coded = sentencepiece_codec.encode(df)
    back = sorted(map(tuple, sentencepiece_codec.decode(coded).collect()), key=str)
    assert back == sorted([(1, "Hello wide world"), (2, ""), (None, ""), (1, "\x00🎉")], key=str)
    assert all(r["round_trip"] for r in sentencepiece_codec.summary(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())
    assert sentencepiece_codec.summary(df.limit(0)).count() == 0


def simple_best_fit(lengths, capacity):
    """Bins that best-fit decreasing opens, a piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(left) if r >= n]
        if fit:
            left[min(fit, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_one_piece_at_a_time(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 37, 64]))
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)) if seed % 2 else np.r_[np.full(50, capacity // 3), rng.integers(1, capacity + 1, 40)]
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_fit_plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity)
    filled, ranks = {}, {}
    for size, rank, n, first, offset in plan:
        ranks.setdefault(size, []).extend(range(rank, rank + n))
        for b in range(first, first + n):
            assert filled.get(b, 0) == offset
            filled[b] = offset + size
    assert {k: sorted(v) for k, v in ranks.items()} == {int(v): list(range(c)) for v, c in zip(values, counts, strict=True)}
    assert sorted(capacity - x for x in filled.values()) == simple_best_fit(lengths.tolist(), capacity)


@pytest.mark.parametrize("times", [1, 7, 30])
def test_repeated_short_lengths_fill_a_bin_before_the_next(times):
    lengths = [600] * 2 * times + [130] * 2 * times + [100] * 5 * times
    plan = packing.best_fit_plan({600: 2 * times, 130: 2 * times, 100: 5 * times}, 1024)
    filled, ranks = {}, {}
    for size, rank, n, first, offset in plan:
        ranks.setdefault(size, []).extend(range(rank, rank + n))
        for b in range(first, first + n):
            assert filled.get(b, 0) == offset
            filled[b] = offset + size
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c * times)) for k, c in ((600, 2), (130, 2), (100, 5))}
    assert sorted(1024 - x for x in filled.values()) == simple_best_fit(lengths, 1024)


def test_pack_is_whole_gapless_and_cut_from_the_front(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (None, "x"), (-2, "a b c"), (-2, "a b c")], SCHEMA)
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("length", F.lit("x"))
    got = packing.pack(both).toPandas()
    want = []
    for i, t in both.select("doc_id", "text").collect():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = [(None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 1024 and (s["offset"].to_numpy() == np.r_[0, np.cumsum(s["length"])[:-1]]).all()
    assert got["sequence_id"].nunique() == len(simple_best_fit(got["length"].tolist(), 1024))
    assert packing.pack(both.limit(0)).count() == 0
