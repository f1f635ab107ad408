import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import minhash_dedup as m

SCHEMA = "doc_id long, text string"


def brute(rows, width=5, percent=80):
    """Components by comparing every pair of documents on sets of word tuples."""
    sets = {}
    for i, text in rows:
        words = tuple((text or "").encode().lower().split())
        n = min(width, len(words))
        sets[i] = {words[k : k + n] for k in range(len(words) - n + 1)} if words else set()
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    near = {(a, b) for g in by_shingle.values() for k, b in enumerate(g) for a in g[:k]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def result(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in m.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force_on_documents(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(docs, width=width) == brute(rows, width)


def test_large_group_of_near_copies_that_only_hang_together_through_others(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = f"x{rng.integers(1e9)}"
        rows.append((i, " ".join(words)))
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(7), width=4) == brute(rows, 4)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, None), (4, ""), (5, " \t\n"), (6, "one two"), (9, "one  TWO"), (7, "two one"), (8, "é É")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("same", F.lit(None))
    got = result(df, width=4)
    assert got == brute(rows, 4)
    assert got[3] == (3, 1, False) and got[2] == (0, 2, True) and got[9] == (1, 6, False)
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (2, "q r s t u")], SCHEMA)
    got = sorted(map(tuple, m.near_duplicates(odd, width=4).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert m.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5_000])), (3, " ".join(words[: len(words) // 2]))]
    assert result(spark.createDataFrame(rows, SCHEMA), width=5) == brute(rows, 5)


def test_recall_of_pairs_just_above_the_threshold(spark):
    """400 separate pairs with similarities from 0.80 to 0.84, found through the tables or not at all: recall is measured."""
    rng = np.random.default_rng(21)
    rows, pairs = [], []
    for k in range(400):
        words = [f"w{k}x{j}" for j in range(105)]
        other, n = list(words), int(rng.integers(8, 11))
        for j in range(n):  # each changed word at the end takes one shingle, those before it no more
            other[-1 - j] = f"v{k}x{j}"
        a, b = ({tuple(x[i : i + 4]) for i in range(len(x) - 3)} for x in (words, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    found = sum(got[b] == a for a, b in pairs)
    assert len(pairs) > 300 and found >= 0.99 * len(pairs), (found, len(pairs))
    assert all(got[b] != a or (a, b) in set(pairs) for a, b in ((2 * k, 2 * k + 1) for k in range(400)))
