import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string"


def brute(rows, size=50):
    """Digests by a dictionary of every window's smallest document."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - size + 1):
            w = raw[k : k + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - size + 1):
            if first[raw[k : k + size]] < i:
                gone[k : k + size] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(raw) else 0
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df, **more):
    return sorted(map(tuple, s.removal_report(df, **more).collect()))


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_shifted_overlapping_and_exactly_long_enough(spark, seed, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_SUFFIXES", 40)
    monkeypatch.setattr(s, "SLICE", 16)
    rng = np.random.default_rng(seed)
    letters = list("ab é中 ")
    word = lambda n: "".join(rng.choice(letters, n))
    pool = [word(n) for n in (20, 40, 49, 50, 51, 80, 200)] + ["a" * 120, "ab" * 70]
    rows = [(int(rng.integers(0, 60)) * 100 + i, word(int(rng.integers(0, 30))) + "".join(str(rng.choice(pool)) + word(int(rng.integers(0, 9))) for _ in range(int(rng.integers(0, 7))))) for i in range(90)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


@pytest.mark.parametrize("most", [1 << 17, 3])
def test_a_passage_that_most_documents_have_crosses_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(s, "BUCKET_SUFFIXES", 64)
    monkeypatch.setattr(s, "SLICE", 8)
    monkeypatch.setattr(s, "MOST_SPLITTERS", most)
    passage = " ".join(f"word{k * k}" for k in range(40))
    rows = [(i, f"start {i * 7919} {passage[: 120 + i % 90]} end {i}") for i in range(300)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(9)) == brute(rows)


def test_a_short_phrase_in_different_surroundings_removes_nothing(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_SUFFIXES", 64)
    phrase = "the very same forty bytes of every text, "
    rows = [(i, "".join(f"{i * 7919 + k} {phrase[:45]} {k * k + i} {phrase[3:]}" for k in range(4))) for i in range(150)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_equal_hashes_of_different_windows_are_told_apart():
    rng = np.random.default_rng(3)
    context = rng.integers(0, 3, (6, 80)).astype(np.uint8)
    context[:, 30:50] = 7
    context[1, 10:65] = context[0, 10:65]
    n, o = np.array([0, 1, 1, 2]), np.array([20, 20, 5, 20], np.uint8)
    assert s._confirmed(context, n, o, np.array([-1, 0, -1, -1]), 50)
    assert not s._confirmed(context, n, o, np.array([-1, 0, -1, 0]), 50)
    classes = s._classes(context, n, o, 50)
    assert classes[0] == classes[1] and len(set(classes.tolist())) == 3


def test_bucket_numbers_follow_all_keys():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    splitters = np.unique(rng.integers(0, 3, (9, 4)).astype(np.uint64), axis=0)
    want = [sum(tuple(x) <= row for x in splitters.tolist()) for row in zip(*(k.tolist() for k in keys), strict=True)]
    assert s._bucket_of(keys, splitters).tolist() == want


def test_helper_columns_leave_the_users_alone(spark):
    p = "the same passage of well over fifty bytes in several documents"
    df = spark.createDataFrame([(1, p, "a", "b", 3), (2, p, "c", None, 4)], "doc_id long, text string, `row` string, Spans string, doc int").withColumn("__row", F.lit("x")).withColumn("__spans", F.lit("y"))
    got = s.remove_repeats(df).orderBy("doc_id")
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [(1, p, "a", "b", 3, "x", "y"), (2, "", "c", None, 4, "x", "y")]


def test_nulls_repeats_and_clashing_names(spark):
    p = "the same passage of well over fifty bytes in several documents"
    rows = [(1, p), (1, p), (2, None), (3, ""), (4, p[:49]), (5, p + "x"), (5, "y" + p)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("a")).withColumn("spans", F.lit(None)).withColumn("part", F.lit(1))
    assert result(df) == brute(rows)
    assert s.removal_report(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, p), (1, p), (None, p)], SCHEMA)
    assert sorted(r["n_removed"] for r in s.removal_report(odd).collect()) == [0, 0, 0]
    cut = {r["doc_id"]: r["text"] for r in s.remove_repeats(df.where("doc_id <> 5")).collect()}
    assert cut == {1: p, 2: None, 3: "", 4: p[:49]}
    wide = "é" * 40
    got = {r["doc_id"]: r["text"] for r in s.remove_repeats(spark.createDataFrame([(1, "a" + wide), (2, "b" + wide + "c")], SCHEMA)).collect()}
    assert got == {1: "a" + wide, 2: "bc"}


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(s, "STRETCH", 4096)
    text = " ".join(f"w{k * 31 % 9973}" for k in range(8_000))
    rows = [(1, text), (2, text[5_000:9_000] + "tail"), (3, "x" + text)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
