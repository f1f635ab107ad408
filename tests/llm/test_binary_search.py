import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import binary_search as b


def brute(rows, queries, k):
    out = []
    for q, code in queries:
        near = sorted({(bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows})[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_equals_brute_force_with_a_hot_code(spark):
    rng = random.Random(1)
    code = lambda: rng.getrandbits(64) - 2**63
    hot = code()
    rows = [(i, hot if i % 3 == 0 else hot ^ (1 << rng.randrange(63)) if i % 3 == 1 else code()) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, code long")
    queries = [r for r in rows if r[0] % 50 == 0]
    got = sorted(map(tuple, b.top_k(df, df.where("id % 50 = 0"), 10).collect()))
    assert got == brute(rows, queries, 10)


def test_scanning_instead_of_probing_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    code = lambda: rng.getrandbits(64) - 2**63
    rows = [(i, code()) for i in range(400)] + [(1000 + i, 5) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, code long").repartition(4)
    queries = [r for r in rows if r[0] % 50 == 0]
    want = brute(rows, queries, 5)
    assert sorted(map(tuple, b.top_k(df, df.where("id % 50 = 0"), 5).collect())) == want
    monkeypatch.setattr(b, "MOST_FLIPS", 0)
    monkeypatch.setattr(b, "SCANNED", 3)
    assert sorted(map(tuple, b.top_k(df, df.where("id % 50 = 0"), 5).collect())) == want


def test_codes_of_several_words(spark):
    rng = random.Random(3)
    rows = [(i, [rng.getrandbits(64) - 2**63 for _ in range(3)]) for i in range(200)]
    rows += [(1000 + i, [x ^ (1 << rng.randrange(63)) for x in rows[i][1]]) for i in range(0, 200, 2)]
    df = spark.createDataFrame(rows, "id long, code array<long>")
    far = lambda a, c: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, c, strict=True))
    want = sorted((q, n + 1, i, d) for q, a in rows if q % 50 == 0 for n, (d, i) in enumerate(sorted((far(a, c), i) for i, c in rows)[:4]))
    assert sorted(map(tuple, b.top_k(df, df.where("id % 50 = 0"), 4).collect())) == want
    with pytest.raises(ValueError):
        b.top_k(df, spark.createDataFrame([(1, [1])], "id long, code array<long>"), 1)


def test_fewer_rows_than_asked_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (None, 7), (3, 5), (3, 5), (4, -1)], "id long, code long").withColumn("rank", F.lit("x")).withColumn("bound", F.lit(1))
    got = sorted(map(tuple, b.top_k(df, df.where("id = 1"), 10).collect()))
    assert got == [(1, 1, 1, 0), (1, 2, 3, 0), (1, 3, 4, 62)]
    assert b.top_k(df.limit(0), df, 3).count() == 0 and b.top_k(df, df.limit(0), 3).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), (None,), ([],), ([1.0, None],), ([float("nan")],), ([1.0] * 64 + [1.0, -1.0],)], "v array<float>")
    assert [r[0] for r in df.select(b.sign_code(F.col("v"))).collect()] == [[0b101], None, None, None, None, [-1, 0b10]]
