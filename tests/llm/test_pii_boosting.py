"""Personal data: base spans against a plain scan, added spans where a neighbour hides data, trees, thresholds, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import pii_boosting as p

#: The patterns as the contract states them.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(s):
    digits = [int(x) for x in reversed(re.sub("[^0-9]", "", s))]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0


def plain(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            s, n = m.group(), len(re.sub("[^0-9]", "", m.group()))
            if [True, k == 1 and all(int(x) <= 255 for x in s.split(".")), 14 <= n <= 19 and luhn(s), 10 <= n <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def with_check_digit(digits):
    return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))


def numbers(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 14, 15, 15, 15, 18])))
    return with_check_digit(digits) if rng.random() < 0.7 else digits


def some_text(rng):
    """Pieces that touch, overlap and nearly match, between words of several scripts."""
    pieces = [
        lambda: f"a{rng.randint(0, 99)}.b@mail{rng.randint(0, 9)}.example.com", lambda: "x@y", lambda: "..@a-b.c_d@e.f.g", lambda: ".".join(str(rng.choice([0, 7, 255, 256, 1000, "007"])) for _ in range(rng.randint(3, 6))),
        lambda: numbers(rng), lambda: "-".join(numbers(rng)[i : i + 4] for i in range(0, 16, 4)), lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(0, 9999):04d}", lambda: "+1 ((", lambda: rng.choice(["é", "语", "😀", "Wort", " ", "\n", "--", "+", "@"]),
    ]
    return "".join(rng.choice(pieces)() + rng.choice([" ", "", ", ", " é "]) for _ in range(rng.randint(0, 14)))


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(3)
    texts = [some_text(rng) for _ in range(1500)] + ["", None, "1" * 30, "1-" * 40 + "1", "a@b.c" * 3, "+" * 20]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["base"]] for r in p.find(df).collect()}
    assert got == {k: plain(t or "") for k, t in enumerate(texts)}


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1200):
        card, phone = with_check_digit("4" + "".join(rng.choice("0123456789") for _ in range(14))), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"
        rows.append((k, f"Call {phone} or mail u{k}@mail.example.com, host 10.{k % 256}.0.{k % 200}, card {card} on file. Order {rng.randint(10**15, 10**16)} of 2024-05-{k % 28 + 1:02d}."))
    rows += [(5000, "Card 4111111111111111 7 items left."), (5001, "It is 1111222233334445 99 and 12 34."), (5002, "Meet at noon. Then we go at 5. Bye.")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("base", F.lit("clash")).withColumn("spans", F.lit(1))


def test_a_card_that_a_neighbouring_number_hides_is_added_and_plain_prose_is_not(notes):
    found = {r["doc_id"]: r for r in p.digest(p.find(notes)).where("doc_id >= 5000").collect()}
    assert found[5000]["n_card"] == 0 and found[5000]["spans"] == "card:5:21"
    assert found[5002]["spans"] == "" and found[5001]["n_added"] == 0


def test_added_spans_overlap_neither_base_spans_nor_each_other(notes):
    for r in p.find(notes).collect():
        added = [(x["start"], x["end"]) for x in r["added"]]
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))
        assert all(a[1] <= b["start"] or b["end"] <= a[0] for a in added for b in r["base"])


def test_trees_learn_a_rule_of_two_features_and_thresholds_follow_precision(spark):
    right = lambda k, a, b: k == 2 and a > 2 and b > 1
    rows = [([k, a, b, 0], 40 * right(k, a, b), 30 * (not right(k, a, b))) for k in range(4) for a in range(6) for b in range(4)]
    seen = spark.createDataFrame(rows, "f array<int>, yes long, no long")
    trees, start = p.boost(seen)
    out = seen.withColumn("p", p.probability(trees, F.col("f"), start)).collect()
    assert min(r["p"] for r in out if r["yes"]) > max(r["p"] for r in out if not r["yes"])
    least = p.thresholds(seen, trees, start)
    assert set(least) == {2}
    assert p.boost(seen.where("no > 0")) == ([], -9.0) and p.boost(seen.limit(0)) == ([], 0.0)


def test_very_long_runs_and_texts(spark):
    long = ["a" * 400_000, "1" * 300_000, "1 " * 150_000, "a." * 100_000 + "@" + "b." * 100_000 + "c", "1." * 150_000, "+1" + "(" * 300_000, "é" * 200_000 + " u@mail.example.com " + "x " * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["base"]] for r in p.find(df).collect()}
    assert got[6] == [(200_001, 0, 200_019)] and got[3] == [(0, 0, len(long[3]))] and got[0] == got[1] == got[5] == []
    assert got[4] == [(8 * k, 1, 8 * k + 7) for k in range(150_000 // 4)]


def test_nulls_repeats_and_empty_tables(spark):
    kind = "doc_id long, text string"
    assert p.digest(p.find(spark.createDataFrame([], kind))).count() == 0
    rows = [(None, "a@b.co"), (1, None), (1, "a@b.co"), (1, "a@b.co"), (2, "")]
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in p.digest(p.find(spark.createDataFrame(rows, kind))).collect())
    assert got == [("1", 0, ""), ("1", 1, "email:0:6"), ("1", 1, "email:0:6"), ("2", 0, ""), ("None", 1, "email:0:6")]


def test_redaction_marks_spans_and_merges_overlaps(spark):
    spans = "array(named_struct('start', 2, 'kind', 0, 'end', 5), named_struct('start', 4, 'kind', 3, 'end', 8), named_struct('start', 9, 'kind', 2, 'end', 10))"
    assert spark.range(1).select(p.redact(F.lit("äb012345678é"), F.expr(spans)).alias("t")).first()["t"] == "äb[EMAIL]6[CARD]8é"


def test_no_python_worker_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    for made in (p.candidates(df), p.digest(p.find(df))):
        assert "Python" not in (plan := made._jdf.queryExecution().toString()) and "Arrow" not in plan
