"""Registries as tables: equal to one regular expression over all forms, of any size, and inside de-identification."""

import random
import re

from larkspur.functions import deidentify as d
from larkspur.functions import registry as g

NAMES = ["Rahul Menon", " ", "", None, "Anna Maria de Souza", "REC-12#", "(X)y", "O'Neil", "Jean-Luc Picard", "Łukasz Żak", "4432 A", "Rahul", "...", "A B C D E", "rahul menon"]
TEXTS = [
    "Rahul Menon was admitted", "R. Menon agreed", "Menon Rahul, 34", "r menon and RAHUL", "unmenonable", "de Souza? Souza, Anna Maria de; A. Souza. A Souza x", "REC-12#a REC-12# (x)y a(X)y", "o'neil's O'Neil", "picard, JEAN-LUC!",
    "łukasz żak Ł. Żak", "4432 a 4432  a", "", None, "Rahul  Menon Rahul Menon Rahul", "a b c d e, E, A B C D e", "😀Rahul😀 Menon_Rahul", "Rahul Menon, Rahul Menon, Rahul",
]


def by_expression(names, text):
    pattern = re.compile(d.registry_pattern([n for n in names if n]).removeprefix("(?i)"), re.I)
    return (None, 0) if text is None else pattern.subn("[NAME_OR_ID]", text)


def marked(spark, texts, names, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(n,) for n in names], "name string")
    return [(r["text"], r["n"]) for r in g.mark_registry(df, table, count_col="n", **more).orderBy("doc_id").collect()]


def test_equals_one_regular_expression(spark):
    assert marked(spark, TEXTS, NAMES) == [by_expression(NAMES, t) for t in TEXTS]


def test_equals_it_on_random_texts_of_touching_and_overlapping_names(spark):
    rng = random.Random(2)
    words = ["Ann", "ann", "Lee", "LEE", "de", "Roe", "x", "7", "Ann-Lee", "Öz"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(25)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", ". ", "-", "", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert marked(spark, texts, names) == [by_expression(names, t) for t in texts]


def test_a_hundred_thousand_names_by_broadcast_and_by_shuffle(spark, monkeypatch):
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    names = [f"Given{letters(k % 97)} Family{letters(k)}" for k in range(100_000)]
    texts = [f"The visit of {names[k * 37]} and FAMILY{letters(k * 41).upper()}, given{letters(k * 41 % 97)} with G. Family{letters(k)}." for k in range(300)] + ["Nobody known here."]
    want = [("The visit of [NAME_OR_ID] and [NAME_OR_ID] with [NAME_OR_ID].", 3)] * 300 + [("Nobody known here.", 0)]
    assert marked(spark, texts, names) == want
    monkeypatch.setattr(g, "BROADCAST_FORMS", 10)
    assert marked(spark, texts[:5], names) == want[:5]


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Rahul", 5), (None, "Rahul", 6)], "doc_id long, text string, registry_spans_ int")
    none = spark.createDataFrame([], "name string")
    assert sorted(r["text"] for r in g.mark_registry(df, none).collect()) == ["Rahul", "Rahul"]
    got = g.mark_registry(df, spark.createDataFrame([("Rahul",)], "name string"))
    assert got.columns == df.columns and sorted(map(str, (r["text"] for r in got.collect()))) == ["Rahul", "[NAME_OR_ID]"]
    assert g.mark_registry(df.limit(0), none).count() == 0


def test_de_identification_takes_a_table(spark):
    texts = ["Dr. Menon saw Menon, Rahul at a.b@c.org", "no one", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([("Rahul Menon",)], "name string")
    by_list, by_table = (d.deidentify(df, registry=x, counted=True).orderBy("doc_id").collect() for x in (["Rahul Menon"], table))
    assert by_table == by_list and by_list[0]["n_registry"] == 1
