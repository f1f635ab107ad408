"""De-identification: literals of the published rules' own tests, and a plain loop over the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from larkspur.functions import deidentify as d
from larkspur.plans import deid

# ---- Fixed values: texts of the published rules' own tests, and what must go from them or stay. ----

RECORD = "Patient Rahul Menon, MRN 4432189, DOB 12/03/1984, tel +44 7700 900123, email rahul.m@example.invalid. Chest pain."
GONE = [
    (RECORD, "Rahul Menon"), (RECORD, "4432189"), (RECORD, "12/03/1984"), (RECORD, "900123"), (RECORD, "rahul.m@example.invalid"),
    ("my email is a.b@example.invalid", "a.b@example.invalid"), ("MRN 4432189 on file", "4432189"), ("NHS 943 476 5919", "943 476 5919"), ("DOB 12/03/1984", "12/03/1984"),
    ("born 3 March 1984", "3 March 1984"), ("call 555-123-4567", "555-123-4567"), ("SSN 123-45-6789", "123-45-6789"), ("card 4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("Dr. Sarah O'Neil reviewed", "Sarah O'Neil"), ("My name is Test User 001, hi", "Test User 001"), ("NIC 199012345678 recorded", "199012345678"), ("old card 901234567V on file", "901234567V"),
    ("passport N1234567 seen", "N1234567"), ("Patient ID 55-8821-XK today", "XK"), ("DOB 1990/04/05", "1990/04/05"), ("admitted on 3rd March 2021", "March 2021"), ("seen March 3, 2021", "March 3"),
    ("a 93-year-old man", "93-year"), ("aged 94 at admission", "94"), ("lives at 42 Baker Street, Colombo 00300", "Baker Street"), ("her daughter Nimali called", "Nimali"),
]
LEFT = [
    "PCB-153 and GS-9620 were tested in MB-231 cells.", "Patient Health Questionnaire scores fell; blood pressure 140/90 mmHg; BMI 31.2.", "The trial enrolled 1203 participants between 2004 and 2009.",
    "A range of 186 000-1 415 000 cells.", "PCB-153 and MB-231 cells were exposed", "the son of the proband was unaffected", "a 2020-2021 cohort of 34 yo adults", "their mother tongue was Sinhala", "ages 60 to 85 were included",
    "Rahul Menon, a 45-year-old man, was admitted to Kandy General Hospital in March 2019.",
]
SH_GONE = [
    ("Policy No. AIA-55821934.", "55821934"), ("Account number 4410 2231 9988.", "4410 2231 9988"), ("Driving licence B1234567.", "B1234567"), ("The car, number plate WP CAB-4521, overturned.", "CAB-4521"),
    ("A pacemaker, serial PJN 4482019, was implanted.", "4482019"), ("Fax: 011 269 4321.", "269 4321"), ("She returned on 3 March.", "3 March"), ("Bloods were repeated on 12/03.", "12/03"), ("Biopsy 12/03/19 showed granulomas.", "12/03/19"),
    ("He was admitted to Kandy General Hospital.", "Kandy"), ("He is a resident of Kurunegala.", "Kurunegala"), ("Postcode SW1A 1AA.", "SW1A 1AA"), ("Rahul Menon, a 45-year-old man, was admitted.", "Menon"), ("Signed: A. Garcia, MD.", "Garcia"),
    ("Patient: Olumide Adeyemi.", "Adeyemi"), ("Written consent was obtained from Kavya Perera.", "Perera"), ("Medical record number: 21843143.", "21843143"), ("Filed under record #4482019.", "4482019"), ("Identity card 196999497577.", "196999497577"),
    ("A fisherman from Matara was brought in.", "Matara"), ("The patient, Nadia Petrov, consented to publication.", "Petrov"), ("Patient name: Petrov, Lucas.", "Lucas"), ("We thank Liam Walsh for his help.", "Walsh"),
]
SH_LEFT = [
    "Haemoglobin 10.2 g/dL (reference range 12.0-16.0 g/dL).", "Potassium decreased from 3.2 mEq/L to 2.8 mEq/L.", "Pain decreased from 7/10 to 3/10.", "The Patient presented with fever; Crohn disease was excluded.",
    "Kaplan Meier curves were drawn; Graves disease was treated.", "The policy changes reduced admissions; serial measurements were taken.", "A diagnosis of tetralogy of Fallot was made; the circle of Willis was normal.",
    "Bence Jones protein was detected in Graves disease.", "Cultures from Escherichia coli grew; Parkinson disease was excluded.", "A 63-year-old African American female was admitted.", "She is of Mexican descent, as shown in Figs.",
]
# ---- End of fixed values. ----

COMMON = "he was admitted to the patient presented with fever disease excluded a of we thank for his help policy bloods were repeated on written consent obtained from postcode cultures grew".split()


def redacted(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in d.deidentify(df, **more).orderBy("doc_id").collect()]


def words(spark, more=()):
    return spark.createDataFrame([(w,) for w in [*COMMON, *more]], "word string")


def test_basic_literals(spark):
    for (text, gone), got in zip(GONE, redacted(spark, [t for t, _ in GONE]), strict=True):
        assert gone not in got, (text, got)
    assert redacted(spark, LEFT) == LEFT


def test_safe_harbor_literals(spark):
    for (text, gone), got in zip(SH_GONE, redacted(spark, [t for t, _ in SH_GONE], level="safe_harbor", common=words(spark)), strict=True):
        assert gone not in got, (text, got)
    assert redacted(spark, SH_LEFT, level="safe_harbor", common=words(spark)) == SH_LEFT
    exact = ["He first noticed the lump in March 2019.", "Galle General Hospital. MRN 1234567."]
    assert redacted(spark, exact, level="safe_harbor", common=words(spark)) == ["He first noticed the lump in [DATE] 2019.", "[ORGANIZATION]. [ID]."]
    with pytest.raises(ValueError):
        redacted(spark, exact, level="other")


def test_registry_forms_and_institutions_own_patterns(spark):
    texts = ["Rahul Menon was admitted", "Menon, Rahul was admitted", "R. Menon agreed", "Menon Rahul, 34", "ref TEST-0042", "unmenonable"]
    got = redacted(spark, texts, registry=["Rahul Menon", " ", ""], id_patterns=[r"\bTEST-\d{4}\b"])
    assert not any("Menon" in t for t in got) and got[4] == "ref [ID]" and got[5] == "unmenonable"
    assert redacted(spark, texts[:1]) == texts[:1]


def test_recogniser_runs_before_or_after_the_rules(spark):
    mark = lambda df: df.withColumn("text", F.regexp_replace("text", "Baker", "[NAME]"))
    assert redacted(spark, ["42 Baker Street"], recogniser=mark) == ["42 [NAME] Street"]
    assert redacted(spark, ["42 Baker Street"], recogniser=mark, level="safe_harbor") == ["[ADDRESS]"]


def test_nulls_counts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, RECORD, "z"), (3, RECORD, "z")], "doc_id long, text string, proper_nouns_ string")
    got = d.deidentify(df, level="safe_harbor", common=words(spark), counted=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got[:2]] == [None, ""] and [r["proper_nouns_"] for r in got] == ["x", "y", "z", "z"]
    assert (got[2]["n_email"], got[2]["n_id"], got[2]["n_date"], got[2]["n_phone"], got[2]["n_name"], got[0]["n_name"]) == (1, 1, 1, 1, 1, 0)
    assert d.deidentify(df.limit(0)).count() == 0


def test_texts_with_the_cut_character_take_the_longer_way(spark):
    df = spark.createDataFrame([(1, "a\x01b Dr. Roe, card 4111 1111 1111 1111\x01 The Dr. The x@y.org"), (2, "Dr. Roe, card 4111 1111 1111 1111 Dr. The x@y.org"), (3, "plain \x01 text")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in d.apply_rules(df, d.basic_rules(), counted=True).collect()}
    assert got[1]["text"] == "a\x01b Dr. [NAME], card [CARD]\x01 The Dr. The [EMAIL]" and got[2]["text"] == "Dr. [NAME], card [CARD] Dr. The [EMAIL]" and got[3]["text"] == "plain \x01 text"
    assert [(got[k]["n_name"], got[k]["n_card"], got[k]["n_email"]) for k in (1, 2, 3)] == [(1, 1, 1), (1, 1, 1), (0, 0, 0)]
    assert [r["text"] for r in d.apply_rules(df, d.basic_rules()).orderBy("doc_id").collect()] == [got[k]["text"] for k in (1, 2, 3)]


def plain(text, rules):
    """The same rules by the re module, match after match."""
    tests = {
        d.luhn: lambda n: sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(re.sub(r"\D", "", n))))) % 10 == 0,
        d.first_word_is_a_name: lambda n: n.split()[0] not in d.NOT_NAMES,
        d.first_word_is_a_place: lambda n: n.split()[0] not in [*d.MONTHS, *d.NOT_NAMES],
        d.no_word_is_ordinary: lambda n: not any(len(w.strip(",.")) > 1 and w.strip(",.") in {*d.NOT_NAMES, *d.MONTHS, *d.NOT_NAME_WORDS} for w in n.split()),
    }
    for rule in rules:
        p = re.compile(rule.pattern)
        if rule.test is None:
            text = p.sub(rule.mark.replace("$", "\\"), text)
        else:
            text = p.sub(lambda m, r=rule: m[1] + r.mark + m[3] if tests[r.test](m[2]) else m[0], text)
    return text


@pytest.mark.parametrize("level", ["basic", "safe_harbor"])
def test_equals_a_plain_loop_over_documents(spark, level):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [t for t, _ in [*GONE, *SH_GONE]] + LEFT + SH_LEFT + ["4111 1111 1111 1111 4111-1111-1111-1112 Dr The Dr Who, Patient Health Dr. Roe", "josé@x.org ½ 12/03/19"]
    df = docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    rules = d.basic_rules(safe_harbor=level == "safe_harbor")
    got = {r["doc_id"]: r["text"] for r in d.apply_rules(df, rules).collect()}
    assert all(got[r["doc_id"]] == plain(r["text"], rules) for r in df.collect())


def test_rules_run_once_and_notes_are_dealt_over_tasks(spark):
    df = spark.createDataFrame([(1, RECORD), (2, "We thank Liam Walsh for his help.")], "doc_id long, text string").withColumn("kind", F.lit(None))
    out = d.deidentify(df, level="safe_harbor", common=words(spark))
    assert d.INSTITUTION not in out._jdf.queryExecution().optimizedPlan().toString()  # else the rest reads the rules' input, twice
    assert [(r["kind"], "Walsh" in r["text"]) for r in out.orderBy("doc_id").collect()] == [(None, False)] * 2
    dealt, whole = deid.case_notes(spark, "/root/testdata/sf0.001", 200), deid.case_notes(spark, "/root/testdata/sf0.001")
    sizes = dealt.groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(sizes) == 8 and max(sizes)[0] < 400 and sorted(dealt.collect()) == sorted(whole.collect())
