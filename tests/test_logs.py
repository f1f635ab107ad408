"""Log rollups and attack cases on small literals."""

import pytest

from larkspur.operators import logs, metrics


def record(q, mode, contact, request=None, response=None, errors=None, stage=None):
    return (q, mode, {"total": 9.0, "embed": 1.0, "routing": 2.0} if stage is None else stage, contact, request or {}, response or {}, {k: 2 for k in contact or {}}, {k: 4 for k in contact or {}}, errors)


ROWS = [
    record("q1", "v2", {"a": 10.0, "b": 30.0}, {"a": 100.0, "b": 50.0}, {"a": 1e6}, {"b": "timeout"}), record("q2", "v2", {"a": 20.0}, {"a": 100.0}), record("q3", "v2", {}), record("q4", "smart", None, stage={}), record("q5", None, {"b": 1.0}),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, logs.RECORD)


def test_transport(log):
    got = {r["mode"]: r for r in logs.transport(log).collect()}
    assert len(got) == 3 and got["v2"]["questions"] == 3 and got["v2"]["contacts"] == 1 and got["v2"]["errors"] == 1
    assert got["v2"]["contact_ms"] == 20 and got["v2"]["contact_p95"] == pytest.approx(29) and got["v2"]["request_bytes"] == pytest.approx(250 / 3)
    assert got["smart"]["total_ms"] is None and got["smart"]["contact_ms"] is None and got[None]["contact_ms"] == 1


def test_the_slowest_contact_decides_the_latency(log):
    got = {r["query_id"]: r["latency"] for r in logs.modelled_latency(log).collect()}
    assert got["q1"] == pytest.approx(3 + 40 + 10 + 80) and got["q2"] == 3 + 40 + 20 and got["q3"] == 3 and got["q4"] == 0


def test_each_source_is_summed_up(log):
    got = {r["node"]: r.asDict() for r in logs.privacy_summary(log).collect()}
    assert got["a"] == {"node": "a", "contacts": 2, "ms": 15.0, "request_bytes": 200.0, "response_bytes": 1e6, "disclosed": 4, "probes": 8, "errors": 0}
    assert got["b"]["errors"] == 1 and got["b"]["contacts"] == 2


def test_attacks_join_their_cases(spark):
    cases = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "case_id int, vec array<double>")
    attacks = spark.createDataFrame([(1, 1, [1.0, 0.0], "x"), (2, 1, [0.0, 1.0], "y"), (3, 2, [0.0, 1.0], "x"), (4, 9, [1.0, 1.0], "z")], "attack_id int, case_id int, vec array<double>, attack_type string")
    evidence = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (2, "a", 0.9)], "case_id int, source_id string, score double")
    sent = spark.createDataFrame([(1, "a"), (1, "b"), (1, "attacker"), (2, "a")], "case_id int, source_id string")
    got = {r["evidence_top_k"]: r for r in metrics.attack_cases(cases, attacks, evidence, sent, "attacker").collect()}
    assert got[0]["attack_cases"] == 3 and got[0]["selected"] == got[0]["cited"] == pytest.approx(2 / 3, abs=1e-6) and got[0]["mean_rank"] == 2
    assert got[2]["cited"] == pytest.approx(1 / 3, abs=1e-6) and got[2]["attack_types"] == "x,y"


def test_trust_starts_anew_unless_the_key_stays(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1, "x", None), (1, 2, "reg", "k"), (1, 3, "x", None), (1, 4, "reg", "k"), (1, 5, "x", None), (1, 6, "reg", None), (1, 7, "reg", None), (1, 8, "x", None), (1, 9, "reg", "k"), (2, 1, "x", None)]
    df = spark.createDataFrame(rows, "user int, seq int, kind string, id string")
    got = metrics.lives(df, "user", ["seq"], F.col("kind") == "reg", F.col("id"), F.floor(F.col("seq") / 3))
    assert sorted((r["user"], r["seq"], r["life"]) for r in got.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (1, 6, 2), (1, 7, 3), (1, 8, 3), (1, 9, 4), (2, 1, 0)]
