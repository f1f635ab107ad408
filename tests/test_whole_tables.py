"""Queries see all of their tables: a source, an event type, turns and suppliers beyond what the given tables hold."""

import datetime as dt

import pytest

from larkspur import plans


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Small tables with 21 sources, a sixth event type, 1,500 turns in a conversation and 10,500 suppliers in a region."""
    sf = str(tmp_path_factory.mktemp("wide"))
    save = lambda rows, kind, name: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    save([(k, f"alpha beta gamma{k} words of passage number{k}") for k in range(40)], "item_id long, text string", "benchmark")
    save([(k, f"number{k % 22} passage gamma{k % 22} beta", f"src{k % 22}", "en") for k in range(66)], "doc_id long, text string, source string, lang string", "documents")
    save([(k, dt.datetime(2024, 1, 1 + k % 5), k % 3, f"type{k % 6}", float(k)) for k in range(60)], "event_id long, ts timestamp, user_id long, event_type string, value double", "events")
    save([(1, k, "user", f"turn {k}") for k in range(1500)], "conv_id long, turn long, role string, text string", "conversations")
    save([(k, f"Supplier{k:06d}", 0) for k in range(10_500)], "s_suppkey long, s_name string, s_nationkey int", "supplier")
    save([(0, "N", 1)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    return sf


def test_every_source_has_a_question(spark, wide):
    for name in ("k4_bm25", "k6_hybrid"):
        rows = plans.QUERIES[name](spark, wide).collect()
        assert len(rows) == 66
        assert name != "k4_bm25" or all(r["bm25"] > 0 for r in rows if r["query_id"] in ("src20", "src21"))


def test_every_event_type_is_a_column(spark, wide):
    assert plans.QUERIES["a24_scorecard"](spark, wide).columns == ["month", *(f"type{k}" for k in range(6))]


def test_every_turn_is_a_passage(spark, wide):
    import hashlib

    from larkspur.functions import text as t

    got = plans.QUERIES["d21_prompts"](spark, wide).first()["passages"]
    listed = "\n".join(f"[{k}] turn {k}" for k in range(1, 1500))
    assert got == hashlib.md5(f"{t.PROMPT[0].splitlines()[0]}\n\nQuestion: turn 0\n\nPassages:\n{listed}\n\nAnswer:".encode()).hexdigest()


def test_every_supplier_is_a_passage(spark, wide):
    found = {r["collection"]: r["passages"] for r in plans.QUERIES["s9_node_files"](spark, wide).collect()}
    assert found == {"public": 1, "clinical": 10_499}
