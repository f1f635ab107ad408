"""Keyed tables: newest version wins, writers at the same time lose nothing, a failed write leaves the table as it was."""

import pytest
from pyspark.sql import functions as F

from larkspur.sources.keyed import KeyedTable, embed_cached

KIND = "key string, vec array<double>"


def rows(spark, **values):
    return spark.createDataFrame([(k, [float(v)]) for k, v in values.items()], KIND)


def held(table):
    return {r["key"]: r["vec"][0] for r in table.read().collect()}


def test_newest_wins_and_lookups_read_only_their_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), KIND, buckets=16)
    assert held(t) == {} and t.lookup(rows(spark, a=0)).count() == 0
    assert t.upsert(rows(spark, a=1, b=2, c=3)) == 1 and t.upsert(rows(spark, b=5, d=4)) == 2
    assert held(t) == {"a": 1, "b": 5, "c": 3, "d": 4}
    found = t.lookup(rows(spark, b=0, x=0))
    assert [tuple(r) for r in found.collect()] == [("b", [5.0])]
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "bucket")
    assert t.compact() == 3 and held(t) == {"a": 1, "b": 5, "c": 3, "d": 4} and len(t.versions()) == 1


def test_overlapping_upserts_both_stay_and_a_failed_one_leaves_nothing(spark, tmp_path, monkeypatch):
    t, other = (KeyedTable(spark, str(tmp_path / "t"), KIND) for _ in range(2))
    t.upsert(rows(spark, a=1))
    publish = t._publish

    def late(data, whole, after):
        assert other.upsert(rows(spark, a=2, b=2)) == 2  # another writer is first
        return publish(data, whole, after)

    monkeypatch.setattr(t, "_publish", late)
    assert t.upsert(rows(spark, b=3, c=3)) == 3
    assert held(other) == {"a": 2, "b": 3, "c": 3}

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(t, "_publish", dies)
    with pytest.raises(OSError):
        t.upsert(rows(spark, a=9, z=9))
    assert held(other) == {"a": 2, "b": 3, "c": 3}
    (tmp_path / "t" / "manifest" / "v000000000009").write_text('{"data": "da')  # its writer died while writing
    assert held(other) == {"a": 2, "b": 3, "c": 3}


def test_null_keys_are_an_error_and_repeated_ones_keep_one_row(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), KIND)
    t.upsert(spark.createDataFrame([("a", [1.0]), ("a", [2.0])], KIND))
    assert held(t) == {"a": 2.0}
    with pytest.raises(Exception, match="assert|ASSERT|null|USER_RAISED"):
        t.upsert(spark.createDataFrame([(None, [1.0])], KIND))


def test_each_missing_text_is_embedded_once(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), KIND)
    seen = []

    def embed(missing):
        seen.append(sorted(r["text"] for r in missing.collect()))
        return missing.select("key", F.array(F.length("text").cast("double")).alias("vec"))

    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None), (5, "")], "doc_id int, text string")
    out, new = embed_cached(df.limit(3), t, "m", embed)
    assert new.count() == 2 and {r["doc_id"]: (r["vec"][0], r["cached"]) for r in out.collect()} == {1: (2.0, False), 2: (2.0, False), 3: (1.0, False)}
    out, new = embed_cached(df, t, "m", embed)
    assert {r["doc_id"]: (r["vec"] and r["vec"][0], r["cached"]) for r in out.collect()} == {1: (2.0, True), 2: (2.0, True), 3: (1.0, True), 4: (None, False), 5: (0.0, False)}
    assert seen == [["aa", "b"], [""]]
    assert embed_cached(df, t, "other", embed)[1].count() == 3
