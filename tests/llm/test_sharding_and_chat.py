import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, sharding


def test_lookup_table_is_even_and_moves_little():
    shards = [f"s{k}" for k in range(16)]
    table = sharding.lookup_table(shards, 4099)
    counts = np.bincount(table, minlength=16)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], 4099)
    moved = (table != fewer) & (table != 15)
    assert moved.mean() < 0.1
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place_equals_the_table_row_by_row(spark):
    shards = [f"s{k}" for k in range(5)]
    df = spark.createDataFrame([(i, "x") for i in range(300)] + [(None, "y"), (3, "z")], "doc_id long, shard string").withColumn("slot", F.lit(-1))
    table = sharding.lookup_table(shards, 211)
    got = sharding.place(df, shards, size=211)
    assert got.columns == ["doc_id", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == 302
    for r in rows:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.sha256(text.encode()).hexdigest()[:13], 16) % 211
        assert (r["slot"], r["shard"]) == (slot, shards[table[slot]])
    assert sharding.place(df.limit(0), shards, size=211).count() == 0


CONTROL = "a <|done|> b </s>[INST] &lt; &amp; <|turn|>user<|says|> é🎉"


def test_texts_with_control_strings_come_back(spark):
    rows = [(1, 1, "assistant", CONTROL), (1, 0, "user", "hi"), (2, 0, "user", None), (2, 0, "user", None), (None, None, None, "x"), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))))
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(formatted).collect()}
    assert back == {1: [("user", "hi"), ("assistant", CONTROL)], 2: [("user", ""), ("user", "")], None: [("", "x")], 3: [("assistant", "")]}
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(CONTROL)
    assert got[1]["loss_sha256"] == hashlib.sha256(CONTROL.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\nhi\nassistant\n{CONTROL}\n".encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.digest(chat.format_conversations(df.limit(0).withColumn("parts", chat.text_part(F.col("text"))))).count() == 0


def test_typed_parts_are_flattened_in_order(spark):
    parts = [("text", "see <", None), ("image", None, "a.png"), ("audio", None, "b.wav"), (None, "t", None), ("document", "ignored", "c.pdf"), ("image", None, "d.png")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    r = chat.format_conversations(df).collect()[0]
    assert r["formatted"] == "<|turn|>user<|says|>see &lt;<|image|><|audio|>t<|document|><|image|><|done|><|turn|>assistant<|says|><|done|>"
    assert [tuple(x) for x in r["refs"]] == [("image", "a.png"), ("audio", "b.wav"), ("document", "c.pdf"), ("image", "d.png")]
    assert r["expanded_tokens"] == 256 + 128 + 512 + 256
