"""Constant-time placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; the share of a shard is even within about shards / TABLE_SIZE.
TABLE_SIZE = 65_537


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Shard number of every slot of a prime-sized table.

    Each shard visits the slots in an order of its own, offset + i * skip (mod size). The shards take turns; each
    claims the next free slot of its order. Dropping a shard moves few slots besides its own.
    """
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be given, differ and be no more than slots")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digest]
    slots, taken, at = np.full(size, -1, np.int32), 0, [0] * len(shards)
    while True:
        for k in range(len(shards)):
            slot = (offset[k] + at[k] * skip[k]) % size
            while slots[slot] >= 0:
                at[k] += 1
                slot = (offset[k] + at[k] * skip[k]) % size
            slots[slot] = k
            at[k] += 1
            taken += 1
            if taken == size:
                return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: its SHA-256's first 52 bits modulo the table size, as any other system can compute it."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """All rows of docs with slot int and shard string.

    The table has a fixed number of rows, whatever the data, and is broadcast: no row of docs is shuffled, and a hot
    source spreads because the key is the document's. A null key is placed like the empty string; equal keys get
    equal shards; columns of docs named slot or shard are replaced; an empty table gives an empty result.
    """
    table = pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "shard": np.array(shards, dtype=object)[lookup_table(shards, size)]})
    slots = docs.sparkSession.createDataFrame(table, "slot int, shard string")
    clean = docs.drop("slot", "shard")
    return clean.withColumn("slot", slot_of(F.col(key_col), size)).join(F.broadcast(slots), "slot").select(*clean.columns, "slot", "shard")
