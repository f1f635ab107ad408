"""Exact token counts of whole texts from a prefix table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import prefix_counter, tokenizer_path


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A map over the rows: no shuffle, memory bounded by the memo table and one Arrow batch.
    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated results; an
    empty table gives an empty result; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer_path(vocabulary))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncate_to_budget(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per input row: the id and the longest leading text of whole characters within the token budget.

    Answered from the prefix table: the counts of a prefix are those of the document's own pre-tokens up to its cut.
    Nulls and empty texts give the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer_path(vocabulary))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            kept = [x.encode()[: counter.cut_at_budget(x, budget)].decode() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=[id_col, "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, text string")
