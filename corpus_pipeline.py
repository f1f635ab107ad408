"""From documents to packed training sequences, in four stages, each one of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import minhash_dedup, packing, suffix_dedup, toxicity
from larkspur.llm.common import staged
from larkspur.llm.queries import table

#: Dropped ids are broadcast up to this many rows; beyond it the texts are shuffled instead.
BROADCAST_ROWS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the network learns from the labelled rows that are not held out."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; rows of one id stay or go together."""
    found = staged(minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("best_fit_packing", pack)]

#: A trained network, minhash groups and packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
