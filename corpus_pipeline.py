"""A corpus in five stages: from documents to packed training sequences.

Each stage reads what its predecessor wrote, takes its decisions and returns
the documents that it keeps; the last one returns where each piece lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, mixing, near, packing, toxicity
from tessera.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts have the score of a text without features and stay;
    repeated rows are scored alike; texts of any length are read whole; an empty
    table stays empty; columns of any name pass through.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space.

    Null and blank texts are one group; of ties the smallest doc_id stays (null
    last), of rows that are alike one; columns of any name pass through.
    """
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest doc_id stays (null last).  Texts without words are linked with
    nothing and stay; columns of any name pass through.
    """
    return near.dedup(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for.

    Null is a source of its own; texts without words have no share in the mix and
    go; rows that are alike count one by one; columns of any name pass through.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens.

    A document that the mix repeats is packed as often; null texts are empty
    ones, of the closing token alone; longer texts than a sequence are cut.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Learning and tokenizing have no SQL: tests/llm/test_pipeline.py compares each stage of a run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each from the Parquet files of the one before, which then go."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        after = Scratch(spark)
        docs = after.cut(stage(spark, docs, sf_dir))
        if before is not None:
            before.release()
        before = after
    return docs
