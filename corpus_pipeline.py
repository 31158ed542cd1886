"""A corpus pipeline in stages, each of which is written as Parquet and read again by the next one.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verigauge.llm import mixing, near_copies, tiles, token_files, toxicity
from verigauge.llm.queries import public_tokenizer, table
from verigauge.llm.store import kept
from verigauge.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; empty and null texts stay unless the model says otherwise."""
    ship_package(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    ship_package(spark)
    return near_copies.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    ship_package(spark)
    return tiles.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the mix: a document comes as often as it is drawn."""
    ship_package(spark)
    *_, shards, spot = mixing.added(docs)
    return mixing.shuffled(mixing.mix(docs), docs.columns, shards, spot)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, read back: a row per document drawn."""
    ship_package(spark)
    return token_files.read_ids(token_files.write_ids(docs, public_tokenizer()))


STAGES = [("toxicity", drop_toxic), ("near_copies", one_of_each), ("decontamination", drop_leaks),
          ("mixing", to_weights), ("token_ids", to_tokens)]

#: A fitted model, alignments, random draws and a tokenizer are beyond SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = kept(docs)
    return docs
