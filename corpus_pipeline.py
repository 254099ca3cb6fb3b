"""The corpus pipeline: language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import langid, mixing, packing, simhash
from tracewell.llm.common import materialize, scratch_scope, table
from tracewell.llm.registry import vocabulary_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest go."""
    return langid.keep_identified(docs, "lang", "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8 or more): that of smallest id."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources come near their targets."""
    return mixing.repeat(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces. Workers still hold memory of the stages before, so they remember fewer words here."""
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"), cache_bytes=1 << 26, slice_bytes=1 << 20)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: Evidence fusion, shingle sets, hashed draws and token ids are beyond SQL; the tests hold each stage of run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_scope():  # a stage's own tables go when its result is written
            docs = materialize(stage(spark, docs, sf_dir), name, stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
