"""A training-data pipeline over ``documents``: each stage takes what the one before it kept.

quality rules -> one document of each group of near copies -> no benchmark passages -> copies by source targets ->
bit-packed token files. Every stage's rows are written as Parquet in the shared folder and read again by the next one;
what a stage made on its way is deleted once its rows are written, and a stage's rows once the next one's are.

All stages: an empty table gives no rows; columns beyond doc_id, text and source are carried along whatever their
names; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm import decontaminate, mixing, quality_rules, simhash, token_files
from tidings.llm.common import dropped_since, made, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects (operator 8).

    Null and empty texts have no words and go; each row is judged by its text alone, repeated ones and rows without
    doc_id like any other."""
    return quality_rules.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 3 at 5-word shingles, Jaccard >= 0.8): the smallest doc_id.

    Repeated rows are copies, and so are null and empty texts of each other. Rows without doc_id are copies like others
    and stay only where no row of their group has one."""
    return simhash.one_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item (operator 1).

    A row's text decides, so repeated rows share their fate and rows without doc_id are judged too. Null and empty
    texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, 0 to 2 times (operator 5).

    A null source is a source of its own. Null and empty texts have no words and are taken 0 times. Repeated rows are
    documents of their own, with or without doc_id."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; what each document's ids are there (operator 4).

    Null and empty texts are the end id alone; rows without doc_id come first; repeated rows each stand there."""
    return token_files.token_rows(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("no_benchmark", no_benchmark), ("mix", mix), ("tokens", tokens)]

#: Copies depend on the tilted rates and ids on the tokenizer: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped_since(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
