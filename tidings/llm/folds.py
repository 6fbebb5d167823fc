"""Folds by crc32 of the document id as text, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import written


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; null ids hash as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled documents outside the held-out fold, as a written table.

    Only labels whose document is at hand count: ids meet first (without texts), then a hash of the id picks. An id is
    one example however often it is labelled or stands in the documents: its label is the majority of its labels (1 if
    even), its text the last in order. Rows with a null id or label are no examples."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(~held_out)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    matched = written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    # thinned by the hash that also ranks, so that the ranking sees about twice the rows that it keeps
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = matched.filter(rank < 2.0 * (rows + 1000) / max(1, matched.count()))
    picked = written(few.orderBy(rank, "doc_id").limit(rows).select(F.col("doc_id").alias("id"), "y"), "picked")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, F.col("doc_id") == F.col("id"))
    return written(sample.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "text", "y"), "sample")
