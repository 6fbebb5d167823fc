"""Vectors as arrays, in double precision whatever the arrays hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scaled(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def merged_centroid(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """The centroid of two groups of sizes na and nb, at length 1."""
    return scaled(F.zip_with(doubles(a), doubles(b), lambda x, y: x * na + y * nb))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, mean: the mean vector of each group, built from one partial sum for each place and group."""
    each = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
