"""Write semantics as transformations of immutable tables: what a mutable store would hold after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows to append: first per key in the given total order, of keys the table lacks (SNK1)."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
    return first.join(table.select(*keys), keys, "left_anti")


def upsert_latest(table: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table after an upsert in which the row with the latest time wins, new rows winning ties (SNK2)."""
    both = table.withColumn("__n", F.lit(0)).unionByName(rows.withColumn("__n", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("__n"))
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__n")


def upsert_merge(log: DataFrame, keys: list[str], at: str, latest: list[str], known: list[str]) -> DataFrame:
    """A row for each key (SNK3): ``latest`` columns of the newest row, nulls too; ``known`` columns' newest non-null values."""
    aggs = [F.max_by(c, at).alias(c) for c in latest] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in known]
    return log.groupBy(*keys).agg(*aggs, F.max(at).alias(at))


def counters(log: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Counters that increments would have left behind (SNK4)."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that rows has (SNK5)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def retained(rows: DataFrame, at: str, as_of: Column, days: int, kept: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows younger than ``days`` (at least 15), and older ones whose key is in ``kept`` (SNK6)."""
    young = F.col(at) >= as_of - F.make_dt_interval(F.lit(max(15, days)))
    if kept is None:
        return rows.filter(young)
    k = kept.select(*keys).distinct().withColumn("__k", F.lit(True))
    return rows.join(k, keys, "left").filter(young | F.col("__k").isNotNull()).drop("__k")


def feature_collection(rows: DataFrame, lat: str, lon: str, *props: str) -> DataFrame:
    """feature: a GeoJSON feature of each row (SNK7)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def report_lines(rows: DataFrame, group: str, order: list[Column], *parts: Column) -> DataFrame:
    """group, report: an ordered plain-text report for each group (SNK8)."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    lines = rows.select(group, r.alias("r"), F.concat_ws(" ", *parts).alias("line"))
    return lines.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "\n").alias("report"))
