"""Loaders of dimension tables (SRC30): tab-separated files with a header, plain or compressed, read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.text import place_key


def tsv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The named columns of a file, cast to their types; empty fields and what does not cast are null."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "\\").csv(path)
    return rows.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).try_cast(t).alias(c) for c, t in columns.items()])


def countries(spark: SparkSession, path: str, centres: str | None = None) -> DataFrame:
    """iso, fips, name, lat, lon: countries, placed at the middle of their land where ``centres`` knows it. Columns iso2, fips,
    name, lat, lon; of centres iso2, lat, lon. Countries without any place are left out."""
    c = tsv(spark, path, {"iso2": "string", "fips": "string", "name": "string", "lat": "double", "lon": "double"})
    if centres:
        m = tsv(spark, centres, {"iso2": "string", "lat": "double", "lon": "double"}).select("iso2", F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon"))
        c = c.join(m, "iso2", "left").withColumns({"lon": F.when(F.col("mid_lat").isNotNull(), F.col("mid_lon")).otherwise(F.col("lon")), "lat": F.coalesce("mid_lat", "lat")})
    return c.filter("lat is not null").select(F.col("iso2").alias("iso"), "fips", "name", "lat", "lon")


def cities(spark: SparkSession, path: str) -> DataFrame:
    """key, name, country, population, lat, lon, capital; columns geonameid, name, country, population, lat, lon, capital (1: yes)."""
    kinds = {"geonameid": "string", "name": "string", "country": "string", "population": "long", "lat": "double", "lon": "double", "capital": "string"}
    return tsv(spark, path, kinds).select(F.concat(F.lit("gn:"), "geonameid").alias("key"), "name", "country", F.coalesce("population", F.lit(0)).alias("population"), "lat", "lon", F.col("capital").eqNullSafe("1").alias("capital"))


def towns(spark: SparkSession, path: str) -> DataFrame:
    """spelling, key, country, province, population, lat, lon: a row for each distinct spelling of a place; names are separated by bars."""
    kinds = {"geonameid": "string", "name": "string", "names": "string", "country": "string", "admin1": "string", "population": "long", "lat": "double", "lon": "double"}
    every = F.concat(F.array("name"), F.split(F.coalesce("names", F.lit("")), r"\|"))
    t = tsv(spark, path, kinds).withColumn("one", F.explode(every)).withColumn("spelling", place_key(F.col("one"))).filter("spelling <> ''")
    t = t.select("spelling", F.col("geonameid").alias("key"), "country", F.col("admin1").alias("province"), F.coalesce("population", F.lit(0)).alias("population"), "lat", "lon")
    return t.distinct()


def desks(spark: SparkSession, path: str) -> list[tuple[str, int, list[str]]]:
    """(key, priority, keywords) of each desk, what desk_scores() takes: a configuration of a few rows. Columns key, priority, keywords (separated by bars)."""
    rows = tsv(spark, path, {"key": "string", "priority": "int", "keywords": "string"}).filter("key is not null").orderBy("key").collect()
    return [(r["key"], r["priority"] or 0, [k for k in (r["keywords"] or "").split("|") if k]) for r in rows]


def outlets(spark: SparkSession, path: str) -> DataFrame:
    """suffix, tier: domains and domain suffixes in lower case; the first tier in order where one stands twice. Columns domain, tier."""
    t = tsv(spark, path, {"domain": "string", "tier": "string"}).filter("domain is not null")
    return t.groupBy(F.regexp_replace(F.lower("domain"), r"^\.", "").alias("suffix")).agg(F.min("tier").alias("tier"))
