"""Places: gazetteer lookup, evidence weights, geocoding with refusal, locations of events by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.geo import cosines_km
from tidings.functions.text import folded


def gazetteer(cities: DataFrame, countries: DataFrame, aliases: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """spelling, key, kind, country (SF17): every name a place goes by; where spellings clash, countries win, then larger
    cities, then aliases. cities: key, name, country, population; countries: iso, name; aliases: spelling, key, kind, country."""
    c = countries.select(folded(F.col("name")).alias("spelling"), F.concat(F.lit("cc:"), "iso").alias("key"), F.lit("country").alias("kind"), F.col("iso").alias("country"), F.lit(0).alias("rank"), F.lit(0).alias("population"))
    t = cities.select(folded(F.col("name")).alias("spelling"), "key", F.lit("city").alias("kind"), "country", F.lit(1).alias("rank"), "population")
    saints = t.filter(F.startswith("spelling", F.lit("saint "))).withColumn("spelling", F.regexp_replace("spelling", "^saint ", "st. "))
    a = aliases.select(folded(F.col("spelling")).alias("spelling"), "key", "kind", "country", F.lit(2).alias("rank"), F.lit(0).alias("population"))
    every = c.unionByName(t).unionByName(saints).unionByName(a).filter(~F.col("spelling").isin(skip or []))
    r = F.row_number().over(Window.partitionBy("spelling").orderBy("rank", F.desc("population"), "key"))
    return every.withColumn("r", r).filter("r = 1").select("spelling", "key", "kind", "country")


def found_places(texts: DataFrame, names: DataFrame, limit: int = 4, longest: int = 3) -> DataFrame:
    """id, key, kind, country (SF16, JN13): places named in a text: word runs of up to ``longest`` words meet the spellings
    in an equi-join; a country goes when one of its cities is there; cities first, then by place in the text."""
    w = F.filter(F.split(folded(F.col("text")), r"[^\p{L}\p{N}_.']+"), lambda x: x != "")
    t = texts.select("id", w.alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i + 1, n), " ").alias("s")))))
    each = t.filter(F.size("w") > 0).select("id", F.explode(runs).alias("r")).select("id", "r.i", F.regexp_replace("r.s", r"[.']+$", "").alias("spelling"))
    hit = each.join(names, "spelling").groupBy("id", "key", "kind", "country").agg(F.min("i").alias("i"))
    has_city = F.max((F.col("kind") != "country").cast("int")).over(Window.partitionBy("id", "country"))
    hit = hit.withColumn("c", has_city).filter(~((F.col("kind") == "country") & (F.col("c") == 1)))
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.col("kind") == "country", "i", "key"))
    return hit.withColumn("r", r).filter(F.col("r") <= limit).select("id", "key", "kind", "country", F.col("r").alias("rank"))


def evidence(tagged: Column, rank: Column, in_title: Column, supported: Column, contradicts: Column, distrusted: Column, at_home: Column) -> Column:
    """The weight of a place for an item (SF15): in the title 3; found in the text 1; tagged less the later it comes, a tenth
    if it contradicts the title unsupported, a fifth of it if distrusted and unsupported; 0.3 more at home."""
    later = F.greatest(F.lit(0.25), 1.0 - 0.2 * rank)
    by_tag = F.when(~supported & contradicts, 0.1).when(~supported & distrusted, later * 0.2).otherwise(later)
    return F.round(F.when(in_title, 3.0).when(~tagged, 1.0).otherwise(by_tag) + F.when(at_home, 0.3).otherwise(0.0), 3)


def geocoded(asks: DataFrame, places: DataFrame, large: int = 20_000, times: float = 10.0, apart_km: float = 25.0) -> DataFrame:
    """ask, key (GEO8): the place a name means, or nothing where that is unclear.

    asks: ask, spelling, country, province (null: any); places: key, spelling, country, province, lat, lon, population.
    Provinces agree by their first five letters. Of several places the largest wins if it is large and ``times`` the next
    one's size; else any wins if all lie within apart_km of the largest; else the ask is refused."""
    p = places.select(F.col("spelling").alias("sp"), F.col("country").alias("co"), F.col("province").alias("pr"), "key", "lat", "lon", "population")
    j = asks.join(p, F.col("spelling") == F.col("sp")).filter(F.col("country").isNull() | (F.col("country") == F.col("co")))
    j = j.filter(F.col("province").isNull() | (F.substring(folded(F.col("province")), 1, 5) == F.substring(folded(F.col("pr")), 1, 5)))
    w = Window.partitionBy("ask").orderBy(F.desc("population"), "key")
    j = j.withColumns({"n": F.row_number().over(w), "next": F.lead("population").over(w), "la": F.first("lat").over(w), "lo": F.first("lon").over(w)})
    far = F.max(cosines_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))).over(Window.partitionBy("ask"))
    j = j.withColumn("far", far).filter("n = 1")
    clear = F.col("next").isNull() | ((F.col("population") >= large) & (F.col("population") >= times * F.col("next"))) | (F.col("far") <= apart_km)
    return j.select("ask", F.when(clear, F.col("key")).alias("key"))


def by_priority(key: str, *ranked: DataFrame) -> DataFrame:
    """key, lat, lon, how: the first table, in the given order, that knows a key's location (GEO10, GEO11)."""
    every = None
    for n, t in enumerate(ranked):
        t = t.select(key, "lat", "lon", "how", F.lit(n).alias("n"))
        every = t if every is None else every.unionByName(t)
    return every.filter("lat is not null and lon is not null").groupBy(key).agg(F.min(F.struct("n", "how", "lat", "lon")).alias("b")).select(key, "b.lat", "b.lon", "b.how")


def region_of(lat: Column, lon: Column, country: Column, regions: dict[str, tuple[tuple[float, float, float, float], list[str]]]) -> Column:
    """The first region whose box (south, west, north, east) and countries fit (GEO7)."""
    out = F.lit(None).cast("string")
    for name, (box, countries) in reversed(list(regions.items())):
        out = F.when(lat.between(box[0], box[2]) & lon.between(box[1], box[3]) & country.isin(countries), name).otherwise(out)
    return out
