"""Verdicts of judges and people applied as data: desk reviews, locations, audits, quotes, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.geo import cosines_km
from tidings.functions.text import folded


def reviewed(stories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Stories after a desk review (TR5): desk 'none' sends cold, a desk moves or rescues, an unsure verdict changes nothing.

    verdicts: story_id, desk, sure, at (the latest counts)."""
    v = verdicts.groupBy("story_id").agg(F.max_by(F.struct(F.col("desk").alias("new_desk"), "sure"), "at").alias("v"))
    j = stories.join(v, "story_id", "left")
    sure = F.coalesce(F.col("v.sure"), F.lit(False))
    cold = sure & (F.col("v.new_desk") == "none")
    return j.withColumns({"desk": F.when(sure & ~cold, F.col("v.new_desk")).otherwise(F.col("desk")), "routed": F.when(cold, False).when(sure, True).otherwise(F.col("routed"))}).drop("v")


def needs_work(stories: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """Stories not looked at, or doubled or ten items larger since (FLT13, TR6), largest first."""
    d = done.groupBy("story_id").agg(F.max("items").alias("then"))
    j = stories.join(d, "story_id", "left")
    return j.filter(F.col("then").isNull() | (F.col("items") >= 2 * F.col("then")) | (F.col("items") >= F.col("then") + 10)).orderBy(F.desc("items"), "story_id").limit(limit).drop("then")


def relocated(stories: DataFrame, verdicts: DataFrame, least: float = 0.6) -> DataFrame:
    """Stories with confident location verdicts in place, unless a person locked the location (TR6)."""
    v = verdicts.filter(F.col("confidence") >= least).groupBy("story_id").agg(F.max_by("place", "at").alias("judged"))
    j = stories.join(v, "story_id", "left")
    return j.withColumn("place", F.when(F.col("locked") | F.col("judged").isNull(), F.col("place")).otherwise(F.col("judged"))).drop("judged")


def clean_answer(aspect: Column, answer: Column, desks: list[str]) -> Column:
    """An audit answer in one spelling, null where it makes no sense for its aspect (TR7)."""
    a = F.lower(F.trim(answer))
    bare = F.regexp_replace(a, r"[^a-z0-9._ -]", "")
    number = F.regexp_extract(bare, r"^([0-5](?:\.\d+)?)", 1)
    return F.when(aspect == "desk", F.when(bare.isin([*desks, "none"]), bare)).when(aspect == "significance", F.nullif(number, F.lit(""))).otherwise(F.nullif(bare, F.lit("")))


def quote_stands(quote: Column, post: Column, names: Column, flight: str, impact: str) -> Column:
    """A quote counts (SF34) if it is in the post, names the place up to case endings, and is not only about a flight path."""
    plain = lambda c: F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "))
    q, src = plain(quote), plain(post)
    inside = (F.length(q) >= 10) & (F.contains(src, F.substring(q, 1, 50)) | F.contains(src, F.right(q, F.lit(35))))
    stems = F.transform(F.filter(F.flatten(F.transform(names, lambda n: F.split(plain(n), " "))), lambda w: F.length(w) >= 4), lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2)))
    return ~(quote.rlike(flight) & ~quote.rlike(impact)) & inside & F.exists(stems, lambda s: F.contains(q, s))


COORDS = r"(-?\d{1,2}\.\d{3,})[,;\s]+(-?\d{1,3}\.\d{3,})"


def exact_spot(text: Column, lat: Column, lon: Column, km: float = 30.0) -> Column:
    """The first coordinates in a text within km of a named place, as a struct; null if none are (SF33)."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(COORDS), F.lit(1)), F.regexp_extract_all(text, F.lit(COORDS), F.lit(2)), lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon")))
    good = F.filter(pairs, lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180) & (cosines_km(lat, lon, p["lat"], p["lon"]) <= km))
    return F.get(good, F.lit(0))


def event_day(said: Column, published: Column, days: int = 3) -> Column:
    """The day a report names if it lies in the ``days`` before its publication, else its publication day (SF35)."""
    day = F.to_date(F.try_to_timestamp(F.substring(said, 1, 10), F.lit("yyyy-MM-dd")))
    p = F.to_date(published)
    return F.when((day >= F.date_sub(p, days)) & (day < p), day).otherwise(p)


def learned_adjustment(liked: Column, disliked: Column) -> Column:
    """0.6 times the mean of what likeness to liked and unlikeness to disliked stories say (SF25)."""
    known = liked.isNotNull().cast("int") + disliked.isNotNull().cast("int")
    return F.coalesce(F.try_divide(0.6 * (F.coalesce(liked, F.lit(0.0)) - F.coalesce(disliked, F.lit(0.0))), known), F.lit(0.0))


def level_score(levels: Column) -> Column:
    """0 to 5 from a map of level to probability; levels that start at 1 are moved down (SF26)."""
    shift = F.when(F.array_min(F.map_keys(levels)) >= 1, 1).otherwise(0)
    total = F.aggregate(F.map_values(levels), F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.map_entries(levels), F.lit(0.0), lambda s, e: s + (e["key"] - shift) * e["value"])
    return F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.try_divide(mean, total)))
