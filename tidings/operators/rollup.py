"""Roll-ups of reports into stories, and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.scoring import half_up, significance


def stories(items: DataFrame) -> DataFrame:
    """story_id with counts of items and outlets, first and last time (AG1), and significance (SF14)."""
    s = items.groupBy("story_id").agg(
        F.count("*").alias("items"), F.countDistinct("outlet").alias("outlets"), F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_seen"), F.avg("value").alias("importance"),
    )
    return s.withColumn("significance", significance(F.col("importance") / 100.0, F.col("outlets"), F.lit(1)))


def seen_between(stories_: DataFrame, start: Column, end: Column, least: float = 0.0) -> DataFrame:
    """Stories whose interval overlaps the window (FLT1)."""
    return stories_.filter((F.col("last_seen") >= start) & (F.col("first_seen") <= end) & (F.col("significance") >= least))


def in_desks(df: DataFrame, desks: list[str], column: str = "desk") -> DataFrame:
    """Desk filter; 'none' also takes rows without a desk (FLT2)."""
    named = F.col(column).isin([d for d in desks if d != "none"])
    return df.filter(named | F.col(column).isNull() if "none" in desks else named)


def breaking(items: DataFrame, as_of: DataFrame, last: str = "1 hour", prior: str = "24 hours", least_items: int = 6, least_outlets: int = 4, times: float = 3.0, quiet: str = "25 hours") -> DataFrame:
    """Stories that accelerate (AG6): reports in the last hour against the hourly mean of the day before.

    as_of has one row; it joins as a one-row broadcast, so the scan of items is aggregated in one pass."""
    now = F.col("as_of")
    i = items.join(F.broadcast(as_of), F.col("published_at") <= now)
    since = now - F.expr(f"interval {last}")
    fresh = F.col("published_at") > since
    before = ~fresh & (F.col("published_at") > since - F.expr(f"interval {prior}"))
    hours = F.lit(24.0)
    g = i.groupBy("story_id").agg(
        F.count_if(fresh).alias("last_hour"), F.count_if(before).alias("prior_day"),
        F.countDistinct(F.when(fresh | before, F.col("outlet"))).alias("outlets"), F.max("published_at").alias("last_seen"), F.first("as_of").alias("as_of"),
    )
    hot = (F.col("last_hour") >= least_items) & (F.col("outlets") >= least_outlets) & (F.col("last_hour") >= times * F.greatest(F.col("prior_day") / hours, F.lit(1.0)))
    silent = F.col("last_seen") < F.col("as_of") - F.expr(f"interval {quiet}")
    return g.select("story_id", "last_hour", "prior_day", "outlets", (hot & ~silent).alias("breaking"), F.when(silent, F.lit(0)).otherwise(F.col("last_hour")).cast("long").alias("velocity"))


def most_common(df: DataFrame, keys: list[str], value: str, skip=()) -> DataFrame:
    """keys, value, n: the most frequent value of each group that is not null and not to be skipped, ties to the smallest (AG8, AG26)."""
    n = df.filter(F.col(value).isNotNull() & ~F.col(value).isin(*skip)).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n")).over(Window.partitionBy(*keys))["n"]
    return n.withColumn("best", best).filter("n = best").groupBy(*keys, "n").agg(F.min(value).alias(value)).select(*keys, value, "n")


def histogram(df: DataFrame, at: str, group: str, buckets: int, flag: Column) -> DataFrame:
    """bucket, group, n, flagged: equal-width time buckets between the first and last row (AG11)."""
    s = F.unix_micros(at) / 1e6
    ends = df.agg(F.min(s).alias("lo"), (F.max(s) + 1e-6).alias("hi"))
    b = F.floor((s - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets).cast("long")
    return df.join(F.broadcast(ends)).groupBy(b.alias("bucket"), group).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))


def primary_place(weights: DataFrame, least: float = 0.15) -> DataFrame:
    """story_id, place, weight, confidence: the heaviest place above the least weight (WN1).

    weights: story_id, place, kind, weight (one row for each place). Countries lose ties, then the smaller id wins."""
    w = Window.partitionBy("story_id")
    ranked = weights.withColumn("total", F.sum("weight").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), F.col("kind") == "country", "place")))
    return ranked.filter((F.col("rank") == 1) & (F.col("weight") > least)).select("story_id", "place", "weight", half_up(F.col("weight") / F.col("total"), 3).alias("confidence"))


def about_place(weights: DataFrame, share: float = 0.3) -> DataFrame:
    """story_id, place: places that hold at least this share of a story's place evidence (FLT5, WN7)."""
    total = F.sum("weight").over(Window.partitionBy("story_id"))
    return weights.withColumn("share", F.try_divide(F.col("weight"), total)).filter(F.col("share") >= share).select("story_id", "place", half_up(F.col("share"), 6).alias("share"))


def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order (WN2, WN4, WN6, TK2)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def trailing_weeks(days: DataFrame, key: str = "key", unusual_pct: float = 25.0, least_days: int = 5) -> DataFrame:
    """Week to the last day, mean week of the 8 before, same week last year, change and flag (AG14).

    days: key, day, n. Sums are conditional on the distance from the key's last day, so each day is read once."""
    last = days.groupBy(key).agg(F.max("day").alias("last"))
    age = F.datediff("last", "day")
    d = days.join(last, key).withColumn("age", age)
    in_ = lambda a, z: (F.col("age") >= a) & (F.col("age") < z)
    g = d.groupBy(key).agg(
        F.sum(F.when(in_(0, 7), F.col("n"))).alias("week"), F.count_if(in_(0, 7)).alias("week_days"),
        (F.sum(F.when(in_(7, 63), F.col("n"))) / 8.0).alias("normal"), F.sum(F.when(in_(364, 371), F.col("n"))).alias("last_year"),
    )
    pct = F.when(F.col("normal") > 0, half_up(100.0 * (F.col("week") - F.col("normal")) / F.col("normal"), 0))
    return g.withColumn("change_pct", pct).withColumn("unusual", F.coalesce((F.abs("change_pct") >= unusual_pct) & (F.col("week_days") >= least_days), F.lit(False)))


def port_change(df: DataFrame) -> DataFrame:
    """change_pct of calls against normal (null below 1 normal call), unusual from 7 normal calls and 40 per cent (AG15)."""
    pct = F.when(F.col("calls_normal") >= 1, half_up(100.0 * (F.col("calls_week") - F.col("calls_normal")) / F.col("calls_normal"), 0))
    return df.withColumn("change_pct", pct).withColumn("unusual", F.coalesce((F.col("calls_normal") >= 7) & (F.abs("change_pct") >= 40), F.lit(False)))
