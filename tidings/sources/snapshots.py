"""Choice of snapshots from a history of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_snapshots(history: DataFrame, key: str, hours_ahead: int = 3) -> DataFrame:
    """The last update of each local day (SRC20). history: key, at."""
    day = F.to_date(F.col("at") + F.make_dt_interval(F.lit(0), F.lit(hours_ahead)))
    h = history.withColumn("day", day)
    w = Window.partitionBy("day").orderBy(F.desc("at"), F.desc(key))
    return h.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def thinned(revisions: DataFrame, key: str, daily_days: int, weekly_days: int) -> DataFrame:
    """The last revision of each day up to daily_days back, then of each ISO week up to weekly_days back (SRC22).

    revisions: key, at, now. Older ones go."""
    age = (F.unix_seconds("now") - F.unix_seconds("at")) / 86400
    year = F.extract(F.lit("YEAROFWEEK"), F.col("at"))
    slot = F.when(age <= daily_days, F.date_format("at", "yyyy-MM-dd")).when(age <= weekly_days, F.concat_ws("-", year, F.lpad(F.weekofyear("at").cast("string"), 2, "0")))
    r = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("at"), F.desc(key)))
    return revisions.withColumn("slot", slot).filter("slot is not null").withColumn("r", r).filter("r = 1").drop("r")
