"""Histories read backwards or in order: how long a mark has stood, which snapshot counts, who was let in."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.geo import haversine_km
from tidings.operators.graph import saved
from tidings.operators.joins import as_of
from tidings.operators.tracks import _km


def walked_back(days: list, marks: dict, day, lat: float, lon: float, near_km: float, gap_days: int) -> tuple:
    """(since, at_least, days with a mark on the way): from a spot back over the days (newest first) that have a map, following the mark
    nearest to the last one found while it lies within near_km. The walk ends where no mark is found for more than gap_days."""

    def nearest(d, spot):
        far, best = min(((_km(*spot, *m), m) for m in marks.get(d, ())), default=(None, None))
        return best if far is not None and far <= near_km else None

    spot, since, before, passed = (lat, lon), None, None, set()
    for d in days:
        found = nearest(d, spot)
        if found is None and since is not None:
            if (before - d).days > gap_days:  # no maps for a while: the mark may be older if it stood when they begin again
                return since, before == since, passed
            if (since - d).days > gap_days:
                return since, False, passed
        if found is not None:
            spot, since = found, d
            passed.add(d)
        before = d
    return since, since is not None and since == days[-1], passed  # it stood on the oldest map there is


def persistence(asks: DataFrame, maps: DataFrame, marks: DataFrame, near_km: float = 10.0, gap_days: int = 4, reach_km: float = 150.0) -> DataFrame:
    """ask, since, run_days, at_least, maps_last_year, marked_last_year (WN9): how long a mark has been near a spot, as it moves.

    asks: ask, track, day, lat, lon; maps: track, day (days that have a map); marks: track, day, lat, lon. An ask meets its track's days
    and the marks within reach_km up to its day; marked_last_year counts maps of 365 days with a mark near the spot itself or on the walk.
    Asks of one spot and day share their answer, and a task holds the marks of one of them."""
    kinds = "one long, since date, run_days int, at_least boolean, maps_last_year int, marked_last_year int"
    spot = ["track", "day", "lat", "lon"]
    spots = saved(asks.groupBy(*spot).agg(F.min("ask").alias("one")))
    days = spots.join(maps.distinct().withColumnRenamed("day", "d"), "track").filter("d <= day").groupBy("one").agg(F.array_sort(F.collect_list("d")).alias("days"))
    m = marks.select("track", F.col("day").alias("d"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    near = spots.join(m, "track").filter((F.col("d") <= F.col("day")) & (haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) <= reach_km))
    near = near.groupBy("one").agg(F.collect_list(F.struct("d", "y", "x")).alias("marks"))

    def run(batches):
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                one, day, lat, lon, own, some = (c[0] for c in b.slice(k, 1).to_pydict().values())
                own = (own or [])[::-1]
                at = defaultdict(list)
                for s in some or ():
                    at[s["d"]].append((s["y"], s["x"]))
                since, at_least, passed = walked_back(own, at, day, lat, lon, near_km, gap_days) if own else (None, False, set())
                year = [d for d in own if (day - d).days < 365]
                here = sum(d in passed or any(_km(lat, lon, *p) <= near_km for p in at.get(d, ())) for d in year)
                rows.append((one, since, (day - since).days + 1 if since else 0, at_least, len(year), here))
            types = [pa.int64(), pa.date32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=[k.split()[0] for k in kinds.split(", ")])

    both = spots.select("one", "day", "lat", "lon").join(days, "one", "left").join(near, "one", "left")
    told = both.select("one", "day", "lat", "lon", "days", "marks").mapInArrow(run, kinds)
    of = spots.select("one", *[F.col(c).alias(f"own_{c}") for c in spot]).join(told, "one")
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in spot]
    return asks.join(of, same).select("ask", *[k.split()[0] for k in kinds.split(", ")[1:]])


def snapshot_and_previous(probes: DataFrame, snapshots: DataFrame, key: str, at: str, snap_at: str, snap: str, days: int, slack: Column | None = None) -> DataFrame:
    """probes with snap and snap_at, previous and previous_at (JN9): the latest snapshot at or before a probe's time, or else the key's
    first one; and the latest one at least ``days`` less ``slack`` (6 hours) before that, null if there is none or it is the same.

    snap is unique within a key."""
    slack = F.expr("interval 6 hours") if slack is None else slack
    found = as_of(probes, snapshots, [key], at, snap_at, [snap])
    first = snapshots.groupBy(key).agg(F.min(F.struct(snap_at, snap)).alias("first"))
    found = found.join(first, key, "left").withColumns({snap: F.coalesce(snap, f"first.{snap}"), snap_at: F.coalesce(snap_at, f"first.{snap_at}")}).drop("first")
    then = found.withColumn("then", F.col(snap_at) - F.make_dt_interval(F.lit(days)) + slack)
    back = as_of(then, snapshots.select(key, F.col(snap).alias("previous"), F.col(snap_at).alias("previous_at")), [key], "then", "previous_at", ["previous"])
    same = F.col("previous").eqNullSafe(F.col(snap))
    return back.withColumns({"previous_at": F.when(~same, F.col("previous_at")), "previous": F.when(~same, F.col("previous"))}).drop("then")


def admitted(log: DataFrame, standing: DataFrame, most_surge: int = 5, most: int = 20) -> DataFrame:
    """newsroom, at, story, outcome (TR10): what each request for a surge agent comes to, in the order of the log.

    log: newsroom, at (a total order within it), story, kind ('request' or 'retire'); standing: newsroom, n (its other agents). A story
    that has an agent is 'already' served; with most_surge surge agents active it is 'refused_surge', with ``most`` agents in all
    'refused_total'; else 'hired'. Each outcome rests on all before it, so a newsroom's log is one task, which holds the stories that
    have an agent, at most most_surge of them."""

    def run(log_, others):
        active, out = set(), []
        n = int(others["n"].iloc[0]) if len(others) else 0
        f = log_.sort_values("at")
        for newsroom, at, story, kind in zip(f["newsroom"], f["at"], f["story"], f["kind"]):
            if kind == "retire":
                active.discard(story)
                continue
            if story in active:
                outcome = "already"
            elif len(active) >= most_surge:
                outcome = "refused_surge"
            elif n + len(active) >= most:
                outcome = "refused_total"
            else:
                outcome = "hired"
                active.add(story)
            out.append((newsroom, at, story, outcome))
        return pd.DataFrame(out, columns=["newsroom", "at", "story", "outcome"])

    return log.select("newsroom", "at", "story", "kind").groupBy("newsroom").cogroup(standing.groupBy("newsroom")).applyInPandas(run, "newsroom long, at long, story long, outcome string")
