"""Histories, bound to the given tables: moving marks, snapshots with what came before them, admission under quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import histories
from tidings.plans.registry import query
from tidings.tables import Tables

#: A mark moves 0.05 degrees a day; maps are missing on many days, marks on more.
FRONT = """f as (select event_id, user_id % 5 as track, cast(ts as date) as day, (user_id % 5) + 0.05e0 * (cast(ts as date) - date '2024-01-01') + 0.02e0 * (event_id % 3) as lat, 30e0 + 0.03e0 * (user_id % 4) as lon, (day(ts) + user_id % 5) % 7 as k, value from events where event_type = 'purchase')"""
FAR = "6371e0 * 2 * asin(least(1e0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


@query("wn9b_moving_mark", f"""with recursive {FRONT}, maps as (select distinct track, day from f where k <> 3), marks as (select distinct track, day, lat, lon from f where k in (0, 1, 4, 6) and value > 70), asks as (select event_id as ask, track, day, lat, lon from f where k in (0, 1, 4, 6) and value > 95),
 d as (select ask, any_value(a.track) as track, any_value(a.day) as day, any_value(lat) as lat, any_value(lon) as lon, list(m.day order by m.day desc) as ds from asks a join maps m on m.track = a.track and m.day <= a.day group by ask),
 w as (select ask, 0 as i, lat, lon, null::date as since, null::date as before, false as at_least, false as done, []::date[] as passed from d union all
  select ask, i + 1, case when go and hit is not null then hit.y else lat end, case when go and hit is not null then hit.x else lon end, case when go and hit is not null then now else since end, now,
   case when not go then (case when date_diff('day', now, before) > 4 then before = since else false end) when last then (hit is not null) else false end, (not go) or last, case when go and hit is not null then list_append(passed, now) else passed end
  from (select w.*, d.ds[w.i + 1] as now, w.i + 1 = len(d.ds) as last, h.hit, not (h.hit is null and w.since is not null and (date_diff('day', d.ds[w.i + 1], w.before) > 4 or date_diff('day', d.ds[w.i + 1], w.since) > 4)) as go
   from w join d using (ask), lateral (select min({{'far': {FAR.format('w.lat', 'w.lon', 'm.lat', 'm.lon')}, 'y': m.lat, 'x': m.lon}}) as hit from marks m where m.track = d.track and m.day = d.ds[w.i + 1]
    and {FAR.format('w.lat', 'w.lon', 'm.lat', 'm.lon')} <= 10 and {FAR.format('d.lat', 'd.lon', 'm.lat', 'm.lon')} <= 150) h where not w.done) s),
 e as (select * from w where done), y as (select ask, unnest(ds) as md from d),
 c as (select y.ask, count(*) as maps_, count(*) filter (where list_contains(e.passed, md) or exists (select 1 from marks m where m.track = d.track and m.day = md and {FAR.format('d.lat', 'd.lon', 'm.lat', 'm.lon')} <= 10)) as marked_ from y join d using (ask) join e using (ask) where date_diff('day', md, d.day) < 365 group by y.ask)
 select ask, strftime(since, '%Y-%m-%d') as since, case when since is null then 0 else date_diff('day', since, d.day) + 1 end::int as run_days, at_least, maps_::int as maps_last_year, marked_::int as marked_last_year from e join d using (ask) join c using (ask)""")
def wn9b(spark, d):
    e = Tables(spark, d).events.filter("event_type = 'purchase'")
    day = F.to_date("ts")
    track = F.col("user_id") % 5
    lat = track + 0.05 * F.datediff(day, F.lit("2024-01-01").cast("date")) + 0.02 * (F.col("event_id") % 3)
    f = e.select("event_id", track.alias("track"), day.alias("day"), lat.alias("lat"), (30.0 + 0.03 * (F.col("user_id") % 4)).alias("lon"), ((F.dayofmonth("ts") + track) % 7).alias("k"), "value")
    maps = f.filter("k <> 3").select("track", "day").distinct()
    marked = f.filter("k in (0, 1, 4, 6)")
    asks = marked.filter("value > 95").select(F.col("event_id").alias("ask"), "track", "day", "lat", "lon")
    out = histories.persistence(asks, maps, marked.filter("value > 70").select("track", "day", "lat", "lon").distinct())
    return out.withColumn("since", F.date_format("since", "yyyy-MM-dd"))


@query("jn9b_snapshot_and_previous", """with p as (select event_id, user_id, ts from events where event_type = 'purchase'), s as (select user_id, ts as "at", event_id as snap from events where event_type = 'view' and value > 60),
 a as (select p.*, coalesce(x.snap, f.snap) as snap, coalesce(x."at", f."at") as "at" from p left join lateral (select snap, "at" from s where s.user_id = p.user_id and s."at" <= p.ts order by "at" desc, snap desc limit 1) x on true left join lateral (select snap, "at" from s where s.user_id = p.user_id order by "at", snap limit 1) f on true)
 select event_id, a.snap, case when y.snap <> a.snap then y.snap end as previous from a left join lateral (select snap from s where s.user_id = a.user_id and s."at" <= a."at" - interval 3 day + interval 6 hour order by "at" desc, snap desc limit 1) y on true""")
def jn9b(spark, d):
    e = Tables(spark, d).events
    snaps = e.filter("event_type = 'view' and value > 60").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("snap"))
    found = histories.snapshot_and_previous(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), snaps, "user_id", "ts", "at", "snap", 3)
    return found.select("event_id", "snap", "previous")


@query("tr10b_surge_admission", """with recursive l as (select conv_id % 5 as newsroom, turn * 1000000 + conv_id as "at", conv_id as story, case when turn = max(turn) over (partition by conv_id) and turn > 0 then 'retire' else 'request' end as kind from conversations),
 n as (select *, row_number() over (partition by newsroom order by "at") as k, 3 + newsroom as standing from l),
 w as (select newsroom, 0::bigint as k, []::bigint[] as active, null::bigint as "at", null::bigint as story, null::varchar as kind, null::varchar as outcome from (select distinct newsroom from l) union all
  select newsroom, k, case when kind = 'retire' then list_filter(active, lambda x: x <> story) when outcome = 'hired' then list_append(active, story) else active end, "at", story, kind, outcome from
   (select n.newsroom, n.k, w.active, n."at", n.story, n.kind, case when n.kind = 'retire' then null when list_contains(w.active, n.story) then 'already' when len(w.active) >= 4 then 'refused_surge' when n.standing + len(w.active) >= 8 then 'refused_total' else 'hired' end as outcome
    from w join n on n.newsroom = w.newsroom and n.k = w.k + 1) s) select newsroom, "at", story, outcome from w where kind = 'request'""")
def tr10b(spark, d):
    from pyspark.sql import Window

    c = Tables(spark, d).conversations
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    newsroom = (F.col("conv_id") % 5).cast("long").alias("newsroom")
    log = c.select(newsroom, (F.col("turn") * 1_000_000 + F.col("conv_id")).cast("long").alias("at"), F.col("conv_id").cast("long").alias("story"), F.when((F.col("turn") == last) & (F.col("turn") > 0), "retire").otherwise("request").alias("kind"))
    standing = c.select(newsroom).distinct().withColumn("n", 3 + F.col("newsroom"))
    return histories.admitted(log, standing, 4, 8)
