"""Tracks, shipping, newsroom and write semantics, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.functions import geo
from tidings.operators import outlines, sinks, tracks
from tidings.plans.registry import query
from tidings.plans.relations import HAV
from tidings.tables import Tables

EV = "e as (select event_id as id, user_id as track, event_type as kind, ts, value, ((user_id * 13 + event_id * 7) % 41 - 20)::double as lat, ((user_id * 29 + event_id * 3) % 61 - 30)::double as lon from events)"
COS = "6371e0 * acos(least(1e0, greatest(-1e0, sin(radians({0})) * sin(radians({2})) + cos(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))))"


def positions(spark, d):
    e = Tables(spark, d).events
    lat = ((F.col("user_id") * 13 + F.col("event_id") * 7) % 41 - 20).cast("double")
    lon = ((F.col("user_id") * 29 + F.col("event_id") * 3) % 61 - 30).cast("double")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("track"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), "value", lat.alias("lat"), lon.alias("lon"))


@query("flt4_box", f"with {EV} select id from e where lat between -10 and 10 and (lon >= 20 or lon <= -20)")
def flt4(spark, d):
    return positions(spark, d).filter(geo.in_box(F.col("lat"), F.col("lon"), -10, 20, 10, -20)).select("id")


@query("sf20_distances", f"with {EV} select id, round({HAV.format('lat', 'lon', '10e0', '20e0')}, 3) as haversine, round({COS.format('lat', 'lon', '10e0', '20e0')}, 3) as cosines from e")
def sf20(spark, d):
    p = positions(spark, d)
    to = (F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return p.select("id", F.round(geo.haversine_km(*to), 3).alias("haversine"), F.round(geo.cosines_km(*to), 3).alias("cosines"))


BEARING = "fmod(degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360e0, 360e0)"


@query("sf21_bearing", f"with {EV}, b as (select id, {BEARING.format('lat', 'lon', '10.5e0', '20.5e0')} as b from e) select id, round(b, 4) as bearing, (['N','NE','E','SE','S','SW','W','NW'])[(floor(b / 45e0 + 0.5e0)::int % 8) + 1] as compass, round(abs(fmod(b - 90e0 + 180e0 + 360e0, 360e0) - 180e0), 4) as off from b")
def sf21(spark, d):
    b = geo.bearing(F.col("lat"), F.col("lon"), F.lit(10.5), F.lit(20.5))
    return positions(spark, d).select("id", F.round(b, 4).alias("bearing"), geo.compass(b).alias("compass"), F.round(geo.angle_between(b, F.lit(90.0)), 4).alias("off"))


@query("sf22_towards", """with x as (select s.s_suppkey, c.c_custkey, abs(s.s_suppkey * 7 - c.c_custkey * 3) % 60 as km, (s.s_suppkey * 11 + c.c_custkey * 5) % 50 as off, c.c_acctbal from supplier s join customer c on c.c_nationkey = s.s_nationkey),
 y as (select *, log10(greatest(c_acctbal, 0) + 10e0) - off / 60e0 - km / 80e0 as score from x where km between 2 and 40 and off <= 35), r as (select *, row_number() over (partition by s_suppkey order by score desc, c_custkey) as k from y) select s_suppkey, c_custkey, round(score, 6) as score from r where k = 1""")
def sf22(spark, d):
    t = Tables(spark, d)
    towns = t.customer.select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("town"), F.greatest("c_acctbal", F.lit(0.0)).alias("population"))
    arrows = t.supplier.select(F.col("s_nationkey").alias("area"), F.col("s_suppkey").alias("arrow"))
    km, off = F.abs(F.col("arrow") * 7 - F.col("town") * 3) % 60, (F.col("arrow") * 11 + F.col("town") * 5) % 50
    best = tracks.aims(arrows, towns, off, km)
    return best.select(F.col("arrow").alias("s_suppkey"), F.col("town").alias("c_custkey"), F.round("score", 6).alias("score"))


@query("wn8_grouped_reports")
def wn8(spark, d):
    return tracks.grouped_reports(positions(spark, d).select("track", "id", "at", "lat", "lon"), 48, 1500.0)


@query("geo12_day_support", f"""with {EV}, p as (select *, cast(ts as date) as day, 0.5e0 + value / 200e0 as weight, kind = 'signup' as confirmed from e), q as (select *, bool_or(confirmed) over (partition by track, day) as any_ from p), pool as (select * from q where not any_ or confirmed)
 select a.track, a.id, round(sum(b.weight), 6) as support from pool a join pool b on a.track = b.track and a.day = b.day and {COS.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1000.5e0 group by 1, 2""")
def geo12(spark, d):
    return tracks.day_support(day_points(spark, d), 1000.5).select("track", "id", F.round("support", 6).alias("support"))


def day_points(spark, d):
    return positions(spark, d).select("track", "id", F.to_date("at").alias("day"), "lat", "lon", (0.5 + F.col("value") / 200.0).alias("weight"), (F.col("kind") == "signup").alias("confirmed"))


@query("geo12b_daily_path")
def geo12b(spark, d):
    return tracks.daily_path(day_points(spark, d), 1000.0, 1500.0)


@query("wn11_path_length", f"""with {EV}, l as (select *, lag(lat) over (partition by track order by ts, id) as la, lag(lon) over (partition by track order by ts, id) as lo from e) select track, round(sum(coalesce({HAV.format('la', 'lo', 'lat', 'lon')}, 0)), 3) as km from l group by 1""")
def wn11(spark, d):
    p = tracks.path_length(positions(spark, d), "track", ["at", "id"], geo.haversine_km)
    return p.groupBy("track").agg(F.round(F.max("km"), 3).alias("km"))


def boxes(spark, d, plus):
    s = Tables(spark, d).supplier
    south, west = (F.col("s_suppkey") % 7).cast("double"), (F.col("s_suppkey") % 11).cast("double")
    return s.select((F.col("s_nationkey") % 3).cast("long").alias("area"), south.alias("south"), (west + plus).alias("west"), (south + 1.5).alias("north"), (west + plus + 1.5).alias("east"))


BOX = """select (s_nationkey % 3)::bigint as area, (s_suppkey % 7)::double as s, (s_suppkey % 11)::double + {0}e0 as w from supplier"""
CELL = """select distinct area, cy, cx from ({box}) b, unnest(range(-10, 60)) y(cy), unnest(range(-10, 60)) x(cx) where (cy + 0.5e0) * 0.25e0 >= s and (cy + 0.5e0) * 0.25e0 < s + 1.5e0 and (cx + 0.5e0) * 0.25e0 >= w and (cx + 0.5e0) * 0.25e0 < w + 1.5e0"""
KM2 = "pow(0.25e0 * 111.195e0, 2) * cos(radians((cy + 0.5e0) * 0.25e0))"


@query("geo1_geo2_areas", f"with c as ({CELL.format(box=BOX.format(0))}) select area, round(sum({KM2}), 4) as km2 from c group by 1")
def geo1(spark, d):
    return tracks.areas(tracks.cover(boxes(spark, d, 0.0), 0.25), 0.25).select("area", F.round("km2", 4).alias("km2"))


@query("geo1c_outlines", CELL.format(box=BOX.format(0)))
def geo1c(spark, d):
    """The cells inside the outlines of areas: the areas' own cells again."""
    return tracks.polygon_cells(outlines.outlines(tracks.cover(boxes(spark, d, 0.0), 0.25), 0.25), 0.25, holes=True)


#: Cells without another one beside them on the side that an edge faces: the length of all outlines, in cells.
@query("snk7b_outline_lengths", f"""with c as ({CELL.format(box=BOX.format(0))}) select area, sum((not exists (select 1 from c o where o.area = c.area and o.cy = c.cy + 1 and o.cx = c.cx))::int + (not exists (select 1 from c o where o.area = c.area and o.cy = c.cy - 1 and o.cx = c.cx))::int
 + (not exists (select 1 from c o where o.area = c.area and o.cy = c.cy and o.cx = c.cx + 1))::int + (not exists (select 1 from c o where o.area = c.area and o.cy = c.cy and o.cx = c.cx - 1))::int)::bigint as edges from c group by 1""")
def snk7b(spark, d):
    """How long the rings of each area's outline are together."""
    r = F.col("ring")
    step = F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.abs(F.get(r, i + 1)["lat"] - F.get(r, i)["lat"]) + F.abs(F.get(r, i + 1)["lon"] - F.get(r, i)["lon"]))
    length = F.aggregate(step, F.lit(0.0), lambda a, x: a + x)
    o = outlines.outlines(tracks.cover(boxes(spark, d, 0.0), 0.25), 0.25)
    return o.groupBy("area").agg(F.round(F.sum(length) / 0.25).cast("long").alias("edges"))


@query("geo3_gained_lost", f"""with a as ({CELL.format(box=BOX.format(0))}), b as ({CELL.format(box=BOX.format(0.5))})
 select area, 'gained' as change, round(sum({KM2}), 4) as km2 from (select * from b except select * from a) group by 1 union all select area, 'lost', round(sum({KM2}), 4) from (select * from a except select * from b) group by 1""")
def geo3(spark, d):
    c = lambda plus: tracks.cover(boxes(spark, d, plus), 0.25)
    return tracks.changes(c(0.0), c(0.5), 0.25, ("area",)).select("area", "change", F.round("km2", 4).alias("km2"))


@query("geo5_held_cells", f"""with p as (select s_suppkey as id, (s_nationkey % 2)::int as side, (s_suppkey % 7) + 0.13e0 as lat, (s_suppkey % 11) + 0.07e0 as lon, case when s_suppkey % 2 = 0 then 60e0 else 35e0 end as r from supplier),
 x as (select cy, cx, p.*, round({COS.format('lat', 'lon', '(cy + 0.5e0) * 0.25e0', '(cx + 0.5e0) * 0.25e0')}, 6) as dist from p, unnest(range(-8, 40)) y(cy), unnest(range(-8, 60)) z(cx)),
 k as (select *, row_number() over (partition by cy, cx order by dist, id) as n from x) select cy::bigint as cy, cx::bigint as cx, side from k where n = 1 and dist <= r""")
def geo5(spark, d):
    s = Tables(spark, d).supplier
    p = s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2).alias("side"), (F.col("s_suppkey") % 7 + 0.13).alias("lat"), (F.col("s_suppkey") % 11 + 0.07).alias("lon"))
    return tracks.held_cells(p, 0.25, F.when(F.col("id") % 2 == 0, 60.0).otherwise(35.0))


@query("geo6_changed_hands", """select a.c_custkey as place, a.s as was, b.s as now from (select c_custkey, c_nationkey % 4 as s, round(c_custkey / 3e0, 2) as k from customer) a join (select c_custkey, (c_nationkey + c_custkey) % 4 as s, round(c_custkey / 3e0, 2) as k from customer) b on a.c_custkey = b.c_custkey and a.k = b.k where a.s <> b.s""")
def geo6(spark, d):
    c = Tables(spark, d).customer
    key = F.round(F.col("c_custkey") / 3.0, 2).alias("k")
    a = c.select(F.col("c_custkey").alias("place"), key, (F.col("c_nationkey") % 4).alias("was"))
    b = c.select(F.col("c_custkey").alias("place"), key, ((F.col("c_nationkey") + F.col("c_custkey")) % 4).alias("now"))
    return a.join(b, ["place", "k"]).filter("was <> now").select("place", "was", "now")


@query("geo9_tiles", "with p as (select c_custkey, ((c_custkey * 37) % 121 - 60)::double as lat, ((c_custkey * 71) % 341 - 170)::double as lon from customer) select c_custkey, floor((lon + 180e0) / 360e0 * 32)::int as x, floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 32)::int as y from p")
def geo9(spark, d):
    lat, lon = ((F.col("c_custkey") * 37) % 121 - 60).cast("double"), ((F.col("c_custkey") * 71) % 341 - 170).cast("double")
    x, y = geo.tile_xy(lat, lon, 5)
    return Tables(spark, d).customer.select("c_custkey", x.alias("x"), y.alias("y"))


@query("geo13_trail", f"with {EV}, w as (select *, floor(epoch(ts) / 21600)::bigint * 21600 as slot, row_number() over (partition by track, floor(epoch(ts) / 21600) order by ts, id) as k from e) select track as key, slot, floor(epoch(ts))::bigint as at, lat, lon from w where k = 1")
def geo13(spark, d):
    return tracks.trail(positions(spark, d).withColumnRenamed("track", "key"), 360)


@query("wn9_marked_since", """with x as (select distinct user_id as key, cast(ts as date) as day from events where event_type = 'error'), y as (select *, day - lag(day) over (partition by key order by day) as g from x), z as (select *, sum(case when g > 4 then 1 else 0 end) over (partition by key order by day rows unbounded preceding) as run from y),
 r as (select key, run, min(day) as since, max(day) as last, row_number() over (partition by key order by run desc) as k from z group by 1, 2) select key, strftime(since, '%Y-%m-%d') as since, (last - since + 1)::bigint as run_days from r where k = 1""")
def wn9(spark, d):
    e = Tables(spark, d).events.filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"))
    return tracks.marked_since(e).select("key", F.date_format("since", "yyyy-MM-dd").alias("since"), "run_days")


@query("snk1_insert_if_absent", """with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'signup') select user_id, event_id from n where k = 1 and user_id not in (select user_id from events where event_type = 'purchase' and value > 95)""")
def snk1(spark, d):
    e = Tables(spark, d).events
    return sinks.insert_if_absent(e.filter("event_type = 'purchase' and value > 95"), e.filter("event_type = 'signup'"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@query("snk2_upsert_latest", "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as k from events where event_type in ('view', 'click')) select user_id, event_id from r where k = 1")
def snk2(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "event_type")
    return sinks.upsert_latest(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], "event_id").select("user_id", "event_id")


@query("snk3_upsert_merge", "select user_id, arg_max(event_type, event_id) as state, arg_max(value, event_id) filter (where value > 50) as high, max(event_id) as event_id from events group by 1")
def snk3(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", F.col("event_type").alias("state"), F.when(F.col("value") > 50, F.col("value")).alias("high"))
    return sinks.upsert_merge(e, ["user_id"], "event_id", ["state"], ["high"])


@query("snk4_counters", "select user_id, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def snk4(spark, d):
    c = sinks.counters(Tables(spark, d).events, ["user_id", "event_type"], total=F.col("value"))
    return c.withColumn("total", F.round("total", 4))


@query("snk6_retention", "select event_id from events, (select max(ts) as m from events) where ts >= m - interval 15 day or user_id in (select user_id from events where event_type = 'purchase' and value > 99)")
def snk6(spark, d):
    e = Tables(spark, d).events
    now = F.broadcast(e.agg(F.max("ts").alias("m")))
    kept = e.filter("event_type = 'purchase' and value > 99").select("user_id")
    return sinks.retained(e.join(now), "ts", F.col("m"), 10, kept, ["user_id"]).select("event_id")


@query("snk7_geojson")
def snk7(spark, d):
    return sinks.feature_collection(positions(spark, d), "lat", "lon", "id", "kind")


@query("snk8_report", "select event_type, string_agg(user_id || ' ' || n, chr(10) order by n desc, user_id) as report from (select event_type, user_id, count(*) as n from events group by 1, 2) group by 1")
def snk8(spark, d):
    n = Tables(spark, d).events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return sinks.report_lines(n, "event_type", [F.desc("n"), F.col("user_id")], F.col("user_id"), F.col("n"))


@query("src3_stamps", "select strftime(unnest(range(timestamp '2024-01-01 00:15:00', timestamp '2024-01-02 00:01:00', interval 15 minute)), '%Y%m%d%H%M%S') as stamp")
def src3(spark, d):
    from tidings.sources.feeds import stamps_between

    return stamps_between(spark, "2023-12-30 00:00:00", "2024-01-02 00:00:00", 8)


@query("src8_congress", "select distinct year(o_orderdate)::int as year, ((year(o_orderdate) - 1789) // 2 + 1)::int as congress, case when year(o_orderdate) % 2 = 1 then 1 else 2 end as session from orders")
def src8(spark, d):
    from tidings.sources.feeds import congress, congress_session

    y = F.year("o_orderdate").alias("year")
    return Tables(spark, d).orders.select(y, congress(F.col("o_orderdate")).alias("congress"), congress_session(F.col("o_orderdate")).alias("session")).distinct()


@query("src20_daily_snapshots", "with r as (select event_id, cast(ts + interval 3 hour as date) as day, row_number() over (partition by cast(ts + interval 3 hour as date) order by ts desc, event_id desc) as k from events) select event_id, strftime(day, '%Y-%m-%d') as day from r where k = 1")
def src20(spark, d):
    from tidings.sources.snapshots import daily_snapshots

    s = daily_snapshots(Tables(spark, d).events.select("event_id", F.col("ts").alias("at")), "event_id")
    return s.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("src22_thinned_revisions", """with m as (select max(ts) as now from events), x as (select event_id, ts, case when date_diff('second', ts, now) <= 10 * 86400 then strftime(ts, '%Y-%m-%d') when date_diff('second', ts, now) <= 25 * 86400 then strftime(ts, '%G-%V') end as b from events, m), r as (select *, row_number() over (partition by b order by ts desc, event_id desc) as k from x where b is not null) select event_id from r where k = 1""")
def src22(spark, d):
    from tidings.sources.snapshots import thinned

    e = Tables(spark, d).events.select("event_id", F.col("ts").alias("at"))
    return thinned(e.join(F.broadcast(e.agg(F.max("at").alias("now")))), "event_id", 10, 25).select("event_id")


@query("tr9_escalations", "with r as (select event_type as desk, event_id, row_number() over (order by value desc, event_id) as k from events where value > 90), u as (select count(*) as used from events where event_id % 997 = 0) select desk, event_id from r, u where k <= 60 - used")
def tr9(spark, d):
    e = Tables(spark, d).events
    room = F.broadcast(e.filter("event_id % 997 = 0").agg((60 - F.count("*")).alias("room")))
    top = e.filter("value > 90").orderBy(F.desc("value"), "event_id").limit(60)
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")))  # 60 rows
    return ranked.join(room).filter(F.col("k") <= F.col("room")).select(F.col("event_type").alias("desk"), "event_id")


@query("tr11_desk_queue", """with s as (select user_id as story_id, max(ts) as last_seen, max(value) as sig from events group by 1), m as (select max(ts) as now from events) select story_id, story_id % 10 = 0 as followed from s, m where last_seen >= now - interval 6 hour or story_id % 10 = 0 order by story_id % 10 = 0 desc, sig desc, story_id limit 20""")
def tr11(spark, d):
    e = Tables(spark, d).events
    s = e.groupBy(F.col("user_id").alias("story_id")).agg(F.max("ts").alias("last_seen"), F.max("value").alias("sig")).join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    followed = F.col("story_id") % 10 == 0
    s = s.filter((F.col("last_seen") >= F.col("now") - F.expr("interval 6 hours")) | followed)
    return s.orderBy(followed.desc(), F.desc("sig"), "story_id").limit(20).select("story_id", followed.alias("followed"))
