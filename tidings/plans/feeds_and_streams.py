"""Sources and streams, bound to the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidings.operators.graph import shared_folder
from tidings.plans.registry import query
from tidings.sources import feeds, pages, sensors
from tidings.streaming import flows
from tidings.tables import Tables


@query("src1_event_lines", r"""select 'http://x.example/' || event_id as url, 'A fairly long headline number ' || event_id as title, floor(epoch(ts))::bigint as at, round(value, 3) as tone, case when event_id % 2 = 0 then 'KILL,TERROR' else 'TERROR' end as themes, 'Anna Noor' as person from events where event_type <> 'view'""")
def src1(spark, d):
    """Events written as tab-separated lines and parsed again."""
    e = Tables(spark, d).events
    cols = {0: F.col("event_id"), 1: F.date_format("ts", "yyyyMMddHHmmss"), 2: F.when(F.col("event_type") == "view", "2").otherwise("1"), 3: F.lit("x.example"), 4: F.concat(F.lit("http://x.example/"), "event_id"),
            7: F.when(F.col("event_id") % 2 == 0, "TERROR,1;KILL,2;OTHER,3;KILL,9").otherwise("TERROR,4;TAX,5"), 11: F.lit("anna noor;anna noor"), 15: F.concat(F.round("value", 3).cast("string"), F.lit(",1,2")),
            26: F.concat(F.lit("<PAGE_TITLE>A fairly long headline number "), "event_id", F.lit(" | Site</PAGE_TITLE>"))}
    line = F.concat_ws("\t", *[F.coalesce(cols[k].cast("string"), F.lit("")) if k in cols else F.lit("") for k in range(27)])
    g = feeds.gkg(e.select(line.alias("value")), ["KILL", "TERROR"], ["un"])
    return g.select("url", "title", F.unix_seconds("published_at").alias("at"), "tone", F.array_join("themes", ",").alias("themes"), F.col("persons")[0].alias("person"))


@query("src2_locations", "select c_custkey, case when c_custkey % 2 = 0 then 'Odesa|Kyiv' else 'Ukraine|Kharkiv Oblast' end as names from customer where c_custkey % 2 = 0 union all select c_custkey, 'Poland|Odesa' from customer where c_custkey % 2 = 1")
def src2(spark, d):
    k = F.col("c_custkey")
    even = F.lit("1#Ukraine#UP#UP##49#32#UP#5;4#Kyiv, Ukraine#UP#UP12##50.4#30.5#-1#90;4#Odesa, Ukraine#UP#UP17##46.5#30.7#-2#40;bad#x;4#Odesa, Ukraine#UP#UP17##46.5#30.7#-2#99")
    odd = F.lit("4#Odesa, Ukraine#UP#UP17##46.5#30.7#-2#40;1#Poland#PL#PL##52#19#PL#7;4#Nowhere#UP#UP##x#30#-3#1")
    places = feeds.locations(F.when(k % 2 == 0, even).otherwise(odd))
    return Tables(spark, d).customer.select("c_custkey", F.array_join(F.transform(places, lambda p: p["name"]), "|").alias("names"))


@query("src10_handles", "select c_custkey, case c_custkey % 4 when 0 then 'chan' || c_custkey when 1 then null when 2 then null else 'chan' || c_custkey end as handle from customer")
def src10(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://t.me/s/Chan"), k)).when(k % 4 == 1, "https://t.me/share/url?x").when(k % 4 == 2, F.concat(F.lit("https://t.me/c"), k, F.lit("_bot"))).otherwise(F.concat(F.lit("http://t.me/chan"), k, F.lit("/12")))
    return Tables(spark, d).customer.select("c_custkey", pages.handle_of(url).alias("handle"))


@query("src13_articles")
def src13(spark, d):
    a = pages.articles(Tables(spark, d).pages, most=None, captions=None)
    return a.select("page_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"), "status", F.size("captions").alias("captions"))


@query("src18_outbound_links")
def src18(spark, d):
    p = Tables(spark, d).pages
    here = F.concat("html", F.lit('<a href="https://news.example/2024/a/b?utm_source=x">A</a><a href="https://facebook.com/x/y">F</a>'))
    return pages.outbound(p.select("page_id", "url", here.alias("html")), ["facebook.com"], ["share"], ["tag", "live"], most=None)


@query("src25_airports", "select p_partkey::varchar as code, p_name as name, case when p_size > 40 then 'large_airport' else 'medium_airport' end as type from part where p_size > 40 or (p_size > 20 and p_partkey % 2 = 0)")
def src25(spark, d):
    size = F.col("p_size")
    rows = Tables(spark, d).part.select(
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).otherwise("").alias("icao_code"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_partkey").cast("string")).alias("gps_code"), F.col("p_partkey").cast("string").alias("ident"), F.col("p_name").alias("name"),
        F.when(size > 40, "large_airport").when(size > 20, "medium_airport").otherwise("heliport").alias("type"), F.when(F.col("p_partkey") % 2 == 0, "yes").otherwise("no").alias("scheduled_service"))
    return sensors.airports(rows)


@query("src28_ais", "select event_id as mmsi, (event_id % 90)::double as lat, (event_id % 180)::double as lon, case when event_id % 3 = 0 then null else (event_id % 360)::int end as heading from events where event_id <> 0 and not (event_id % 90 = 0 and event_id % 180 = 0) and event_id % 7 <> 0")
def src28(spark, d):
    e, k = Tables(spark, d).events, F.col("event_id")
    pos = F.struct((k % 90).cast("double").alias("Latitude"), F.when(k % 7 == 0, 999.0).otherwise((k % 180).cast("double")).alias("Longitude"), F.when(k % 3 == 0, 511).otherwise(k % 360).alias("TrueHeading"))
    meta = F.struct(k.alias("MMSI"), F.lit(" SHIP@@ ").alias("ShipName"), F.lit("2024-01-01 00:00:00.5 +0000 UTC").alias("time_utc"))
    json = F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), F.struct(pos.alias("PositionReport")).alias("Message")))
    return sensors.ais(e.select(json.alias("json"))).select("mmsi", "lat", "lon", "heading")


@query("src29_cargo_planes", "select s_suppkey::varchar as icao24, case when s_suppkey % 2 = 0 then 'Fast Freight' else 'Box Air' end as operator, round(s_suppkey * 1.943844e0, 4) as knots from supplier where s_suppkey % 5 <> 0")
def src29(spark, d):
    k = F.col("s_suppkey")
    states = Tables(spark, d).supplier.select(
        k.cast("string").alias("icao24"), F.concat(F.when(k % 2 == 0, "ffr").otherwise("box"), k, F.lit(" ")).alias("callsign"), F.when(k % 5 != 0, 1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(None).cast("double").alias("geo_altitude"), F.lit(9.0).alias("baro_altitude"), k.cast("double").alias("velocity"))
    airlines = spark.createDataFrame([("FFR", "Fast Freight"), ("BOX", "Box Air")], "prefix string, operator string")
    return sensors.cargo_planes(states, airlines).select("icao24", "operator", F.round("knots", 4).alias("knots"))


@query("flt16_sf27_ship_types", "select p_partkey, p_size + 40 between 60 and 89 as wanted, case (p_size + 40) // 10 when 4 then 'high speed craft' when 5 then 'special craft' when 6 then 'passenger' when 7 then 'cargo' when 8 then 'tanker' when 9 then 'other' end as kind from part")
def flt16(spark, d):
    t = F.col("p_size") + 40
    return Tables(spark, d).part.select("p_partkey", sensors.wanted_type(t).alias("wanted"), sensors.label(F.floor(t / 10), sensors.SHIP_KINDS).alias("kind"))


HAZARD = "case t % 10 when 1 then ', hazardous goods (A)' when 2 then ', hazardous goods (B)' when 3 then ', hazardous goods (C)' when 4 then ', hazardous goods (D)' else '' end"


@query("sf27b_ship_labels", f"""with x as (select p_partkey, case when p_partkey % 9 <> 0 then p_size + 50 end as t, p_partkey % 10 as nav from part) select p_partkey, case when t is null then 'type not yet known' when t // 10 = 7 then 'cargo ship' || {HAZARD} when t // 10 = 8 then 'tanker' || {HAZARD} when t // 10 = 6 then 'passenger ship' else 'AIS type ' || t end as label,
 ['under way', 'at anchor', 'not under command', 'restricted in how it can move', 'constrained by its draught', 'moored', 'aground', 'fishing', 'under way sailing'][nav + 1] as state from x""")
def sf27b(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 9 != 0, F.col("p_size") + 50)
    return Tables(spark, d).part.select("p_partkey", sensors.ship_label(kind).alias("label"), sensors.label(k % 10, sensors.NAVIGATION).alias("state"))


CLOSED = "(select max(ts) as m from events)"


@query("st2_st7_tumbling", f"select slot, event_type, count(*) as n from (select floor(epoch(ts) / 21600)::bigint * 21600 as slot, event_type from events) x, {CLOSED} where slot + 21600 <= epoch(m) - 7200 group by 1, 2")
def st2(spark, d):
    out = flows.drained(flows.tumbling(flows.file_stream(spark, d, "events"), "ts", ["event_type"], "6 hours"))
    end = Tables(spark, d).events.agg((F.unix_seconds(F.max("ts")) - 7200).alias("m"))
    return out.join(F.broadcast(end)).filter("slot + 21600 <= m").drop("m")


@query("st2b_sliding", f"""with u as (select event_type, (floor(epoch(ts) / 21600)::bigint + k) * 21600 as upto from events, unnest(range(1, 5)) r(k)) select upto, event_type, count(*) as n from u, {CLOSED} where upto <= epoch(m) - 7200 group by 1, 2""")
def st2b(spark, d):
    out = flows.drained(flows.sliding(flows.file_stream(spark, d, "events"), "ts", ["event_type"], "24 hours", "6 hours"))
    end = Tables(spark, d).events.agg((F.unix_seconds(F.max("ts")) - 7200).alias("m"))
    return out.join(F.broadcast(end)).filter("upto <= m").drop("m")


@query("st3_first_seen", "select distinct event_id from events")
def st3(spark, d):
    s = flows.file_stream(spark, d, "events")
    return flows.drained(flows.first_seen(s.unionByName(flows.file_stream(spark, d, "events")), "ts", ["event_id"], "40 days").select("event_id"))


@query("st4_latest_state", "select user_id, max(epoch_us(ts)) as at_us, arg_max(value, ts) filter (where value > 50) as high from events group by 1")
def st4(spark, d):
    s = flows.file_stream(spark, d, "events").select("user_id", "ts", F.when(F.col("value") > 50, F.col("value")).alias("high"))
    out = flows.drained(flows.latest_state(s, "user_id", "ts", ["high"], "40 days"))
    return out.groupBy("user_id").agg(F.max("at_us").alias("at_us"), F.max_by("high", "at_us").alias("high"))


@query("st5_forgotten_state")
def st5(spark, d):
    """Events in four files by time, read one after the other; a user's state is forgotten three days behind the watermark."""
    e = Tables(spark, d).events.select("user_id", "ts", F.when(F.col("value") > 50, F.col("value")).alias("high"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    folder = f"{shared_folder(spark)}/st5-{uuid.uuid4().hex}"
    for k in range(4):
        a, z = (low + (high - low) * x / 4 for x in (k, k + 1))
        e.filter((F.col("ts") >= a) & ((F.col("ts") < z) | F.lit(k == 3))).repartition(1).write.mode("append").parquet(f"{folder}/events.parquet")  # read by all tasks, written by one
    out = flows.drained(flows.latest_state(flows.file_stream(spark, folder, "events", 1), "user_id", "ts", ["high"], "3 days"))
    return out.select("user_id", "at_us", "high")


@query("st8_sessions", f"""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour then 1 else 0 end as cut from events), y as (select *, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as k from x),
 s as (select user_id, floor(epoch(min(ts)))::bigint as start, floor(epoch(max(ts)))::bigint + 21600 as "end", count(*) as n from y group by user_id, k) select user_id, start, "end", n from s, {CLOSED} where "end" <= epoch(m) - 7200""")
def st8(spark, d):
    out = flows.drained(flows.sessions(flows.file_stream(spark, d, "events"), "ts", ["user_id"]))
    end = Tables(spark, d).events.agg((F.unix_seconds(F.max("ts")) - 7200).alias("m"))
    return out.join(F.broadcast(end)).filter("end <= m").drop("m")
