"""Plug-ins and dimension files, bound to the given tables by small deterministic stand-ins."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tidings import plugins
from tidings.operators import joins, places, rollup, search, tracks
from tidings.operators.graph import shared_folder
from tidings.plans.registry import query
from tidings.plans.relations import HAV, LAT, LON, coordinates
from tidings.sources import dimensions, shapes
from tidings.tables import Tables


class Letters:
    """Shares of the vowels in a text."""

    dims = 5

    def embed(self, texts):
        return [[t.count(c) / max(1, len(t)) for c in "aeiou"] for t in texts]


@query("ud2_embedder", "select p_partkey as id, place, round(((length(p_name) - length(replace(p_name, substr('aeiou', place::int + 1, 1), ''))) / length(p_name)::double), 9) as x from part, unnest(range(0, 5)) u(place)")
def ud2(spark, d):
    v = plugins.embedded(Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), Letters())
    return v.select("id", F.posexplode("v").alias("place", "x")).select("id", F.col("place").cast("long").alias("place"), F.round("x", 9).alias("x"))


class ByLength:
    def decide(self, contexts, desks):
        return [("none of them" if len(c) % 5 == 0 else desks[len(c) % 2], len(c) / 10, 0.5) for c in contexts]


@query("ud3_decider", """select p_partkey as story_id, case when length(p_name) % 5 = 0 then null when length(p_name) % 2 = 0 then 'north' else 'south' end as desk,
 case when length(p_name) % 5 <> 0 then length(p_name) / 10e0 end as significance, case when length(p_name) % 5 <> 0 then 0.5e0 end as confidence from part""")
def ud3(spark, d):
    return plugins.decided(Tables(spark, d).part.select(F.col("p_partkey").alias("story_id"), F.col("p_name").alias("context")), ByLength(), ["north", "south"])


class SameStart:
    def same(self, pairs):
        return [None if s[:1] == "b" else s.split(" ")[0] == t.split(" ")[0] for s, t in pairs]


@query("ud4_judge", "select x.p_partkey as a, y.p_partkey as b, split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) as same from part x join part y on y.p_partkey = x.p_partkey + 1 where x.p_name[1] <> 'b'")
def ud4(spark, d):
    p = Tables(spark, d).part
    right = p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("right"))
    return plugins.judged(p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("left")).join(right, "a"), SameStart())


class Numbered:
    def collect(self, source):
        return [(f"{source.url}/{k}", f"{source.name} {k}", 86_400 * k) for k in range(source.options["count"])]


@query("ud5_collector", "with s as (select n_name as name, n_nationkey % 4 as n from nation) select name as source, 'https://' || lower(name) || '.example/' || k as url, name || ' ' || k as title, 86400 * k as at from s, unnest(range(0, 3)) u(k) where k < n")
def ud5(spark, d):
    specs = [plugins.SourceSpec(r["n_name"], "rss", f"https://{r['n_name'].lower()}.example", {"count": r["n_nationkey"] % 4}) for r in Tables(spark, d).nation.collect()]
    return plugins.collected(spark, specs, Numbered()).select("source", "url", "title", F.unix_seconds("published_at").alias("at"))


class Checksums:
    def locate(self, names):
        return [None if len(n) % 3 == 0 else (zlib.crc32(n.encode()) % 90 * 1.0, len(n) * 1.0) for n in names]


@query("ud6_locator", "select c_custkey as ask, case when length(n_name) % 3 = 0 then null else length(n_name)::double end as lon from customer join nation on c_nationkey = n_nationkey")
def ud6(spark, d):
    t = Tables(spark, d)
    asks = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ask"), F.col("n_name").alias("name"))
    return plugins.located(asks, Checksums()).select("ask", "lon")


def filed(df, name: str) -> str:
    """df as a tab-separated file with a header."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return path


@query("src30_countries", "select n_nationkey::varchar as iso, case when n_nationkey % 3 = 0 then null else 'F' || n_nationkey end as fips, n_name as name, case when n_nationkey % 2 = 0 then 1e0 else n_nationkey::double end as lat, case when n_nationkey % 2 = 0 then 2e0 else -n_nationkey::double end as lon from nation where n_nationkey % 2 = 0 or n_nationkey % 5 <> 0")
def src30(spark, d):
    n, k = Tables(spark, d).nation, F.col("n_nationkey")
    c = n.select(k.alias("iso2"), F.when(k % 3 != 0, F.concat(F.lit("F"), k)).otherwise("").alias("fips"), F.col("n_name").alias("name"), F.when(k % 5 != 0, k).alias("lat"), (-k).alias("lon"))
    m = n.filter(k % 2 == 0).select(k.alias("iso2"), F.lit("1.0").alias("lat"), F.lit("2.0").alias("lon"))
    return dimensions.countries(spark, filed(c, "src30-countries"), filed(m, "src30-centres"))


@query("src30b_towns", "select distinct s.x as spelling, p_partkey::varchar as key, coalesce(try_cast(case when p_partkey % 7 = 0 then 'many' else p_size::varchar end as bigint), 0) as population from part, unnest([lower(p_name), 'old ' || lower(p_name)]) s(x)")
def src30b(spark, d):
    k = F.col("p_partkey")
    names = F.concat_ws("|", F.upper("p_name"), F.concat(F.lit("Old  "), "p_name"), F.lit("'"))
    t = Tables(spark, d).part.select(k.alias("geonameid"), F.initcap("p_name").alias("name"), names.alias("names"), F.lit("UA").alias("country"), F.lit("").alias("admin1"), F.when(k % 7 == 0, "many").otherwise(F.col("p_size").cast("string")).alias("population"), F.lit(1).alias("lat"), F.lit(2).alias("lon"))
    return dimensions.towns(spark, filed(t, "src30-towns")).select("spelling", "key", "population")


@query("src30c_outlets", "select 'site' || (p_partkey % 50) || '.example' as suffix, min(chr((65 + p_size % 4)::int)) as tier from part group by 1")
def src30c(spark, d):
    t = Tables(spark, d).part.select(F.concat(F.lit("Site"), F.col("p_partkey") % 50, F.lit(".EXAMPLE")).alias("domain"), F.chr(F.lit(65) + F.col("p_size") % 4).alias("tier"))
    return dimensions.outlets(spark, filed(t, "src30-outlets"))


CITIES = [("gn:1", "Saint Anna", "3", 50_000), ("gn:2", "Springfield", "5", 90_000), ("gn:3", "Springfield", "7", 20_000), ("gn:4", "Nation_9", "8", 10), ("gn:5", "Readingham", "2", 70_000)]
ALIASES = [("The Motherland", "cc:4", "country", "4"), ("springfield", "cc:1", "country", "1")]


@query("sf16b_cities_and_aliases", """with t as (select c_custkey as id, c_custkey % 6 as k, n_nationkey as n from customer join nation on c_nationkey = n_nationkey)
 select distinct id, key from (select id, 'cc:' || n as key from t where not (k in (0, 1) and n = 3) and not (k = 2 and n = 5) union all select id, 'gn:1' from t where k in (0, 1) union all select id, 'gn:2' from t where k = 2 union all select id, 'cc:4' from t where k = 3
 union all select id, 'cc:9' from t where k = 4)""")
def sf16b(spark, d):
    t = Tables(spark, d)
    towns = F.element_at(F.array(*map(F.lit, ["Saint Anna", "St. Anna", "Springfield", "the Motherland", "NATION_9", "Readingham"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("News from "), "n_name", F.lit(", and from "), towns, F.lit(".")).alias("text"))
    countries = t.nation.select(F.col("n_nationkey").cast("string").alias("iso"), F.col("n_name").alias("name"))
    names = places.gazetteer(spark.createDataFrame(CITIES, "key string, name string, country string, population long"), countries, spark.createDataFrame(ALIASES, "spelling string, key string, kind string, country string"), skip=["readingham"])
    return places.found_places(texts, names).select("id", "key")


MENTION = """select l_orderkey as story, case l_partkey % 6 when 0 then 'NATO' when 1 then 'Reuters' else p_name end as name,
 case (l_orderkey + l_linenumber) % 5 when 0 then 'LIVE: ' when 1 then 'Morning News: ' when 2 then 'World news ' when 3 then 'Alive: ' else 'A ' end || p_name as title from lineitem join part on l_partkey = p_partkey"""


@query("flt12_telling_mentions", f"with m as ({MENTION}) select story, name, count(*) as n from m where name not in ('NATO', 'Reuters') and left(title, 2) = 'A ' or (name not in ('NATO', 'Reuters') and left(title, 6) = 'Alive:') group by 1, 2")
def flt12(spark, d):
    t = Tables(spark, d)
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_partkey") % 6 == 0, "NATO").when(F.col("l_partkey") % 6 == 1, "Reuters").otherwise(F.col("p_name"))
    lead = F.element_at(F.array(*map(F.lit, ["LIVE: ", "Morning News: ", "World news ", "Alive: ", "A "])), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int"))
    m = m.select(F.col("l_orderkey").alias("story"), name.alias("name"), F.concat(lead, "p_name").alias("title"))
    return joins.telling_mentions(m, "name", "title").groupBy("story", "name").agg(F.count("*").alias("n"))


@query("so3_stories_at", f"""with spots as (select s_suppkey as spot, {LAT.format('s_suppkey')} as lat, {LON.format('s_suppkey')} as lon from supplier where s_suppkey % 4 = 0),
 st as (select c_custkey as story, {LAT.format('c_custkey')} as lat, {LON.format('c_custkey')} as lon from customer where c_custkey % 3 <> 0), sp as (select c_custkey as story, {LAT.format('(c_custkey + 40)')} as lat, {LON.format('(c_custkey + 40)')} as lon from customer where c_custkey % 10 > 1)
 select distinct spot, story from (select spot, story from spots join st on {HAV.format('spots.lat', 'spots.lon', 'st.lat', 'st.lon')} <= 400 union all select spot, story from spots join sp on {HAV.format('spots.lat', 'spots.lon', 'sp.lat', 'sp.lon')} <= 400)""")
def so3(spark, d):
    from tidings.functions.geo import haversine_km

    t = Tables(spark, d)
    lat, lon = coordinates("s_suppkey")
    spots = t.supplier.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("spot"), lat.alias("lat"), lon.alias("lon"))
    lat, lon = coordinates("c_custkey")
    dot = F.col("c_custkey") % 3 != 0
    stories = t.customer.select(F.col("c_custkey").alias("story"), F.when(dot, lat).alias("lat"), F.when(dot, lon).alias("lon"))
    far = t.customer.withColumn("k", F.col("c_custkey") + 40)
    lat, lon = coordinates("k")
    return joins.stories_at(spots, stories, far.select(F.col("c_custkey").alias("story"), lat.alias("lat"), lon.alias("lon"), (F.col("c_custkey") % 10 / 10.0).alias("weight")), 400.0, haversine_km)


@query("jn12_nearest_in_cell", f"""with a as (select c_custkey as id, {LAT.format('c_custkey')} as lat, {LON.format('c_custkey')} as lon from customer), b as (select s_suppkey as place, {LAT.format('s_suppkey')} as lat, {LON.format('s_suppkey')} as lon from supplier),
 x as (select id, place, round({HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) as km from a join b on floor(a.lat / 30) = floor(b.lat / 30) and floor(a.lon / 30) = floor(b.lon / 30)), k as (select *, row_number() over (partition by id order by km, place) as n from x) select id, place, round(km, 3) as km from k where n = 1""")
def jn12(spark, d):
    from tidings.functions.geo import haversine_km
    from tidings.plans.relations import points

    t = Tables(spark, d)
    dist = lambda *x: F.round(haversine_km(*x), 6)
    near = joins.nearest_in_cell(points(t.customer, "c_custkey"), points(t.supplier, "s_suppkey").withColumnRenamed("id", "place"), 30.0, dist, "id")
    return near.select("id", "place", F.round("km", 3).alias("km"))


@query("ag26_common_known", """with n as (select l_suppkey as event, l_returnflag as weapon, count(*) as n from lineitem where l_returnflag not in ('unknown', 'N') group by 1, 2), k as (select *, row_number() over (partition by event order by n desc, weapon) as r from n), q as (select l_suppkey as event, max(l_quantity) as killed from lineitem group by 1)
 select q.event, weapon, n, killed from q left join k on q.event = k.event and r = 1""")
def ag26(spark, d):
    l = Tables(spark, d).lineitem.withColumnRenamed("l_suppkey", "event")
    common = rollup.most_common(l.withColumnRenamed("l_returnflag", "weapon"), ["event"], "weapon", skip=["unknown", "N"])
    return l.groupBy("event").agg(F.max("l_quantity").alias("killed")).join(common, "event", "left").select("event", "weapon", "n", "killed")


RING_SQL = """with r as (select s_suppkey as area, s_suppkey % 7 + 0.31e0 as y, s_suppkey % 11 + 0.17e0 as x from supplier), v as (select area, i, y + [0e0, 0.1e0, 1.4e0, 0.7e0, 1.3e0][i] as vy, x + [0e0, 1.5e0, 1.2e0, 0.6e0, -0.2e0][i] as vx from r, unnest(range(1, 6)) u(i))"""
RINGS = f"""{RING_SQL},
 e as (select a.area, a.vy as ay, a.vx as ax, b.vy as by_, b.vx as bx from v a join v b on a.area = b.area and b.i = a.i % 5 + 1), g as (select cy, cx, (cy + 0.5e0) * 0.25e0 as py, (cx + 0.5e0) * 0.25e0 as px from unnest(range(-10, 60)) y(cy), unnest(range(-10, 70)) z(cx))"""


def rings(spark, d):
    y, x = F.col("s_suppkey") % 7 + 0.31, F.col("s_suppkey") % 11 + 0.17
    ring = F.array(*[F.struct((y + a).alias("lat"), (x + b).alias("lon")) for a, b in ((0.0, 0.0), (0.1, 1.5), (1.4, 1.2), (0.7, 0.6), (1.3, -0.2))])
    return Tables(spark, d).supplier.select(F.col("s_suppkey").cast("long").alias("id"), ring.alias("ring"))


def shape_files(rows, parts, kind: int):
    """rows (id, parts: array of arrays of struct lat, lon) with a shape file of one record each."""

    def run(batches):
        for b in batches:
            files = [shapes.shape_file([p], kind) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], names=["id", "content"])

    return rows.select("id", parts.alias("parts")).mapInArrow(run, "id long, content binary")


@query("src23_zones", f"""{RING_SQL}, n as (select area, count(*) as vertices from v group by 1) select s_suppkey as area, n.vertices + 1 as vertices, round(s_suppkey % 7 + 0.31e0, 6) as south, round(s_suppkey % 11 + 0.17e0 + 1.5e0, 6) as east from supplier join n on s_suppkey = n.area""")
def src23(spark, d):
    z = shapes.parts(shape_files(rings(spark, d), F.array(F.concat("ring", F.slice("ring", 1, 1))), shapes.POLYGON))
    z = z.select(F.col("id").alias("area"), F.col("line").alias("ring"))
    return z.select("area", F.size("ring").cast("long").alias("vertices"), F.round(F.array_min(F.transform("ring", lambda p: p["lat"])), 6).alias("south"), F.round(F.array_max(F.transform("ring", lambda p: p["lon"])), 6).alias("east"))


@query("src26_rail_lines", "select s_suppkey as line, part, n_points from supplier, (values (0, 2), (1, 3)) x(part, n_points)")
def src26(spark, d):
    two = F.array(F.slice("ring", 1, 2), F.slice("ring", 3, 1), F.slice("ring", 3, 3))  # the second part is a single point, which is no line
    z = shapes.lines(shapes.parts(shape_files(rings(spark, d), two, shapes.LINE)))
    return z.select(F.col("id").alias("line"), F.col("part").cast("int").alias("part"), F.size("line").alias("n_points"))


@query("tk6_tiers", """with e as (select p_partkey, 0 as tier, p_size as closeness from part where contains(p_name, 'red')), f as (select p_partkey, 1 as tier, p_size from part where contains(p_name, 'e') and not contains(p_name, 'red'))
 select p_partkey, tier from (select * from e union all select * from f) order by tier, closeness desc, p_partkey limit 120""")
def tk6(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name", F.col("p_size").alias("closeness"))
    return search.tiered(p.filter(F.contains("p_name", F.lit("red"))), p.filter(F.contains("p_name", F.lit("e"))), "p_partkey", 120, F.desc("closeness"), F.col("p_partkey")).select("p_partkey", "tier")


@query("geo1b_polygons", f"{RINGS} select area, cy::bigint as cy, cx::bigint as cx from e, g where (ay > py) <> (by_ > py) and px < (bx - ax) * (py - ay) / (by_ - ay) + ax group by 1, 2, 3 having count(*) % 2 = 1")
def geo1b(spark, d):
    return tracks.polygon_cells(rings(spark, d).withColumnRenamed("id", "area"), 0.25)
