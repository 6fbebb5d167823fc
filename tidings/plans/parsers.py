"""Parsers run over documents that are written from the given tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import text as tx
from tidings.functions.geo import cosines_km
from tidings.operators import tracks
from tidings.plans.registry import query
from tidings.sources import feeds, pages, sensors
from tidings.streaming import flows
from tidings.tables import Tables


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("src4_rss", "select p_brand as source, 'https://a.example/' || p_partkey as url, 'A headline of good length about ' || p_name as title, 'Body & more' as summary, epoch(timestamp '2026-03-03 10:00:00')::bigint as at from part")
def src4(spark, d):
    p = Tables(spark, d).part
    item = text("<item><title><![CDATA[A headline of good length about ", F.col("p_name"), " | Site]]></title><link>https://a.example/", F.col("p_partkey"), "</link><description>&lt;p&gt;Body &amp;amp; more&lt;/p&gt;</description><pubDate>Tue, 3 Mar 2026 10:00:00 GMT</pubDate></item>")
    docs = p.select(F.col("p_brand").alias("source"), text("<rss><channel>", item, "<item><title></title></item></channel></rss>").alias("xml"))
    return feeds.rss(docs).select("source", "url", "title", "summary", F.unix_seconds("published_at").alias("at"))


@query("src5_bills", "select 'https://www.congress.gov/bill/' || (p_size + 90) || case when (p_size + 90) % 100 between 11 and 13 then 'th' when (p_size + 90) % 10 = 1 then 'st' when (p_size + 90) % 10 = 2 then 'nd' when (p_size + 90) % 10 = 3 then 'rd' else 'th' end || '-congress/house-bill/' || p_partkey || '#2026-02-01' as url, 'HR ' || p_partkey || ': ' || p_name as title from part")
def src5(spark, d):
    b = F.struct(F.lit("HR").alias("type"), F.col("p_partkey").cast("string").alias("number"), (F.col("p_size") + 90).alias("congress"), F.col("p_name").alias("title"), F.struct(F.lit("2026-02-01").alias("actionDate"), F.lit("Passed").alias("text")).alias("latestAction"))
    return feeds.bills(Tables(spark, d).part.select(F.to_json(F.struct(F.array(b).alias("bills"))).alias("json"))).select("url", "title")


@query("src6_votes", "select p_partkey::varchar as number, p_name as title, 'Agreed' as result, p_size || ' to ' || (100 - p_size) as tally from part")
def src6(spark, d):
    c = F.col
    xml = text("<votes><vote><vote_number>", c("p_partkey"), "</vote_number><title>", c("p_name"), " </title><result>Agreed</result><vote_tally><yeas>", c("p_size"), "</yeas><nays>", 100 - c("p_size"), "</nays></vote_tally></vote></votes>")
    return feeds.votes(Tables(spark, d).part.select(xml.alias("xml")))


@query("src7_register", "select 'https://r.example/' || p_partkey as url, p_name as title, epoch(timestamp '2026-02-01')::bigint as at, p_brand as agency from part")
def src7(spark, d):
    r = F.struct(F.col("p_name").alias("title"), text("https://r.example/", F.col("p_partkey")).alias("html_url"), F.lit("An <b>abstract</b>").alias("abstract"), F.lit("2026-02-01").alias("publication_date"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("agencies"))
    out = feeds.register(Tables(spark, d).part.select(F.to_json(F.struct(F.array(r).alias("results"))).alias("json")))
    return out.select("url", "title", F.unix_seconds("published_at").alias("at"), F.col("entities")[0].alias("agency"))


@query("src9_src11_channel_posts", "select 'c' || user_id as channel, event_id as id, 'A first line of post ' || event_id as title, event_id * 100 as views from events where event_id > user_id * 20 and ts > (select max(ts) from events) - interval 48 hour")
def src9(spark, d):
    e = Tables(spark, d).events
    html = text('<div data-post="c/', F.col("event_id"), '"><div class="message_text">A first line of post ', F.col("event_id"), '<br>more</div><span class="message_views">', F.format_string("%.1f", F.col("event_id") / 10.0), 'K</span><time datetime="', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+00:00"></time></div>')
    posts = pages.channel_posts(e.select(text("c", F.col("user_id")).alias("channel"), html.alias("html")))
    last = e.select("user_id").distinct().select(text("c", F.col("user_id")).alias("channel"), (F.col("user_id") * 20).alias("id"))
    now = e.agg(F.max("ts").alias("now"))
    return pages.post_items(posts.join(F.broadcast(now)), last, F.col("now")).select("channel", "id", "title", "views")


@query("src19_feature_class", "select p_partkey, case p_partkey % 4 when 0 then 'occupied' when 1 then 'attack' when 2 then 'liberated' end as category, (p_size * 22.5e0) - floor(p_size * 22.5e0 / 360e0) * 360e0 as bearing from part")
def src19(spark, d):
    k = F.col("p_partkey") % 4
    props = F.to_json(F.struct(F.when(k == 1, "Attack direction").otherwise("Area").alias("name"), F.when(k == 2, "#0F9D58").otherwise("#ffffff").alias("fill"), F.when(k == 0, "{occupied}").otherwise("").alias("description")))
    kind = sensors.feature_class(props, {"{occupied}": "occupied"}, [("(?i)attack", "attack")], {"#0f9d58": "liberated"})
    return Tables(spark, d).part.select("p_partkey", kind.alias("category"), sensors.icon_bearing(text("arrow_", F.col("p_size"))).alias("bearing"))


@query("src21_control_marks", "select p_partkey + 0.5e0 as lat, -p_size::double as lon, p_name as label from part")
def src21(spark, d):
    lua = text("marks = { { lat = ", F.col("p_partkey"), '.5, long = -', F.col("p_size"), ', mark = "Dot red.svg", marksize = "6", label = "', F.col("p_name"), '" }, { long = 1 } }')
    return sensors.control_marks(Tables(spark, d).part.select(lua.alias("text"))).select("lat", "lon", "label")


@query("src27_crossings", "select c_custkey as crossing, c_nationkey::double as lat from customer")
def src27(spark, d):
    t = Tables(spark, d)
    waits = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("crossing"), text(F.col("n_name"), " - Bridge ", F.col("c_custkey")).alias("name"), F.lit("b").alias("border"))
    towns = t.nation.select(F.col("n_name").alias("town"), F.lit("b").alias("border"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    return sensors.crossings(waits, towns).select("crossing", "lat")


@query("sf4_embed_text", "select page_id, md5('Page ' || page_id || '. ' || html[1:300]) as digest from pages")
def sf4(spark, d):
    t = tx.embed_text(text("BREAKING: Page ", F.col("page_id")), F.col("html"), ["breaking"])
    return Tables(spark, d).pages.select("page_id", F.md5(t.cast("binary")).alias("digest"))


#: Frequent short words that tell four languages apart.
FREQUENT = {"en": ["the", "and", "of", "to", "that"], "de": ["der", "die", "und", "das", "von"], "fr": ["les", "des", "et", "une", "dans"], "es": ["los", "las", "una", "con", "por"]}


COUNTS = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in words)}))) as {lang}" for lang, words in FREQUENT.items())


@query("sf6_language_by_words", f"""with w as (select doc_id, text, string_split_regex(lower(text), '[^\\pL]+') as w from documents), n as (select doc_id, length(text) as size, {COUNTS} from w)
 select doc_id, case when size < 12 or greatest(en, de, fr, es) = 0 then null when en = greatest(en, de, fr, es) then 'en' when de = greatest(en, de, fr, es) then 'de' when fr = greatest(en, de, fr, es) then 'fr' else 'es' end as language from n""")
def sf6(spark, d):
    return Tables(spark, d).documents.select("doc_id", tx.language_by_words(F.col("text"), FREQUENT).alias("language"))


AREA = "pow(0.25e0 * 111.195e0, 2) * cos(radians((cy + 0.5e0) * 0.25e0))"
NEAR = "6371e0 * acos(least(1e0, greatest(-1e0, sin(radians((cy + 0.5e0) * 0.25e0)) * sin(radians(3.1e0)) + cos(radians((cy + 0.5e0) * 0.25e0)) * cos(radians(3.1e0)) * cos(radians(4.1e0 - (cx + 0.5e0) * 0.25e0))))) <= 200"


@query("geo4_taken_nearby", f"""with b(area, s, w) as (select (s_nationkey % 3)::bigint, (s_suppkey % 7)::double, (s_suppkey % 11)::double from supplier), g as (select cy, cx from unnest(range(-10, 60)) y(cy), unnest(range(-10, 60)) x(cx)),
 o as (select distinct area, cy, cx from g, b where (cy + 0.5e0) * 0.25e0 >= s and (cy + 0.5e0) * 0.25e0 < s + 1.5e0 and (cx + 0.5e0) * 0.25e0 >= w and (cx + 0.5e0) * 0.25e0 < w + 1.5e0),
 n as (select distinct area, cy, cx from g, b where (cy + 0.5e0) * 0.25e0 >= s and (cy + 0.5e0) * 0.25e0 < s + 1.5e0 and (cx + 0.5e0) * 0.25e0 >= w + 0.5e0 and (cx + 0.5e0) * 0.25e0 < w + 2e0)
 select area, round(sum({AREA}), 4) as km2 from (select * from n except select * from o) where {NEAR} group by 1""")
def geo4(spark, d):
    from tidings.plans.movement import boxes

    here = lambda c: c.filter(cosines_km((F.col("cy") + 0.5) * 0.25, (F.col("cx") + 0.5) * 0.25, F.lit(3.1), F.lit(4.1)) <= 200)
    old, new = here(tracks.cover(boxes(spark, d, 0.0), 0.25)), here(tracks.cover(boxes(spark, d, 0.5), 0.25))
    return tracks.changes(old, new, 0.25, ("area",)).filter("change = 'gained'").select("area", F.round("km2", 4).alias("km2"))


@query("st1_st6_clamped_stream", "select event_id, floor(epoch(least(ts, timestamp '2024-01-20')))::bigint as at from events")
def st1(spark, d):
    s = flows.clamped(flows.file_stream(spark, d, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return flows.drained(s.select("event_id", F.unix_seconds("ts").alias("at")))
