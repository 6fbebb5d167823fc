"""Clusters, places, reviews and predicates that the other modules leave, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import text as tx
from tidings.functions.vectors import cosine, mean_vectors, scaled
from tidings.operators import cluster, places, review
from tidings.plans.registry import query
from tidings.plans.relations import PAIRS, vectors
from tidings.tables import Tables


@query("cl1_online_clusters")
def cl1(spark, d):
    e = Tables(spark, d).embeddings
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 600)
    return cluster.online(e.select(F.col("label").cast("long").alias("shard"), F.col("vec_id").alias("item"), at.alias("at"), F.col("embedding").alias("v")), 0.3)


#: Pairs in order (confirmed ones first, without split ones), then one step for each: st holds what is gone, the merges and the sizes by now.
MERGES = f"""{PAIRS.format(least=0.35)}, c0 as (select user_id as id, count(*) as n from events group by 1), cnt as (select list(coalesce(c0.n, 1) order by vec_id) as c, min(vec_id) as low from embeddings left join c0 on c0.id = vec_id),
 e0 as (select vec_id as a, vec_id + 5 as b, null::double as sim from embeddings where vec_id % 50 = 0 and vec_id + 5 <= (select max(vec_id) from embeddings) union all select a, b, sim from p),
 e as (select a, b, sim, row_number() over (order by sim is not null, case when sim is null then a end, case when sim is null then b end, sim desc, a desc, b desc) as k from e0 where (a + b) % 7 <> 0),
 st as (select 0::bigint as k, []::bigint[] as gone, []::struct(gone bigint, kept bigint, sim double, k bigint)[] as m, c from cnt union all
  select st.k + 1, case when ok then list_append(gone, dropped) else gone end, case when ok then list_append(m, struct_pack(gone := dropped, kept := keep, sim := sim, k := st.k + 1)) else m end, case when ok then list_transform(c, lambda x, i: case when i = keep - low + 1 then x + c[dropped - low + 1] else x end) else c end
  from st, cnt as z(c_, low), lateral (select *, case when ca >= cb then a else b end as keep, case when ca >= cb then b else a end as dropped, not list_contains(gone, a) and not list_contains(gone, b) and (sim is null or sim >= least(0.35e0 + 0.08e0, 0.35e0 + 0.015e0 * log2(greatest(least(ca, cb), 1)))) as ok
   from (select e.*, c[e.a - low + 1] as ca, c[e.b - low + 1] as cb from e where e.k = st.k + 1) e1) e2),
 f as (select unnest(m, recursive := true) from (select m from st order by k desc limit 1)), g1 as (select gone, kept from f where sim is null union all select gone, kept from (select * from f where sim is not null order by k limit 500)),
 w(gone, kept) as (select gone, kept from g1 union select w.gone, g1.kept from w join g1 on g1.gone = w.kept), g as (select gone, kept from w where kept not in (select gone from g1))"""


def merges(spark, d):
    v = vectors(spark, d)
    sizes = Tables(spark, d).events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    confirmed = v.filter("id % 50 = 0").select(F.col("id").alias("a"), (F.col("id") + 5).alias("b")).join(v.select(F.col("id").alias("b")), "b", "left_semi")
    return cluster.first_merges(v, sizes, 0.35, confirmed, lambda t: t.filter("(a + b) % 7 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


@query("cl3b_greedy_merges", f"with recursive {MERGES} select gone, kept from g")
def cl3b(spark, d):
    return merges(spark, d)


@query("cl4_absorbed", f"with recursive {MERGES}, x as (select least(coalesce(g1.kept, p.a), coalesce(g2.kept, p.b)) as a, greatest(coalesce(g1.kept, p.a), coalesce(g2.kept, p.b)) as b from p left join g g1 on p.a = g1.gone left join g g2 on p.b = g2.gone) select distinct a, b from x where a <> b")
def cl4(spark, d):
    return cluster.absorbed_pairs(vectors(spark, d), 0.35, merges(spark, d))


@query("cl5_detached", "select case when event_type = 'error' and value > 90 then -event_id else user_id end as story_id, count(*) as items from events group by 1")
def cl5(spark, d):
    t = Tables(spark, d).items()
    out = cluster.detached(t, t.filter("outlet = 'error' and value > 90").select("item_id"))
    return out.groupBy("story_id").agg(F.count("*").alias("items"))


CENTRE = "select story, list_transform(range(0, 64), lambda i: list_extract(list(x order by place), i + 1)) as m from (select story, place, avg(x) as x from (select case when vec_id % 50 = 0 then -vec_id else label end as story, unnest(range(0, 64)) as place, unnest(embedding)::double as x from embeddings) group by 1, 2) group by 1"


@query("cl5b_centroids_after_splits", f"with c as ({CENTRE}) select story, i as place, round(m[i + 1] / sqrt(list_dot_product(m, m)), 6) as x from c, unnest(range(0, 64)) r(i)")
def cl5b(spark, d):
    """Detached items are stories of their own; the centroids of all stories are computed anew, at length 1."""
    e = Tables(spark, d).embeddings.select(F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("story_id"), "embedding")
    out = cluster.detached(e, e.filter("item_id % 50 = 0").select("item_id"))
    m = mean_vectors(out, ["story_id"], "embedding").select(F.col("story_id").alias("story"), F.posexplode(scaled(F.col("mean"))).alias("place", "x"))
    return m.select("story", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("gr7_citations", """with l as (select distinct l_suppkey as url, (l_partkey % 97) as cites from lineitem), r as (select s_suppkey as root from supplier), u as (select root, root as url, 0 as depth from r union all select root, cites, 1 from r join l on l.url = root
 union all select root, y.cites, 2 from r join l x on x.url = root join l y on y.url = x.cites) select root, url, min(depth)::int as depth from u group by 1, 2""")
def gr7(spark, d):
    t = Tables(spark, d)
    links = t.lineitem.select(F.col("l_suppkey").alias("url"), (F.col("l_partkey") % 97).alias("cites")).distinct()
    return cluster.cited(t.supplier.select(F.col("s_suppkey").alias("root")), links)


@query("geo7_regions", "select c_custkey, case when lat between 0 and 30 and lon between -50 and 50 and c_nationkey in (1, 2, 3) then 'south' when lat between 20 and 60 and lon between -90 and 90 and c_nationkey in (3, 4, 5) then 'north' end as region from (select *, ((c_custkey * 37) % 121 - 60) as lat, ((c_custkey * 71) % 341 - 170) as lon from customer)")
def geo7(spark, d):
    c = Tables(spark, d).customer
    lat, lon = (F.col("c_custkey") * 37) % 121 - 60, (F.col("c_custkey") * 71) % 341 - 170
    regions = {"south": ((0, -50, 30, 50), ["1", "2", "3"]), "north": ((20, -90, 60, 90), ["3", "4", "5"])}
    return c.select("c_custkey", places.region_of(lat, lon, F.col("c_nationkey").cast("string"), regions).alias("region"))


COS = "6371e0 * acos(least(1e0, greatest(-1e0, sin(radians(lat)) * sin(radians(la)) + cos(radians(lat)) * cos(radians(la)) * cos(radians(lo - lon)))))"


@query("geo8_geocode", f"""with p as (select p_name as sp, p_partkey as k, (p_partkey % 50)::double as lat, (p_partkey % 90)::double as lon, p_size * case when p_partkey % 40 = 0 then 100000 else 100 end as pop from part), a as (select distinct p_name as ask from part),
 j as (select ask, k, lat, lon, pop, row_number() over w as n, lead(pop) over w as nxt, first_value(lat) over w as la, first_value(lon) over w as lo from a join p on sp = ask window w as (partition by ask order by pop desc, k)),
 f as (select *, max({COS}) over (partition by ask) as far from j) select ask, case when nxt is null or (pop >= 20000 and pop >= 10e0 * nxt) or far <= 25 then k end as key from f where n = 1""")
def geo8(spark, d):
    part = Tables(spark, d).part
    k = F.col("p_partkey")
    p = part.select(F.col("p_name").alias("spelling"), F.lit("x").alias("country"), F.lit("y").alias("province"), k.alias("key"), (k % 50).cast("double").alias("lat"), (k % 90).cast("double").alias("lon"), (F.col("p_size") * F.when(k % 40 == 0, 100000).otherwise(100)).alias("population"))
    asks = part.select(F.col("p_name").alias("ask")).distinct().select("ask", F.col("ask").alias("spelling"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("province"))
    return places.geocoded(asks, p)


@query("geo10_geo11_by_priority", "select c_custkey, case when c_nationkey % 3 = 0 then 'site' when c_nationkey % 3 = 1 then 'town' else 'country' end as how, case when c_nationkey % 3 = 0 then 1.5e0 when c_nationkey % 3 = 1 then 2.5e0 else 3.5e0 end as lat from customer")
def geo10(spark, d):
    c = Tables(spark, d).customer
    level = lambda rows, how, lat: rows.select("c_custkey", F.lit(lat).alias("lat"), F.lit(0.0).alias("lon"), F.lit(how).alias("how"))
    return places.by_priority("c_custkey", level(c.filter("c_nationkey % 3 = 0"), "site", 1.5), level(c.filter("c_nationkey % 3 < 2"), "town", 2.5), level(c, "country", 3.5)).select("c_custkey", "how", "lat")


@query("sf12_cosine", "select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def sf12(spark, d):
    v = vectors(spark, d)
    j = v.select(F.col("id").alias("a"), F.col("v").alias("va")).join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("v").alias("vb")), "a")
    return j.select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("sf15_place_evidence", """select l_orderkey, l_linenumber, round(case when l_linenumber = 1 then 3e0 when l_returnflag = 'N' then 1e0 when l_linestatus = 'F' and l_tax > 0.04 then 0.1e0 when l_linestatus = 'F' and l_discount > 0.05 then greatest(0.25e0, 1e0 - 0.2e0 * (l_linenumber - 1)) * 0.2e0
 else greatest(0.25e0, 1e0 - 0.2e0 * (l_linenumber - 1)) end + case when l_suppkey % 5 = 0 then 0.3e0 else 0e0 end, 3) as weight from lineitem""")
def sf15(spark, d):
    c = F.col
    w = places.evidence(c("l_returnflag") != "N", c("l_linenumber") - 1, c("l_linenumber") == 1, c("l_linestatus") != "F", c("l_tax") > 0.04, c("l_discount") > 0.05, c("l_suppkey") % 5 == 0)
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", w.alias("weight"))


@query("sf16_sf17_places_in_text", """with n as (select lower(n_name) as spelling, 'cc:' || n_nationkey as key from nation), t as (select c_custkey, lower('news from ' || n_name || ' and ' || r_name || ' today') as x from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
 select c_custkey as id, key from t join n on contains(' ' || replace(x, ',', ' ') || ' ', ' ' || spelling || ' ')""")
def sf16(spark, d):
    t = Tables(spark, d)
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("News from "), "n_name", F.lit(" and "), "r_name", F.lit(" today.")).alias("text"))
    countries = t.nation.select(F.col("n_nationkey").cast("string").alias("iso"), F.col("n_name").alias("name"))
    none = spark.createDataFrame([], "key string, name string, country string, population long")
    names = places.gazetteer(none, countries, spark.createDataFrame([], "spelling string, key string, kind string, country string"))
    return places.found_places(texts, names).select("id", "key")


@query("sf18_country_of_domain", r"select page_id, case regexp_extract(url, '//[^/?#:]*\.([a-z]+)', 1) when 'org' then 'OO' when 'uk' then 'GB' else null end as country from pages")
def sf18(spark, d):
    p = Tables(spark, d).pages.select("page_id", F.element_at(F.split(tx.domain(F.col("url")), r"\."), -1).alias("tld"))
    return p.join(F.broadcast(spark.createDataFrame([("org", "OO"), ("uk", "GB")], "tld string, country string")), "tld", "left").select("page_id", "country")


@query("sf25_learned_adjustment", "select c_custkey, case when c_nationkey % 2 = 0 and c_nationkey % 3 = 0 then 0.6e0 * (c_nationkey / 25e0 - 0.5e0) / 2 when c_nationkey % 2 = 0 then 0.6e0 * (c_nationkey / 25e0) when c_nationkey % 3 = 0 then -0.3e0 else 0e0 end as adjustment from customer")
def sf25(spark, d):
    n = F.col("c_nationkey")
    return Tables(spark, d).customer.select("c_custkey", review.learned_adjustment(F.when(n % 2 == 0, n / 25.0), F.when(n % 3 == 0, F.lit(0.5))).alias("adjustment"))


@query("sf26_level_score", "select p_partkey, round((1 * 0.25e0 + 2 * 0.25e0 + 3 * (p_size / 100e0)) / (0.5e0 + p_size / 100e0) - case when p_partkey % 2 = 0 then 1 else 0 end * 1e0, 6) + case when p_partkey % 2 = 1 then 0 else 0 end as score from part where p_partkey % 2 = 0 union all select p_partkey, round((0 * 0.25e0 + 1 * 0.25e0 + 2 * (p_size / 100e0)) / (0.5e0 + p_size / 100e0), 6) from part where p_partkey % 2 = 1")
def sf26(spark, d):
    lv = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(0)
    m = F.map_from_arrays(F.array(lv, lv + 1, lv + 2), F.array(F.lit(0.25), F.lit(0.25), F.col("p_size") / 100.0))
    return Tables(spark, d).part.select("p_partkey", F.round(review.level_score(m), 6).alias("score"))


@query("sf33_exact_spot", "select c_custkey, case when c_custkey % 2 = 0 then 50.1234e0 end as lat from customer")
def sf33(spark, d):
    text = F.when(F.col("c_custkey") % 2 == 0, "at 10.0001, 20.0001 and 50.1234, 30.5678 they said").otherwise("at 1.0 2.0, or 40.1234 30.5678")
    return Tables(spark, d).customer.select("c_custkey", review.exact_spot(text, F.lit(50.1), F.lit(30.5))["lat"].alias("lat"))


@query("sf34_quotes", "select c_custkey, c_custkey % 4 = 0 as ok from customer")
def sf34(spark, d):
    k = F.col("c_custkey") % 4
    quote = F.when(k == 0, "explosions were heard in Kharkovi tonight").when(k == 1, "drones flying towards Kharkov region").when(k == 2, "something in Kharkov that no one wrote").otherwise("short")
    post = F.lit("Explosions were heard in Kharkovi tonight! Drones flying towards Kharkov region. short")
    ok = review.quote_stands(quote, post, F.array(F.lit("Kharkov")), "(?i)flying|heading", "(?i)hit|explosion")
    return Tables(spark, d).customer.select("c_custkey", ok.alias("ok"))


@query("sf35_event_day", "select o_orderkey, strftime(case when o_orderkey % 5 in (1, 2, 3) then cast(o_orderdate as date) - (o_orderkey % 5)::int else cast(o_orderdate as date) end, '%Y-%m-%d') as day from orders")
def sf35(spark, d):
    said = F.when(F.col("o_orderkey") % 5 < 4, F.date_format(F.date_sub("o_orderdate", (F.col("o_orderkey") % 5).cast("int")), "yyyy-MM-dd")).otherwise("not a day")
    return Tables(spark, d).orders.select("o_orderkey", F.date_format(review.event_day(said, F.col("o_orderdate")), "yyyy-MM-dd").alias("day"))


@query("tr5_desk_review", """with v as (select l_partkey as story_id, arg_max(case l_returnflag when 'R' then 'none' when 'A' then 'moved' else 'kept' end, l_orderkey * 10 + l_linenumber) as d, arg_max(l_linestatus = 'F', l_orderkey * 10 + l_linenumber) as sure from lineitem group by 1)
 select p_partkey as story_id, case when coalesce(sure, false) and d <> 'none' then d else p_type end as desk, case when coalesce(sure, false) then d <> 'none' else p_size > 25 end as routed from part left join v on p_partkey = v.story_id""")
def tr5(spark, d):
    t = Tables(spark, d)
    desk = F.when(F.col("l_returnflag") == "R", "none").when(F.col("l_returnflag") == "A", "moved").otherwise("kept")
    v = t.lineitem.select(F.col("l_partkey").alias("story_id"), desk.alias("desk"), (F.col("l_linestatus") == "F").alias("sure"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return review.reviewed(t.part.select(F.col("p_partkey").alias("story_id"), F.col("p_type").alias("desk"), (F.col("p_size") > 25).alias("routed")), v)


@query("tr6_relocated", """with v as (select l_partkey as story_id, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) as judged from lineitem where l_discount >= 0.06 group by 1) select p_partkey as story_id, case when p_size > 40 or judged is null then -1 else judged end as place from part left join v on p_partkey = v.story_id""")
def tr6(spark, d):
    t = Tables(spark, d)
    v = t.lineitem.select(F.col("l_partkey").alias("story_id"), F.col("l_suppkey").alias("place"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    s = t.part.select(F.col("p_partkey").alias("story_id"), F.lit(-1).cast("long").alias("place"), (F.col("p_size") > 40).alias("locked"))
    return review.relocated(s, v).select("story_id", "place")


@query("flt13_needs_work", """with s as (select user_id as story_id, count(*) as items from events group by 1), d as (select user_id as story_id, count(*) as t from events where ts < timestamp '2024-01-15' and user_id % 3 <> 0 group by 1)
 select s.story_id, items from s left join d using (story_id) where t is null or items >= 2 * t or items >= t + 10 order by items desc, s.story_id limit 60""")
def flt13(spark, d):
    e = Tables(spark, d).events
    s = e.groupBy(F.col("user_id").alias("story_id")).agg(F.count("*").alias("items"))
    done = e.filter("ts < timestamp '2024-01-15' and user_id % 3 <> 0").groupBy(F.col("user_id").alias("story_id")).agg(F.count("*").alias("items"))
    return review.needs_work(s, done, 60)


@query("tr7_clean_answers", "select p_partkey, case p_partkey % 3 when 0 then case when p_type = 'PROMO' then 'promo' end when 1 then case when p_size < 6 then p_size::varchar end else lower(p_name) end as answer from part")
def tr7(spark, d):
    k = F.col("p_partkey") % 3
    aspect = F.when(k == 0, "desk").when(k == 1, "significance").otherwise("place")
    said = F.when(k == 0, F.concat(F.lit(" "), "p_type", F.lit("!"))).when(k == 1, F.when(F.col("p_size") < 6, F.col("p_size").cast("string")).otherwise("high")).otherwise(F.upper("p_name"))
    return Tables(spark, d).part.select("p_partkey", review.clean_answer(aspect, said, ["promo"]).alias("answer"))


@query("flt6_flt9_flt10_flt11_words", r"""select doc_id, regexp_matches(text, '(?i)\b(the|and)\b') as words, regexp_matches(text, '(?i)\bthe\b') and regexp_matches(text, '(?i)\band\b') as both, case when regexp_matches(text, '(?i)\bpathetic\b') then 'abuse' when regexp_matches(text, '(?i)\blicense') then 'legal' end as kind from documents""")
def flt6(spark, d):
    t = F.col("text")
    kind = F.when(t.rlike(r"(?i)\bpathetic\b"), "abuse").when(t.rlike(r"(?i)\blicense"), "legal")
    return Tables(spark, d).documents.select("doc_id", t.rlike(r"(?i)\b(the|and)\b").alias("words"), (t.rlike(r"(?i)\bthe\b") & t.rlike(r"(?i)\band\b")).alias("both"), kind.alias("kind"))


@query("flt14_null_safe", "select event_id from events where nullif(event_type, 'view') is distinct from case when value > 50 then 'click' end")
def flt14(spark, d):
    a, b = F.nullif(F.col("event_type"), F.lit("view")), F.when(F.col("value") > 50, "click")
    return Tables(spark, d).events.filter(~a.eqNullSafe(b)).select("event_id")


@query("ag24_channel_stats", """with p as (select event_id, user_id, ts, value from events where event_type = 'click'), o as (select p.event_id, count(distinct e.event_type) as outlets, min(e.ts) as first from p join events e on e.user_id = p.user_id and e.event_type <> 'click' and e.ts > p.ts and e.ts <= p.ts + interval 48 hour group by 1)
 select p.user_id, count(*) as posts, count(o.event_id) as corroborated, count(*) filter (where outlets >= 2) as early, round(percentile_cont(0.5) within group (order by epoch(first - p.ts) / 60e0) filter (where o.event_id is not null), 3) as median_lead from p left join o using (event_id) group by 1""")
def ag24(spark, d):
    e = Tables(spark, d).events
    p = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    others = e.filter("event_type <> 'click'").select(F.col("user_id").alias("u"), F.col("event_type").alias("outlet"), F.col("ts").alias("t"))
    # a post meets its user's reports of its own span of 48 hours and the next one, not all of them
    span = lambda c: F.floor(F.unix_micros(c) / (48 * 3_600_000_000)).cast("long")
    spread = p.withColumn("span", F.explode(F.array(span("ts"), span("ts") + 1)))
    near = spread.join(others.withColumnRenamed("u", "user_id").withColumn("span", span("t")), ["user_id", "span"])
    o = near.filter((F.col("t") > F.col("ts")) & (F.col("t") <= F.col("ts") + F.expr("interval 48 hours"))).groupBy("event_id").agg(F.countDistinct("outlet").alias("outlets"), F.min("t").alias("first"))
    j = p.join(o, "event_id", "left").withColumn("lead", (F.unix_micros("first") - F.unix_micros("ts")) / 6e7)
    return j.groupBy("user_id").agg(F.count("*").alias("posts"), F.count("first").alias("corroborated"), F.count_if(F.col("outlets") >= 2).alias("early"), F.round(F.percentile("lead", F.lit(0.5)), 3).alias("median_lead"))


@query("sf30_sf31_json_and_time", "select event_id, (props->>'k')::bigint + 1 as k, floor(epoch(date_trunc('hour', ts)))::bigint as hour, (props->>'none') is null as missing from events")
def sf30(spark, d):
    return Tables(spark, d).events.select("event_id", (F.variant_get(F.parse_json("props"), "$.k", "bigint") + 1).alias("k"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("hour"), F.try_variant_get(F.parse_json("props"), "$.none", "string").isNull().alias("missing"))


@query("ud1_sql_functions", "select p_partkey, floor(least(5e0, 0.4e0 * least(5e0, p_size / 10e0) + least(3e0, 0.45e0 * ln(1e0 + p_size) / ln(2e0) + 0.1e0 * least(greatest(p_partkey % 9 - 1, 0), 5))) * 100e0 + 0.5e0) / 100e0 as significance from part")
def ud1(spark, d):
    """Significance as a SQL function."""
    spark.sql("""create or replace temporary function tidings_significance(importance double, sources bigint, countries bigint) returns double
      return floor(least(5d, 0.4d * greatest(0d, least(5d, importance)) + least(3d, 0.45d * ln(1d + sources) / ln(2d) + 0.1d * least(greatest(countries - 1, 0), 5))) * 100d + 0.5d) / 100d""")
    return Tables(spark, d).part.select("p_partkey", F.expr("tidings_significance(p_size / 10d, p_size, p_partkey % 9)").alias("significance"))


@query("tk7_digest_order", "select doc_id from documents order by lang <> 'en', source, n_chars desc, doc_id limit 14")
def tk7(spark, d):
    return Tables(spark, d).documents.orderBy(F.col("lang") != "en", "source", F.desc("n_chars"), "doc_id").limit(14).select("doc_id")


@query("snk5_replace_partitions", "select event_type, count(*) as n from events where event_type <> 'view' group by 1 union all select 'view', count(*) from events where event_type = 'view' and value > 50")
def snk5(spark, d):
    import uuid

    from tidings.operators.graph import shared_folder
    from tidings.operators.sinks import replace_partitions

    e = Tables(spark, d).events
    path = f"{shared_folder(spark)}/partitions-{uuid.uuid4().hex}"
    replace_partitions(e.select("event_id", "event_type"), path, "event_type")
    replace_partitions(e.filter("event_type = 'view' and value > 50").select("event_id", "event_type"), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))
