"""Aggregates, windows, filters, sorts and set operations, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.functions.scoring import half_up
from tidings.operators import rollup
from tidings.plans.registry import query
from tidings.tables import Tables

STORIES = """
i as (select event_id as item_id, user_id as story_id, event_type as outlet, ts as published_at, value, props from events),
st as (select story_id, count(*) as items, count(distinct outlet) as outlets, min(published_at) as first_seen,
              max(published_at) as last_seen, avg(value) as importance from i group by story_id),
s as (select *, floor(least(5e0, 0.4e0 * greatest(0e0, least(5e0, importance / 100e0))
              + least(3e0, 0.45e0 * ln(1e0 + outlets) / ln(2e0))) * 100e0 + 0.5e0) / 100e0 as significance from st),
a as (select max(ts) as as_of from events)
"""
#: Weights of places of a story: customers' nations as places of market segments.
WEIGHTS = """
w as (select c_mktsegment as story_id, c_nationkey::bigint as place, case when c_nationkey % 5 = 0 then 'country' else 'city' end as kind,
             count(*)::double as weight from customer group by 1, 2, 3)
"""


def epoch(c):
    return F.unix_seconds(c).alias(c)


@query("ag1_story_rollup", f"with {STORIES} select story_id, items, outlets, floor(epoch(first_seen))::bigint as first_seen, floor(epoch(last_seen))::bigint as last_seen, round(importance, 10) as importance, significance from s")
def story_rollup(spark, d):
    s = rollup.stories(Tables(spark, d).items())
    return s.select("story_id", "items", "outlets", epoch("first_seen"), epoch("last_seen"), F.round("importance", 10).alias("importance"), "significance")


@query("flt1_tk1_top_stories", f"""with {STORIES} select story_id, items, outlets, significance from s, a
 where last_seen >= as_of - interval 72 hour and first_seen <= as_of and significance >= 1 order by significance desc, items desc, story_id limit 50""")
def top_stories(spark, d):
    t = Tables(spark, d)
    s = rollup.stories(t.items()).join(F.broadcast(t.latest()))
    s = rollup.seen_between(s, F.col("as_of") - F.expr("interval 72 hours"), F.col("as_of"), 1.0)
    return s.orderBy(F.desc("significance"), F.desc("items"), "story_id").limit(50).select("story_id", "items", "outlets", "significance")


@query("flt2_desk_filter", "select count(*) as n, count(o_orderstatus) as named from (select nullif(o_orderstatus, 'P') as o_orderstatus from orders) where o_orderstatus in ('F') or o_orderstatus is null")
def desk_filter(spark, d):
    o = Tables(spark, d).orders.select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("desk"))
    return rollup.in_desks(o, ["F", "none"]).agg(F.count("*").alias("n"), F.count("desk").alias("named"))


@query("flt3_title_search", "select p_partkey, p_name from part where p_name ilike '%RED%' and p_name ilike '%wid%' or p_type ilike '%promo%'")
def title_search(spark, d):
    return Tables(spark, d).part.filter(F.col("p_name").ilike("%RED%") & F.col("p_name").ilike("%wid%") | F.col("p_type").ilike("%promo%")).select("p_partkey", "p_name")


@query("flt5_about_place", f"with {WEIGHTS}, x as (select story_id, place, weight / sum(weight) over (partition by story_id) as share from w) select story_id, place, floor(share * 1e6 + 0.5e0) / 1e6 as share from x where share >= 0.045e0")
def about_place(spark, d):
    return rollup.about_place(place_weights(spark, d), 0.045)


def place_weights(spark, d):
    c = Tables(spark, d).customer
    kind = F.when(F.col("c_nationkey") % 5 == 0, "country").otherwise("city")
    return c.groupBy(F.col("c_mktsegment").alias("story_id"), F.col("c_nationkey").cast("long").alias("place"), kind.alias("kind")).agg(F.count("*").cast("double").alias("weight"))


@query("ag2_place_weights", "select c_mktsegment as story_id, c_nationkey::bigint as place, round(sum(c_acctbal), 4) as weight from customer group by 1, 2")
def ag2(spark, d):
    return Tables(spark, d).customer.groupBy(F.col("c_mktsegment").alias("story_id"), F.col("c_nationkey").cast("long").alias("place")).agg(F.round(F.sum("c_acctbal"), 4).alias("weight"))


@query("ag3_any_flag", "select user_id as story_id, bool_or(event_type = 'error') as any_error, bool_and(value > 0) as all_positive from events group by 1")
def ag3(spark, d):
    return Tables(spark, d).events.groupBy(F.col("user_id").alias("story_id")).agg(F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_and(F.col("value") > 0).alias("all_positive"))


@query("ag4_countries_above_weight", f"with {WEIGHTS}, x as (select story_id, place, weight / sum(weight) over (partition by story_id) as share from w) select story_id, count(distinct place) filter (where share > 0.04e0) as countries from x group by 1")
def ag4(spark, d):
    w = place_weights(spark, d)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("story_id"))
    return w.withColumn("share", share).groupBy("story_id").agg(F.countDistinct(F.when(F.col("share") > 0.04, F.col("place"))).alias("countries"))


@query("ag5_filtered_counts", """select event_type, count(*) as n, count(*) filter (where value > 50) as high, count(distinct user_id) filter (where value > 50) as high_users,
 count(distinct user_id) as users from events group by 1""")
def ag5(spark, d):
    high = F.col("value") > 50
    return Tables(spark, d).events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.countDistinct(F.when(high, F.col("user_id"))).alias("high_users"), F.countDistinct("user_id").alias("users"))


@query("ag6_breaking", f"""with {STORIES}, g as (select story_id, count(*) filter (where published_at > as_of - interval 24 hour) as last_hour,
 count(*) filter (where published_at <= as_of - interval 24 hour and published_at > as_of - interval 24 hour - interval 240 hour) as prior_day,
 count(distinct outlet) filter (where published_at > as_of - interval 24 hour - interval 240 hour) as outlets, max(published_at) as last_seen, any_value(as_of) as as_of
 from i, a where published_at <= as_of group by story_id)
 select story_id, last_hour, prior_day, outlets, last_hour >= 3 and outlets >= 3 and last_hour >= 1.2e0 * greatest(prior_day / 24e0, 1e0) and not last_seen < as_of - interval 25 hour as breaking,
 case when last_seen < as_of - interval 25 hour then 0 else last_hour end as velocity from g""")
def ag6(spark, d):
    t = Tables(spark, d)
    return rollup.breaking(t.items(), t.latest(), last="24 hours", prior="240 hours", least_items=3, least_outlets=3, times=1.2)


@query("ag7_median_lead", "select event_type, percentile_cont(0.5) within group (order by value) filter (where value > 10) as median_value from events group by 1")
def ag7(spark, d):
    Tables(spark, d).events.createOrReplaceTempView("tidings_events")
    return spark.sql("select event_type, percentile_cont(0.5) within group (order by value) filter (where value > 10) as median_value from tidings_events group by 1")


MODE = "n as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from n)"


@query("ag8_mode", f"with {MODE} select user_id, event_type, n from r where k = 1")
def ag8(spark, d):
    return rollup.most_common(Tables(spark, d).events, ["user_id"], "event_type")


@query("ag9_ordered_lists", """select user_id, string_agg(distinct event_type, ',' order by event_type) as types, count(distinct event_type) as n_types,
 arg_max(event_type, event_id) as last_type from events group by 1""")
def ag9(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.countDistinct("event_type").alias("n_types"), F.max_by("event_type", "event_id").alias("last_type"))


@query("ag10_place_nodes", """with m as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2), r as (select *, row_number() over (partition by c_nationkey order by n desc, c_mktsegment) as k from m),
 g as (select c_nationkey, count(distinct c_custkey) as stories, round(sum(c_acctbal), 4) as weight, max(c_acctbal) as top, bool_or(c_acctbal < 0) as hot from customer group by 1)
 select n_name, stories, weight, top, hot, r.c_mktsegment as desk from g join r using (c_nationkey) join nation on c_nationkey = n_nationkey where k = 1""")
def ag10(spark, d):
    t = Tables(spark, d)
    c = t.customer
    g = c.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("stories"), F.round(F.sum("c_acctbal"), 4).alias("weight"), F.max("c_acctbal").alias("top"), F.bool_or(F.col("c_acctbal") < 0).alias("hot"))
    m = rollup.most_common(c, ["c_nationkey"], "c_mktsegment").select("c_nationkey", F.col("c_mktsegment").alias("desk"))
    return g.join(m, "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "stories", "weight", "top", "hot", "desk")


@query("ag11_timeline", """with e as (select min(epoch(ts)) as lo, max(epoch(ts)) + 1e-6 as hi from events)
 select floor((epoch(ts) - lo) / (hi - lo) * 48)::bigint as bucket, event_type, count(*) as n, count(*) filter (where value > 50) as flagged from events, e group by 1, 2""")
def ag11(spark, d):
    return rollup.histogram(Tables(spark, d).events, "ts", "event_type", 48, F.col("value") > 50)


@query("ag12_discovery", "select user_id, count(distinct event_type) as sources, count(*) filter (where event_type = 'click') as forwards from events group by 1 having count(distinct event_type) >= 5 or count(*) filter (where event_type = 'click') >= 16")
def ag12(spark, d):
    g = Tables(spark, d).events.groupBy("user_id").agg(F.countDistinct("event_type").alias("sources"), F.count_if(F.col("event_type") == "click").alias("forwards"))
    return g.filter((F.col("sources") >= 5) | (F.col("forwards") >= 16))


@query("ag13_readiness", "select conv_id, count(distinct role) as desks, count(*) as reports from conversations group by 1 having count(distinct role) >= 3 or count(*) >= 6")
def ag13(spark, d):
    g = Tables(spark, d).conversations.groupBy("conv_id").agg(F.countDistinct("role").alias("desks"), F.count("*").alias("reports"))
    return g.filter((F.col("desks") >= 3) | (F.col("reports") >= 6))


@query("ag14_trailing_weeks", """with d as (select o_orderpriority as key, cast(o_orderdate as date) as day, count(*) as n from orders group by 1, 2),
 l as (select key, max(day) as last from d group by 1), x as (select d.*, last - day as age from d join l using (key)),
 g as (select key, (sum(n) filter (where age < 7))::bigint as week, count(*) filter (where age < 7) as week_days, sum(n) filter (where age >= 7 and age < 63) / 8e0 as normal,
 (sum(n) filter (where age >= 364 and age < 371))::bigint as last_year from x group by 1),
 p as (select *, case when normal > 0 then floor(100e0 * (week - normal) / normal + 0.5e0) end as change_pct from g)
 select *, coalesce(abs(change_pct) >= 25 and week_days >= 5, false) as unusual from p""")
def ag14(spark, d):
    o = Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return rollup.trailing_weeks(o)


@query("ag15_port_change", """with l as (select max(cast(l_shipdate as date)) as last from lineitem), g as (select l_suppkey, count(*) filter (where last - cast(l_shipdate as date) < 28) as calls_week,
 count(*) filter (where last - cast(l_shipdate as date) between 28 and 251) / 8e0 as calls_normal from lineitem, l group by 1),
 p as (select *, case when calls_normal >= 1 then floor(100e0 * (calls_week - calls_normal) / calls_normal + 0.5e0) end as change_pct from g)
 select *, coalesce(calls_normal >= 7 and abs(change_pct) >= 40, false) as unusual from p""")
def ag15(spark, d):
    li = Tables(spark, d).lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("day"))
    age = F.datediff("last", "day")
    g = li.join(F.broadcast(li.agg(F.max("day").alias("last")))).groupBy("l_suppkey").agg(F.count_if(age < 28).alias("calls_week"), (F.count_if(age.between(28, 251)) / 8.0).alias("calls_normal"))
    return rollup.port_change(g)


@query("ag16_usage", """select event_type as agent, epoch(date_trunc('day', ts + interval 3 hour))::bigint as day, round(sum(value), 4) as tokens, count(*) as runs,
 count(*) filter (where value > 50) as big from events group by 1, 2""")
def ag16(spark, d):
    day = F.unix_seconds(F.date_trunc("day", F.from_utc_timestamp("ts", "GMT+3"))).alias("day")
    return Tables(spark, d).events.groupBy(F.col("event_type").alias("agent"), day).agg(F.round(F.sum("value"), 4).alias("tokens"), F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("big"))


@query("ag17_scorecard", """select d.source, count(*) as checked, count(*) filter (where quality = 0) as wrong, count(*) filter (where toxic = 1) as unsure,
 round(count(*) filter (where quality = 0) / count(*)::double, 6) as error_rate from labels l join documents d using (doc_id) group by 1""")
def ag17(spark, d):
    t = Tables(spark, d)
    wrong = F.count_if(F.col("quality") == 0)
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("checked"), wrong.alias("wrong"), F.count_if(F.col("toxic") == 1).alias("unsure"), F.round(wrong / F.count("*"), 6).alias("error_rate"))


@query("ag18_confusions", """with x as (select o_orderstatus as was, case when o_totalprice > 150000 then 'F' else 'O' end as should_be from orders)
 select was, should_be, count(*) as n from x where was <> should_be group by 1, 2 order by n desc, was, should_be limit 20""")
def ag18(spark, d):
    x = Tables(spark, d).orders.select(F.col("o_orderstatus").alias("was"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("should_be"))
    return x.filter("was <> should_be").groupBy("was", "should_be").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "was", "should_be").limit(20)


@query("ag18b_upper_median", """with x as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events)
 select event_type, max(value) filter (where k = n // 2 + 1) as median, min(value) as least, max(value) as most from x group by 1""")
def ag18b(spark, d):
    upper = F.expr("percentile_disc(0.5) within group (order by value desc)")
    return Tables(spark, d).events.groupBy("event_type").agg(upper.alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("ag21_global_stats", """select (select count(*) from events) as items, (select count(distinct user_id) from events) as stories, (select count(*) from documents) as texts,
 (select count(*) from pages) as pages, (select count(distinct lang) from documents) as languages""")
def ag21(spark, d):
    t = Tables(spark, d)
    one = lambda df, c, n: df.agg(c.alias(n))
    parts = [one(t.events, F.count("*"), "items"), one(t.events, F.countDistinct("user_id"), "stories"), one(t.documents, F.count("*"), "texts"), one(t.pages, F.count("*"), "pages"), one(t.documents, F.countDistinct("lang"), "languages")]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


@query("ag22_ops_report", """select 'day' as section, strftime(ts, '%Y-%m-%d') as item, count(*) as n from events group by 1, 2
 union all select 'kind', event_type, count(*) from events group by 1, 2 union all select 'language', lang, count(*) from documents group by 1, 2
 union all select 'desk', c_mktsegment, count(*) from customer group by 1, 2""")
def ag22(spark, d):
    t = Tables(spark, d)
    part = lambda df, section, c: df.groupBy(F.lit(section).alias("section"), c.alias("item")).agg(F.count("*").alias("n"))
    return part(t.events, "day", F.date_format("ts", "yyyy-MM-dd")).union(part(t.events, "kind", F.col("event_type"))).union(part(t.documents, "language", F.col("lang"))).union(part(t.customer, "desk", F.col("c_mktsegment")))


@query("ag23_wn3_top_entities", """with n as (select l_suppkey as story_id, l_partkey as entity, count(*) as n from lineitem group by 1, 2),
 r as (select *, row_number() over (partition by story_id order by n desc, entity) as k from n) select story_id, entity, n from r where k <= 5""")
def ag23(spark, d):
    n = Tables(spark, d).lineitem.groupBy(F.col("l_suppkey").alias("story_id"), F.col("l_partkey").alias("entity")).agg(F.count("*").alias("n"))
    return rollup.first_by(n, ["story_id"], F.desc("n"), F.col("entity"), n=5).select("story_id", "entity", "n")


@query("ag25_event_summary", """with m as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2)
 select l_suppkey, sum(n)::bigint as hits, coalesce(sum(n) filter (where l_returnflag = 'R'), 0)::bigint as intercepted, string_agg(l_returnflag || ':' || n, ',' order by l_returnflag) as weapons from m group by 1""")
def ag25(spark, d):
    m = Tables(spark, d).lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))), lambda x: F.concat_ws(":", x["l_returnflag"], x["n"])), ",")
    return m.groupBy("l_suppkey").agg(F.sum("n").alias("hits"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("n"))), F.lit(0)).alias("intercepted"), listed.alias("weapons"))


@query("wn1_primary_place", f"""with {WEIGHTS}, r as (select *, sum(weight) over (partition by story_id) as total, row_number() over (partition by story_id order by weight desc, (kind = 'country'), place) as k from w)
 select story_id, place, weight, floor(weight / total * 1000e0 + 0.5e0) / 1000e0 as confidence from r where k = 1 and weight > 0.15""")
def wn1(spark, d):
    return rollup.primary_place(place_weights(spark, d))


@query("wn2_first_items", "with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events) select user_id, event_id, k as rank from r where k <= 3")
def wn2(spark, d):
    r = rollup.first_by(Tables(spark, d).events, ["user_id"], F.col("ts"), F.col("event_id"), n=3)
    return r.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("wn4_headline_by_tier", """with r as (select source, doc_id, lang, row_number() over (partition by source order by list_position(['en', 'de', 'fr', 'es'], lang), n_chars desc, doc_id) as k from documents) select source, doc_id, lang from r where k = 1""")
def wn4(spark, d):
    tier = F.array_position(F.array(*map(F.lit, ("en", "de", "fr", "es"))), F.col("lang"))
    return rollup.first_by(Tables(spark, d).documents.select("source", "doc_id", "lang", "n_chars"), ["source"], tier, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "lang")


@query("wn5_latest_feedback", "select user_id, arg_max(value, event_id) as value from events where event_type in ('click', 'error') group by 1")
def wn5(spark, d):
    return Tables(spark, d).events.filter(F.col("event_type").isin("click", "error")).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("wn6_distinct_titles", "with r as (select conv_id, role, turn, row_number() over (partition by conv_id, role order by text is not null desc, turn desc) as k from conversations) select conv_id, role, turn from r where k = 1")
def wn6(spark, d):
    return rollup.first_by(Tables(spark, d).conversations, ["conv_id", "role"], F.col("text").isNotNull().desc(), F.desc("turn")).select("conv_id", "role", "turn")


@query("wn10_same_state_since", """with x as (select user_id, event_type, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events),
 y as (select *, sum(case when prev is distinct from event_type then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from x),
 z as (select user_id, run, any_value(event_type) as state, min(ts) as since, max(event_id) as m, count(*) as n, max(ts) as upto from y group by 1, 2)
 select user_id, state, floor(epoch(since))::bigint as since, n as reports from (select *, row_number() over (partition by user_id order by run desc) as k from z) where k = 1""")
def wn10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = Tables(spark, d).events.withColumn("new", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    z = x.groupBy("user_id", "run").agg(F.any_value("event_type").alias("state"), F.unix_seconds(F.min("ts")).alias("since"), F.count("*").alias("reports"))
    return z.groupBy("user_id").agg(F.max(F.struct("run", "state", "since", "reports")).alias("z")).select("user_id", "z.state", "z.since", "z.reports")


@query("tk3_boolean_order", "select s_suppkey, s_acctbal from supplier order by (s_acctbal > 0) desc, nullif(s_nationkey, 3) desc nulls last, s_suppkey limit 25")
def tk3(spark, d):
    return Tables(spark, d).supplier.orderBy((F.col("s_acctbal") > 0).desc(), F.nullif(F.col("s_nationkey"), F.lit(3)).desc_nulls_last(), "s_suppkey").limit(25).select("s_suppkey", "s_acctbal")


@query("tk4_stable_sample", "select c_custkey from customer order by (c_custkey * 2654435761) % 4294967296, c_custkey limit 100")
def tk4(spark, d):
    return Tables(spark, d).customer.orderBy((F.col("c_custkey") * F.lit(2654435761)) % F.lit(4294967296), "c_custkey").limit(100).select("c_custkey")


@query("tk5_stratified_sample", """with r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by substr(md5(c_custkey || ':7'), 1, 8), c_custkey) as k from customer) select c_mktsegment, c_custkey from r where k <= 5""")
def tk5(spark, d):
    key = F.substring(F.md5(F.concat_ws(":", "c_custkey", F.lit(7)).cast("binary")), 1, 8)
    return rollup.first_by(Tables(spark, d).customer, ["c_mktsegment"], key, F.col("c_custkey"), n=5).select("c_mktsegment", "c_custkey")


@query("tk8_log_rank", "select l_suppkey, round(log10(1 + count(*)) + case when l_suppkey % 7 = 0 then 2 else 0 end, 6) as rank from lineitem group by l_suppkey")
def tk8(spark, d):
    g = Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return g.select("l_suppkey", F.round(F.log10(1.0 + F.col("n")) + F.when(F.col("l_suppkey") % 7 == 0, 2).otherwise(0), 6).alias("rank"))


@query("so1_union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
def so1(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("so2_union_all", "select 'gained' as side, count(*) as n from orders where o_orderstatus = 'O' union all select 'lost', count(*) from orders where o_orderstatus = 'F'")
def so2(spark, d):
    o = Tables(spark, d).orders
    part = lambda side, s: o.filter(F.col("o_orderstatus") == s).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return part("gained", "O").unionByName(part("lost", "F"))


@query("so4_key_sets", "select 'gone' as side, count(*) as n from (select c_custkey from customer except select o_custkey from orders) union all select 'live', count(*) from (select c_custkey from customer intersect select o_custkey from orders)")
def so4(spark, d):
    t = Tables(spark, d)
    c, o = t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"))
    part = lambda side, how: c.join(o, "c_custkey", how).distinct().agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return part("gone", "left_anti").unionByName(part("live", "left_semi"))


@query("so5_array_distinct", "select conv_id, string_agg(role, ',' order by first_turn) as roles from (select conv_id, role, min(turn) as first_turn from conversations group by 1, 2) group by 1")
def so5(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return Tables(spark, d).conversations.groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))
