"""Read queries that put operators together: the globe, one story, the state of the newsroom."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import graph, rollup, similarity
from tidings.plans.aggregates import STORIES
from tidings.plans.registry import query
from tidings.plans.relations import PAIRS, vectors
from tidings.tables import Tables


def globe(tables: Tables, hours: int, least: float, limit: int, link_at: float):
    """Stories seen in the last hours, and the links among them (two tables)."""
    s = rollup.stories(tables.items()).join(F.broadcast(tables.latest()))
    s = rollup.seen_between(s, F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(hours)), F.col("as_of"), least)
    top = s.orderBy(F.desc("significance"), F.desc("items"), "story_id").limit(limit).select("story_id", "items", "outlets", "significance")
    e = graph.related(similarity.similar_pairs(tables.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), link_at), 6)
    ids = top.select("story_id")
    links = e.join(ids.withColumnRenamed("story_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("story_id", "b"), "b", "left_semi")
    return top, links


@query("view_globe_links", f"""with {STORIES}, {PAIRS.format(least=0.3)}, top as (select story_id from s, a where last_seen >= as_of - interval 48 hour and first_seen <= as_of and significance >= 1 order by significance desc, items desc, story_id limit 100),
 t as (select a as node, b as other, sim from p union all select b, a, sim from p), k as (select *, row_number() over (partition by node order by sim desc, other) as r from t),
 g as (select distinct least(node, other) as a, greatest(node, other) as b, sim as weight from k where r <= 6) select a, b, weight from g where a in (select story_id from top) and b in (select story_id from top)""")
def view_globe_links(spark, d):
    return globe(Tables(spark, d), 48, 1.0, 100, 0.3)[1].select("a", "b", "weight")


@query("view_story", "select user_id as story_id, event_id, event_type, floor(epoch(ts))::bigint as at from events where user_id = 7 order by ts desc, event_id limit 12")
def view_story(spark, d):
    e = Tables(spark, d).events.filter("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(12)
    return e.select(F.col("user_id").alias("story_id"), "event_id", "event_type", F.unix_seconds("ts").alias("at"))


@query("view_globe_stories", f"with {STORIES} select story_id, items, outlets, significance from s, a where last_seen >= as_of - interval 24 hour and first_seen <= as_of and significance >= 1.2 order by significance desc, items desc, story_id limit 1500")
def view_globe_stories(spark, d):
    return globe(Tables(spark, d), 24, 1.2, 1500, 0.35)[0]


@query("view_newsroom_agents", """select c.role as agent, count(*) as reports, count(distinct conv_id) as threads, max(turn) as longest, (select count(*) from conversations x where x.role = c.role and x.text is null) as empty from conversations c group by 1""")
def view_newsroom_agents(spark, d):
    return Tables(spark, d).conversations.groupBy(F.col("role").alias("agent")).agg(F.count("*").alias("reports"), F.countDistinct("conv_id").alias("threads"), F.max("turn").alias("longest"), F.count_if(F.col("text").isNull()).alias("empty"))


@query("tr10_quiet_runs", """with x as (select conv_id, turn, case when length(text) < 120 then 0 else 1 end as loud from conversations), m as (select conv_id, max(turn) as last, coalesce(max(turn) filter (where loud = 1), -1) as last_loud from x group by 1) select conv_id, last - last_loud as quiet, last - last_loud >= 3 as retire from m""")
def tr10(spark, d):
    loud = F.length("text") >= 120
    g = Tables(spark, d).conversations.groupBy("conv_id").agg(F.max("turn").alias("last"), F.coalesce(F.max(F.when(loud, F.col("turn"))), F.lit(-1)).alias("loud"))
    return g.select("conv_id", (F.col("last") - F.col("loud")).alias("quiet"), (F.col("last") - F.col("loud") >= 3).alias("retire"))
