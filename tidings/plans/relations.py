"""Joins, similarity, clusters and graphs, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.functions import geo
from tidings.functions.scoring import join_needs
from tidings.functions.vectors import merged_centroid, mean_vectors, norm
from tidings.operators import cluster, graph, joins, similarity
from tidings.plans.registry import query
from tidings.tables import Tables

#: Coordinates by formula from the key, the same in SQL.
LAT, LON = "(({0} * 37) % 121 - 60)::double", "(({0} * 71) % 341 - 170)::double"
HAV = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
PAIRS = """p as (select x.vec_id as a, y.vec_id as b, round(list_dot_product(x.embedding::double[], y.embedding::double[]), 6) as sim
 from embeddings x join embeddings y on x.vec_id < y.vec_id where list_dot_product(x.embedding::double[], y.embedding::double[]) >= {least}e0)"""


def coordinates(key):
    return ((F.col(key) * 37) % 121 - 60).cast("double"), ((F.col(key) * 71) % 341 - 170).cast("double")


def points(df, key, prefix=""):
    lat, lon = coordinates(key)
    return df.select(F.col(key).cast("long").alias(f"{prefix}id"), lat.alias(f"{prefix}lat"), lon.alias(f"{prefix}lon"))


def vectors(spark, d):
    return Tables(spark, d).embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("jn1_inner", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 100000")
def jn1(spark, d):
    t = Tables(spark, d)
    o = t.orders.filter("o_totalprice > 100000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("o_orderkey", "c_name", "n_name")


@query("jn2_left", "select c_custkey, count(o_orderkey) as orders, round(sum(o_totalprice), 2) as spent from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'O' group by 1")
def jn2(spark, d):
    t = Tables(spark, d)
    o = t.orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "spent")


@query("jn3_anti", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def jn3(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("jn4_semi", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority like '1%')")
def jn4(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.filter("o_orderpriority like '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("jn5_jn14_independent_coverage", """select e.event_id, count(distinct o.event_type) as outlets from events e join events o on o.user_id = e.user_id and o.event_type <> 'click' and o.event_id <> e.event_id
 and o.ts >= e.ts + interval 10 minute and o.ts <= e.ts + interval 48 hour where e.event_type = 'click' group by 1""")
def jn5(spark, d):
    e = Tables(spark, d).events
    posts = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    others = e.filter("event_type <> 'click'").select(F.col("user_id").alias("u"), F.col("event_type").alias("outlet"), F.col("ts").alias("t"))
    # times meet by spans of 48 hours: what follows a post lies in its own span or the next one
    span = lambda c: F.floor(F.unix_seconds(c) / 172_800)
    others = others.withColumn("span", F.explode(F.array(span("t"), span("t") - 1)))
    j = posts.withColumn("at", span("ts")).join(others, (F.col("user_id") == F.col("u")) & (F.col("at") == F.col("span")))
    j = j.filter((F.col("t") >= F.col("ts") + F.expr("interval 10 minutes")) & (F.col("t") <= F.col("ts") + F.expr("interval 48 hours")))
    return j.groupBy("event_id").agg(F.countDistinct("outlet").alias("outlets"))


@query("jn6_neighbours", f"with {PAIRS.format(least=0.35)} select node, count(*) as degree, max(sim) as best from (select a as node, sim from p union all select b, sim from p) group by 1")
def jn6(spark, d):
    return joins.both_ways(similarity.similar_pairs(vectors(spark, d), 0.35)).groupBy("node").agg(F.count("*").alias("degree"), F.max("sim").alias("best"))


@query("jn7_similarity_join", f"with {PAIRS.format(least=0.35)} select * from p")
def jn7(spark, d):
    return similarity.similar_pairs(vectors(spark, d), 0.35)


#: Where bands of sign bits pay: 256 buckets for each of 48 bands.
LSH = 0.6


def versions(spark, d):
    """The vectors, and beside each a version of it that leans towards the next one."""
    v = vectors(spark, d).select("id", F.col("v").cast("array<double>").alias("v"))
    j = v.join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w")), "id")
    m = j.select((F.col("id") + 1_000_000).alias("id"), F.zip_with("v", "w", lambda x, y: x + 0.75 * y).alias("v"))
    return v.unionByName(m.select("id", F.transform("v", lambda x: x / norm(F.col("v"))).alias("v")))


@query("jn7b_similarity_join_lsh")
def jn7b(spark, d):
    return similarity.similar_pairs_lsh(versions(spark, d), LSH, 64)


@query("jn7c_pairs_in_window", f"with {PAIRS.format(least=0.3)} select * from p where b - a <= 432")
def jn7c(spark, d):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600)  # 432 steps of ten minutes are 72 hours
    return similarity.similar_pairs_in_window(vectors(spark, d).withColumn("at", at), 0.3, 72)


@query("jn8_nearest_neighbours", """with s as (select q.vec_id as id, x.vec_id as other, round(list_dot_product(q.embedding::double[], x.embedding::double[]), 6) as sim from embeddings q join embeddings x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0),
 r as (select *, row_number() over (partition by id order by sim desc, other) as rank from s) select id, other, sim, rank::int as rank from r where rank <= 5""")
def jn8(spark, d):
    v = vectors(spark, d)
    return similarity.top_neighbours(v, v.filter("id % 100 = 0"), 5)


@query("jn9_as_of", """with r as (select e.event_id, e.user_id, s.event_id as snap, row_number() over (partition by e.event_id order by s.ts desc, s.event_id desc) as k
 from events e left join events s on s.user_id = e.user_id and s.event_type = 'view' and s.ts <= e.ts where e.event_type = 'purchase') select event_id, user_id, snap from r where k = 1""")
def jn9(spark, d):
    e = Tables(spark, d).events
    probes = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    snaps = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("snap"))
    return joins.as_of(probes, snaps, ["user_id"], "ts", "at", ["snap"]).select("event_id", "user_id", "snap")


@query("jn10_distance_join", f"select c_custkey as id, s_suppkey as r_id, round({HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) as km from (select c_custkey, {LAT.format('c_custkey')} as lat, {LON.format('c_custkey')} as lon from customer) a, (select s_suppkey, {LAT.format('s_suppkey')} as lat, {LON.format('s_suppkey')} as lon from supplier) b where {HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 300")
def jn10(spark, d):
    t = Tables(spark, d)
    p = joins.within_km(points(t.customer, "c_custkey"), points(t.supplier, "s_suppkey", "r_"), 300.0, geo.haversine_km)
    return p.select("id", "r_id", F.round("km", 3).alias("km"))


@query("jn11_nearest_point", f"""with x as (select c_custkey as id, s_suppkey as r_id, {HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from (select c_custkey, {LAT.format('c_custkey')} as lat, {LON.format('c_custkey')} as lon from customer) a, (select s_suppkey, {LAT.format('s_suppkey')} as lat, {LON.format('s_suppkey')} as lon from supplier) b),
 r as (select *, row_number() over (partition by id order by round(km, 6), r_id) as k from x where km <= 500) select id, r_id, round(km, 3) as km from r where k = 1""")
def jn11(spark, d):
    t = Tables(spark, d)
    dist = lambda *x: F.round(geo.haversine_km(*x), 6)
    return joins.nearest_within(points(t.customer, "c_custkey"), points(t.supplier, "s_suppkey", "r_"), 500.0, dist, "id", "r_id").select("id", "r_id", F.round("km", 3).alias("km"))


CO = """m as (select distinct l_orderkey as g, l_partkey as e from lineitem), f as (select e from m group by 1 having count(*) between 2 and 40), n as (select m.* from m join f using (e)),
 c as (select x.g as a, y.g as b, count(*) as shared from n x join n y on x.e = y.e and x.g < y.g group by 1, 2 having count(*) >= 2)"""


@query("jn15_gr2_same_actor", f"with {CO} select a, b, shared, least(1e0, shared / 4e0) as weight from c")
def jn15(spark, d):
    c = joins.co_occurring(Tables(spark, d).lineitem, "l_orderkey", "l_partkey", 2, 40, 2)
    return c.withColumn("weight", F.least(F.lit(1.0), F.col("shared") / 4.0))


@query("gr2b_same_actor_evidence", """with m as (select distinct l_suppkey as g, l_partkey as e from lineitem), d as (select e from m group by 1 having count(*) between 2 and 15), k as (select g, e from m join d using (e))
 select a.g as a, b.g as b, count(*) as shared, array_to_string(list(a.e order by a.e)[1:8], ',') as evidence from k a join k b on a.e = b.e and a.g < b.g group by 1, 2 having count(*) >= 2""")
def gr2b(spark, d):
    """Suppliers of the same parts, with the first eight parts that tie them."""
    c = joins.co_occurring(Tables(spark, d).lineitem, "l_suppkey", "l_partkey", 2, 15, 2, evidence=8)
    return c.withColumn("evidence", F.array_join("evidence", ","))


@query("jn16_excluded_pairs", f"with {PAIRS.format(least=0.35)} select a, b, sim from p where (a + b) % 7 <> 0")
def jn16(spark, d):
    p = similarity.similar_pairs(vectors(spark, d), 0.35)
    splits = p.filter("(a + b) % 7 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return joins.without_pairs(p, splits)


@query("jn17_scalar_subqueries", "select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select max(s_acctbal) from supplier where s_nationkey = n_nationkey) as top from nation")
def jn17(spark, d):
    t = Tables(spark, d)
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("top"))
    return t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), "top")


@query("ag19_mean_vectors", "select label, i as place, round(avg(x), 9) as mean from (select label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings) group by 1, 2")
def ag19(spark, d):
    m = mean_vectors(Tables(spark, d).embeddings, ["label"], "embedding")
    return m.select("label", F.posexplode("mean").alias("place", "mean")).select("label", F.col("place").cast("long").alias("place"), F.round("mean", 9).alias("mean"))


@query("ag20_merged_centroid", """with m as (select a.vec_id as a, b.vec_id as b, list_transform(range(1, 65), lambda i: a.embedding[i]::double * 3 + b.embedding[i]::double * 2) as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
 select a, b, round(sqrt(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))))), 6) as length, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first from m""")
def ag20(spark, d):
    v = vectors(spark, d)
    j = v.select(F.col("id").alias("a"), F.col("v").alias("va")).join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("v").alias("vb")), "a")
    m = j.select("a", "b", merged_centroid(F.col("va"), F.lit(3), F.col("vb"), F.lit(2)).alias("v"))
    return m.select("a", "b", F.round(norm(F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@query("cl2_components", f"""with recursive {PAIRS.format(least=0.35)}, e as (select a as x, b as y from p union select b, a from p),
 r(x, y) as (select vec_id, vec_id from embeddings union select r.x, e.y from r join e on e.x = r.y) select x as node, min(y) as label from r group by 1""")
def cl2(spark, d):
    v = vectors(spark, d)
    return graph.components(v.select(F.col("id").alias("node")), similarity.similar_pairs(v, 0.35))


@query("cl3_merge_candidates", f"""with {PAIRS.format(least=0.3)}, s as (select user_id as id, count(*) as n from events group by 1), q as (select p.*, coalesce(x.n, 1) as na, coalesce(y.n, 1) as nb from p left join s x on x.id = a left join s y on y.id = b)
 select a, b, sim, case when na >= nb then a else b end as keep from q where sim >= least(0.3e0 + 0.08e0, 0.3e0 + 0.015e0 * log2(greatest(least(na, nb), 1)))""")
def cl3(spark, d):
    sizes = Tables(spark, d).events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return cluster.merge_candidates(vectors(spark, d), sizes, 0.3)


@query("cl6_duplicate_candidates", f"with {PAIRS.format(least=0.3)} select a, b, sim from p where sim < 0.45e0 + 0.08e0 and (a * 31 + b) % 5 <> 0 order by sim desc, a, b limit 40")
def cl6(spark, d):
    p = similarity.similar_pairs(vectors(spark, d), 0.3)
    checked = p.filter("(a * 31 + b) % 5 = 0").select("a", "b")
    return joins.without_pairs(p.filter(F.col("sim") < 0.53), checked).orderBy(F.desc("sim"), "a", "b").limit(40)


RELATED = f"""{PAIRS.format(least=0.35)}, t as (select a as node, b as other, sim from p union all select b, a, sim from p),
 k as (select *, row_number() over (partition by node order by sim desc, other) as r from t), g as (select distinct least(node, other) as a, greatest(node, other) as b, sim as weight from k where r <= 2)"""


@query("gr1_tk2_related", f"with {RELATED} select * from g")
def gr1(spark, d):
    return graph.related(similarity.similar_pairs(vectors(spark, d), 0.35), 2)


@query("gr3_gr6_edge_life", f"""with {RELATED}, ag as (select vec_id as a, vec_id + 3 as b, case when vec_id % 2 = 0 then 'causes' else 'gossip' end as kind, 1e0 as weight from embeddings where vec_id % 9 = 0),
 u as (select a, b, 'related' as kind, weight from g union all select a, b, kind, weight from ag where kind = 'causes') select a, b, kind, weight from u where (a + b) % 11 <> 0""")
def gr3(spark, d):
    v = vectors(spark, d)
    rules = graph.related(similarity.similar_pairs(v, 0.35), 2).select("a", "b", F.lit("related").alias("kind"), "weight")
    agents = v.filter("id % 9 = 0").select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"), F.when(F.col("id") % 2 == 0, "causes").otherwise("gossip").alias("kind"), F.lit(1.0).alias("weight"))
    rejected = rules.select("a", "b").union(agents.select("a", "b")).filter("(a + b) % 11 = 0")
    return graph.current_edges(rules, agents, rejected)


@query("gr4_bfs", f"""with recursive {PAIRS.format(least=0.35)}, t as (select a as node, b as other, sim from p union all select b, a, sim from p),
 k as (select *, row_number() over (partition by node order by sim desc, other) as r from t), e as (select node, other from k where r <= 12),
 b(root, node, depth) as (select vec_id, vec_id, 0 from embeddings where vec_id % 100 = 0 union select b.root, e.other, b.depth + 1 from b join e on e.node = b.node where b.depth < 3) select root, node, min(depth)::int as depth from b group by 1, 2""")
def gr4(spark, d):
    v = vectors(spark, d)
    p = similarity.similar_pairs(v, 0.35).withColumnRenamed("sim", "weight")
    return graph.neighbourhood(p, v.filter("id % 100 = 0").select(F.col("id").alias("node")), 3)


@query("gr5_entities_that_tie", """with m as (select distinct l_suppkey as s, l_partkey as e from lineitem), c as (select e, count(*) as n from m group by 1), r as (select m.s, m.e, c.n, row_number() over (partition by m.s order by c.n desc, m.e) as k from m join c using (e))
 select s as story, e as entity, n as stories from r where n >= 2 or k <= 3""")
def gr5(spark, d):
    m = Tables(spark, d).lineitem.select(F.col("l_suppkey").alias("story"), F.col("l_partkey").alias("entity")).distinct()
    m = m.join(m.groupBy("entity").agg(F.count("*").alias("stories")), "entity")
    k = F.row_number().over(Window.partitionBy("story").orderBy(F.desc("stories"), "entity"))
    return m.withColumn("k", k).filter((F.col("stories") >= 2) | (F.col("k") <= 3)).select("story", "entity", "stories")


@query("sf13_join_needs", "select p_size as size, least(0.75e0 + 0.05e0, 0.75e0 + 0.015e0 * log2(greatest(p_size, 1))) as need from part group by 1")
def sf13(spark, d):
    return Tables(spark, d).part.select(F.col("p_size").alias("size")).distinct().select("size", join_needs(0.75, F.col("size")).alias("need"))


@query("tr13_related_reports", """with q as (select * from embeddings where vec_id = 0), n as (select x.vec_id as id, round(list_dot_product(x.embedding::double[], q.embedding::double[]), 6) as sim from embeddings x, q where x.vec_id <> 0),
 u as (select vec_id as id, 1e0 as sim from embeddings where label = (select label from q) and vec_id <> 0 union all select * from (select id, sim from n where sim >= 0.2e0 order by sim desc, id limit 40)) select id, max(sim) as score from u group by 1""")
def tr13(spark, d):
    t = Tables(spark, d)
    e = t.embeddings
    q = e.filter("vec_id = 0")
    near = similarity.top_neighbours(vectors(spark, d), q.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 40).filter(F.col("sim") >= 0.2).select(F.col("other").alias("id"), "sim")
    same = e.filter("vec_id <> 0").join(q.select("label"), "label", "left_semi").select(F.col("vec_id").alias("id"), F.lit(1.0).alias("sim"))
    return same.unionByName(near).groupBy("id").agg(F.max("sim").alias("score"))
