"""Text functions, links, triage and search, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import text as tx
from tidings.functions.scoring import band, channel_score
from tidings.operators import search, triage
from tidings.plans.registry import query
from tidings.tables import Tables

STOP = ["the", "and", "of", "to", "in", "de", "la", "der", "die", "et"]
MARKS = "strip_accents(lower({0}))"


def documents(spark, d):
    return Tables(spark, d).documents


@query("sf1_clean", r"""with c as (select page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;?', '&', 'g'), '[\s\x{00a0}]+', ' ', 'g')) as t from pages)
 select page_id, length(t) as n, case when length(t) > 200 then regexp_replace(t[1:200], ' [^ ]*$', '') || '...' else t end as text from c""")
def sf1(spark, d):
    p = Tables(spark, d).pages
    return p.select("page_id", F.length(tx.clean(F.col("html"))).cast("long").alias("n"), tx.clean(F.col("html"), 200).alias("text"))


@query("sf2_clean_title", r"""with t as (select p_partkey, 'The long headline of part ' || p_name || case p_partkey % 4 when 0 then ' | Daily ' || p_brand when 1 then ' - The ' || p_brand || ' Post' when 2 then ' - and more of it' else '' end as t from part)
 select p_partkey, case when p_partkey % 4 in (0, 1) then 'The long headline of part ' || p_name from_ else t end as title from (select p_partkey, t, p_name from t join part using (p_partkey))""".replace("p_name from_ else", "p_name else"))
def sf2(spark, d):
    p = Tables(spark, d).part
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, F.concat(F.lit(" | Daily "), "p_brand")).when(k == 1, F.concat(F.lit(" - The "), "p_brand", F.lit(" Post"))).when(k == 2, " - and more of it").otherwise("")
    return p.select("p_partkey", tx.clean_title(F.concat(F.lit("The long headline of part "), "p_name", tail)).alias("title"))


LEADS = ["(LEAD) ", "BREAKING: [Video] ", "", "UPDATE 2-", "\u3010Extra\u3011 ", "Live updates 3 | (2nd LD) RPT-", "Lead: Watch - Opinion: [1] Factbox: "]


@query("sf3_comparable_title", "select p_partkey, case when p_partkey % 7 = 6 then 'Factbox: ' || p_name else p_name end as title from part")
def sf3(spark, d):
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("p_partkey") % 7 + 1).cast("int"))  # four labels go at most
    return Tables(spark, d).part.select("p_partkey", tx.comparable_title(F.concat(lead, "p_name")).alias("title"))


TITLES = ["Privacy Policy - Example", "404", "Subscriber numbers grow", "World News - The Daily Post", "local headlines", "Senior Data Engineer", "Site engineer", "The nurse who stayed", "Sign in to read", "Loginov wins the race"]


@query("flt7_junk_titles", "select p_partkey, p_partkey % 10 in (0, 1, 3, 4, 5, 6, 8) as junk from part")
def flt7(spark, d):
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return Tables(spark, d).part.select("p_partkey", tx.junk_title(title).alias("junk"))


@query("sf5_phrases", r"""select p_partkey, len(list_distinct(regexp_extract_all(lower(p_name), '\b(?:red widget|widget|red|bolt)\b'))) as n from part""")
def sf5(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.size(tx.phrases_found(F.col("p_name"), ["red", "widget", "red widget", "bolt"])).cast("long").alias("n"))


@query("sf7_folded", f"select doc_id, md5({MARKS.format('text')}) as digest from documents")
def sf7(spark, d):
    return documents(spark, d).select("doc_id", F.md5(tx.folded(F.col("text")).cast("binary")).alias("digest"))


SPELLINGS = "case p_partkey % 4 when 0 then 'Pokrovs''k' when 1 then 'Łódź–Ěščř' when 2 then 'Ёлка' else 'Thị xã Sơn’Tây' end || '  ' || p_name"


@query("sf8_place_key", f"select p_partkey, trim(regexp_replace(regexp_replace(strip_accents(lower({SPELLINGS})), '[''’`ʼ]', '', 'g'), '[^\\pL\\pN_]+', ' ', 'g')) as key from part")
def sf8(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Pokrovs'k").when(k == 1, "Łódź–Ěščř").when(k == 2, "Ёлка").otherwise("Thị xã Sơn’Tây")
    return Tables(spark, d).part.select("p_partkey", tx.place_key(F.concat(name, F.lit("  "), "p_name")).alias("key"))


@query("sf9_query_words", f"""with w as (select item_id, list_filter(string_split_regex({MARKS.format('text')}, '[^\\pL\\pN_]+'), lambda x: x <> '') as w from benchmark), k as (select item_id, w, list_filter(w, lambda x: length(x) >= 2 and x not in ('the','and','of','to','in','de','la','der','die','et')) as k from w)
 select item_id, array_to_string((case when len(k) > 0 then k else w end)[1:8], ' ') as words from k""")
def sf9(spark, d):
    return Tables(spark, d).benchmark.select("item_id", F.array_join(tx.query_words(F.col("text"), STOP), " ").alias("words"))


@query("sf10_word_similarity")
def sf10(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.round(tx.word_similarity_udf(F.lit("wigdet"), F.col("p_name")), 6).alias("similarity"))


@query("sf11_hash_embedding")
def sf11(spark, d):
    e = documents(spark, d).select("doc_id", F.explode(tx.hashed_terms(F.col("text"), STOP)).alias("t")).groupBy("doc_id", "t.place").agg(F.sum("t.sign").alias("x"))
    return e.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.count("*").alias("places"))


@query("sf19_outlet_tier", r"""with u as (select page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^www\.', '') as d from pages), t(suffix, tier) as (values ('example.org', 'A'), ('example.com', 'B'), ('blog.tionsh.example.com', 'S'))
 select page_id, coalesce(arg_max(t.tier, length(t.suffix)), 'U') as tier from u left join t on d = suffix or ends_with(d, '.' || suffix) group by page_id""")
def sf19(spark, d):
    p = Tables(spark, d).pages.select("page_id", F.explode(tx.domain_suffixes(tx.domain(F.col("url")))).alias("suffix"))
    tiers = spark.createDataFrame([("example.org", "A"), ("example.com", "B"), ("blog.tionsh.example.com", "S")], "suffix string, tier string")
    return p.join(F.broadcast(tiers), "suffix", "left").groupBy("page_id").agg(F.coalesce(F.max_by("tier", F.when(F.col("tier").isNotNull(), F.length("suffix"))), F.lit("U")).alias("tier"))


@query("sf23_channel_score", """with s as (select user_id, count(*) as posts, count(*) filter (where event_type = 'view') as routed, count(*) filter (where event_type = 'error') as forwarded, count(*) filter (where event_type = 'purchase') as corroborated,
 count(*) filter (where event_type in ('purchase', 'click')) as evaluable, count(*) filter (where event_type = 'purchase' and value > 50) as early from events group by 1)
 select user_id, floor(1000e0 * (0.35e0 * (corroborated + 1) / (evaluable + 4) + 0.35e0 * (early + 0.5e0) / (corroborated + 3) + 0.2e0 * (routed + 1) / (posts + 3) + 0.1e0 * (1 - forwarded / posts::double)) + 0.5e0) / 10e0 as score from s""")
def sf23(spark, d):
    t = F.col("event_type")
    s = Tables(spark, d).events.groupBy("user_id").agg(
        F.count("*").alias("posts"), F.count_if(t == "view").alias("routed"), F.count_if(t == "error").alias("forwarded"), F.count_if(t == "purchase").alias("corroborated"),
        F.count_if(t.isin("purchase", "click")).alias("evaluable"), F.count_if((t == "purchase") & (F.col("value") > 50)).alias("early"))
    return s.select("user_id", channel_score(*[F.col(c) for c in ("posts", "routed", "forwarded", "corroborated", "evaluable", "early")]).alias("score"))


@query("sf24_band", "select event_id, case when value / 20 >= 4 then 'top' when value / 20 >= 3 then 'high' when value / 20 >= 2 then 'medium' else 'low' end as band from events")
def sf24(spark, d):
    return Tables(spark, d).events.select("event_id", band(F.col("value") / 20).alias("band"))


@query("sf28_compact_count", "select p_partkey, case p_partkey % 3 when 0 then (p_size * 100)::bigint when 1 then (p_size * 1000000)::bigint else null end as n from part")
def sf28(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.format_string("%.1f", F.col("p_size") / 10.0), F.lit("K"))).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit("m"))).otherwise("many")
    return Tables(spark, d).part.select("p_partkey", tx.compact_count(raw).alias("n"))


@query("sf29_name_case", "select p_partkey, 'NATO ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] as name from part")
def sf29(spark, d):
    return Tables(spark, d).part.select("p_partkey", tx.name_case(F.concat(F.lit("NATO  "), F.upper(F.split("p_name", " ")[0])), ["nato", "un"]).alias("name"))


@query("sf32_pasted", r"""with x as (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: length(l) = 0 or length(l) > 2) as l from conversations) select conv_id, turn, md5(trim(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'))) as digest from x""")
def sf32(spark, d):
    return Tables(spark, d).conversations.select("conv_id", "turn", F.md5(tx.pasted(F.col("text")).cast("binary")).alias("digest"))


@query("src14_fetch_status", "select o_orderkey, case when c in (401, 402, 403, 429, 451) then 'blocked' when c <> 200 then 'failed' else 'ok' end as status from (select o_orderkey, 200 + (o_orderkey * 7) % 260 as c from orders)")
def src14(spark, d):
    c = F.lit(200) + (F.col("o_orderkey") * 7) % 260
    return Tables(spark, d).orders.select("o_orderkey", F.when(c.isin(401, 402, 403, 429, 451), "blocked").when(c != 200, "failed").otherwise("ok").alias("status"))


@query("src16_links", r"""select page_id, 'article' as kind, regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', '') as link from pages""")
def src16(spark, d):
    messy = F.concat(F.lit(" "), F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x&gclid=1#top "))
    return Tables(spark, d).pages.select("page_id", tx.link_kind(F.col("url")).alias("kind"), tx.canonical_link(messy).alias("link"))


@query("src17_date_in_link", "select o_orderkey, case when o_orderkey % 4 = 3 then null else strftime(date_trunc('day', o_orderdate + interval 10 year) + interval 12 hour, '%Y-%m-%d %H:%M') end as at from orders")
def src17(spark, d):
    """Dates of all orders, ten years on: a year of two digits is one of this century."""
    day = F.add_months("o_orderdate", 120)
    tail = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy/M/d")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "M-d-yy")).otherwise("99-99-99")
    return Tables(spark, d).orders.select("o_orderkey", F.date_format(tx.date_in_link(F.concat(F.lit("https://a.example/x/"), tail, F.lit("/story?x=1"))), "yyyy-MM-dd HH:mm").alias("at"))


DESKS = [("red", 2, ["red", "widget"]), ("blue", 1, ["blue", "bolt"]), ("ring", 3, ["ring", "small ring"])]


@query("tr1_rules_triage", r"""with k as (select p_partkey as story_id, p_size % 4 as themes, (regexp_matches(p_name, '\bred\b')::int + regexp_matches(p_name, '\bwidget\b')::int) as r, (regexp_matches(p_name, '\bblue\b')::int + regexp_matches(p_name, '\bbolt\b')::int) as b, regexp_matches(p_name, '\bring\b')::int as g from part),
 s as (select story_id, 'red' as desk, 2 as p, case when r > 0 then r + 0.5e0 * least(themes, 3) else 0e0 end as score from k union all select story_id, 'blue', 1, case when b > 0 then b + 0.5e0 * least(themes, 3) else 0e0 end from k union all select story_id, 'ring', 3, case when g > 0 then g + 0.5e0 * least(themes, 3) else 0e0 end from k),
 m as (select *, row_number() over (partition by story_id order by score desc, p desc) as n from s) select story_id, case when score >= 1 then desk end as desk, score, score >= 1.5 as routed from m where n = 1""")
def tr1(spark, d):
    p = Tables(spark, d).part.select(F.col("p_partkey").alias("story_id"), F.col("p_name").alias("text"), (F.col("p_size") % 4).alias("themes"))
    return triage.routed(triage.desk_scores(p, DESKS))


FULL_DESKS = [{"key": "red", "priority": 2, "phrases": ["red", "widget"], "themes": ["WAR"], "countries": ["C1"]}, {"key": "blue", "priority": 1, "phrases": ["blue", "bolt"]}, {"key": "ring", "priority": 3, "phrases": ["ring", "small ring"], "themes": ["TAX", "LAW"], "countries": ["C2", "C3"]}]
OUT = [{"key": "plates", "phrases": ["plate", "hot plate"], "urls": ["/sport/"]}, {"key": "old", "phrases": ["old"], "urls": []}]
HAS = lambda w: rf"regexp_matches(t, '\b{w}\b')::int"


@query("tr1b_full_rules", rf"""with p as (select a.p_partkey as story_id, a.p_name || ', ' || coalesce(b.p_name, '') as t, a.p_partkey % 4 as c, a.p_size % 3 as th, a.p_partkey % 5 as u, a.p_partkey % 3 as tier from part a left join part b on b.p_partkey = a.p_partkey + 1),
 k as (select *, {HAS('red')} + {HAS('widget')} as r, {HAS('blue')} + {HAS('bolt')} as b, {HAS('ring')} * (1 + (regexp_matches(t, 'small ring') and regexp_matches(regexp_replace(t, 'small ring', '', 'g'), '\bring\b'))::int) as g, regexp_matches(regexp_replace(t, 'hot plate', '', 'g'), '\bplate\b')::int + regexp_matches(t, 'hot plate')::int + 3e0 * (case u when 0 then 0 when 1 then 0.5e0 else 1 end) * (u < 3)::int as x1, {HAS('old')}::double as x2, {HAS('gizmo')} + {HAS('large')} as w from p),
 s as (select *, case when r > 0 then least(r, 5) + 0.5e0 * (th > 0)::int + 0.75e0 * (c = 1)::int else 0e0 end as sr, case when b > 0 then least(b, 5)::double else 0e0 end as sb, case when g > 0 then least(g, 5) + 0.5e0 * (th > 1)::int + 0.75e0 * (c in (2, 3))::int else 0e0 end as sg from k),
 m as (select *, greatest(sr, sb, sg) as best, case when sg = greatest(sr, sb, sg) then 'ring' when sr = greatest(sr, sb, sg) then 'red' else 'blue' end as first, case when greatest(x1, x2) >= 1 then case when x1 >= x2 then 'plates' else 'old' end end as o, greatest(x1, x2) as xs from s),
 z as (select *, best >= 1.5 and (o is null or best >= greatest(2.5e0, xs + 0.5e0)) as routed from m)
 select story_id, case when routed or best >= 1 then first end as desk, routed, case when not routed then coalesce(o, 'no_desk_match') end as reason, best as desk_score, round(least(5e0, 1e0 + least(2e0, best / 2.5e0) + 0.75e0 * (th > 1)::int + 0.5e0 * (tier = 0)::int + 0.5e0 * (w > 0)::int), 2) as significance,
  round(case when routed then least(1e0, best / 5e0 + 0.1e0 * w) else least(0.2e0, best / 10e0) end, 3) as relevance, case when routed and best >= 3 and o is null then 0.9e0 when routed and best >= 2 then 0.6e0 when routed then 0.45e0 when c <> 0 and o is null then 0.45e0 when best < 0.75 then 0.9e0 when o is not null and best < 2 then 0.7e0 else 0.45e0 end as confidence from z""")
def tr1b(spark, d):
    """Desk, exclusion, significance, relevance and confidence of each story."""
    part = Tables(spark, d).part
    k, here = F.col("p_partkey"), F.lit("https://a.example/sport/1")
    after = part.select((k - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    words = lambda *w: F.array(*map(F.lit, w))
    none = F.array().cast("array<string>")
    p = part.join(after, "p_partkey", "left").select(
        k.alias("story_id"), F.concat("p_name", F.lit(", "), F.coalesce("next", F.lit(""))).alias("text"), F.array(F.concat(F.lit("C"), k % 4)).alias("countries"),
        F.when(F.col("p_size") % 3 == 0, none).when(F.col("p_size") % 3 == 1, words("WAR_X", "ODD")).otherwise(words("WAR_X", "WAR_X", "TAX_A", "ODD")).alias("themes"),
        F.when(k % 5 == 0, words("https://b.example/x")).when(k % 5 == 1, F.array(here, F.lit("https://b.example/x"))).when(k % 5 == 2, F.array(here, F.upper(here))).otherwise(none).alias("urls"), F.when(k % 3 == 0, words("B", "A")).otherwise(words("B")).alias("tiers"))
    return triage.decided(p, FULL_DESKS, OUT, ["gizmo", "large"], ["TAX"])


@query("tr2_second_opinions", """select p_partkey as story_id, case when p_size < 30 and p_partkey % 5 > 1 and p_partkey % 2 = 0 then 'second' else 'first' end as desk, case when p_size < 30 and p_partkey % 5 > 1 and p_partkey % 2 = 0 then (p_size / 10e0 + 3e0) / 2 else p_size / 10e0 end as significance,
 case when p_size < 30 and p_partkey % 5 > 1 and p_partkey % 2 = 0 then 'second' else 'first' end as backend from part""")
def tr2(spark, d):
    p = Tables(spark, d).part
    first = p.select(F.col("p_partkey").alias("story_id"), F.lit("first").alias("desk"), (F.col("p_size") / 10.0).alias("significance"), (F.col("p_size") / 50.0).alias("confidence"), (F.col("p_partkey") % 5).alias("items"))
    second = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("story_id"), F.lit("second").alias("desk"), F.lit(3.0).alias("significance"))
    return triage.second_opinions(first, second)


@query("tr3_overrides", """with f as (select l_partkey as story_id, arg_max(case when l_returnflag = 'R' then -1 else 1 end, l_orderkey * 10 + l_linenumber) as vote from lineitem where l_returnflag <> 'N' group by 1)
 select p_partkey as story_id, case when vote = 1 then true when vote = -1 then false when p_size > 40 and p_size / 10e0 < 4.5e0 and p_size / 10e0 < 4 then false else p_partkey % 2 = 0 end as routed from part left join f on p_partkey = f.story_id""")
def tr3(spark, d):
    t = Tables(spark, d)
    dec = t.part.select(F.col("p_partkey").alias("story_id"), (F.col("p_partkey") % 2 == 0).alias("routed"), (F.col("p_size") / 10.0).alias("significance"), F.when(F.col("p_size") > 40, -0.3).otherwise(0.0).alias("learned"))
    fb = t.lineitem.filter("l_returnflag <> 'N'").select(F.col("l_partkey").alias("story_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return triage.overridden(dec, fb).select("story_id", "routed")


@query("tr4_contexts", """with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc) as k from conversations) select conv_id as story_id, count(*) as items, string_agg(distinct role, ',' order by role) as outlets, (max(length(text[1:400])) filter (where k = 1))::bigint as first_length from r where k <= 4 group by 1""")
def tr4(spark, d):
    c = Tables(spark, d).conversations.select(F.col("conv_id").alias("story_id"), F.col("turn").alias("item_id"), F.col("turn").alias("published_at"), F.col("text").alias("title"), F.col("text").alias("summary"), F.col("role").alias("outlet"))
    x = triage.contexts(c, newest=4)
    return x.select("story_id", "items", F.array_join("outlets", ",").alias("outlets"), F.length(F.col("summaries")[0]).cast("long").alias("first_length"))


@query("tr8_scout_state", """with a as (select c_custkey, case c_custkey % 3 when 0 then 'candidate' when 1 then 'following' else 'paused' end as status, c_custkey % 40 as age, c_custkey % 60 as sd, c_custkey % 25 as posts, c_custkey % 9 as ev, (c_custkey * 7) % 100 as score, c_custkey % 11 = 0 as prot from customer)
 select c_custkey, case when status = 'candidate' and age >= 7 and posts >= 10 and score >= 45 then 'following' when status = 'candidate' and age >= 14 and (score < 25 or posts < 5) and not prot then 'removed'
 when status = 'following' and age >= 7 and ev >= 5 and score < 25 and not prot then 'paused' when status = 'paused' and not prot and sd >= 30 then 'removed' else status end as next_status from a""")
def tr8(spark, d):
    k = F.col("c_custkey")
    a = Tables(spark, d).customer.select(k, F.when(k % 3 == 0, "candidate").when(k % 3 == 1, "following").otherwise("paused").alias("status"), (k % 40).alias("age_days"), (k % 60).alias("status_days"), (k % 25).alias("posts"), (k % 9).alias("evaluable"), ((k * 7) % 100).alias("score"), (k % 11 == 0).alias("protected"))
    return triage.scout_state(a).select("c_custkey", "next_status")


@query("flt8_not_news", r"select source as story_id, avg(regexp_matches(text, '(?i)\bthe\b')::int) > 0.5 as not_news from documents group by 1")
def flt8(spark, d):
    return triage.not_news(documents(spark, d).select(F.col("source").alias("story_id"), F.col("text").alias("title")), r"(?i)\bthe\b")


@query("flt15_json_predicate", "select event_id from events where (props->>'k')::int > 50 and props->>'feed' is null")
def flt15(spark, d):
    j = lambda p: F.get_json_object("props", p)
    return Tables(spark, d).events.filter((j("$.k").cast("int") > 50) & j("$.feed").isNull()).select("event_id")


@query("tr12_search_exact", f"select doc_id from documents where contains({MARKS.format('text')}, 'eaueux') and contains({MARKS.format('text')}, 'ement')")
def tr12(spark, d):
    return search.by_words(documents(spark, d), ["eaueux", "ement"]).select("doc_id")


@query("tr12b_search_fuzzy")
def tr12b(spark, d):
    p = Tables(spark, d).part.select("p_partkey", F.col("p_name").alias("text"))
    exact, fuzzy = search.by_words(p, ["red", "widgt"]), search.by_close_spelling(p, ["red", "widgt"])
    return search.tiered(exact.withColumn("closeness", F.lit(2.0)), fuzzy, "p_partkey", 50, F.desc("closeness")).select("p_partkey", "text", "tier")
