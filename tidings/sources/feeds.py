"""Feeds: tab-separated event files, RSS, bills, votes, registers. Bytes or lines in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.text import clean, clean_title, name_case


def stamps_between(spark: SparkSession, last: str | None, latest: str, backfill: int) -> DataFrame:
    """stamp: the 15-minute file names after ``last`` up to ``latest`` (SRC3), a day back at most; without ``last`` the
    newest ``backfill`` of them."""
    end = F.lit(latest).cast("timestamp")
    day_back = end - F.expr("interval 1 day")
    start = F.greatest(F.lit(last).cast("timestamp"), day_back) + F.expr("interval 15 minutes") if last else end - F.expr(f"interval {15 * (backfill - 1)} minutes")
    times = F.when(start <= end, F.sequence(start, end, F.expr("interval 15 minutes"))).otherwise(F.array().cast("array<timestamp>"))
    return spark.range(1).select(F.explode(times).alias("t")).select(F.date_format("t", "yyyyMMddHHmmss").alias("stamp"))


def congress(at: Column) -> Column:
    return (F.floor((F.year(at) - 1789) / 2) + 1).cast("int")


def congress_session(at: Column) -> Column:
    return F.when(F.year(at) % 2 == 1, 1).otherwise(2)


def locations(field: Column, limit: int = 4) -> Column:
    """The places of a location field (SRC2) as an array of structs in the order of their offset in the article.

    Blocks are type#name#country#adm1#adm2#lat#lon#feature#offset. A country goes when one of its cities is there."""
    blocks = F.filter(F.split(F.coalesce(field, F.lit("")), ";"), lambda b: F.size(F.split(b, "#")) >= 9)

    def parsed(b):
        f = F.split(b, "#")
        kind = F.when(f[0] == "1", "country").when(f[0].isin("2", "5"), "region").otherwise("city")
        key = F.when(f[0] == "1", F.concat(F.lit("cc:"), f[2])).otherwise(F.concat(F.lit("place:"), F.coalesce(F.nullif(f[7], F.lit("")), f[1])))
        return F.struct(
            F.coalesce(F.nullif(f[8], F.lit("")).try_cast("int"), F.lit(0)).alias("offset"), key.alias("key"), kind.alias("kind"), F.split(f[1], ",")[0].alias("name"),
            f[2].alias("country"), f[5].try_cast("double").alias("lat"), f[6].try_cast("double").alias("lon"))

    good = F.array_sort(F.filter(F.transform(blocks, parsed), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))

    def first_of_key(ps):
        return F.slice(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda q: q["key"] == p["key"])), 1, limit)

    def without_countries(ps):
        kept = F.filter(ps, lambda p: ~((p["kind"] == "country") & F.exists(ps, lambda q: (q["kind"] != "country") & (q["country"] == p["country"]))))
        return F.when(F.size(kept) > 0, kept).otherwise(ps)

    let = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)
    return let(let(good, first_of_key), without_countries)


def gkg(lines: DataFrame, prefixes: list[str], acronyms: list[str], min_themes: int = 1, junk: str | None = None) -> DataFrame:
    """Items of tab-separated event lines (SRC1; column ``value``, as spark.read.text gives): of web articles with at
    least min_themes distinct theme codes that start with a prefix, and a page title."""
    c = lines.select(F.split("value", "\t").alias("c")).filter((F.size("c") >= 27) & (F.get("c", F.lit(2)) == "1"))
    at = lambda k: F.get("c", F.lit(k))
    codes = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(at(7), ";"), lambda t: t != ""), lambda t: F.split(t, ",")[0])))
    wanted = F.filter(codes, lambda t: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(t, p)))
    names = lambda k: F.transform(F.slice(F.array_distinct(F.filter(F.split(at(k), ";"), lambda n: n != "")), 1, 8), lambda n: name_case(n, acronyms))
    items = c.select(
        at(4).alias("url"), clean_title(F.regexp_extract(at(26), "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)).alias("title"), F.try_to_timestamp(at(1), F.lit("yyyyMMddHHmmss")).alias("published_at"),
        F.coalesce(F.nullif(F.regexp_extract(at(25), r"srclc:(\w{3})", 1), F.lit("")), F.lit("eng")).alias("language"), at(3).alias("outlet"), wanted.alias("themes"),
        names(11).alias("persons"), names(13).alias("orgs"), F.split(at(15), ",")[0].try_cast("double").alias("tone"), locations(at(10)).alias("places"),
    )
    items = items.filter((F.size("themes") >= min_themes) & (F.col("title") != "") & F.col("published_at").isNotNull())
    return items.filter(~F.col("title").rlike(junk)) if junk else items


RSS_ITEM = "title string, link string, description string, pubDate string"


def rss(feeds: DataFrame) -> DataFrame:
    """Items of RSS documents (SRC4; columns source, xml)."""
    each = feeds.select("source", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("x"))

    def tag(name):
        raw = F.regexp_extract("x", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")

    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    when = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(tag("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy HH:mm:ss"))
    return each.select("source", F.trim(tag("link")).alias("url"), clean_title(text(tag("title"))).alias("title"), clean(text(tag("description")), 1200).alias("summary"), when.alias("published_at")).filter("title <> '' and url <> ''")


BILLS = "bills array<struct<type:string,number:string,congress:int,title:string,latestAction:struct<actionDate:string,text:string>>>"


def bills(docs: DataFrame) -> DataFrame:
    """Bills of JSON documents (SRC5; column json): one item for each latest action."""
    b = docs.select(F.explode(F.from_json("json", BILLS)["bills"]).alias("b")).select("b.*")
    n = F.col("congress")
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    kind = F.when(F.upper("type") == "S", "senate-bill").when(F.upper("type") == "HR", "house-bill").otherwise(F.lower("type"))
    url = F.concat(F.lit("https://www.congress.gov/bill/"), n, suffix, F.lit("-congress/"), kind, F.lit("/"), F.col("number"), F.lit("#"), F.col("latestAction.actionDate"))
    return b.select(url.alias("url"), F.concat_ws(" ", F.concat(F.col("type"), F.lit(" "), F.col("number"), F.lit(":")), "title").alias("title"), F.col("latestAction.text").alias("summary"), F.to_timestamp("latestAction.actionDate").alias("published_at"))


def register(docs: DataFrame) -> DataFrame:
    """Documents of a register's JSON (SRC7; column json)."""
    kind = "results array<struct<title:string,html_url:string,abstract:string,publication_date:string,agencies:array<struct<name:string>>>>"
    r = docs.select(F.explode(F.from_json("json", kind)["results"]).alias("r")).select("r.*")
    return r.select(F.col("html_url").alias("url"), clean(F.col("title")).alias("title"), clean(F.col("abstract"), 1200).alias("summary"), F.to_timestamp("publication_date").alias("published_at"), F.transform("agencies", lambda a: a["name"]).alias("entities"))


def votes(docs: DataFrame) -> DataFrame:
    """Roll-call votes of XML documents (SRC6; column xml)."""
    v = docs.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<vote>(.*?)</vote>"), F.lit(1))).alias("x"))
    tag = lambda t: F.trim(F.regexp_extract("x", rf"(?s)<{t}>(.*?)</{t}>", 1))
    return v.select(tag("vote_number").alias("number"), clean(tag("title")).alias("title"), tag("result").alias("result"), F.concat(tag("yeas"), F.lit(" to "), tag("nays")).alias("tally"))
