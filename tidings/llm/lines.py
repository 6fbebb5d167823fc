"""Line dedup by site-relative frequency, in DataFrame functions only.

A line's ratio is the number of a host's pages that contain it, divided by the number of the host's pages. Lines above
the boilerplate ratio that stand on LEAST pages or more are dropped from all pages of the host, whatever its size: what
stands on one page only repeats nothing. Lines of a page are counted once each and by hash before they are shuffled, and counts are combined before the shuffle, so a host with a third of
all pages is no single task's work. A host has fewer than (lines a page) / RATIO lines above the ratio; they join the
pages by host as one array, a join that Spark splits where a host is large.

Lines: HTML comments, scripts and styles go, tags of blocks break lines, other tags go; a line is trimmed, empty ones go.
A null or malformed url has host '' (a site of its own); null and empty html has no lines. Repeated pages count each time, with or
without page_id. Lines are compared by 64-bit hashes of their text. Very long pages are read whole. Columns other than page_id, url and html are
ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import written

RATIO = 0.3
LEAST = 2
JUNK = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BLOCKS = r"(?i)</?(?:p|br|div|li|ul|ol|nav|h[1-6]|article|section|header|footer|head|body|html|title|table|tr|td|th|main|aside|form|blockquote|pre|hr)\b[^>]*>"
TAGS = r"<[^>]*>"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def page_lines(html: Column) -> Column:
    t = F.regexp_replace(F.coalesce(html, F.lit("")), JUNK, "")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r"))), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, drop: the hashes of each host's lines above the ratio. pages: host, lines."""
    # written tables on both sides of a join let Spark split a host with very many rows
    totals = written(pages.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    each = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("h"))
    common = each.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)  # most lines stand once
    above = written(common.join(totals, "host").filter(F.col("n") > F.col("pages") * ratio).select("host", "h"), "host-lines")
    return above.groupBy("host").agg(F.collect_list("h").alias("drop"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text: the lines that stay, joined by newlines."""
    lines = pages.select("page_id", host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    lines = written(lines, "page-lines")  # html is parsed once
    drop = written(boilerplate(lines, ratio, least), "boilerplate")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("drop", F.array().cast("array<bigint>")), F.xxhash64(x)))
    out = lines.join(drop, "host", "left").withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def digest(pages: DataFrame) -> DataFrame:
    """without_boilerplate() with the text as a hash."""
    return without_boilerplate(pages).select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


ORACLE = r"""
with t as (select row_number() over () as r, page_id,
                  lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '')) as host,
                  regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') as x
           from pages),
u as (select r, page_id, host, regexp_replace(regexp_replace(x, '(?i)</?(?:p|br|div|li|ul|ol|nav|h[1-6]|article|section|header|footer|head|body|html|title|table|tr|td|th|main|aside|form|blockquote|pre|hr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as x from t),
l as (select r, page_id, host, list_filter(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '^[ \t\v\f\r]+|[ \t\v\f\r]+$', '', 'g')), lambda y: y <> '') as lines from u),
n as (select host, count(*) as pages from l group by host),
c as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from l) group by host, line),
b as (select c.host, list(line) as dropped from c join n using (host) where c.n >= 2 and c.n > n.pages * 0.3e0 group by c.host),
k as (select page_id, l.host, lines, list_filter(lines, lambda y: not list_contains(coalesce(dropped, []), y)) as kept
      from l left join b on l.host = b.host)
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped,
       sha256(array_to_string(kept, chr(10))) as text_sha256 from k
"""
