"""HTML: articles, channel pages, links. Parsing uses the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import canonical_link, compact_count, domain, link_parts

SKIP = {"script", "style", "nav", "footer", "header", "aside", "noscript", "form"}
BLOCK = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "blockquote", "figcaption", "tr"}


class _Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.text, self.captions, self.image, self.title = [], [], None, None
        self.figure = self.in_title = False
        self.links: list[tuple[str, str]] = []
        self.href = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIP:
            self.skip += 1
        if tag == "title":
            self.in_title = True
        if tag == "meta" and (a.get("property") or a.get("name") or "").lower() in ("og:image", "twitter:image") and not self.image:
            self.image = a.get("content")
        if tag == "figcaption":
            self.figure = True
            self.captions.append("")
        if tag == "a" and a.get("href"):
            self.href = a["href"]
            self.links.append((self.href, ""))
        if tag in BLOCK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIP and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False
        if tag == "figcaption":
            self.figure = False
        if tag == "a":
            self.href = None

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        if self.href is not None and self.links:
            self.links[-1] = (self.links[-1][0], (self.links[-1][1] + data).strip())
        if self.skip or self.in_title:
            return
        if self.figure:
            self.captions[-1] += data
        self.text.append(data)


def article_of(html: str, most: int | None = 30_000, captions: int | None = 6) -> tuple:
    """title, text, lead image, captions, status of a page (SRC13); None takes the whole text and all captions."""
    p = _Article()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.text).split("\n"))
    text = "\n".join(x for x in lines if x)[:most]
    return p.title, text, p.image, [c.strip() for c in p.captions if c.strip()][:captions], "ok" if len(text) >= 300 else "short"


def articles(pages: DataFrame, most: int | None = 30_000, captions: int | None = 6) -> DataFrame:
    """page_id, title, text, image, captions, status; pages: page_id, html. The limits are those of article_of()."""

    def run(batches):
        for b in batches:
            rows = [article_of(h, most, captions) for h in b.column(1).to_pylist()]
            c = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(c, kinds)]], names=["page_id", "title", "text", "image", "captions", "status"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, title string, text string, image string, captions array<string>, status string")


def outbound(pages: DataFrame, unwanted_hosts=(), unwanted_parts=(), section_parts=(), most: int | None = 60) -> DataFrame:
    """page_id, link, text: links worth following (SRC18), each once, the first ``most`` of a page (None: all).

    Not to the page itself, a bare host, an unwanted host (or one below it), a path with an unwanted part, or the site's own
    section pages: those with one part of path, or with one of section_parts among them. pages: page_id, url, html."""
    a = r'(?is)<a\b[^>]*?href="(https?://[^"]+)"[^>]*>(.*?)</a>'
    each = pages.select("page_id", "url", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(a), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(a), F.lit(2)).alias("t"))).alias("n", "x"))
    link = canonical_link(F.col("x.h"))
    e = each.select("page_id", "url", "n", link.alias("link"), F.regexp_replace("x.t", "<[^>]*>", "").alias("text"))
    host, home = domain(F.col("link")), domain(F.col("url"))
    parts = link_parts(F.col("link"))[1]
    below = lambda x, name: (x == name) | F.endswith(x, F.concat(F.lit("."), name))
    unwanted = F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, unwanted_parts)).cast("array<string>"))
    for name in unwanted_hosts:
        unwanted = unwanted | below(host, F.lit(name))
    section = below(host, home) & ((F.size(parts) < 2) | F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, section_parts)).cast("array<string>")))
    e = e.filter((F.col("link") != canonical_link(F.col("url"))) & (host != "") & (F.size(parts) > 0) & ~unwanted & ~section)
    first = e.groupBy("page_id", "link").agg(F.min(F.struct("n", "text")).alias("f"))
    r = F.row_number().over(Window.partitionBy("page_id").orderBy("f.n"))
    first = first.withColumn("r", r)
    return (first.filter(F.col("r") <= most) if most else first).select("page_id", "link", "f.text")


class _Channel(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.posts, self.now, self.depth, self.views = [], None, 0, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        if a.get("data-post"):
            self.now = {"id": int(a["data-post"].rsplit("/", 1)[-1]), "text": "", "at": None, "views": None, "forward": None, "photos": 0}
            self.posts.append(self.now)
        if self.now is None:
            return
        if tag == "div" and (self.depth or any(k.endswith("message_text") for k in kinds)):
            self.depth += 1
        elif tag == "br" and self.depth:
            self.now["text"] += "\n"
        if tag == "time" and a.get("datetime"):
            self.now["at"] = a["datetime"]
        self.views = any(k.endswith("message_views") for k in kinds)
        if any("forwarded_from_name" in k for k in kinds) and a.get("href"):
            self.now["forward"] = a["href"]
        if any("photo" in k for k in kinds) and "background-image" in (a.get("style") or ""):
            self.now["photos"] += 1

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.now is None:
            return
        if self.depth:
            self.now["text"] += data
        elif self.views:
            self.now["views"], self.views = data.strip(), False


HANDLE = r"(?i)^https?://t\.me/(?:s/)?([A-Za-z][A-Za-z0-9_]{3,31})(?:[/?].*)?$"
#: First path parts of t.me links that are no channels.
RESERVED = ("share", "joinchat", "addstickers", "proxy", "iv", "login", "socks")


def handle_of(url: Column) -> Column:
    """The channel of a t.me link in lower case; null for reserved words and bots (SRC10)."""
    h = F.lower(F.regexp_extract(url, HANDLE, 1))
    return F.when((h != "") & ~h.isin(*RESERVED) & ~F.endswith(h, F.lit("bot")), h)


def channel_posts(pages: DataFrame) -> DataFrame:
    """channel, id, text, at, views, forward, photos: posts of channel pages (SRC9; columns channel, html)."""

    def run(batches):
        for b in batches:
            rows = []
            for channel, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Channel()
                p.feed(html or "")
                rows += [(channel, x["id"], x["text"].strip(), x["at"], x["views"], x["forward"], x["photos"]) for x in sorted(p.posts, key=lambda x: x["id"])]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["channel", "id", "text", "at", "views", "forward", "photos"])

    raw = pages.select("channel", "html").mapInArrow(run, "channel string, id long, text string, at string, views string, forward string, photos int")
    return raw.withColumns({"at": F.to_timestamp("at"), "views": compact_count(F.col("views")), "forward": handle_of(F.col("forward"))})


def post_items(posts: DataFrame, last: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Posts that become items (SRC11): newer than the channel's last one, under ``hours`` old, of 20 letters and more;
    headline: the first line of 8 letters and more, cut at a sentence or 240 letters."""
    p = posts.join(last.select("channel", F.col("id").alias("last_id")), "channel", "left")
    p = p.filter((F.col("id") > F.coalesce("last_id", F.lit(-1))) & (F.col("at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.length("text") >= 20))
    line = F.element_at(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 8), 1)
    title = F.coalesce(line, F.col("text"))
    cut = F.regexp_extract(title, r"^(.{20,240}?[.!?])(?:\s|$)", 1)
    return p.select("channel", "id", "at", F.when((F.length(title) > 240) & (cut != ""), cut).otherwise(F.substring(title, 1, 240)).alias("title"), "text", "views", "forward")
