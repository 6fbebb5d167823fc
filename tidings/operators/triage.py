"""Rules triage of stories, overrides and the cascade of opinions. Desks and exclusions are tables of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import phrases_found


def desk_scores(stories: DataFrame, desks: list[tuple[str, int, list[str]]], text: str = "text") -> DataFrame:
    """story_id, desk, priority, keywords, score (TR1): a row for each story and desk.

    desks: key, priority, phrases. A story may bring ``themes`` (a count) and ``geo`` (a flag) as hints, which only
    strengthen a desk that has a phrase of its own."""
    themes = F.col("themes") if "themes" in stories.columns else F.lit(0)
    geo = F.col("geo") if "geo" in stories.columns else F.lit(False)
    hint = 0.5 * F.least(themes, F.lit(3)) + F.when(geo, 0.75).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(k).alias("desk"), F.lit(p).alias("priority"), F.size(phrases_found(F.col(text), words)).alias("keywords")) for k, p, words in desks])
    each = stories.select("*", F.explode(rows).alias("d")).select(*stories.columns, "d.*")
    return each.withColumn("score", F.when(F.col("keywords") > 0, F.least("keywords", F.lit(5)) + hint).otherwise(0.0))


def routed(scores: DataFrame, excluded: Column | None = None) -> DataFrame:
    """story_id, desk, score, routed: each story's best desk, routed unless a stronger exclusion stands against it."""
    strength = excluded if excluded is not None else F.lit(0.0)
    best = F.max(F.struct("score", "priority", "desk"))
    g = scores.withColumn("__x", strength).groupBy("story_id").agg(best.alias("b"), F.max("__x").alias("exclusion"))
    go = (F.col("b.score") >= 1.5) & ((F.col("exclusion") < 1) | (F.col("b.score") >= F.greatest(F.lit(2.5), F.col("exclusion") + 0.5)))
    return g.select("story_id", F.when(go | (F.col("b.score") >= 1), F.col("b.desk")).alias("desk"), F.col("b.score").alias("score"), go.alias("routed"))


def second_opinions(first: DataFrame, second: DataFrame, unsure: float = 0.6, least_items: int = 2) -> DataFrame:
    """Where the first decision is unsure, the second one's desk and the mean significance (TR2)."""
    s = second.select("story_id", F.col("desk").alias("desk2"), F.col("significance").alias("sig2"))
    j = first.join(s, "story_id", "left").withColumn("ask", (F.col("confidence") < unsure) & (F.col("items") >= least_items) & F.col("sig2").isNotNull())
    return j.select("story_id", F.when(F.col("ask"), F.col("desk2")).otherwise(F.col("desk")).alias("desk"), F.when(F.col("ask"), (F.col("significance") + F.col("sig2")) / 2).otherwise(F.col("significance")).alias("significance"), F.when(F.col("ask"), "second").otherwise("first").alias("backend"))


def overridden(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback of +1 or -1 (the latest for a story) wins; else strong learned dislike sends weak stories away (TR3)."""
    latest = feedback.groupBy("story_id").agg(F.max_by("value", "at").alias("vote"))
    j = decisions.join(latest, "story_id", "left")
    cold = (F.col("learned") <= -0.25) & (F.col("significance") < 4)
    return j.withColumn("routed", F.when(F.col("vote") == 1, True).when(F.col("vote") == -1, False).when(cold, False).otherwise(F.col("routed"))).drop("vote")


def not_news(titles: DataFrame, pattern: str) -> DataFrame:
    """story_id, not_news: whether more than half of a story's titles look like site pages or roundups (FLT8)."""
    return titles.groupBy("story_id").agg((F.avg(F.col("title").rlike(pattern).cast("double")) > 0.5).alias("not_news"))


def contexts(items: DataFrame, newest: int = 12, summaries: int = 5) -> DataFrame:
    """story_id, titles, summaries, outlets, items: what a judge is shown of each story (TR4)."""
    w = Window.partitionBy("story_id").orderBy(F.desc("published_at"), F.desc("item_id"))
    top = items.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= newest)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(c).alias("x")))), lambda s: s["x"])
    return top.groupBy("story_id").agg(F.array_distinct(ordered("title")).alias("titles"), F.slice(F.transform(ordered("summary"), lambda x: F.substring(x, 1, 400)), 1, summaries).alias("summaries"), F.array_sort(F.collect_set("outlet")).alias("outlets"), F.count("*").alias("items"))


def scout_state(accounts: DataFrame, candidate_days: int = 7, least_posts: int = 10, promote_at: float = 45.0, drop_below: float = 25.0, judge_from: int = 5) -> DataFrame:
    """next_status of each account (TR8) from status, age_days, status_days, posts, evaluable, score, protected."""
    a = F.col
    promote = (a("age_days") >= candidate_days) & (a("posts") >= least_posts) & (a("score") >= promote_at)
    useless = (a("age_days") >= 2 * candidate_days) & ((a("score") < drop_below) | (a("posts") < 5)) & ~a("protected")
    weak = (a("age_days") >= candidate_days) & (a("evaluable") >= judge_from) & (a("score") < drop_below) & ~a("protected")
    nxt = (
        F.when((a("status") == "candidate") & promote, "following").when((a("status") == "candidate") & useless, "removed")
        .when((a("status") == "following") & weak, "paused").when((a("status") == "paused") & ~a("protected") & (a("status_days") >= 30), "removed").otherwise(a("status"))
    )
    return accounts.withColumn("next_status", nxt)


def decided(stories: DataFrame, desks: list[dict], exclusions: list[dict], includes: list[str], heavy: list[str]) -> DataFrame:
    """story_id, desk, routed, reason, desk_score, significance, relevance, confidence: the whole decision by rules (TR1).

    stories: story_id, text, themes, countries, urls, tiers (arrays). desks: key, priority, phrases, themes (prefixes), countries;
    exclusions: key, phrases, urls (what a link may hold); heavy: prefixes of weighty themes. Everything is a column expression over
    a story's row, so a decision costs no shuffle."""
    text = F.col("text")
    list_of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    begins = lambda prefixes: F.array_distinct(F.filter(list_of("themes"), lambda t: F.array_contains(F.array(*[F.startswith(t, F.lit(p)) for p in prefixes]), True))) if prefixes else F.array().cast("array<string>")
    holds = lambda parts: lambda u: F.array_contains(F.array(*[F.contains(F.lower(u), F.lit(p)) for p in parts]), True)
    rows = []
    for d in desks:
        near = F.arrays_overlap(list_of("countries"), F.array(*map(F.lit, d["countries"]))) if d.get("countries") else F.lit(False)
        found = F.size(phrases_found(text, d["phrases"]))
        # themes and places say little alone: they strengthen a desk's own words
        hint = 0.5 * F.least(F.size(begins(d.get("themes"))), F.lit(3)) + F.when(near, 0.75).otherwise(0.0)
        rows.append(F.struct(F.when(found > 0, F.least(found, F.lit(5)) + hint).otherwise(0.0).alias("score"), F.lit(d["priority"]).alias("priority"), F.lit(d["key"]).alias("desk"), near.alias("near")))
    urls = list_of("urls")
    against = []
    for k, x in enumerate(exclusions):
        held = F.filter(urls, holds(x["urls"])) if x.get("urls") else F.array()
        strength = F.size(phrases_found(text, x["phrases"])) + 3.0 * F.size(held) / F.greatest(F.size(urls), F.lit(1))
        against.append(F.struct(strength.alias("strength"), F.lit(-k).alias("order"), F.lit(x["key"]).alias("key")))
    s = stories.select(
        "story_id", F.array(*rows).alias("desks"), F.array_max(F.array(*against)).alias("against"), F.size(phrases_found(text, includes)).alias("wanted"),
        (F.size(begins(heavy)) > 0).alias("heavy"), F.array_contains(list_of("tiers"), "A").alias("trusted"))
    best = F.array_max("desks")
    s = s.select("*", best["score"].alias("best"), best["desk"].alias("first"), F.exists("desks", lambda d: d["near"]).alias("near"), F.when(F.col("against.strength") >= 1, F.col("against")).alias("out")).drop("desks", "against")
    score, out = F.col("best"), F.col("out")
    routed = (score >= 1.5) & (out.isNull() | (score >= F.greatest(F.lit(2.5), out["strength"] + 0.5)))
    s = s.withColumn("routed", routed)
    weight = 1.0 + F.least(F.lit(2.0), score / 2.5) + F.when(F.col("heavy"), 0.75).otherwise(0.0) + F.when(F.col("trusted"), 0.5).otherwise(0.0) + F.when(F.col("wanted") > 0, 0.5).otherwise(0.0)
    sure = F.when(F.col("routed") & (score >= 3) & out.isNull(), 0.9).when(F.col("routed"), F.when(score >= 2, 0.6).otherwise(0.45))
    sure = sure.when(F.col("near") & out.isNull(), 0.45).when(score < 0.75, 0.9).when(out.isNotNull() & (score < 2), 0.7).otherwise(0.45)
    return s.select(
        "story_id", F.when(F.col("routed") | (score >= 1), F.col("first")).alias("desk"), "routed", F.when(~F.col("routed"), F.coalesce(out["key"], F.lit("no_desk_match"))).alias("reason"), score.alias("desk_score"),
        F.round(F.least(F.lit(5.0), weight), 2).alias("significance"), F.round(F.when(F.col("routed"), F.least(F.lit(1.0), score / 5 + 0.1 * F.col("wanted"))).otherwise(F.least(F.lit(0.2), score / 10)), 3).alias("relevance"), sure.alias("confidence"))
