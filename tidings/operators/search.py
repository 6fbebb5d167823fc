"""Search: all words first, then close spellings, then meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import folded, word_similarity_from


def by_words(items: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Items whose folded text contains every word (TR12, exact part)."""
    t = folded(F.col(text))
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(t, F.lit(w))
    return items.filter(hit)


def close_spelling(word: str, text: Column) -> Column:
    """word_similarity of a word of 4 letters or more in a text; 0 where it is below 0.4, which a text that has the word as written reaches.

    Two trigrams must then be shared at least, so one besides the word's first letter: an inner one, the first two
    letters of a word or its last two. Only texts that have one go through Python."""
    inner = {word[i : i + 3] for i in range(len(word) - 2)}
    some = "|".join([*map(re.escape, sorted(inner)), r"(?<![\p{L}\p{N}_])" + re.escape(word[:2]), re.escape(word[-2:]) + r"(?![\p{L}\p{N}_])"])
    return F.coalesce(word_similarity_from(F.lit(word), F.when(text.rlike(some), text), F.lit(0.4)), F.lit(0.0))


def by_close_spelling(items: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Items that contain each word or one spelled like it; with several words at least one as written. Adds closeness."""
    least = 0.4 if len(words) > 1 else 0.55
    t = folded(F.col(text))
    like = {w: close_spelling(w, t) if len(w) >= 4 else F.when(F.contains(t, F.lit(w)), 1.0).otherwise(0.0) for w in words}
    near, exact = F.lit(True), F.lit(False)
    for w in words:
        has = F.contains(t, F.lit(w))
        near = near & (has | (like[w] >= least))
        exact = exact | has
    found = items.filter(near & exact if len(words) > 1 else near)
    return found.withColumn("closeness", sum(like.values(), F.lit(0.0)))


def tiered(exact: DataFrame, fuzzy: DataFrame, key: str, limit: int, *order) -> DataFrame:
    """Exact matches, then close spellings that are not among them, at most limit (TK6)."""
    more = fuzzy.join(exact.select(key), key, "left_anti")
    both = exact.withColumn("tier", F.lit(0)).unionByName(more.withColumn("tier", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("tier", *order, key).limit(limit)
