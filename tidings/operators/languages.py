"""The language of a text by character trigrams (SF6): profiles are a table, a text's score is a sum over its grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1_000_000  # characters that a task takes at once


def spaced(text: Column) -> Column:
    """A text's words in lower case, each between spaces; other characters than letters end a word."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "), F.lit(" "))


def codes(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of spaced texts as (first, behind the last, row of each gram, gram as a number, by whose order grams are ordered).

    A gram is three characters of which the middle one is a letter: all trigrams of each word between two spaces."""
    a = 0
    while a < len(texts):
        z, size = a, 0
        while z < len(texts) and (z == a or size + len(texts[z]) <= CHUNK):
            size += len(texts[z])
            z += 1
        c = np.frombuffer("".join(texts[a:z]).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(z - a), [len(t) for t in texts[a:z]])
        at = np.flatnonzero(c[1:-1] != 32)
        yield a, z, row[at], (c[at] << 42) | (c[at + 1] << 21) | c[at + 2]
        a = z


def profiles(samples: DataFrame, most: int = 4000) -> DataFrame:
    """lang, gram, gain, floor: of samples (lang, text), the ``most`` frequent grams of each language (ties: smaller first).

    floor is the log-likelihood of a gram that the profile lacks, gain what one that it has is better. Counts are smoothed
    by a half over the ``most`` grams and one more. The table's size is bounded by languages times ``most``. Grams are numbers (see codes),
    counted where they are read."""

    def counted(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            names, own = np.unique(langs.astype(str), return_inverse=True)
            for a, z, row, g in codes(b.column(1).to_pylist()):
                for k in np.unique(own[a:z]):
                    gram, n = np.unique(g[own[a:z][row] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(names[k])] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    each = samples.filter("lang is not null").select("lang", spaced(F.col("text")).alias("t")).mapInArrow(counted, "lang string, gram long, n long")
    counts = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.withColumn("r", rank).filter(F.col("r") <= most).join(total, "lang")
    floor = F.log(F.lit(0.5)) - F.log(F.col("total") + 0.5 * (most + 1))
    return kept.select("lang", "gram", (F.log(F.col("n") + 0.5) - F.log(F.lit(0.5))).alias("gain"), floor.alias("floor"))


def detected(texts: DataFrame, key: str, known: DataFrame, least: int = 12) -> DataFrame:
    """key, language of texts (key, text): the language under whose profile the text's grams are likeliest (ties: the smaller code);
    null for texts shorter than ``least`` characters or without a letter.

    The profiles, a table of bounded size, come to the texts, so texts are not shuffled. A text none of whose grams is in any
    profile is judged by the floors alone."""
    table = known.orderBy("lang", "gram").select("lang", "gram", "gain", "floor").toArrow()
    langs, gram, gain, floor = (np.array(table.column(k).to_pylist(), t) for k, t in enumerate((object, np.int64, float, float)))
    order = sorted(set(langs.tolist()), key=lambda x: x.encode())
    own = texts.sparkSession.sparkContext.broadcast([(x, gram[langs == x], gain[langs == x], floor[langs == x][0]) for x in order])

    def told(batches):
        for b in batches:
            out = []
            for a, z, row, g in codes(b.column(1).to_pylist()):
                size = np.bincount(row, minlength=z - a)
                best, name = np.full(z - a, -np.inf), np.full(z - a, None, object)
                for lang, grams, gains, low in own.value:  # a smaller code comes first and stays where scores are equal
                    k = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                    score = np.round(np.bincount(row, np.where(grams[k] == g, gains[k], 0.0), z - a) + size * low, 6)
                    name[score > best] = lang
                    best = np.maximum(best, score)
                name[size == 0] = None
                out += name.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x if n is not None and n >= least else None for x, n in zip(out, b.column(2).to_pylist())], pa.string())], names=[key, "language"])

    rows = texts.select(key, spaced(F.col("text")).alias("t"), F.length("text").alias("n"))
    return rows.mapInArrow(told, f"{key} {texts.schema[key].dataType.simpleString()}, language string")
