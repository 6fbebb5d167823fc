"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: words at its 1s are hashed, words at its 0s are ignored, so a
substituted word breaks only the seeds that have a 1 there. Seeds of the benchmark and of the documents meet in an
equi-join; around each hit the aligned words are compared one by one and the best run, in which a match counts +1
and a substitution -2, decides. A run reaches at most REACH words beyond the outermost hit around it; nothing else bounds
it. Words are lower-cased and lose surrounding punctuation first.

A bitmap of fixed size (2**BITS bits, whatever the benchmark's size) lets each document drop seeds that no benchmark
item has before anything is shuffled; it never drops one that an item has. Documents with hits send on only the
stretches of word hashes around them. Equal texts, of documents or of items, are compared once: texts are known by two
hashes of theirs, which then meet the ids. Spark picks the join strategies by size; by hand only the bitmap is broadcast.

Items of SHORTEST to 9 words, which no mask fits, match as a whole only: their words in a row. Items of fewer words, and
null or empty texts on either side, match nothing. Equal items each report, and so do equal documents; rows that share a
doc_id (or have none) and an item_id are one row of the result, its best run. Long items match by any MATCH equal words. Other
columns are ignored whatever their names; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import WordHash, bitmap, dropped, in_bitmap, mixed, text_keys, texts, written

#: 1: a word that is hashed; 0: a word that may differ.
MASKS = ("11101001011", "1101101011", "10110011101")
BITS = 25
#: Words around a hit that are compared; items of fewer words than SHORTEST match nothing.
REACH, SHORTEST = 128, 5
#: A run of MATCH equal words counts, or SHARE of a shorter item's words.
MATCH, SHARE = 12, 0.6

_EDGE = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def normal(word: bytes) -> bytes:
    return _EDGE.sub(b"", word.decode("utf-8", "replace").lower().encode())


_words = WordHash(normal)


def word_hashes(text: bytes) -> np.ndarray:
    h = _words.of(text.split())
    return h[h != 0]


def seeds(h: np.ndarray, wholes: tuple[int, ...] = ()):
    """For each mask, the hashes of its seeds at each place of h where it fits; then the same for runs of ``wholes`` words."""
    for mask in (*MASKS, *("1" * n for n in wholes)):
        n = len(h) - len(mask) + 1
        total = np.full(max(0, n), int(mask, 2), np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1" and n > 0:
                total = (total + h[k : k + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        yield mixed(total)


def own_wholes(n: int) -> tuple[int, ...]:
    """The whole-item mask of an item of n words, where it has one."""
    return (n,) if SHORTEST <= n < min(map(len, MASKS)) else ()


def item_words(items: DataFrame) -> DataFrame:
    """ia, ib, item, seeds: the word hashes and the distinct seeds of each distinct item text."""

    def run(batches):
        for b in batches:
            own = [word_hashes(t) for t in texts(b)]
            found = [np.unique(np.concatenate(list(seeds(h, own_wholes(len(h)))))).view(np.int64) for h in own]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h.view(np.int64) for h in own], longs), pa.array(found, longs)], names=["ia", "ib", "item", "seeds"])

    t = items.select(*text_keys(F.col("text"), ("ia", "ib")), F.col("text").cast("string").alias("text")).dropDuplicates(["ia", "ib"])
    return t.mapInArrow(run, "ia long, ib long, item array<long>, seeds array<long>")


def stretches(docs: DataFrame, seen, wholes: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, ka, kb, first, words, seeds: around seeds that the bitmap knows, the word hashes from word `first` on, and
    the distinct seeds among them."""

    def run(batches):
        known = np.frombuffer(seen.value, np.uint64)
        for b in batches:
            rows = []
            for doc, ka, kb, text in zip(*[b.column(k).to_pylist() for k in range(3)], texts(b)):
                h = word_hashes(text)
                at, keys = [], []
                for s in seeds(h, wholes):
                    hit = np.flatnonzero(in_bitmap(known, s, BITS))
                    at.append(hit)
                    keys.append(s[hit])
                at, keys = np.concatenate(at), np.concatenate(keys)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, keys = at[order], keys[order]
                breaks = [0, *(np.flatnonzero(np.diff(at) > REACH) + 1).tolist(), len(at)]
                for a, z in zip(breaks, breaks[1:]):
                    first = max(0, int(at[a]) - REACH)
                    rows.append((doc, ka, kb, first, h[first : int(at[z - 1]) + 2 * REACH].view(np.int64), np.unique(keys[a:z]).view(np.int64)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["doc_id", "ka", "kb", "first", "words", "seeds"])

    kinds = "doc_id long, ka long, kb long, first int, words array<long>, seeds array<long>"
    return docs.select("doc_id", *text_keys(F.col("text")), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def shifts(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The distances at which a seed of the item lies on an equal one of the document."""
    met = np.zeros(len(doc) + len(item) + 1, bool)
    whole = own_wholes(len(item))
    for s, own in zip(seeds(doc, whole), seeds(item, whole)):
        order = np.argsort(s, kind="stable")
        a, z = (np.searchsorted(s[order], own, side=side) for side in ("left", "right"))
        for at in np.flatnonzero(a < z).tolist():
            met[order[a[at] : z[at]] - at + len(item)] = True
    return np.flatnonzero(met) - len(item)


def best_run(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal words, start in doc, length) of the best run when item word k lies on doc word k + shift."""
    a, z = max(0, -shift), min(len(item), len(doc) - shift)
    if a >= z:
        return 0, 0, 0
    same = doc[a + shift : z + shift] == item[a:z]
    total = np.r_[0, np.cumsum(np.where(same, 1, -2))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return int(same[start:end].sum()), a + shift + start, end - start


def enough(equal: int, item_words: int) -> bool:
    return item_words > 0 and equal >= min(MATCH, int(np.ceil(SHARE * item_words)))


def matches(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, ka, kb of documents with hits (written); and ka, kb, ia, ib with the best run of each text in each item's text."""
    tests = written(item_words(items), "benchmark")
    lengths = range(SHORTEST, min(map(len, MASKS)))
    wholes = tuple(sorted(r["n"] for r in tests.select(F.size("item").alias("n")).filter(F.col("n").isin(*lengths)).distinct().collect()))
    own = tests.select("ia", "ib", F.explode("seeds").alias("h"))
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(own, "h", BITS))  # 4 MB, fixed

    every = written(stretches(docs, seen, wholes), "stretches")
    ids = written(every.select("doc_id", "ka", "kb").distinct(), "contaminated")
    hits = written(every.dropDuplicates(["ka", "kb", "first"]).drop("doc_id"), "distinct-stretches")  # copies are compared once
    dropped(every)
    spots = hits.select("ka", "kb", "first", F.explode("seeds").alias("h"))
    pairs = spots.join(own, "h").select("ka", "kb", "first", "ia", "ib").distinct()
    pairs = pairs.join(hits.drop("seeds"), ["ka", "kb", "first"]).join(tests.drop("seeds"), ["ia", "ib"])

    def judge(batches):
        for b in batches:
            rows = []
            for ka, kb, ia, ib, first, words, item in zip(*[b.column(k).to_pylist() for k in range(7)]):
                words, item = np.array(words, np.int64).view(np.uint64), np.array(item, np.int64).view(np.uint64)
                equal, start, n = max((best_run(words, item, s) for s in shifts(words, item).tolist()), default=(0, 0, 0))
                if enough(equal, len(item)):
                    rows.append((ka, kb, ia, ib, equal, first + start, n, len(item)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=list("abcdefgh"))

    kinds = "ka long, kb long, ia long, ib long, n_equal long, doc_start long, run_words long, item_words long"
    found = pairs.select("ka", "kb", "ia", "ib", "first", "words", "item").mapInArrow(judge, kinds)
    best = F.max(F.struct("n_equal", (-F.col("doc_start")).alias("o"), "run_words", "item_words")).alias("run")
    return ids, written(found.groupBy("ka", "kb", "ia", "ib").agg(best), "overlaps")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_equal, doc_start, run_words, item_words: a row for each document and item that overlap."""
    ids, found = matches(docs, items)
    named = items.select("item_id", *text_keys(F.col("text"), ("ia", "ib")))
    best = ids.join(found, ["ka", "kb"]).join(named, ["ia", "ib"]).groupBy("doc_id", "item_id").agg(F.max("run").alias("b"))
    return best.select("doc_id", "item_id", "b.n_equal", (-F.col("b.o")).alias("doc_start"), "b.run_words", "b.item_words")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents whose text overlaps no item, with the columns they came with; a row's id plays no part."""
    _, found = matches(docs, items)
    bad = written(found.select("ka", "kb").distinct(), "contaminated-texts")  # its size on disk decides how Spark joins it
    a, b = text_keys(docs["text"])
    return docs.join(bad, (a == bad["ka"]) & (b == bad["kb"]), "left_anti")
