"""Substring dedup: words covered by a window of WIDTH words that also starts in a document with a smaller id go.

An FM-index for each shard decides; what leads to it only makes sure that equal windows meet in a shard:

1. Each window of WIDTH words is keyed by the smallest hash among its word GRAM-grams, which its words alone determine.
   Consecutive windows with one key form a run, so a document has about one run for every 20 words.
2. Only runs whose key stands in several documents stay. Runs with the same words collapse to their first document:
   all later ones are repeats. Runs that share a key but differ go on, trimmed to the windows whose hash stands in
   several documents and collapsed again. A passage in a third of all documents thus leaves a few distinct runs.
3. Runs are dealt by key. A task packs whole keys into shards, builds a compressed FM-index over a shard's distinct
   runs, and streams the same runs through it: backward search over the wavelet matrix tells, for each window, whether
   it stands in a document with a smaller id (matching statistics of WIDTH or more). A key whose distinct runs would outgrow a
   shard is dealt again, by the next smallest gram of each window and, where that is not enough, by the window itself:
   what a window's words alone determine keeps equal windows together.

Words are compared by 64-bit hashes. Nothing is sent on for texts without repeats: their text stays where it is read, as a bitmap of
ids tells, which grows with the repeated documents from 128 KB to 32 MB; beyond that it lets other texts through as well.
Null texts have no words, a text of fewer than WIDTH words has no window. Rows without doc_id neither lose words nor
cause others to. Rows that share a doc_id cause each other no loss, whatever their texts, and each loses the words of its own
text. Very long texts are read whole. Other columns are ignored whatever their names. The result has a row for each input
row; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import Spans, WordHash, bitmap, dropped, in_bitmap, mixed, texts, written
from tidings.llm.fm_index import FMIndex, matched_windows

WIDTH, GRAM = 50, 10
LONGEST = 64  # windows in a run
SHARD_WORDS = 200_000
HEAVY_WORDS = 1_000_000

_words = WordHash()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(h: np.ndarray):
    """key, hash of all words, first window, number of windows of each run."""
    n = len(h) - WIDTH + 1
    if n < 1:
        return None
    spans = Spans(h)
    at = np.arange(len(h) - GRAM + 1)
    low = sliding_min(spans.of(at, at + GRAM), WIDTH - GRAM + 1)
    first = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1, n]
    size = np.diff(first)
    if size.max() > LONGEST:  # periodic texts
        first = np.concatenate([np.arange(a, z, LONGEST) for a, z in zip(first, first[1:])] + [[n]])
        size = np.diff(first)
    first = first[:-1]
    return low[first], spans.of(first, first + size + WIDTH - 1), first, size


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), m (key), c (hash of the words), p (first window), n (windows) of each run."""

    def run(batches):
        for b in batches:
            found = []
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for doc, t, text in zip(ids, keys, texts(b)):
                got = runs_of(_words.of(text.split()))
                if got is not None:
                    found.append((np.full(len(got[0]), doc), np.full(len(got[0]), t), *got))
            if found:
                doc, t, m, c, p, n = (np.concatenate(x) for x in zip(*found))
                columns = [pa.array(doc, pa.int64()), pa.array(t, pa.int64()), pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "m", "c", "p", "n"])

    return known(docs).mapInArrow(run, "doc_id long, t long, m long, c long, p int, n int")


def known(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))


def map_bits(values: int) -> int:
    """Bits of a bitmap of that many values, as a power of two: 16 for each, 2**28 (32 MB) at most."""
    return int(np.clip(np.ceil(np.log2(16 * values + 1)), 20, 28))


def fetched(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """m, c, n, d, words, windows: the word hashes and window hashes of runs (columns m, c, n, d, t, p)."""
    wanted = written(picked.groupBy("d", F.col("t").alias("u")).agg(F.collect_list(F.struct("m", "c", "n", "p")).alias("runs")), "wanted-runs")
    size = map_bits(wanted.count())
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("d"), "d", size))

    def only(batches):  # texts that no run is wanted from don't travel
        bits = np.frombuffer(seen.value, np.uint64)
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size)))

    def cut(batches):
        for b in batches:
            rows = []
            for text, doc, own in zip(texts(b), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = _words.of(text.split())
                spans = Spans(h)
                for r in own:
                    at = np.arange(r["p"], r["p"] + r["n"])
                    rows.append((r["m"], r["c"], r["n"], doc, h[r["p"] : r["p"] + r["n"] + WIDTH - 1].view(np.int64), spans.of(at, at + WIDTH).view(np.int64)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["m", "c", "n", "d", "words", "windows"])

    some = known(docs).mapInArrow(only, "doc_id long, t long, text string")
    both = some.join(wanted, F.expr("doc_id = d and t = u")).select("text", "d", "runs")
    return both.mapInArrow(cut, "m long, c long, n int, d long, words array<long>, windows array<long>")


def pieces(segments: DataFrame, by_window: bool) -> DataFrame:
    """m, tc, k, key, pc, d, words: segments cut into stretches of windows with one key, from window k on.

    The key is that of the next smallest gram of a window beside m, or the hash of the window itself."""

    def run(batches):
        for b in batches:
            rows = []
            for m, tc, k, d, words in zip(*[b.column(i).to_pylist() for i in range(5)]):
                h = np.array(words, np.int64).view(np.uint64)
                spans, n = Spans(h), len(h) - WIDTH + 1
                at = np.arange(n)
                if by_window:
                    low, first = spans.of(at, at + WIDTH), at
                else:
                    grams = np.arange(len(h) - GRAM + 1)
                    g = spans.of(grams, grams + GRAM)
                    low = sliding_min(np.where(g == np.array(m).astype(np.int64).view(np.uint64), np.iinfo(np.uint64).max, g), WIDTH - GRAM + 1)
                    first = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
                stop = np.r_[first[1:], n]
                key = mixed(low[first] + np.uint64(m & (1 << 64) - 1)).view(np.int64).tolist()
                whole = spans.of(first, stop + WIDTH - 1).view(np.int64).tolist()
                rows += [(m, tc, k + a, x, c, d, words[a : z + WIDTH - 1]) for a, z, x, c in zip(first.tolist(), stop.tolist(), key, whole)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["m", "tc", "k", "key", "pc", "d", "words"])

    return segments.select("m", "tc", "k", "d", "words").mapInArrow(run, "m long, tc long, k int, key long, pc long, d long, words array<long>")


def too_big(rows: DataFrame, key: str, heavy: int) -> DataFrame:
    """The keys with more than ``heavy`` words."""
    return written(rows.groupBy(key).agg(F.sum(F.size("words")).alias("all")).filter(F.col("all") > heavy).select(key), "heavy-keys")


def segment_hits(segments: DataFrame, heavy: int = HEAVY_WORDS) -> DataFrame:
    """m, tc, own_hits: for distinct segments (m, tc, d, words), which of its windows stand in a smaller document."""
    big = too_big(segments, "m", heavy)
    light = segments.join(big, "m", "left_anti").select(F.col("m").alias("key"), F.col("tc").alias("pc"), "d", "words")
    out = searched(light).select(F.col("key").alias("m"), F.col("pc").alias("tc"), F.col("hits").alias("own_hits"))
    if big.isEmpty():
        return out
    first = written(pieces(segments.join(big, "m", "left_semi").withColumn("k", F.lit(0)), False), "segment-pieces")
    again = too_big(first, "key", heavy)
    parts = first.join(again, "key", "left_anti").select("m", "tc", "k", "key", "pc", "d", "words")
    parts = written(parts.union(pieces(first.join(again, "key", "left_semi"), True)), "segment-pieces")
    distinct = written(parts.groupBy("key", "pc").agg(F.min("d").alias("d"), F.any_value("words").alias("words")), "distinct-pieces")
    got = searched(distinct).join(distinct.select("key", "pc", F.col("d").alias("first_d")), ["key", "pc"])
    hits = F.when(F.col("d") > F.col("first_d"), F.array_repeat(F.lit(True), F.size("hits"))).otherwise(F.col("hits"))
    each = parts.select("m", "tc", "k", "key", "pc", "d").join(got, ["key", "pc"]).select("m", "tc", F.struct("k", hits.alias("h")).alias("s"))
    own = F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["h"]))
    return out.union(each.groupBy("m", "tc").agg(own.alias("own_hits")))


def searched(segments: DataFrame) -> DataFrame:
    """key, pc, hits: for distinct segments (key, pc, d, words), which windows an FM-index finds in a smaller document."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:  # keys stay whole
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield shard(held)

    def shard(rows):
        length = np.array([len(r[3]) for r in rows])
        begin = np.r_[0, np.cumsum(length + 1)[:-1]]
        flat = np.zeros(int((length + 1).sum()), np.int64)
        ends = begin + length
        place = np.ones(len(flat), bool)
        place[ends] = False
        flat[place] = np.concatenate([np.array(r[3], np.int64) for r in rows])
        symbols = np.zeros(len(flat), np.int64)
        symbols[place] = np.unique(flat[place], return_inverse=True)[1] + 1
        own = np.unique(np.array([r[2] for r in rows]), return_inverse=True)[1].astype(np.int32)
        index = FMIndex(symbols, np.repeat(own, length + 1))
        windows = length - WIDTH + 1
        hit = matched_windows(index, symbols, begin, windows, own, WIDTH)
        hits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(windows)].astype(np.int32)), pa.array(hit))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), hits], names=["key", "pc", "hits"])

    # by a hash of the key: Spark would leave out a repartition by the very key of a join before it, and may then split that join's keys
    dealt = segments.select("key", "pc", "d", "words").repartition(F.xxhash64("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, pc long, hits array<boolean>")


def repeats(docs: DataFrame, heavy: int = HEAVY_WORDS) -> DataFrame:
    """doc_id, t, spans: for each document that repeats an earlier one, [start, stop) word places, possibly overlapping."""
    every = written(runs(docs), "runs")
    # written tables on both sides of a join let Spark split a key, window or run that very many documents share
    shared = written(every.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("m"), "shared-keys")
    some = written(every.join(shared, "m"), "shared-runs")
    dropped(every)
    first = F.min(F.struct(F.col("doc_id").alias("d"), "t", "p")).alias("f")
    reps = written(some.groupBy("m", "c", "n").agg(first).select("m", "c", "n", "f.d", "f.t", "f.p"), "distinct-runs")
    mixed_keys = reps.groupBy("m").agg(F.min("d").alias("a"), F.max("d").alias("z")).filter("a < z").select("m")
    parts = written(fetched(docs, reps.join(mixed_keys, "m")), "run-words")

    # the windows of a run that stand in several documents, from the first to the last
    each = parts.select("m", "c", "n", "d", F.posexplode("windows").alias("k", "w"))
    common = written(each.groupBy("w").agg(F.min("d").alias("a"), F.max("d").alias("z")).filter("a < z").select("w"), "shared-windows")
    kept = each.join(common, "w").groupBy("m", "c", "n").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    trimmed = parts.join(kept, ["m", "c", "n"]).select("m", "c", "n", "d", "lo", F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + WIDTH).alias("words"))
    trimmed = written(trimmed.withColumn("tc", F.xxhash64("words")).dropDuplicates(["m", "c", "n"]), "trimmed-runs")  # rows that repeat id and text
    dropped(parts)
    distinct = written(trimmed.groupBy("m", "tc").agg(F.min("d").alias("d"), F.any_value("words").alias("words")), "segments")
    found = written(segment_hits(distinct, heavy).join(distinct.select("m", "tc", F.col("d").alias("first_d")), ["m", "tc"]), "segment-hits")
    # later documents with the same words repeat the first one whole
    hits = F.when(F.col("d") > F.col("first_d"), F.array_repeat(F.lit(True), F.size("own_hits"))).otherwise(F.col("own_hits"))
    by_run = written(trimmed.drop("words").join(found, ["m", "tc"]).select("m", "c", "n", "lo", hits.alias("hits")), "run-hits")
    for t in (trimmed, distinct, found):
        dropped(t)

    status = written(reps.join(by_run, ["m", "c", "n"], "left").select("m", "c", "n", "d", "lo", "hits"), "run-status")
    all_ = some.join(status, ["m", "c", "n"])
    whole = F.array(F.struct(F.col("p").alias("a"), (F.col("p") + F.col("n") + (WIDTH - 1)).alias("z")))
    start = lambda k: F.col("p") + F.col("lo") + k
    windows = F.filter(F.transform("hits", lambda x, k: F.when(x, F.struct(start(k).alias("a"), (start(k) + WIDTH).alias("z")))), lambda x: x.isNotNull())
    spans = F.when(F.col("doc_id") > F.col("d"), whole).otherwise(F.coalesce(windows, F.array().cast("array<struct<a:int,z:int>>")))
    out = all_.select("doc_id", "t", spans.alias("s")).filter(F.size("s") > 0)
    out = written(out.groupBy("doc_id", "t").agg(F.flatten(F.collect_set("s")).alias("spans")), "repeats")
    for t in (some, reps, by_run, status):
        dropped(t)
    return out


def stripped(docs: DataFrame, with_text: bool = False, heavy: int = HEAVY_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay joined by spaces) of each document."""
    found = repeats(docs, heavy).withColumnRenamed("doc_id", "d").withColumnRenamed("t", "u")
    size = map_bits(found.count())
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("d"), "d", size))

    def result(text: bytes, spans):
        words = text.split()
        keep = np.ones(len(words), bool)
        for a, z in spans or ():
            keep[a:z] = False
        kept = b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()])
        return len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None

    def untouched(batches):  # documents without repeats are done where they are read; the others' texts go on
        bits = np.frombuffer(seen.value, np.uint64)
        for b in batches:
            ids = b.column(0)
            maybe = in_bitmap(bits, ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size) & ids.is_valid().to_numpy(zero_copy_only=False)
            rows = [(None, None, None, None, t) if later else (*result(t, None), None) for t, later in zip(texts(b), maybe.tolist())]
            yield pa.RecordBatch.from_arrays([ids, b.column(1), *[pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))]], names=["doc_id", "t", "n_words", "n_removed", "kept_sha256", "kept", "text"])

    def finished(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                done = (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"])
                rows.append((r["doc_id"], *(done if r["text"] is None else result(r["text"], [(x["a"], x["z"]) for x in r["spans"] or ()]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(untouched, "doc_id long, t long, n_words long, n_removed long, kept_sha256 string, kept string, text binary")
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    out = read.join(found, F.expr("doc_id = d and t = u"), "left").mapInArrow(finished, kinds)
    return out if with_text else out.drop("kept")
