"""The wide form of SimHash near-dedup: documents whose sets of 5-word shingles have Jaccard similarity >= 0.8.

Texts of the same words collapse first (lower case of A-Z, ASCII white space). Each distinct text has a 64-bit SimHash of
its shingle set. At similarity 0.8 two fingerprints differ in about 10 bits, in 12 where the sets are tiny; RADIUS = 26 bits leaves
out fewer than 1 such pair in 10,000 at worst, and 9 in 10 of unrelated texts (32 bits apart). No set of blocks of 64 bits gives small
buckets at that radius, so buckets come from the shingles: 20 bands of 4 min-hashes, of which a pair at similarity 0.8
shares none with probability (1 - 0.8**4)**20, 3 in 100,000 (at 0.9: 2 in 10**10). What the blocks can serve comes from them first:
fingerprints within 2 bits are linked by operator 3's own buckets and tiles (close_prints) and verified like all others.

Buckets do not emit all their pairs: first each member meets one of its bucket's 4 hubs at most, drawn by a hash, so
that groups of copies link up at linear cost; what is then still apart in one bucket goes through the tiles in the bucket's task:
exclusive-or and bit counts of the fingerprints, and the sizes of the sets, rule pairs out. Where a bucket has many members (pages with
one template), only pairs are looked at that share one of their rarest shingles: of two sets alike at 0.8, the fifth of either that is rarest
in the bucket has a shingle in common. So pages that share a frequent half cost no pairs. All that is left is verified on
the whole shingle sets (64-bit hashes of shingles), so no text is dropped that is less alike, and only links leave the task.

Nulls and texts without words are equal to each other. A text of fewer than 5 words is one shingle. Rows without doc_id are
copies like others. Very long texts take memory in proportion to the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm import simhash
from tidings.llm.common import Spans, WordHash, dropped, packed, small_batches, text_keys, texts, written
from tidings.llm.components import components
from tidings.llm.tiles import bounds, close_pairs

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 26
BANDS = 20
ROWS = 4
PART = 2048
MANY = 200  # members of a bucket from which on only rare shingles make pairs
PAIRS = 1 << 20
_draw = np.random.default_rng(42)
FLIP = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
TIMES = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: list[bytes], hashes: WordHash) -> np.ndarray:
    """The set of hashes of a text's shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    start = np.arange(max(1, len(words) - SHINGLE + 1))
    return np.unique(Spans(hashes.of(words)).of(start, np.minimum(start + SHINGLE, len(words))))


def set_print(s: np.ndarray) -> int:
    """The SimHash of a shingle set, as a signed 64-bit number."""
    votes = np.zeros(64, np.int64)
    for part in range(0, len(s), 1 << 16):
        votes += np.unpackbits(s[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(s), bitorder="little").view(np.int64)[0])


def bands(s: np.ndarray) -> list[int]:
    """A key for each band of min-hashes of a set; none for an empty set."""
    if not len(s):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for part in range(0, len(s), PART):  # bounded memory for very long texts
        low = np.minimum(low, ((s[None, part : part + PART] ^ FLIP) * TIMES).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(low.reshape(BANDS, ROWS))]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, ka, kb, same (equal for texts of the same words), n (size of the shingle set), fp, bands."""

    def run(batches):
        hashes = WordHash(limit=100_000)
        for b in batches:
            same, n, fp, keys = [], [], [], []
            for text in texts(b):
                words = text.lower().split()  # of bytes: A-Z and ASCII white space only
                s = shingles(words, hashes)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                n.append(len(s))
                fp.append(set_print(s))
                keys.append(bands(s))
            columns = [*b.columns[:3], pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ka", "kb", "same", "n", "fp", "bands"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    read = docs.select("doc_id", *text_keys(F.col("text")), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, ka long, kb long, same binary, n long, fp long, bands array<long>")


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, s: the shingle set of each wanted node (columns node, doc_id, ka, kb)."""

    def run(batches):
        hashes = WordHash(limit=100_000)
        for b in batches:
            found = [shingles(t.lower().split(), hashes).view(np.int64) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "s"])
        pa.default_memory_pool().release_unused()

    text = docs.select(F.col("doc_id").alias("id"), *text_keys(F.col("text"), ("a", "b")), F.col("text").cast("string").alias("text"))
    both = text.join(wanted, F.expr("id <=> doc_id and a = ka and b = kb"))
    # rows that repeat both id and text would repeat the node
    return both.groupBy("node").agg(F.max("text").alias("text")).mapInArrow(run, "node long, s array<long>")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (distinct values) have the similarity."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= SIMILARITY * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """u, v: the pairs (a, b) of nodes whose shingle sets have the similarity."""
    both = pairs.join(sets_.select(F.col("node").alias("a"), F.col("s").alias("s")), "a").join(sets_.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")

    def run(batches):
        for b in batches:
            s, t = b.column(2), b.column(3)
            good = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                good[k] = similar(s[k].values.to_numpy(), t[k].values.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good))

    return both.select("a", "b", "s", "t").mapInArrow(run, "u long, v long").distinct()


def alike(n, m, fp, gp):
    """Whether sizes and fingerprints allow the similarity."""
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (F.bit_count(fp.bitwiseXOR(gp)) <= RADIUS)


def rare_pairs(sets_, fp: np.ndarray):
    """Pairs of places within the radius that share one of their rarest shingles, as close_pairs() yields them; no pair of the similarity is missing.

    Of n shingles, in the order of how many of the sets have them, the first n - ceil(SIMILARITY * n) + 1 must meet those of a similar set."""
    size = np.array([len(x) for x in sets_])
    owner = np.repeat(np.arange(len(size)), size)
    _, shingle, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, times[shingle], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    rare = order[place < np.repeat(size - np.ceil(SIMILARITY * size - 1e-9).astype(int) + 1, size)]
    rare = rare[times[shingle[rare]] > 1]
    rare = rare[np.argsort(shingle[rare], kind="stable")]
    edges, held = bounds(shingle[rare]), []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if z - a > 1:
            who = owner[rare[a:z]]
            for i, j in close_pairs(fp[who], RADIUS):
                held.append((np.minimum(who[i], who[j]) << 32) + np.maximum(who[i], who[j]))
            if sum(map(len, held)) > PAIRS:  # a pair may share several shingles: those met together are looked at once
                pairs = np.unique(np.concatenate(held))
                held = []
                yield pairs >> 32, pairs & 0xFFFFFFFF
    if held:
        pairs = np.unique(np.concatenate(held))
        yield pairs >> 32, pairs & 0xFFFFFFFF


def across(dealt: DataFrame, nodes: DataFrame, sets_: DataFrame) -> DataFrame:
    """u, v: links between members of one bucket (columns key, node, label) of different labels, as many as join their groups.

    A bucket is one task's: its tiles find the pairs that sizes and fingerprints allow, a pair that shares several
    buckets is looked at in the first of them only, and its shingle sets decide there. So no pair leaves a task but a
    link, and a bucket has fewer links than members."""

    def run(batches):
        held = []  # (key, node, label, n, fp, bands, s) of one bucket, which may go on in the next batch
        for b in batches:
            plain = [b.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(5)]
            lists = [[x.values.to_numpy() for x in b.column(k)] for k in (5, 6)]
            for row in zip(*plain, *lists):
                if held and held[0][0] != row[0]:
                    yield from joined_bucket(held)
                    held = []
                held.append(row)
        if held:
            yield from joined_bucket(held)

    def joined_bucket(rows):
        key, node, label, n, fp, bands_, s = zip(*rows)
        if len(set(label)) == 1:
            return
        group = np.unique(np.array(label), return_inverse=True)[1].tolist()
        root = list(range(len(group)))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        n, bands_ = np.array(n), np.stack(bands_)
        own = int(np.flatnonzero(bands_[0] == key[0])[0])
        u, v = [], []
        fp = np.array(fp, np.int64).view(np.uint64)
        for i, j in close_pairs(fp, RADIUS) if len(n) <= MANY else rare_pairs(s, fp):
            fit = np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j])
            i, j = i[fit], j[fit]
            first = ~(bands_[i, :own] == bands_[j, :own]).any(axis=1)
            i, j = i[first], j[first]
            if len(i):
                roots = np.array([find(x) for x in range(len(root))])
                apart = roots[np.array(group)[i]] != roots[np.array(group)[j]]
                i, j = i[apart], j[apart]
            for a, b in zip(i.tolist(), j.tolist()):
                x, y = find(group[a]), find(group[b])
                if x != y and similar(s[a], s[b]):
                    root[max(x, y)] = min(x, y)
                    u.append(node[a])
                    v.append(node[b])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = dealt.select("key", "node", "label").join(nodes.select("node", "n", "fp", "bands"), "node").join(sets_, "node")
    # by a hash of the key: Spark would leave out a repartition by the very key of a join before it, and may then split that join's keys
    rows = rows.select("key", "node", "label", "n", "fp", "bands", "s").repartition(F.xxhash64("key")).sortWithinPartitions("key")
    return rows.mapInArrow(run, "u long, v long")


def close_prints(nodes: DataFrame) -> DataFrame:
    """a < b: pairs of nodes to be verified that connect those whose fingerprints are within simhash.RADIUS bits: the buckets of pairs of
    blocks and their tiles (simhash.links) join different fingerprints, and nodes of one fingerprint meet the first of them."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(first, "fp").filter("node <> rep").select("rep", "node")
    pairs = simhash.links(first).toDF("rep", "node").union(same)
    return pairs.select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct()


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: links that connect the groups of near copies among nodes (columns node, doc_id, ka, kb, n, fp, bands)."""
    dealt = nodes.select("node", "n", "fp", F.explode("bands").alias("key"))
    hub = F.min_by(F.struct("node", "n", "fp"), F.xxhash64("node", F.pmod("key", F.lit(4))))
    shared = dealt.groupBy("key").agg(F.count("*").alias("m"), hub.alias("hub")).filter("m > 1")
    dealt = written(dealt.join(shared, "key").select("key", "node", "n", "fp", "hub"), "near-buckets")  # few: most buckets have one member
    close = written(close_prints(nodes), "near-prints-close")
    company = dealt.select("node").union(close.select("a")).union(close.select("b")).distinct()
    sets_ = written(sets(docs, nodes.select("node", "doc_id", "ka", "kb").join(company, "node")), "near-sets")
    stars = dealt.filter("node <> hub.node").filter(alike(F.col("n"), F.col("hub.n"), F.col("fp"), F.col("hub.fp")))
    stars = stars.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    stars = written(stars.union(close).distinct(), "near-stars")
    found = written(verified(stars, sets_), "near-links")
    labels = components(found).withColumnRenamed("u", "node")
    now = written(dealt.join(labels, "node", "left").select("key", "node", "n", "fp", F.coalesce("label", "node").alias("label")), "near-labelled")
    apart = now.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("h")).filter("m > 2 and l <> h").select("key")
    rest = written(across(now.join(apart, "key", "left_semi"), nodes, sets_), "near-rest")
    found = written(found.union(rest), "near-links")
    for t in (dealt, close, sets_, now, stars, rest):
        dropped(t)
    return found


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, see simhash.one_each()."""
    with small_batches(docs.sparkSession, 4):
        return _kept_rows(docs)


def _kept_rows(docs: DataFrame) -> DataFrame:
    rows = written(prints(docs), "near-prints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ka", "kb")).alias("head")
    nodes = rows.groupBy("same").agg(head, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # numbered once and written: a number stands for a text from here on
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "head", "n", "fp", "bands"), "near-nodes")
    labels = components(links(nodes.select("node", "head.doc_id", "head.ka", "head.kb", "n", "fp", "bands"), docs))
    groups = nodes.select("node", "head").join(labels, nodes["node"] == labels["u"], "left").groupBy(F.coalesce("label", "node").alias("group"))
    keep = groups.agg(F.min("head").alias("head")).select("head.doc_id", "head.ka", "head.kb")
    times = rows.groupBy("doc_id", "ka", "kb").agg(F.count("*").alias("times"))
    keep = keep.select(F.col("doc_id").alias("i"), F.col("ka").alias("a"), F.col("kb").alias("b"))
    keep = written(times.join(keep, F.expr("i <=> doc_id and a = ka and b = kb"), "left_semi"), "near-kept")
    found = packed(docs).select("row", *text_keys(F.col("row.text"), ("a", "b"))).join(keep, F.expr("row.doc_id <=> doc_id and a = ka and b = kb"))
    again = found.filter("times > 1").dropDuplicates(["doc_id", "ka", "kb"])
    return found.filter("times = 1").select("row").union(again.select("row")).select("row.*")
