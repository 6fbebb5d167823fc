"""SimHash near-dedup: 64-bit fingerprints of shingles, tiled exact comparison, components.

Two forms share the fingerprints, the tiles (exclusive-or and bit counts in numpy, tile pairs whose population counts
differ beyond the radius skipped) and the components:

- near_copies(): 3-word shingles, links at up to 2 differing bits, whatever the texts are. Two such fingerprints agree on at
  least 2 of 4 blocks of 16 bits: each distinct fingerprint goes to the 6 buckets of its pairs of blocks. A bucket with
  very many members is dealt again by thirds of the 32 bits outside its pair, of which one must agree as well; what is dealt
  together then agrees in 42 bits or 43 and so has at most 2**22 members. A radius of 2 bits is narrow: it finds all exact copies,
  but of texts that differ in a few words about half.
- one_each(): 5-word shingles and Jaccard similarity >= 0.8 (tidings/llm/near_texts.py). The radius that this asks for is too wide for
  blocks of 64 bits, so its buckets come from the shingles, and what the tiles leave is verified on the whole shingle sets.

Equal fingerprints collapse first, so groups of copies cost one row. A bucket reports only links that join members it has
not joined yet, so links stay fewer than fingerprints; no link between different groups is lost.

Nulls and texts without words have fingerprint zero and are linked like any other. A text of fewer words than a shingle is one
shingle. Repeated rows are separate documents of the same fingerprint. A row without doc_id links
and gets its component like any other, but names none (null where no row of the component has an id). Very long texts cost memory in proportion to the text. Other columns
are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import texts, written
from tidings.llm.components import components
from tidings.llm.tiles import bounds, close_pairs, joined, whole_buckets

RADIUS = 2
SHINGLE = 3
HEAVY = 50_000
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    stop = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *stop[: n - 1].tolist()]
    stops = (stop[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    votes = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_links(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray):
    """Links (u, v) between representatives, for whole buckets in the order of their keys."""
    edges = bounds(keys)
    sizes = np.diff(edges)
    u, v = [], []
    two = edges[:-1][sizes == 2]  # most buckets with company have two members
    ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS if len(two) else np.zeros(0, bool)
    u.append(rep[two[ok]])
    v.append(rep[two[ok] + 1])
    for a, n in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
        root = joined(n, close_pairs(fp[a : a + n], RADIUS))
        kids = np.flatnonzero(root != np.arange(n))
        u.append(rep[a + root[kids]])
        v.append(rep[a + kids])
    return np.concatenate(u), np.concatenate(v)


PAIRS = [(16 * a, 16 * b) for a in range(4) for b in range(a + 1, 4)]


def bits_of(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def pair_keys(fp):
    """For each pair of blocks, its number and a key of its bits."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.xxhash64(F.lit(k), *[bits_of(fp, s, 16) for s in p]).alias("key")) for k, p in enumerate(PAIRS)]))


def again_keys(fp, pair, key):
    """Keys of the thirds of the 32 bits outside the pair: at most 2 of them differ between close members, so a third agrees."""
    parts = []
    for p in PAIRS:
        low, high = sorted({0, 16, 32, 48} - set(p))
        rest = bits_of(fp, low, 16).bitwiseOR(F.shiftleft(bits_of(fp, high, 16), 16))
        parts.append(F.array(*[F.xxhash64(key, F.lit(k), bits_of(rest, s, w)) for k, (s, w) in enumerate(((0, 11), (11, 11), (22, 10)))]))
    return F.explode(F.element_at(F.array(*parts), pair + 1))


def buckets(nodes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """key, fp, rep: the buckets of distinct fingerprints (columns fp, rep)."""
    dealt = nodes.select("fp", "rep", pair_keys(F.col("fp")).alias("b")).select("fp", "rep", "b.pair", "b.key")
    big = dealt.groupBy("key").count().filter(F.col("count") > heavy).select("key", F.lit(True).alias("big"))
    dealt = dealt.join(big, "key", "left")
    again = dealt.filter("big").select(again_keys(F.col("fp"), F.col("pair"), F.col("key")).alias("key"), "fp", "rep")
    return dealt.filter("big is null").select("key", "fp", "rep").union(again)


def links(nodes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """u, v: links between the representatives of distinct fingerprints (columns fp, rep)."""

    def run(batches):
        for key, fp, rep in whole_buckets(batches):
            u, v = bucket_links(key, fp.view(np.uint64), rep)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # by a hash of the key: Spark would leave out a repartition by the very key of a join before it, and may then split that join's keys
    return buckets(nodes, heavy).repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    prints = written(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # a fingerprint stands for itself, so one whose rows have no id still joins others
    labels = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    group = nodes.join(labels, nodes["fp"] == labels["u"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("group"))
    least = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    # as a written table, Spark can split its join where very many documents have one fingerprint
    classes = written(group.join(least, "group").select("fp", "component_id"), "simhash-classes")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """Of each group of near copies by words (5-word shingles, Jaccard >= 0.8) one row, with the columns it came with.

    It is the row with the smallest doc_id; where that id has several texts in one group, the first by their hashes. A group
    in which no row has an id keeps the first by its hashes. Equal rows are copies, of which one stays."""
    from tidings.llm.near_texts import kept_rows

    return kept_rows(docs)
