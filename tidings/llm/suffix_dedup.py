"""Suffix-array dedup: bytes covered by a WIDTH-byte string that also starts earlier in the corpus go.

Sorting every suffix of a corpus would multiply it by WIDTH, so first the windows (strings of WIDTH bytes) are found that can
have a twin at all; texts are read again for each step instead of travelling:

1. A window's anchor is the leftmost of its smallest GRAM-grams by hash, which its bytes alone determine. Consecutive windows
   with one anchor form a run; twins have anchors of the same gram. Grams that stand once drop their runs.
2. Runs of the same bytes collapse: later ones repeat the first one whole. A passage in a third of all documents leaves its
   first run. Where a gram has several different first runs, these go on.
3. Within a run, STEP windows each share a core of WIDTH - STEP + 1 bytes at a fixed distance from the anchor. Cores that stand
   once drop their windows; what is left has, but for few, a twin.
4. These windows are the suffixes to be sorted. Spark samples splitters and deals them by range of their leading bytes, and by
   (doc_id, start) among equal ones, so that a string which stands in very many places is dealt out as well. A bucket sorts by
   multikey quicksort with symbols of 8 bytes: rows that tie in one symbol are sorted by the next, all ties of a depth at once.
   Neighbours that agree in all WIDTH bytes are twins, and all but the earliest are removed. The first string of a bucket may
   go on from the bucket before: buckets tell their edges, and the earliest of an edge's string decides.

Steps 1 to 3 use hashes: of grams and cores to leave out, where a collision only leaves more in, and 128 bits for equal runs.

The order of places is (doc_id, start). Null texts are empty; a text under WIDTH bytes loses nothing. Rows without doc_id neither
lose bytes nor cause others to. Rows that share a doc_id are one document in the order: equal starts cause each other no loss, and
each row loses bytes of its own text. Very long texts are searched in slices; memory for their result grows with the text.
Other columns are ignored whatever their names. The result has a row for each input row; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import bitmap, dropped, in_bitmap, mixed, texts, written
from tidings.llm.passages import map_bits, sliding_min

WIDTH, GRAM, STEP = 100, 40, 10
PLACES = WIDTH - GRAM + 1  # grams in a window
CORE = WIDTH - STEP + 1
SLICE = 1 << 18  # windows searched at once
BUCKET = 250_000  # suffixes sorted in a task

_byte = mixed(np.arange(1, 257, dtype=np.uint64))
_odd = 0x9E3779B97F4A7C15


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes in a row, by doubling."""
    part, width, factor = _byte[x], 1, _odd
    done, done_width = None, 0
    rest = GRAM
    while True:
        if rest & 1:
            n = len(x) - (done_width + width) + 1
            done = part if done is None else done[:n] * np.uint64(factor) + part[done_width : done_width + n]
            done_width += width
        rest >>= 1
        if not rest:
            return mixed(done)
        n = len(x) - 2 * width + 1
        part = part[:n] * np.uint64(factor) + part[width : width + n]
        factor, width = factor * factor % (1 << 64), 2 * width


class Runs:
    """The runs of some texts: text (place among the texts), p (first window in the text), n (windows), m (the anchor's gram), a
    (the anchor less p, when asked for)."""

    def __init__(self, data: bytes, text, begin, p, n, m, hashes):
        self.data, self.text, self.begin, self.p, self.n, self.m, self.hashes = data, text, begin, p, n, m, hashes

    def only(self, which: np.ndarray) -> Runs:
        return Runs(self.data, self.text[which], self.begin[which], self.p[which], self.n[which], self.m[which], self.hashes)

    def anchors(self) -> np.ndarray:
        """For each run, how far its anchor is from the start of its first window."""
        return (self.hashes[self.begin[:, None] + np.arange(PLACES)] == self.m[:, None]).argmax(axis=1)

    def hashed(self) -> np.ndarray:
        """A hash of each run's bytes."""
        view, digest = memoryview(self.data), xxhash.xxh64_intdigest
        return np.array([digest(view[a:z]) for a, z in zip(self.begin.tolist(), (self.begin + self.n + WIDTH - 1).tolist())], np.uint64)

    def pieces(self):
        """run, first window, number of windows, and core hash of each stretch of windows with one core (places in data)."""
        anchor = self.begin + self.anchors()
        low, high = anchor - self.begin - self.n + 1, anchor - self.begin  # bytes before the anchor in the last and in the first window
        count = high // STEP - low // STEP + 1
        run = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + (low // STEP)[run]
        first, last = anchor[run] - np.minimum(high[run], STEP * j + STEP - 1), anchor[run] - np.maximum(low[run], STEP * j)
        core = anchor[run] - STEP * j
        view, digest = memoryview(self.data), xxhash.xxh64_intdigest
        return run, first, last - first + 1, np.array([digest(view[c : c + CORE]) for c in core.tolist()], np.uint64)


def runs_of(found: list[bytes]):
    """Runs of texts, some of them (or a slice of a very long one) at a time."""
    group, size = [], 0
    for k, text in enumerate(found):
        if len(text) < WIDTH:
            continue
        for start in range(0, len(text) - WIDTH + 1, SLICE):
            part = text[start : start + SLICE + WIDTH - 1] if len(text) > SLICE else text
            group.append((k, start, part))
            size += len(part)
            if size >= SLICE:
                yield grouped_runs(group)
                group, size = [], 0
    if group:
        yield grouped_runs(group)


def grouped_runs(group) -> Runs:
    data = b"".join([part for _, _, part in group])
    ends = np.cumsum([len(part) for _, _, part in group])
    begins = np.r_[0, ends[:-1]]
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    low = sliding_min(hashes, PLACES)
    change = np.ones(len(low), bool)  # where a window's anchor is not that of the window before
    change[1:] = (low[1:] != low[:-1]) | (hashes[: len(low) - 1] == low[:-1])
    change[begins] = True
    beyond = ends - WIDTH + 1  # windows from here on go into the next text
    change[beyond[beyond < len(low)]] = True
    first = np.flatnonzero(change)
    n = np.diff(np.r_[first, len(low)])
    own = np.searchsorted(ends, first, "right")
    fit = first < beyond[own]
    first, n, own = first[fit], n[fit], own[fit]
    text, start = (np.array([g[c] for g in group], np.int64)[own] for c in (0, 1))
    return Runs(data, text, first, first - begins[own] + start, n, low[first], hashes)


def known(docs: DataFrame) -> DataFrame:
    """doc_id, k (stands for a row where ids repeat) and the text of rows with an id."""
    text = F.col("text").cast("string")
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("k"), text.alias("text"))


def twice_at_most(values: np.ndarray) -> np.ndarray:
    """Each distinct value once, or twice if it occurs more often."""
    value, count = np.unique(values, return_counts=True)
    return np.repeat(value, np.minimum(count, 2))


def repeated(docs: DataFrame, values_of, name: str):
    """The values that values_of(batch) gives twice or more over all batches: their number and a bitmap of them."""

    def run(batches):
        for b in batches:
            values = [v for v in values_of(b) if len(v)]
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(twice_at_most(np.concatenate(values)).view(np.int64))], names=["v"])

    shared = known(docs).mapInArrow(run, "v long").groupBy("v").count().filter("count > 1").select("v")
    return filled(written(shared, name), "v")


def filled(values: DataFrame, column: str):
    """A broadcast bitmap of a written table's values (16 bits for each, 32 MB at most; fuller ones only let more through)."""
    size = map_bits(values.count())
    bits = values.sparkSession.sparkContext.broadcast(bitmap(values.select(column), column, size))
    dropped(values)
    return lambda x: in_bitmap(np.frombuffer(bits.value, np.uint64), x.view(np.uint64), size)


def place_hash(k, p):
    """Stands for a run: the same for numpy arrays (signed) and columns."""
    if isinstance(k, np.ndarray):
        return k ^ p ^ (p << 40)
    return k.bitwiseXOR(p).bitwiseXOR(F.shiftleft(p, 40))


def columns_of(b, runs: Runs):
    """doc_id and k of each run."""
    return b.column(0).to_numpy()[runs.text], b.column(1).to_numpy()[runs.text]


def shared_runs(docs: DataFrame, is_shared) -> DataFrame:
    """doc_id, k, p, n, m, c of runs whose gram is shared. A run that repeats one of its own text has no m: it is lost whatever other texts hold."""

    def run(batches):
        for b in batches:
            for runs in runs_of(texts(b)):
                runs = runs.only(is_shared(runs.m))
                if not len(runs.p):
                    continue
                doc, k = columns_of(b, runs)
                c = runs.hashed()
                seen = np.zeros(len(c), bool)
                seen[np.unique(np.stack([runs.text.view(np.uint64), runs.m, c]), axis=1, return_index=True)[1]] = True
                m = pa.array(runs.m.view(np.int64), mask=~seen)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(k), pa.array(runs.p), pa.array(runs.n.astype(np.int32)), m, pa.array(c.view(np.int64))], names=["doc_id", "k", "p", "n", "m", "c"])

    return known(docs).mapInArrow(run, "doc_id long, k long, p long, n int, m long, c long")


def suffixes(docs: DataFrame, is_wanted, is_core) -> DataFrame:
    """doc_id, k, start, suffix: the windows of wanted runs whose core is shared."""

    def run(batches):
        for b in batches:
            for runs in wanted_runs(b, is_wanted):
                at, first, n, core = runs.pieces()
                good = is_core(core)
                at, first, n = at[good], first[good], n[good]
                if not len(at):
                    continue
                window = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = np.repeat(at, n)
                doc, k = columns_of(b, runs)
                data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(runs.data, np.uint8), WIDTH)[window]
                own = pa.Array.from_buffers(pa.binary(), len(window), [None, pa.py_buffer(np.arange(len(window) + 1, dtype=np.int32) * WIDTH), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(k[at]), pa.array(runs.p[at] + window - runs.begin[at]), own], names=["doc_id", "k", "start", "suffix"])

    return known(docs).mapInArrow(run, "doc_id long, k long, start long, suffix binary")


def wanted_runs(b, is_wanted):
    for runs in runs_of(texts(b)):
        runs = runs.only(is_wanted(place_hash(columns_of(b, runs)[1], runs.p)))
        if len(runs.p):
            yield runs


def multikey_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their symbols, and for each place of it whether the row equals the one before."""
    order = np.argsort(symbols[:, 0], kind="stable")
    head = np.r_[True, symbols[order[1:], 0] != symbols[order[:-1], 0]][: len(order)]
    for depth in range(1, symbols.shape[1]):
        group = np.cumsum(head)
        tied = np.flatnonzero(~head | np.r_[~head[1:], False])  # in a group of two or more
        if not len(tied):
            break
        own = symbols[order[tied], depth]
        again = np.lexsort((own, group[tied]))
        order[tied], own = order[tied][again], own[again]
        head[tied[1:]] |= (own[1:] != own[:-1]) & (group[tied[1:]] == group[tied[:-1]])
    return order, ~head


HIT, OPEN, EDGE = 0, 1, 2


def sorted_bucket(batches):
    """kind, doc_id, k, start, suffix of a bucket: what has an earlier twin in it (HIT), the earliest places of its first string, which may have one
    in a bucket before (OPEN), and the earliest place of its first and of its last string (EDGE)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    doc, k, start = (t.column(c).to_numpy() for c in ("doc_id", "k", "start"))
    whole = t.column("suffix").combine_chunks()
    raw = b"".join(whole.to_pylist())
    width = -(-WIDTH // 8) * 8
    padded = np.zeros((len(doc), width), np.uint8)
    padded[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(len(doc), WIDTH)
    order, same = multikey_order(padded.view(">u8").astype(np.uint64))
    group = np.cumsum(~same) - 1
    inner = np.lexsort((start[order], doc[order], group))
    order = order[inner]  # groups stay where they are
    first = order[np.flatnonzero(~same)]  # the earliest place of each group
    lead = first[group]
    later = (doc[order] > doc[lead]) | (start[order] > start[lead])
    open_ = order[(group == 0) & ~later]
    edges = first[[0, -1]] if len(first) > 1 else first
    at = np.concatenate([order[later], open_, edges])
    kind = np.repeat(np.array([HIT, OPEN, EDGE], np.int32), [int(later.sum()), len(open_), len(edges)])
    shown = pa.concat_arrays([pa.nulls(int(later.sum()), pa.binary()), whole.take(pa.array(np.r_[open_, edges])).cast(pa.binary())])
    yield from pa.Table.from_arrays([pa.array(kind), *[pa.array(x[at]) for x in (doc, k, start)], shown], names=["kind", "doc_id", "k", "start", "suffix"]).to_batches(max_chunksize=10_000)


def twins(found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, k, start of the suffixes (a written table) that also start at an earlier place."""
    n = max(1, -(-found.count() // bucket))
    keys = ["suffix", "doc_id", "start"]
    told = found.repartitionByRange(n, *keys).mapInArrow(sorted_bucket, "kind int, doc_id long, k long, start long, suffix binary")
    told = written(told, "suffix-order")
    edges = told.filter(F.col("kind") == EDGE).groupBy(F.col("suffix").alias("s")).agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = told.filter(F.col("kind") == OPEN).join(edges, F.col("suffix") == F.col("s")).filter(F.struct("doc_id", "start") > F.col("first"))
    return told.filter(F.col("kind") == HIT).select("doc_id", "k", "start").union(later.select("doc_id", "k", "start"))


def removals(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """d, u (doc_id and k), spans: [a, z) byte places that go, possibly overlapping, of each row that loses any."""
    is_shared = repeated(docs, lambda b: [runs.m for runs in runs_of(texts(b))], "shared-grams")
    every = written(shared_runs(docs, is_shared), "byte-runs")
    some = every.filter("m is not null")
    head = F.min(F.struct("doc_id", "p", "k", "n")).alias("f")
    heads = written(some.groupBy("m", "c").agg(head, F.count("*").alias("times")).select("m", "c", "f.doc_id", "f.p", "f.k", "times"), "first-runs")
    first = heads.filter("times > 1").select("m", "c", F.struct("doc_id", "p").alias("first"))
    whole = some.join(first, ["m", "c"]).filter(F.struct("doc_id", "p") > F.col("first")).select("doc_id", "k", "p", "n")
    whole = whole.union(every.filter("m is null").select("doc_id", "k", "p", "n"))
    whole = written(whole.select("doc_id", "k", F.col("p").alias("a"), (F.col("p") + F.col("n") + WIDTH - 1).alias("z")), "whole-runs")

    several = heads.groupBy("m").count().filter("count > 1").select("m")
    wanted = written(heads.join(several, "m", "left_semi").select(place_hash(F.col("k"), F.col("p")).alias("v")), "wanted-runs")
    dropped(every)
    dropped(heads)
    is_wanted = filled(wanted, "v")
    is_core = repeated(docs, lambda b: [runs.pieces()[3] for runs in wanted_runs(b, is_wanted)], "shared-cores")
    found = written(suffixes(docs, is_wanted, is_core), "suffixes")
    hits = twins(found, bucket).select("doc_id", "k", F.col("start").alias("a"), (F.col("start") + WIDTH).alias("z"))
    spans = whole.union(hits).groupBy(F.col("doc_id").alias("d"), F.col("k").alias("u")).agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    out = written(spans, "byte-spans")
    for t in (found, whole, hits):
        dropped(t)
    return out


def result(text: bytes, spans, with_text: bool):
    """n_bytes, n_removed, n_spans, kept_sha256, kept."""
    if not len(spans):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text if with_text else None
    turn = np.zeros(len(text) + 1, np.int64)
    np.add.at(turn, spans[:, 0], 1)
    np.add.at(turn, spans[:, 1], -1)
    gone = np.cumsum(turn[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def stripped(docs: DataFrame, with_text: bool = False, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of each document."""
    spans = removals(docs, bucket)
    size = map_bits(spans.count())
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select("u"), "u", size))

    def untouched(batches):  # texts that lose nothing are done where they are read; the others travel
        bits = np.frombuffer(seen.value, np.uint64)
        for b in batches:
            ids, k = b.column(0), b.column(1)
            maybe = in_bitmap(bits, k.to_numpy().view(np.uint64), size) & ids.is_valid().to_numpy(zero_copy_only=False)
            rows = [(None,) * 5 + (t,) if later else (*result(t, (), with_text), None) for t, later in zip(texts(b), maybe.tolist())]
            values = [pa.array(x, t) for x, t in zip(zip(*rows), [*KINDS[1:], pa.binary()])]
            yield pa.RecordBatch.from_arrays([ids, k, *values], names=["doc_id", "k", *NAMES[1:], "text"])

    def finished(batches):
        for b in batches:
            rows, lists = [], b.column(b.schema.get_field_index("spans"))
            for at, r in enumerate(b.drop_columns(["spans"]).to_pylist()):
                if r["text"] is None:
                    rows.append(tuple(r[c] for c in NAMES))
                    continue
                own = lists[at].values
                own = np.stack([own.field(c).to_numpy() for c in ("a", "z")], axis=1) if own is not None and len(own) else ()
                rows.append((r["doc_id"], *result(r["text"], own, with_text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), KINDS)], names=NAMES)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("k"), text.alias("text")).mapInArrow(untouched, f"doc_id long, k long, {kinds}, text binary")
    both = read.join(spans, F.expr("doc_id = d and k = u"), "left").select(*NAMES, "text", "spans")
    out = both.mapInArrow(finished, f"doc_id long, {kinds}")
    return out if with_text else out.drop("kept")


ORACLE = """
with texts as (select row_number() over () as r, doc_id, hex(coalesce(text, '')) as h from documents),
parts as (select r, doc_id, c, substr(h, 2 * c + 1, 998) as h from (select r, doc_id, h, unnest(range(0, len(h) // 2 - 99, 400)) as c from texts where doc_id is not null)),
windows as (select r, doc_id, c + i as i, md5_number(substr(h, 2 * i + 1, 200)) as s from (select r, doc_id, c, h, unnest(range(least(400, len(h) // 2 - 99))) as i from parts)),
firsts as (select s, min({'d': doc_id, 'i': i}) as f from windows group by s having count(*) > 1),
gone as (select r, i from windows join firsts using (s) where {'d': doc_id, 'i': i} > f),
marked as (select r, i, case when i <= lag(i) over (partition by r order by i) + 100 then 0 else 1 end as opens from gone),
numbered as (select r, i, sum(opens) over (partition by r order by i) as n from marked),
spans as (select r, n, min(i) as a, max(i) + 100 as z from numbered group by r, n),
gaps as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as from_ from spans),
cut as (select r, count(*) as n_spans, sum(z - a) as n_removed, max(z) as last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) as kept from gaps join texts using (r) group by r)
select doc_id, len(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from texts left join cut using (r)
"""
