"""Hard negatives by exact search over one-dimensional distance keys.

A vector's components become integers, floor(256 * x); a row's score for an anchor is their inner product. One more component,
sqrt(M - |x|^2) with M the largest |x|^2, gives all rows one length, so that a higher score is a smaller distance: |q|^2 + M - 2 *
score = distance^2 with the anchor's own further component at 0. Each row belongs to its nearest of PIVOTS pivots, and its key
is the distance to that pivot. Rows are stored sorted by (pivot, key), in blocks of BLOCK rows with the interval of their keys.

By the triangle inequality a block holds nothing nearer to an anchor than the gap between its interval and the anchor's distance
to the pivot. So a search scans the blocks whose gap lies in the next annulus, keeps the best rows, and widens the annulus until
the score that its radius still allows is beaten by the last of the best rows (or is below what counts). Positives are searched
from the anchor outwards; negatives from the distance at which scores fall to 90 % of the best positive's, and blocks that lie
nearer as a whole are left out. Every row is indexed and every search is certified: nothing is approximate.

An annulus is a round: pairs of anchor and block come from a join by pivot, go in tiles of one block and up to some QUERIES
anchors, and a tile sends on its best rows alone. Rounds are few: radii are where 1/1000, 1/128, 1/16 and 1/2 of a sample lie, then all.

The pivots are fitted on at most SAMPLE rows (those with the smallest hashes); they and the sample, which is broadcast, decide speed only.

Rows without vec_id, label or vector, and rows with a null or non-finite component, take no part. A vector shorter than another counts as 0
beyond its end; an empty one scores 0. Rows that repeat a vec_id are rows of their own, but are no partners of an anchor with
that vec_id. Scores beyond 64 bits stop at the largest such number. Ties go by vec_id. An anchor without a positive, or a positive without
negatives, has no rows. Other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import dropped, small_batches, written

PIVOTS, SAMPLE = 32, 2048
BLOCK, QUERIES = 1024, 256
POSITIVES, NEGATIVES = 5, 10
EVERY = 100  # anchors are the rows whose vec_id this divides
RANKS = (2, 16, 128, 1024)  # of SAMPLE
SLACK = 1e-6  # relative; distances are floating-point numbers, scores are not


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (integer components) and n2 (squared length) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda e: F.floor(e * 256)).alias("v"))
    return rows.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix, shorter lists filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    size = np.diff(np.r_[0, ends])
    out = np.zeros((len(size), int(max(size.max(initial=0), width or 0))), flat.dtype if len(flat) else np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices cut to the width that both have: what is beyond one's end counts as 0."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices, exactly."""
    a, b = aligned(a, b)
    most = [int(max(x.max(initial=0), -int(x.min(initial=0)))) for x in (a, b)]
    bound = most[0] * most[1] * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Space:
    """The pivots, a sample of rows, and distances to either; `longest` is the largest squared length of any row."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        self.sample = self.augmented(sample)
        self.pivots = self.fitted(self.sample, min(PIVOTS, len(sample)))

    def augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.c_[v, np.sqrt(np.maximum(self.longest - (v * v).sum(axis=1), 0))]

    @staticmethod
    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))

    def fitted(self, x: np.ndarray, k: int) -> np.ndarray:
        """Farthest-first pivots, moved to the means of what is nearest to them."""
        chosen, low = [0], self.far(x, x[:1])[:, 0]
        while len(chosen) < k:
            chosen.append(int(low.argmax()))
            low = np.minimum(low, self.far(x, x[chosen[-1:]])[:, 0])
        pivots = x[chosen]
        for _ in range(5):
            own = self.far(x, pivots).argmin(axis=1)
            pivots = np.stack([x[own == j].mean(axis=0) if (own == j).any() else pivots[j] for j in range(k)])
        return pivots

    def fit(self, v: np.ndarray) -> np.ndarray:
        """Vectors of any length at the width of the sample: the end of a longer one lies in the component that the others lack."""
        width = self.sample.shape[1] - 1
        return np.pad(v[:, :width], ((0, 0), (0, max(0, width - v.shape[1]))))

    def keys(self, v: np.ndarray) -> np.ndarray:
        return self.far(self.augmented(self.fit(v)), self.pivots)

    def from_anchors(self, v: np.ndarray, to: np.ndarray) -> np.ndarray:
        v = self.fit(v).astype(np.float64)
        return self.far(np.c_[v, np.zeros(len(v))], to)


INDEX = "block long, pivot int, lo double, hi double, ids binary, labels binary, width int, vectors binary"


def indexed(rows: DataFrame, space) -> DataFrame:
    """The blocks: rows sorted by (pivot, key), BLOCK at a time."""

    def keyed(batches):
        for b in batches:
            far = space.value.keys(matrix(b.column(2)))
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot]), *b.columns[:3]], names=["pivot", "key", "vec_id", "label", "v"])

    def packed(batches):
        block, held = TaskContext.get().partitionId() << 32, None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows:
                pivot = held.column(0).to_numpy()
                n = int(np.searchsorted(pivot, pivot[0], "right"))
                if n == held.num_rows and n < BLOCK:
                    break
                yield row(block, held.slice(0, min(n, BLOCK)))
                block, held = block + 1, held.slice(min(n, BLOCK))
        if held is not None and held.num_rows:
            yield row(block, held)

    def row(block, t):
        t = t.combine_chunks()
        key = t.column(1).to_numpy()
        v = matrix(t.column("v").combine_chunks())
        small = np.abs(v).max(initial=0) < 1 << 31 and v.min(initial=0) > -(1 << 31)
        values = [block, t.column(0)[0].as_py(), key[0], key[-1], t.column("vec_id").to_numpy().tobytes(), t.column("label").to_numpy().tobytes(), v.shape[1], v.astype("<i4" if small else "<i8").tobytes()]
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    keys = rows.select("vec_id", "label", "v").mapInArrow(keyed, "pivot int, key double, vec_id long, label long, v array<long>")
    order = ["pivot", "key", "vec_id"]
    return keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, INDEX)


def unpacked(b: pa.RecordBatch, k: int):
    """ids, labels and vectors of a block."""
    ids, labels, raw = (b.column(b.schema.get_field_index(x))[k].as_py() for x in ("ids", "labels", "vectors"))
    ids, width = np.frombuffer(ids, "<i8"), b.column(b.schema.get_field_index("width"))[k].as_py()
    if not width:
        return ids, np.frombuffer(labels, "<i8"), np.zeros((len(ids), 0), np.int64)
    kind = "<i4" if len(raw) == 4 * len(ids) * width else "<i8"
    return ids, np.frombuffer(labels, "<i8"), np.frombuffer(raw, kind).reshape(len(ids), width)


def best(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int):
    """Row, score and id of the k best places of each row of s where ok, by score and then by smaller id."""
    low = np.where(ok, s, np.iinfo(np.int64).min)
    if s.shape[1] > k:
        ok = ok & (s >= np.partition(low, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    i, j = np.nonzero(ok)
    order = np.lexsort((ids[j], ~s[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], s[i, j][rank < k], ids[j][rank < k]


def found_in(tiles: DataFrame, negatives: bool) -> DataFrame:
    """qid, j, score, id: the best rows of each tile's block for each of its anchors (and, for negatives, each positive j)."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, labels, v = unpacked(b, k)
                q = pa.RecordBatch.from_struct_array(b.column(b.schema.get_field_index("q"))[k].values)
                qid, own_id, own_label = (q.column(x).to_numpy(zero_copy_only=False) for x in range(3))
                s = scores(matrix(q.column(3)), v)
                same, self_ = own_label[:, None] == labels, own_id[:, None] == ids
                if not negatives:
                    yield rows(qid, 0, *best(s, same & ~self_, ids, POSITIVES))
                    continue
                low, high = ([x or [] for x in q.column(c).to_pylist()] for c in (4, 5))
                for j in range(max(map(len, low), default=0)):
                    lo, hi = (np.array([[x[j]] if j < len(x) else [gone] for x in side]) for side, gone in ((low, 1), (high, 0)))
                    yield rows(qid, j, *best(s, ~same & ~self_ & (s >= lo) & (s <= hi), ids, NEGATIVES))

    def rows(qid, j, i, score, id_):
        return pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(np.full(len(i), j, np.int32)), pa.array(score), pa.array(id_)], names=["qid", "j", "score", "id"])

    return tiles.mapInArrow(run, "qid long, j int, score long, id long")


def searched(anchors: DataFrame, ways: DataFrame, index: DataFrame, longest: float, negatives: bool) -> DataFrame:
    """qid, j, score, id, rank: the best rows for the anchors (qid, vec_id, label, v, n2, low, high, near, radii), certified.

    ways: qid, pivot, d (distance of the anchor to the pivot)."""
    k = NEGATIVES if negatives else POSITIVES
    slots = -(-anchors.count() // QUERIES)
    query = F.struct("qid", "vec_id", "label", "v", "low", "high")
    live = anchors.select("qid", "n2", "near", "radii", "low", F.lit(-1.0).alias("r0"))
    have = None
    for step in range(len(RANKS) + 1):
        if step:  # who is not certified yet
            worst = have.groupBy("qid", "j").agg(F.count("*").alias("n"), F.min("score").alias("worst")).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("j", F.when(F.col("n") >= k, F.col("worst")).alias("w")))).alias("worst"))
            allowed = (F.col("n2") + longest - F.col("r1") * F.col("r1")) / 2 + SLACK * (F.col("n2") + longest)
            open_ = lambda j: F.coalesce(allowed > F.col("worst")[j], F.lit(True))
            still = F.exists(F.sequence(F.lit(0), F.size("low") - 1), lambda j: open_(j) & (allowed >= F.col("low")[j])) if negatives else open_(F.lit(0))
            live = written(live.join(worst, "qid", "left").filter(still).select("qid", "n2", "near", "radii", "low", F.col("r1").alias("r0")), "search-live")
            if live.isEmpty():
                break
        live = live.withColumn("r1", F.col("radii")[step])
        gap = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0)) * (1 - SLACK)
        there = ways.join(live, "qid").join(index.select("block", "pivot", "lo", "hi"), "pivot")
        there = there.filter((gap <= F.col("r1")) & (gap > F.col("r0")) & ((F.col("d") + F.col("hi")) * (1 + SLACK) >= F.col("near")))
        slot = F.pmod(F.xxhash64("qid"), F.lit(slots))
        tiles = there.select("block", "qid", slot.alias("slot")).join(anchors.select("qid", query.alias("own")), "qid").groupBy("block", "slot").agg(F.collect_list("own").alias("q"))
        fresh = found_in(tiles.join(index.select("block", "ids", "labels", "width", "vectors"), "block").select("ids", "labels", "width", "vectors", "q"), negatives)
        rank = F.row_number().over(Window.partitionBy("qid", "j").orderBy(F.desc("score"), "id"))
        every = fresh if have is None else have.select("qid", "j", "score", "id").union(fresh)
        have = written(every.withColumn("rank", rank).filter(F.col("rank") <= k), "search-best")
    return have


def with_radii(anchors: DataFrame, space, near: Column) -> DataFrame:
    """anchors with `near`, nearer than which nothing counts, and `radii`, where rounds end."""

    def run(batches):
        for b in batches:
            far = np.sort(space.value.from_anchors(matrix(b.column(1)), space.value.sample), axis=1)
            own = b.column(2).to_numpy(zero_copy_only=False)
            first = (far < own[:, None]).sum(axis=1)
            radii = [[float(f[n + r]) if n + r < len(f) else float("inf") for r in RANKS] + [float("inf")] for f, n in zip(far, first.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(radii, pa.list_(pa.float64()))], names=["k", "near", "radii"])

    more = anchors.select("qid", "v", near.alias("near")).mapInArrow(run, "k long, near double, radii array<double>")
    return anchors.join(more, F.col("qid") == F.col("k")).drop("k")


def mined(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    with small_batches(embeddings.sparkSession):
        return _mined(embeddings)


def _mined(embeddings: DataFrame) -> DataFrame:
    spark = embeddings.sparkSession
    rows = written(prepared(embeddings), "vectors")
    longest = rows.agg(F.max("n2")).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id", "label", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sample.num_rows:
        return spark.createDataFrame([], kind)
    space = spark.sparkContext.broadcast(Space(matrix(sample.column(0).combine_chunks()), longest))
    index = written(indexed(rows, space), "vector-blocks")
    numbers = F.array().cast("array<long>")
    anchors = rows.filter(F.col("vec_id") % EVERY == 0).select(F.monotonically_increasing_id().alias("qid"), "vec_id", "label", "v", "n2")
    anchors = written(anchors, "anchors")

    def to_pivots(batches):
        for b in batches:
            far = space.value.from_anchors(matrix(b.column(1)), space.value.pivots)
            n, p = far.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), p)), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(far.reshape(-1))], names=["qid", "pivot", "d"])

    ways = written(anchors.select("qid", "v").mapInArrow(to_pivots, "qid long, pivot int, d double"), "anchor-pivots")
    plain = written(with_radii(anchors, space, F.lit(0.0)).withColumns({"low": numbers, "high": numbers}), "anchors")
    found = searched(plain, ways, index, longest, negatives=False)

    positives = found.select("qid", (F.col("rank") - 1).cast("int").alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 30 p <= 100 s <= 90 p in whole numbers: from the ceiling of 3 p / 10 to the floor of 9 p / 10
    p = F.col("score").cast("decimal(38,0)")
    limits = F.struct("rank", F.ceil(p * 3 / 10).cast("long").alias("low"), F.floor(p * 9 / 10).cast("long").alias("high"))
    limits = found.groupBy("qid").agg(F.array_sort(F.collect_list(limits)).alias("limits"))
    with_limits = anchors.join(limits, "qid").select("qid", "vec_id", "label", "v", "n2", F.col("limits.low").alias("low"), F.col("limits.high").alias("high"))
    near = F.sqrt(F.greatest(F.col("n2") + longest - 2 * F.array_max("high").cast("double"), F.lit(0.0))) * (1 - SLACK)
    with_limits = written(with_radii(with_limits, space, near), "anchors")
    negatives = searched(with_limits, ways, index, longest, negatives=True)
    out = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["qid", "j"])
    out = out.join(anchors.select("qid", F.col("vec_id").alias("anchor_id")), "qid")
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for t in (rows, index, anchors, ways, plain, found, with_limits, negatives):
        dropped(t)
    return out


ORACLE = """
with took_part as (
  select cast(vec_id as bigint) as vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from took_part a join took_part b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
negatives as (
  select p.*, s.other_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from negatives where rank <= 10
"""
