"""Similarity joins of unit vectors.

similar_pairs is exact and runs as tiles: vectors are dealt into blocks, a task multiplies one pair of blocks, and
only pairs at or above the threshold leave it. Each pair of blocks is a partition, so no side is
broadcast and memory holds two blocks. Exact all-pairs work is quadratic; similar_pairs_lsh trades recall for less.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


#: Bytes of vectors in a block of rows (as doubles), rows of a block of few, and the shape of a tile.
HELD, FEW, TILE = 32 << 20, 2048, (512, 1024)


def meetings(vectors: DataFrame, told: Callable, schema: str, by: str = "id", blocks: int | None = None) -> DataFrame:
    """What ``told`` makes of the pairs of rows (v, and whole numbers, ``by`` among them) that are alike.

    Rows are dealt into blocks by a hash of ``by``; each pair of blocks is a partition of its own, so a vector travels once for each block, in the
    type it comes in, and a task holds two blocks. told(rows, hits) gets the columns as arrays and yields columns of the schema. hits(floor,
    asks) yields i, j, sim for one tile of rows after the other: the pairs that reach floor[0], which may rise meanwhile, and the lesser of
    asks[i] and asks[j] (sim is not rounded). Rows of a block are in order of asks or ``by``; a pair of two rows comes once. Products are taken
    in single precision; what they leave in doubt or find is multiplied again in double precision, one place after the other, as SQL does."""
    kind = "array<float>" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
    whole = [c for c in vectors.columns if c != "v"]
    own = vectors.filter("v is not null").select(*[F.col(c).cast("long").alias(c) for c in whole], F.col("v").cast(kind).alias("v"))
    count, width = own.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = blocks or max(1, -(-count // max(FEW, HELD // (8 * (width or 1)))), min(8, -(-count // FEW)))
    spread = own.withColumn("k", F.pmod(F.xxhash64(by), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    low, high = F.least("k", "other"), F.greatest("k", "other")
    dealt = spread.repartitionById(blocks * (blocks + 1) // 2, (F.shiftright(high * (high + 1), 1) + low).cast("int"))
    names, kinds = zip(*((c.split()[0], {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")))

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        rows = {c: table.column(c).to_numpy() for c in [*whole, "k", "other"]}
        m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]).reshape(len(rows["k"]), -1)
        ends = sorted((rows["k"][0], rows["other"][0]))
        sides = [np.flatnonzero(rows["k"] == k) for k in ends]
        out, waiting = [], 0
        for columns in told(rows, lambda floor, asks=None: tiles(m, *sides, rows[by] if asks is None else asks, floor, asks, ends[0] == ends[1])):
            out.append(columns)
            waiting += len(columns[0])
            if waiting >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], names=list(names))
                out, waiting = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], names=list(names))

    return dealt.mapInArrow(run, schema)


def tiles(m: np.ndarray, one: np.ndarray, two: np.ndarray, order: np.ndarray, floor: list, asks: np.ndarray | None, same: bool):
    """i, j, sim of each tile's pairs, see meetings; same: both sides are one block, of which a pair is taken once."""
    if not len(one) or not len(two):
        return
    one, two = (side[np.argsort(order[side], kind="stable")] for side in (one, two))
    with np.errstate(all="ignore"):
        long = [float(np.nan_to_num(np.sqrt(np.einsum("ij,ij->i", m[side], m[side], dtype=float)), nan=0.0, posinf=np.inf).max()) for side in (one, two)]
        kind = np.float32 if (doubt := 1.2e-7 * (m.shape[1] + 4) * long[0] * long[1]) < 1e-3 else np.float64
        doubt = doubt if kind is np.float32 else 2.3e-16 * (m.shape[1] + 4) * long[0] * long[1]
        x, y = m[one].astype(kind, copy=False), np.ascontiguousarray(m[two].T.astype(kind, copy=False))
        needs = [None if asks is None else asks[side] for side in (one, two)]
        for a in range(0, len(one), TILE[0]):
            for b in range(a if same else 0, len(two), TILE[1]):
                least = floor[0] if asks is None else max(floor[0], min(needs[0][a : a + TILE[0]].min(), needs[1][b : b + TILE[1]].min()) - 1e-6)
                near = x[a : a + TILE[0]] @ y[:, b : b + TILE[1]] >= kind(least - doubt - 1e-7)
                flat = near.reshape(-1)
                if flat.size % 8:
                    at = np.flatnonzero(flat)
                else:  # eight at once: few are alike
                    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
                    at = at[flat[at]]
                i, j = np.divmod(at, near.shape[1])
                if same:
                    later = j + b > i + a
                    i, j = i[later], j[later]
                i, j = one[i + a], two[j + b]
                sim = np.concatenate([np.zeros(0)] + [np.cumsum(m[i[k : k + 4096]].astype(float) * m[j[k : k + 4096]], axis=1)[:, -1] for k in range(0, len(i), 4096)])
                reach = sim >= (least if asks is None else np.maximum(floor[0], np.minimum(asks[i], asks[j]) - 1e-6))
                if reach.any():
                    yield i[reach], j[reach], sim[reach]


def rounded(sim: np.ndarray) -> np.ndarray:
    """To 6 digits, as SQL does: halves away from zero."""
    return np.copysign(np.floor(np.abs(sim) * 1e6 + 0.5), sim) / 1e6


def similar_pairs(vectors: DataFrame, least: float, blocks: int | None = None) -> DataFrame:
    """a < b, sim: pairs of rows (id, v) with a dot product of at least ``least`` (JN7), rounded to 6 digits."""

    def told(rows, hits):
        for i, j, sim in hits([least]):
            x, y = rows["id"][i], rows["id"][j]
            keep = x != y
            yield np.minimum(x, y)[keep], np.maximum(x, y)[keep], rounded(sim[keep])

    return meetings(vectors.select("id", "v"), told, "a long, b long, sim double", blocks=blocks)


def similar_pairs_in_window(vectors: DataFrame, least: float, hours: int = 72) -> DataFrame:
    """The same for rows (id, at, v), as far as they lie at most ``hours`` apart: what clusters and links look at.

    A row goes to its own span of ``hours`` and to the next one; a pair is found in the later row's span. So the work
    grows with the rows of a window, not with their square over all time."""
    span = F.floor(F.unix_micros("at") / (hours * 3_600_000_000)).cast("long")
    own = vectors.select("id", F.unix_micros("at").alias("at"), F.col("v").cast("array<double>").alias("v"), span.alias("own"))
    spread = own.withColumn("span", F.explode(F.array("own", F.col("own") + 1)))
    # each span has blocks by its own rows, so a busy one copies no other span's rows
    blocks = spread.groupBy("span").count().select("span", F.ceil(F.col("count") / (2 * BLOCK)).alias("blocks"))
    spread = spread.join(blocks, "span").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = spread.select("span", F.least("k", "other").alias("p"), F.greatest("k", "other").alias("q"), "k", "own", "id", "at", "v")

    def run(frame):
        import pandas as pd

        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sim": np.zeros(0)})]
        k, ids, at = (frame[c].to_numpy() for c in ("k", "id", "at"))
        now = frame["own"].to_numpy() == frame["span"].to_numpy()
        m = np.array(frame["v"].tolist(), float)
        one, two = np.flatnonzero(k == frame["p"].iloc[0]), np.flatnonzero(k == frame["q"].iloc[0])
        for a in range(0, len(one), BLOCK):
            for b in range(0, len(two), BLOCK):
                i, j = one[a : a + BLOCK], two[b : b + BLOCK]
                near = (np.abs(at[i][:, None] - at[j][None, :]) <= hours * 3_600_000_000) & (now[i][:, None] | now[j][None, :])
                sim = m[i] @ m[j].T
                r, c = np.nonzero((sim >= least - 1e-12) & near)
                x, y = ids[i[r]], ids[j[c]]
                keep = x < y if frame["p"].iloc[0] == frame["q"].iloc[0] else x != y
                out.append(pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "sim": sim[r, c][keep]}))
        return pd.concat(out)

    found = pair.groupBy("span", "p", "q").applyInPandas(run, "a long, b long, sim double")
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


def lsh_bits(least: float, bands: int, miss: float) -> int:
    """The largest number of bits in a band with which a pair at the threshold is missed with probability ``miss`` at most."""
    return max(1, int(np.log(1 - miss ** (1 / bands)) / np.log(1 - np.arccos(least) / np.pi)))


def similar_pairs_lsh(vectors: DataFrame, least: float, dims: int, bands: int = 48, miss: float = 0.05, seed: int = 11) -> DataFrame:
    """The same pairs, as far as they share a band of sign bits of random projections; each is verified exactly.

    Approximate: a pair at cosine s is missed with probability (1 - (1 - acos(s) / pi) ** bits) ** bands. It pays where
    bits (see lsh_bits) is large: 2 ** bits buckets a band; below a threshold of about 0.6 similar_pairs does less work.
    A bucket's members are compared tile by tile in its task, and only verified pairs leave it."""
    bits = lsh_bits(least, bands, miss)
    planes = np.random.default_rng(seed).standard_normal((bands * bits, dims))

    def keys(batches):
        for b in batches:
            m = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            sign = (m @ planes.T > 0).reshape(len(m), bands, bits) if len(m) else np.zeros((0, bands, bits), bool)
            found = (sign << np.arange(bits)).sum(axis=2) + (np.arange(bands) << bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(found.astype(np.int64)), pa.list_(pa.int64()))], names=["id", "v", "keys"])

    def compared(batches):
        held = []
        for b in batches:
            for key, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and held[0][0] != key:
                    yield from pairs(held)
                    held = []
                held.append((key, i, v))
        yield from pairs(held)

    def pairs(rows):
        ids, m = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
        for a in range(0, len(ids) if len(ids) > 1 else 0, BLOCK):
            for b in range(a, len(ids), BLOCK):
                sim = m[a : a + BLOCK] @ m[b : b + BLOCK].T
                i, j = np.nonzero(sim >= least - 1e-12)
                x, y = ids[i + a], ids[j + b]
                keep = x < y if a == b else x != y
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(np.round(sim[i, j][keep], 6))], names=["a", "b", "sim"])

    v = vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(keys, "id long, v array<double>, keys array<long>")
    near = v.select(F.explode("keys").alias("key"), "id", "v")
    company = near.groupBy("key").count().filter("count > 1").select("key")
    # by a hash of the key: Spark would leave out a repartition by the very key of the join, and may then split that join's keys
    near = near.join(company, "key").repartition(F.xxhash64("key")).sortWithinPartitions("key")
    return near.mapInArrow(compared, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def best_of(sim: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k greatest entries in each row of sim, by falling value and then by ``own`` of the column; a row's own id is no partner."""
    sim = np.where(ids[:, None] == own, -np.inf, sim)
    low = np.partition(sim, -k, axis=1)[:, -k, None] if len(own) > k else -np.inf
    i, j = np.nonzero((sim >= low) & (sim > -np.inf))  # ties of the last one too; only these are sorted
    order = np.lexsort((own[j], -sim[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def top_neighbours(vectors: DataFrame, queries: DataFrame, k: int, per_block: int = 4096) -> DataFrame:
    """id, other, sim, rank: the k nearest vectors of each query (JN8). queries: id, v.

    Vectors and queries are dealt into blocks that meet in pairs, so neither is held whole anywhere; each pair of
    blocks keeps the k best of each query, then ranks merge."""
    left, right = (max(1, -(-t.count() // per_block)) for t in (vectors, queries))
    # both sides' numbers are of one type: an int and a long of one value hash apart, and cogroup would let their rows miss each other
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = lambda t: t.select("id", F.col("v").cast("array<double>").alias("v"))
    v = kinds(vectors).withColumn("p", block(left)).withColumn("q", spread(right)).groupBy("p", "q")
    q = kinds(queries).withColumn("q", block(right)).withColumn("p", spread(left)).groupBy("p", "q")

    def run(some, asks):
        import pandas as pd

        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "sim": np.zeros(0)})]
        if len(some) and len(asks):
            own, ids = some["id"].to_numpy(), asks["id"].to_numpy()
            m = np.array(some["v"].tolist(), float)
            for a in range(0, len(ids), BLOCK):
                sim = np.round(np.array(asks["v"].iloc[a : a + BLOCK].tolist(), float) @ m.T, 6)
                i, j = best_of(sim, ids[a : a + BLOCK], own, k)
                out.append(pd.DataFrame({"id": ids[a + i], "other": own[j], "sim": sim[i, j]}))
        return pd.concat(out)

    near = v.cogroup(q).applyInPandas(run, "id long, other long, sim double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).filter(F.col("rank") <= k)
