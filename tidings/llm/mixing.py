"""Mixing sources to target weights by entropy balancing.

Each source gets a target in words. Among all document rates of a source whose expected words meet its target, the
ones closest in relative entropy to one copy each, with at most CAP copies, are exponentially tilted:
``rate = min(CAP, exp(lambda * size / mean size))``. The multiplier of each source solves a convex dual in one unknown;
all sources are solved at once by distributed Newton steps over a histogram of (source, size), so that an iteration
never reads documents again and no source is gathered in one task.

Rates become copies by systematic rounding: documents of a source stand in the order of (size, salt, row key) and
document k gets floor(C_k + 1/2) - floor(C_{k-1} + 1/2) copies, C being the running sum of rates. A document thus gets
its rate rounded down or up, and a source's words miss their target by about its longest document at most. That gap is closed
by documents that could as well have been rounded the other way: a histogram of their sizes says how many of each size
turn, the largest that fit first (see `turns`). Sums run over histogram cells, then salts, then ranks in a salt, in
integer units of 2**-20 copies, so reruns agree.

Nulls: a null source is a source of its own (last in order); a null text has size 0. Documents of size 0 take nothing.
Repeated rows and repeated ids are separate documents; rows equal in id, text and source are interchangeable, and so are their copies.
Other columns are ignored (mix() carries them along) whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import dropped, packed, text_keys, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Documents of one source and size in one window task, on average; SALTS salts at least.
PER_SALT, SALTS = 200_000, 16
UNIT = 1 << 20
#: Bracket of the multipliers, and Newton steps in one job.
REACH, STEPS = 60.0, 3


def targets(sources: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> with its target: ``share`` of all words dealt by weight, none above cap times its size.

    Where by-weight shares exceed a cap, the excess is dealt again by weight to the others until none is above. In
    the order of cap / weight the capped sources come first, so running sums over the table of sources (one row
    each) give the level at which that ends."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sources.withColumn("w", pick).withColumn("cap", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    all_ = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.row_number().over(by).alias("k"), "level"))
    s = s.withColumn("fits", fits).withColumn("level", F.min("fits").over(all_)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def tilted(size: Column, mean: Column, multiplier: Column, cap: float = CAP) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), multiplier * size / mean)))


def newton_step(cells: DataFrame, state: DataFrame, cap: float, close: float) -> DataFrame:
    """The state after one step on log(words) = log(target), kept inside the bracket [lo, hi]."""
    same = cells["source"].eqNullSafe(state["source"])
    j = cells.filter("size > 0").join(state, same).select(state["source"], "size", "n", "target", "mean", "lam", "lo", "hi", "source_size")
    rate = tilted(F.col("size"), F.col("mean"), F.col("lam"), cap)
    words = F.col("n") * F.col("size") * rate
    slope = F.when(rate < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
    got = j.groupBy("source", "target", "mean", "source_size", "lam", "lo", "hi").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
    low = F.col("got") < F.col("target")
    lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
    step = F.col("lam") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
    miss = F.abs(F.col("got") - F.col("target")) / F.col("source_size")
    # a source at its cap (or at nothing) has no finite multiplier: the end of the bracket stands for it, as where it has shrunk to a point
    ends = F.when(F.col("target") >= F.col("source_size") * cap, F.lit(REACH)).when(F.col("target") <= 0, F.lit(-REACH))
    fresh = got.withColumns({"lo": lo, "hi": hi, "step": F.when((F.col("slope") > 0) & (F.col("target") > 0), step), "miss": miss, "ends": ends})
    done = (F.col("miss") <= close) | (F.col("hi") - F.col("lo") <= 1e-9)
    inside = F.when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
    lam = F.coalesce("ends", F.when(done, F.col("lam")).otherwise(inside))
    return fresh.select("source", "target", "mean", "source_size", lam.alias("lam"), "lo", "hi", (F.col("ends").isNull() & ~done).alias("open"))


def multipliers(cells: DataFrame, goals: DataFrame, cap: float = CAP, rounds: int = 60, close: float = 1e-7) -> DataFrame:
    """source, mean, lambda: Newton steps for all sources at once until each meets its target.

    cells: source, size, n; goals: source, source_size, target. The state is a table with a row for each source; a job
    takes STEPS steps, and the driver sees one number for each job: how many sources are still open. Raises if some stay so."""
    docs = cells.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("docs"))
    state = goals.join(docs, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), "source_size",
        F.lit(0.0).alias("lam"), F.lit(-REACH).alias("lo"), F.lit(REACH).alias("hi"), F.lit(True).alias("open"),
    )
    state = written(state, "mix-state")
    for _ in range(rounds):
        fresh = state
        for _ in range(STEPS):
            fresh = newton_step(cells, fresh, cap, close)
        fresh = written(fresh, "mix-state")
        dropped(state)
        state = fresh
        if not state.filter("open").count():
            return state.select("source", "mean", F.round("lam", 7).alias("lam"))
    raise RuntimeError(f"multipliers have not settled after {rounds * STEPS} Newton steps")


def starts(counts: DataFrame, step: Column) -> DataFrame:
    """s, z, t, step, start: for each (source, size, salt), the sum of ``step`` over all documents in front of it.

    counts: source, size, salt, n and what step reads. Running sums go over the sizes of a source (their number is bounded
    by the longest text, not by the rows) and over the salts of a size."""
    key = [F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()]
    c = counts.withColumn("step", step)
    upto = Window.partitionBy(*key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per_size = c.groupBy("source", "size", "step").agg(F.sum("n").alias("n"))
    per_size = per_size.select(F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum(F.col("n") * F.col("step")).over(upto), F.lit(0)).alias("before"))
    c = c.withColumn("earlier", F.coalesce(F.sum("n").over(in_front()), F.lit(0)))
    return c.join(per_size, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(
        "s", "z", F.col("salt").alias("t"), "step", (F.col("before") + F.col("earlier") * F.col("step")).alias("start"))


def in_front():
    """The salts of a source and size in front of a salt."""
    return Window.partitionBy(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)


def placed(docs: DataFrame, starts_: DataFrame) -> DataFrame:
    """docs with the columns of starts_, and k: the document's place in its (source, size, salt)."""
    key = [F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()]
    k = F.row_number().over(Window.partitionBy(*key, "size", "salt").orderBy("doc_id", "ka", "kb"))
    return docs.withColumn("k", k).join(starts_, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t"))).drop("s", "z", "t")


def fitting(values: np.ndarray, gap: float, size: int):
    """Picks of up to ``size`` places of values (sorted) whose sum comes near the gap, nearest first."""

    def near(want):  # the two values around each wanted one
        at = np.searchsorted(values, want)
        return np.stack([np.clip(at - 1, 0, len(values) - 1), np.clip(at, 0, len(values) - 1)], axis=-1)

    if size == 1:
        last = near(np.array([gap]))
        heads = np.zeros((1, 0), np.int64)
    elif size == 2:
        heads = np.arange(len(values))[:, None]
        last = near(gap - values)
    else:
        i, j = np.triu_indices(len(values))
        heads = np.stack([i, j], axis=1)
        last = near(gap - values[i] - values[j])
    miss = np.abs(gap - values[heads].sum(axis=1)[:, None] - values[last])
    for flat in np.argsort(miss, axis=None)[:200]:
        row, side = divmod(int(flat), 2)
        yield float(miss[row, side]), [*heads[row].tolist(), int(last[row, side])]


def turns(size: np.ndarray, up: np.ndarray, down: np.ndarray, gap: float, triples: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of each size (ascending) get a copy more and a copy less, so that little of the gap is left.

    up and down: how many could. First the largest that fit turn, then smaller ones. Then moves that bring the sum nearer
    are taken while there are any: of one document, of two, and of three where there are at most ``triples`` kinds of moves."""
    net, left = np.zeros(len(size), np.int64), abs(gap)
    for k in range(np.searchsorted(size, left, side="right") - 1, -1, -1):
        n = min(int((up if gap > 0 else down)[k]), int(left // size[k]))
        net[k] = n if gap > 0 else -n
        left -= n * int(size[k])
    gap = left if gap > 0 else -left
    for _ in range(64):
        room = np.r_[up - net, net + down]
        ops = np.flatnonzero(room > 0)
        values = np.r_[size, -size][ops]
        order = np.argsort(values, kind="stable")
        ops, values = ops[order], values[order].astype(float)
        move = None
        for n in (1, 2, 3) if len(ops) <= triples else (1, 2):
            for miss, picks in fitting(values, gap, n) if len(ops) and abs(gap) >= 1 else ():
                if miss >= abs(gap) - 1e-9:
                    break
                chosen = ops[picks]
                if (np.bincount(chosen, minlength=len(room)) <= room).all():
                    move = chosen
                    break
            if move is not None:
                break
        if move is None:
            break
        for op in move.tolist():
            k, sign = op % len(size), 1 if op < len(size) else -1
            net[k] += sign
            gap -= sign * int(size[k])
    return np.maximum(net, 0), np.maximum(-net, 0)


def turned(free: DataFrame) -> DataFrame:
    """s, z, d, quota: for each source and size, how many documents of direction d (1 or -1) turn.

    free: source, size, d, n, gap. A source's rows are two for each of its sizes at most: the longest text bounds them."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.groupby(["size", "d"])["n"].sum().unstack(fill_value=0).reindex(columns=[1, -1], fill_value=0).sort_index()
        add, cut = turns(wide.index.to_numpy(np.int64), wide[1].to_numpy(np.int64), wide[-1].to_numpy(np.int64), float(rows["gap"].iloc[0]))
        out = pd.DataFrame({"z": np.r_[wide.index, wide.index], "d": np.repeat([1, -1], len(wide)), "quota": np.r_[add, cut]})
        return out[out["quota"] > 0].assign(s=rows["source"].iloc[0])[["s", "z", "d", "quota"]]

    named = free.withColumn("is_null", F.col("source").isNull())
    return named.groupBy("is_null", "source").applyInPandas(one, "s string, z long, d int, quota long")


def named(text: Column, source: Column) -> Column:
    """Text and source in one, which stands for a row whose id is null or repeated."""
    return F.concat_ws("\x1f", F.coalesce(text, F.lit("")), F.coalesce(source.cast("string"), F.lit("")), source.isNull().cast("string"))


def mixed(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, ka, kb (keys of text and source), source, size, source_size, target, rate, copies of each document (see the module)."""
    keys = text_keys(named(F.col("text"), F.col("source")))
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *keys), "mix-sizes")
    salts = max(SALTS, sized.count() // PER_SALT)
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ka"), F.lit(salts)).cast("int"))
    counts = written(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-counts")
    cells = written(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-cells")
    goals = written(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, cap), "mix-goals")
    lam = multipliers(cells, goals, cap)

    rated = counts.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when((F.col("size") > 0) & F.col("lam").isNotNull(), tilted(F.col("size"), F.col("mean"), F.col("lam"), cap)).otherwise(0.0)
    d = placed(sized, starts(rated, F.round(rate * UNIT).cast("long")))
    at = lambda k: F.floor((F.col("start") + k * F.col("step") + UNIT // 2) / UNIT)
    copies = (at(F.col("k")) - at(F.col("k") - 1)).cast("long")
    # which way a document could as well have been rounded: a copy more (1), a copy less (-1), neither (0)
    way = F.when(F.col("unit") % UNIT == 0, 0).when(F.col("copies") <= F.floor(F.col("unit") / UNIT), 1).otherwise(-1).cast("int")
    d = d.select("doc_id", "ka", "kb", "source", "size", "salt", F.col("step").alias("unit"), copies.alias("copies")).withColumn("d", way)
    d = written(d, "mix-copies")

    cells = d.groupBy("source", "size", "salt", "d").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("words"))
    cells = written(cells, "mix-rounded")
    taken = cells.groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("taken"))
    gaps = written(goals.join(taken, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", (F.col("target") - F.col("taken")).alias("gap")), "mix-gaps")
    free = cells.filter("d <> 0").groupBy("source", "size", "d").agg(F.sum("n").alias("n"))
    g = gaps.withColumnRenamed("source", "s")
    quotas = written(turned(free.join(g, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "d", "n", "gap")), "mix-turns")
    # a quota goes to the first documents in the order of (salt, row key)
    in_salt = F.coalesce(F.sum("n").over(in_front().partitionBy(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), "size", "d")), F.lit(0))
    spots = cells.filter("d <> 0").join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (cells["d"] == quotas["d"]))
    spots = spots.select("source", "size", "salt", cells["d"], "n", "quota").withColumn("earlier", in_salt).filter("earlier < quota")
    spots = written(spots.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), F.col("d").alias("way"), (F.col("quota") - F.col("earlier")).alias("most")), "mix-spots")
    match = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t")) & (F.col("d") == F.col("way"))
    held = d.join(spots, match, "left")
    nth = F.row_number().over(Window.partitionBy("s", F.col("s").isNull(), "z", "t", "way").orderBy("doc_id", "ka", "kb"))
    columns = ["doc_id", "ka", "kb", "source", "size", "unit"]
    moved = held.filter("way is not null").withColumn("nth", nth).select(*columns, (F.col("copies") + F.when(F.col("nth") <= F.col("most"), F.col("d")).otherwise(0)).alias("copies"))
    d = held.filter("way is null").select(*columns, "copies").unionByName(moved)
    d = d.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return d.select("doc_id", "ka", "kb", "source", "size", "source_size", "target", (F.col("unit") / UNIT).alias("rate"), "copies")


def mix_rows(docs: DataFrame) -> DataFrame:
    m = mixed(docs)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns they came with.

    Rows equal in doc_id, text and source are one cell, whose copies are dealt evenly; so a null doc_id gathers nothing."""
    m = mixed(docs).groupBy(F.col("doc_id").alias("id"), "ka", "kb").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    m = written(m, "mix-rows")
    d = packed(docs)
    a, b = text_keys(named(F.col("row.text"), F.col("row.source")), ("a", "b"))
    out = d.select("row", a, b).join(m, F.expr("row.doc_id <=> id and a = ka and b = kb"))
    nth = F.row_number().over(Window.partitionBy("id", "ka", "kb").orderBy(F.lit(1)))
    several = out.filter("rows > 1").withColumn("copies", F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("int"))
    both = out.filter("rows = 1").select("row", "copies").unionByName(several.select("row", "copies"))
    return both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
