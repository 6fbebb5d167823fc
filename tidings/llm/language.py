"""Language ID by prediction by partial matching (PPM) over bytes.

For each language, a context tree holds the byte contexts of up to ORDER bytes that its training texts use most, with
the counts of the bytes that follow. A byte costs -log2(count / (total + kinds)) bits in the longest context of the tree
that ends the text so far and knows it; each context on the way that does not costs an escape, kinds / (total +
kinds); below the empty context all 256 bytes are alike. The statistics are frozen after training, so a text's code
length is a plain sum. The trees of all languages share one automaton whose state is the longest context that ends the
text, so one pass over the bytes yields every language's code length; numpy steps many pieces of many texts at once,
and each piece starts ORDER bytes early, which is all that a state remembers.

Training uses at most ROWS rows of each language (a documented bound), picked by a hash of id and text; every language
that stands in such a row is learned. Spark ranks a language's contexts by how often they occur and keeps the first ones, so
the driver holds one group's tables only. Each language keeps CONTEXTS contexts at least, if its texts have as many: where the
tables of all languages would outgrow TABLE_MB, the languages are dealt into groups with an automaton each, read one after
the other. A language's code length does not depend on its group, unless the group's size changes how many contexts it keeps.

The language of the shortest code wins (ties: first in order); score is its posterior under equal priors. Null texts, texts
without a letter and, without any training text, all texts get `und` and 0. Very long texts are read in pieces of
PIECE bytes. Repeated rows are predicted (and picked for training) one by one; rows without doc_id are predicted and in fold
crc32('') but teach nothing. Other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import dropped, texts, written
from tidings.llm.folds import fold

ORDER = 4
ROWS = 400
TABLE_MB = 16
CONTEXTS = 500
PIECE = 512


def grams(batches):
    """lang, n, gram, times: how often each string of n bytes (as a number) stands in the texts of a batch."""
    for b in batches:
        langs = b.column(b.schema.get_field_index("lang")).to_pylist()
        found = {}
        for lang, text in zip(langs, texts(b)):
            found.setdefault(lang, []).append(text)
        for lang, group in found.items():
            for n in range(1, ORDER + 2):
                keys = []
                for text in group:
                    x = np.frombuffer(text, np.uint8).astype(np.int64)
                    if len(x) >= n:
                        keys.append(sum(x[k : len(x) - n + 1 + k] << (8 * (n - 1 - k)) for k in range(n)))
                if keys:
                    gram, times = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram), pa.array(times)], names=["lang", "n", "gram", "times"])


def contexts(width: int, langs: int) -> int:
    """How many contexts each of the given number of languages may keep in one automaton."""
    return int(np.clip(TABLE_MB * 1e6 / (width * 4 * (1 + langs)), 64, 20_000)) // langs


def per_group(width: int, langs: int) -> int:
    """How many languages share an automaton, each with CONTEXTS contexts at least."""
    return next((g for g in range(langs, 1, -1) if contexts(width, g) >= CONTEXTS), 1)


class Model:
    """The automaton: symbol of a byte, next state, and each language's cost of a symbol in a state."""

    def __init__(self, counts, most: int = 0):
        """counts: a frame with columns lang, n, gram, times; most: how many contexts a language keeps, if given."""
        self.langs = sorted(counts["lang"].unique())
        if not self.langs:
            return
        seen = sorted(set(counts.loc[counts["n"] == 1, "gram"]))
        self.symbol = np.full(256, len(seen), np.uint8 if len(seen) < 254 else np.uint16)  # the last but one symbol: a byte that no training text has
        self.symbol[seen] = np.arange(len(seen))
        self.pad = len(seen) + 1
        width = len(seen) + 2
        most = most or contexts(width, len(self.langs))
        trees, union = [], {(0, 0)}
        for lang in self.langs:
            own = counts[counts["lang"] == lang]
            after = own.assign(n=own["n"] - 1, ctx=own["gram"] // 256, sym=own["gram"] % 256)
            total = after.groupby(["n", "ctx"])["times"].sum().reset_index().sort_values(["times", "n", "ctx"], ascending=[False, True, True])
            kept = set(map(tuple, total[["n", "ctx"]].head(most).to_numpy().tolist()))  # suffixes and prefixes of a kept context are kept
            after = after.merge(total.head(most)[["n", "ctx"]], on=["n", "ctx"])
            trees.append((kept, {k: (self.symbol[g["sym"].to_numpy()], g["times"].to_numpy(float)) for k, g in after.groupby(["n", "ctx"])}))
            union |= kept
        states = sorted(union)
        index = {s: i for i, s in enumerate(states)}
        shorter = lambda s: (s[0] - 1, s[1] & ((1 << (8 * (s[0] - 1))) - 1))
        self.next = np.zeros((len(states), width), np.int32)
        self.cost = np.zeros((len(states), width, len(self.langs)), np.float32)
        for s, i in index.items():
            if s[0]:
                self.next[i] = self.next[index[shorter(s)]]
        # a longer context overrides its suffix's move where it has one of its own
        for s, i in sorted(index.items()):
            if s[0]:
                self.next[i] = self.next[index[shorter(s)]]
            for k, byte in enumerate(seen):
                to = index.get((s[0] + 1, s[1] << 8 | byte)) if s[0] < ORDER else None
                if to is not None:
                    self.next[i, k] = to
        self.next[:, self.pad] = 0
        for j, (kept, stats) in enumerate(trees):
            costs = {}
            for s, i in sorted(index.items()):
                t = s
                while t not in kept and t[0]:
                    t = shorter(t)
                if t not in costs:
                    below = costs[shorter(t)] if t[0] else np.full(width, 8.0)
                    if t in stats:
                        sym, times = stats[t]
                        bits = below + np.log2((times.sum() + len(times)) / len(times))
                        bits[sym] = np.log2((times.sum() + len(times)) / times)
                        costs[t] = bits
                    else:
                        costs[t] = below
                self.cost[i, :, j] = costs[t]
        self.cost[:, self.pad] = 0

    def lengths(self, group: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(group), len(self.langs)))
        pieces = [-(-len(t) // PIECE) for t in group]
        owner = np.repeat(np.arange(len(group)), pieces)
        if not len(owner):
            return out
        flat = self.symbol[np.frombuffer(b"".join(group), np.uint8)]
        offset = np.r_[0, np.cumsum([len(t) for t in group])]
        nth = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
        start = offset[owner] + nth * PIECE
        stop = np.minimum(start + PIECE, offset[owner + 1])
        table, cost = self.next.reshape(-1), self.cost.reshape(-1, len(self.langs))
        width = self.next.shape[1]
        order = np.argsort(start - stop, kind="stable")  # longest pieces first: those still running are a prefix
        start, stop, owner = start[order], stop[order], owner[order]
        first = offset[owner]
        size = stop - start
        state = np.zeros(len(start), np.int64)
        bits = np.zeros((len(start), len(self.langs)), np.float64)
        for t in range(-ORDER, 0):  # bytes before a piece only set its state
            at = start + t
            inside = at >= first
            sym = np.where(inside, flat[np.where(inside, at, 0)], self.pad).astype(np.int64)
            state = table[state * width + sym].astype(np.int64)
        running = len(start)
        for t in range(int(size.max())):
            while running and size[running - 1] <= t:
                running = int(np.searchsorted(-size, -t, side="left"))
            at = state[:running] * width + flat[start[:running] + t]
            bits[:running] += cost[at]
            state[:running] = table[at]
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, bits[:, j], len(group))
        return out


def has_letter(text: bytes) -> bool:
    return text.isalpha() or any(map(str.isalpha, text.decode("utf-8", "replace")))


def held_out():
    return fold(F.col("doc_id"), 4) == 2


def training_rows(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """lang, text: at most ``rows`` rows of each language outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    sizes = known.groupBy(F.col("lang").alias("l")).count().select("l", (2.0 * rows / F.col("count")).alias("share"))
    sizes = written(sizes, "languages")  # a row for each language; its size on disk decides how Spark joins it
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)
    few = known.select("lang", "doc_id", F.col("text").cast("string").alias("text")).join(sizes, F.col("lang") == F.col("l")).filter(rank < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(rank, "doc_id", "text"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= rows).select("lang", "text")


def trained(docs: DataFrame, rows: int = ROWS):
    """The models, group by group of languages."""
    sample = training_rows(docs, rows)
    counts = written(sample.mapInArrow(grams, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")), "language-grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return
    width = counts.filter("n = 1").select("gram").distinct().count() + 2
    size = per_group(width, len(langs))
    most = contexts(width, size)
    busy = counts.groupBy(F.col("lang").alias("l"), F.col("n").alias("m"), F.shiftright("gram", 8).alias("ctx")).agg(F.sum("times").alias("all"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("all"), "m", "ctx"))
    busy = busy.withColumn("nth", nth).filter(F.col("nth") <= most)
    # the empty context comes first in any language, so all single bytes are kept
    kept = counts.join(busy, F.expr("lang = l and n = m and shiftright(gram, 8) = ctx"), "left_semi")
    kept = written(kept, "language-counts")
    dropped(counts)
    for k in range(0, len(langs), size):  # `most` contexts of `size` languages at a time
        yield Model(kept.filter(F.col("lang").isin(langs[k : k + size])).toPandas(), most)
    dropped(kept)


def predicted(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    context = docs.sparkSession.sparkContext
    groups = []
    for m in trained(docs, rows):
        groups.append((context.broadcast(m), m.langs))  # TABLE_MB at most each
    models, langs = [m for m, _ in groups], [x for _, own in groups for x in own]

    def lengths(model, group):
        bits = model.value.lengths(group)
        if len(models) > 1 and hasattr(model, "_value"):
            del model._value  # a worker holds one group's tables at a time and reads them again for the next batch
        return bits

    def run(batches):
        for b in batches:
            group = texts(b)
            pred, score = [], []
            if langs:
                bits = np.concatenate([lengths(m, group) for m in models], axis=1)
                best = bits.argmin(axis=1) if len(group) else []
                post = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -60)).sum(axis=1) if len(group) else []
            for k, text in enumerate(group):
                known = bool(langs) and has_letter(text)
                pred.append(langs[best[k]] if known else "und")
                score.append(float(post[k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
