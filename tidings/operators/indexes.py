"""Search indexes as tables: posting lists of trigrams for spellings, cells of vectors for meaning."""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.functions.text import folded, trigrams
from tidings.operators.graph import shared_folder
from tidings.operators.search import close_spelling
from tidings.operators.similarity import best_of
from tidings.tables import saved

#: Folders of lists; bytes of text that are listed together.
BUCKETS, BLOCK = 64, 1_000_000
#: Similarity that a word spelled differently must reach, beside other words and alone; the distance in meaning that still counts.
NEAR, NEAR_ALONE, MEANING = 0.4, 0.55, 0.42


def spaced(text: Column) -> Column:
    """A folded text's words, a space before and behind each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def numbered(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of values from 0 to end, in order, and each value's place among them: by marks where these take no more room than a sort."""
    if end > max(1 << 20, 4 * len(values)):
        return np.unique(values, return_inverse=True)
    marks = np.zeros(end, bool)
    marks[values] = True
    return np.flatnonzero(marks), (np.cumsum(marks, dtype=np.int32) - 1)[values]


def lists_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of spaced texts (two spaces before and one behind each word), how many texts have each, and these texts' places, list by list."""
    size = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size[-1] - size[0], size[0])
    point = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = size - size[0] if len(point) == len(raw) else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[size - size[0]]
    seen = np.zeros(0x110000, bool)
    seen[point] = True
    seen[32] = False
    chars = np.concatenate([[32], np.flatnonzero(seen)]).astype(np.uint32)  # the space is letter 0
    n = len(chars)
    rank = np.zeros(0x110000, np.int32 if n**3 < 1 << 31 else np.int64)
    rank[chars] = np.arange(n)
    r = rank[point]
    two = r[:-2] * (r[1:-1] > 0)  # before a word's first letter stand two spaces
    word = (r[2:] > 0) | (r[1:-1] > 0)  # a text begins and ends with a space: no trigram begins earlier
    first = r[1:2] if len(r) > 1 else r[:0]
    code = np.concatenate([first[first > 0], ((two * n + r[1:-1]) * n + r[2:])[word]])
    place = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    codes, at = numbered(code, n**3)
    pairs = at.astype(np.int64) * len(texts) + np.concatenate([place[1:2][first > 0], place[2:][word]])
    pairs = np.unique(pairs) if len(codes) * len(texts) > max(1 << 20, 16 * len(pairs)) else np.flatnonzero(np.bincount(pairs, minlength=1))
    names = np.ascontiguousarray(chars[np.stack([codes // n**2, codes // n % n, codes % n], axis=1)]).view("<U3").reshape(-1).tolist() if len(codes) else []
    return names, np.bincount(pairs // len(texts), minlength=len(codes)), pairs % len(texts)


def bucket_of(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def trigram_index(items: DataFrame, key: str, text: str = "text", path: str | None = None) -> str:
    """Writes posting lists (trigram, key) of items' folded texts, in folders by hash of the trigram and sorted by it; the path.

    A list is as many rows as texts have the trigram, so a frequent one is no row of any size. Texts meet in blocks of BLOCK bytes or one text;
    a block's list of a trigram travels and is sorted as one row, so there are far fewer of these than postings."""
    path = path or f"{shared_folder(items.sparkSession)}/trigrams-{uuid.uuid4().hex}"
    most, kind = BLOCK, T.StructType([T.StructField("trigram", T.StringType()), T.StructField("keys", T.ArrayType(items.schema[key].dataType))])

    def listed(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).cast(pa.string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
                names, sizes, places = lists_of(texts.slice(i, j - i))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), keys.slice(i, j - i).take(pa.array(places)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists], names=["trigram", "keys"])
                i = j

    lists = items.select(key, spaced(folded(F.col(text)))).mapInArrow(listed, kind).withColumn("bucket", bucket_of(F.col("trigram")))
    lists = lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram", F.col("keys")[0])
    # once more by what a writer of folders asks for: rows that stand in order already are compared once each
    lists.select(F.explode("keys").alias(key), "trigram", "bucket").sortWithinPartitions("bucket", "trigram").write.partitionBy("bucket").parquet(path)
    return path


def needs(words: list[str]) -> list[tuple[int, str, bool]]:
    """(word's number, trigram, whether it lies inside the word) of words of 3 letters or more."""
    out = []
    for n, w in enumerate(words):
        if len(w) >= 3:
            inside = {w[i : i + 3] for i in range(len(w) - 2)}
            out += [(n, g, g in inside) for g in sorted(set(trigrams(w)) | inside)]
    return out


def postings(spark: SparkSession, path: str, wanted: list[tuple[int, str, bool]]) -> DataFrame:
    """The lists of a query's trigrams: only their folders are opened, and in these only what may hold them."""
    query = spark.createDataFrame(wanted, "word int, trigram string, inside boolean")
    names = sorted({g for _, g, _ in wanted})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in names], "g string").select(bucket_of(F.col("g"))).distinct().collect()]
    lists = spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(names))
    return lists.join(F.broadcast(query), "trigram")


def candidates(spark: SparkSession, path: str, key: str, searches: list[list[str]], fuzzy: bool) -> tuple[DataFrame | None, list[int]]:
    """key, can: the searches (by number) that a text can match: for each word, all trigrams inside it (as written), or enough of its own for the
    similarity. And the searches of which no word has trigrams, so that any text can match.

    A similarity is what is shared over at least the word's own trigrams. All searches read the lists once."""
    words = sorted({w for s in searches for w in s if len(w) >= 3})
    free = [k for k, s in enumerate(searches) if not set(s) & set(words)]
    if not words:
        return None, free
    wanted, number = needs(words), {w: n for n, w in enumerate(words)}
    counts = [F.count_if((F.col("word") == n) & F.col("inside")).alias(f"inner{n}") for n in range(len(words))] + [F.count_if(F.col("word") == n).alias(f"n{n}") for n in range(len(words))]

    def fits(w, near):
        n, own = number[w], len(set(trigrams(w)))
        written = F.col(f"inner{n}") == len({g for m, g, i in wanted if m == n and i})
        return written | (F.col(f"n{n}") >= math.ceil(near * own - 1e-9)) if fuzzy and len(w) >= 4 else written

    shared = postings(spark, path, wanted).groupBy(key).agg(*counts)
    can = [F.when(all_of([fits(w, NEAR if len(s) > 1 else NEAR_ALONE) for w in set(s) & set(words)]), F.lit(k)) for k, s in enumerate(searches) if k not in free]
    return shared.select(key, F.array_compact(F.array(*can)).alias("can")).filter(F.size("can") > 0), free


def all_of(tests: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def spelled_all(items: DataFrame, path: str, key: str, searches: list[list[str]], text: str = "text", fuzzy: bool = True, number: str = "search") -> DataFrame:
    """What search.by_close_spelling (or by_words) finds for each search, with the index: items' columns, the search's number, and if fuzzy closeness.

    The texts are read once for all searches. Only candidates are folded and looked at: this stands in columns above the join and
    in what is exploded, not in a filter, which Spark would take below the join."""
    some, free = candidates(items.sparkSession, path, key, searches, fuzzy)
    always = F.array(*map(F.lit, free)).cast("array<int>")
    if some is None:
        t = items.withColumn("_can", always)
    elif free:
        t = items.join(some.withColumnRenamed("can", "_can"), key, "left").withColumn("_can", F.concat(F.coalesce("_can", F.array().cast("array<int>")), always))
    else:
        t = items.join(some.withColumnRenamed("can", "_can"), key)
    words = sorted({w for s in searches for w in s})
    has, like = {w: F.col(f"_has{n}") for n, w in enumerate(words)}, {w: F.col(f"_like{n}") for n, w in enumerate(words)}
    t = t.withColumn("_folded", folded(F.col(text)))
    t = t.withColumns({f"_has{n}": F.contains("_folded", F.lit(w)) for n, w in enumerate(words)})
    can = [F.array_contains("_can", k) & (any_of([has[w] for w in s]) if fuzzy and len(s) > 1 else F.lit(True)) for k, s in enumerate(searches)]
    if fuzzy:
        looked = {w: F.when(any_of([can[k] for k, s in enumerate(searches) if w in s]), F.col("_folded")) for w in words}
        t = t.withColumns({f"_like{n}": close_spelling(w, looked[w]) if len(w) >= 4 else F.when(has[w], 1.0).otherwise(0.0) for n, w in enumerate(words)})
    found = []
    for k, s in enumerate(searches):
        near = all_of([has[w] | (like[w] >= (NEAR if len(s) > 1 else NEAR_ALONE)) if fuzzy else has[w] for w in s])
        one = F.struct(F.lit(k).alias(number), (sum((like[w] for w in dict.fromkeys(s)), F.lit(0.0)) if fuzzy else F.lit(0.0)).alias("closeness"))
        found.append(F.when(can[k] & near, one))
    t = t.select(*items.columns, F.explode(F.array_compact(F.array(*found))).alias("_found"))
    return t.select(*items.columns, f"_found.{number}", *["_found.closeness"] * fuzzy)


def spelled(items: DataFrame, path: str, key: str, words: list[str], text: str = "text", fuzzy: bool = True) -> DataFrame:
    """What search.by_close_spelling (or by_words) finds, with the index: only texts of candidates are looked at."""
    return spelled_all(items, path, key, [words], text, fuzzy, "_search").drop("_search")


class Cells:
    """Vectors dealt into cells around centres, each vector to its nearest one.

    The centres are fitted on at most ``sample`` vectors (those with the smallest hashes of their ids); every vector is in
    a cell. Rows of a cell are kept in folders by cell, so a search opens the cells it probes only."""

    def __init__(self, vectors: DataFrame, cells: int = 64, sample: int = 5000, rounds: int = 8, path: str | None = None):
        self.spark = vectors.sparkSession
        own = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
        some = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0).to_pylist()
        self.sample = np.array(some, float).reshape(len(some), -1)
        self.centres = self.fitted(self.sample, cells, rounds)
        centres = self.spark.sparkContext.broadcast(self.centres)

        def dealt(batches):
            for b in batches:
                m = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
                cell = (m @ centres.value.T).argmax(axis=1) if len(m) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

        self.path = path or f"{shared_folder(self.spark)}/cells-{uuid.uuid4().hex}"
        own.mapInArrow(dealt, "id long, v array<double>, cell int").hint("rebalance", "cell").write.partitionBy("cell").parquet(self.path)

    @staticmethod
    def fitted(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
        """Spherical k-means from evenly drawn starts."""
        centres = x[:: max(1, len(x) // k)][:k]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, int)
            centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centres)]) if len(x) else centres
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        return centres

    def probes_for(self, recall: float, k: int = 10, asks: int = 300) -> int:
        """How many cells must be probed to find that share of the k nearest, measured within the sample. In the whole table
        neighbours are nearer than in the sample, so it errs on the side of more."""
        x = self.sample
        q = x[: min(asks, len(x))]
        sim = q @ x.T
        sim[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-sim, axis=1)[:, : min(k, max(0, len(x) - 1))]
        own = (x @ self.centres.T).argmax(axis=1)
        order = np.argsort(-(q @ self.centres.T), axis=1)
        place = np.argsort(order, axis=1)  # of each cell for each query
        found = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
        return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1 if len(found) else 1

    def nearest(self, queries: DataFrame, k: int, probes: int = 8, per_block: int = 4096) -> DataFrame:
        """id, other, sim, rank: the k nearest vectors of each query (id, v) among those of its ``probes`` nearest cells.

        A cell's vectors are dealt into blocks, which meet the cell's queries; a block keeps k of each query. With as many
        probes as cells the result is exact."""
        centres = self.spark.sparkContext.broadcast(self.centres)
        probes = min(probes, len(self.centres))

        def probed(batches):
            for b in batches:
                m = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
                best = np.argsort(-(m @ centres.value.T), axis=1, kind="stable")[:, :probes] if len(m) else np.zeros((0, probes), int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "v", "cells"])

        asked = queries.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(probed, "id long, v array<double>, cells array<int>")
        asked = asked.select("id", "v", F.explode("cells").alias("cell"))
        held = self.spark.read.parquet(self.path)
        blocks = {r["cell"]: -(-r["count"] // per_block) for r in held.groupBy("cell").count().collect()}  # a number for each cell
        if not blocks:
            return asked.select("id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("int").alias("rank")).limit(0)
        of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
        held = held.withColumn("block", F.pmod(F.xxhash64("id"), of[F.col("cell")]).cast("int"))
        asked = asked.withColumn("n", of[F.col("cell")]).filter("n is not null").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

        def met(some, asks):
            import pandas as pd

            out = [pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "sim": np.zeros(0)})]
            if len(some) and len(asks):
                own, ids = some["id"].to_numpy(), asks["id"].to_numpy()
                m = np.array(some["v"].tolist(), float)
                for a in range(0, len(ids), 1024):
                    sim = np.round(np.array(asks["v"].iloc[a : a + 1024].tolist(), float) @ m.T, 6)
                    i, j = best_of(sim, ids[a : a + 1024], own, k)
                    out.append(pd.DataFrame({"id": ids[a + i], "other": own[j], "sim": sim[i, j]}))
            return pd.concat(out)

        found = held.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(met, "id long, other long, sim double")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).filter(F.col("rank") <= k)


def searched_all(items: DataFrame, key: str, trigram_path: str, cells: Cells, searches: list[list[str]], vectors: list[list[float]], limit: int = 25, meaning: int = 8, few: int = 3) -> DataFrame:
    """search (its number), key, tier, closeness of searches, each with its vector (TR12): texts with all words (tier 0); with fewer than ``few`` of these, close
    spellings as well (tier 1), up to ``limit`` together; and what is nearest in meaning, within the distance MEANING and not among them (tier 2), up to ``meaning``.

    items: key (a long, as in the cells' id), text. Order within a tier: closeness, then key. Texts and lists are read once for the words
    and once for close spellings; what is found, at most ``limit`` rows a search, is kept in tables."""
    spark, order = items.sparkSession, (F.desc("closeness"), key)
    first = lambda t, n, *by: t.withColumn("_rank", F.row_number().over(Window.partitionBy("search").orderBy(*by))).filter(F.col("_rank") <= n).drop("_rank")
    exact = spelled_all(items, trigram_path, key, searches, fuzzy=False).select("search", key, F.lit(0).alias("tier"), F.lit(0.0).alias("closeness"))
    found = saved(first(exact, limit, key))
    hits = {r["search"]: r["count"] for r in found.groupBy("search").count().collect()}
    little = [k for k in range(len(searches)) if hits.get(k, 0) < few]
    if little:
        of = F.element_at(F.array(*map(F.lit, little)), F.col("search") + 1)
        more = spelled_all(items, trigram_path, key, [searches[k] for k in little]).select(of.alias("search"), key, F.lit(1).alias("tier"), F.round("closeness", 6).alias("closeness"))
        found = saved(first(found.unionByName(more.join(found.select("search", key), ["search", key], "left_anti")), limit, "tier", *order))
    asks = spark.createDataFrame([(-1 - k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, v array<double>")
    near = cells.nearest(asks, meaning + limit, cells.probes_for(0.95)).filter(1 - F.col("sim") <= MEANING)
    near = near.select((-1 - F.col("id")).cast("int").alias("search"), F.col("other").alias(key), F.lit(2).alias("tier"), F.round("sim", 6).alias("closeness"))
    near = first(near.join(found.select("search", key), ["search", key], "left_anti"), meaning, *order)
    return found.unionByName(near).orderBy("search", "tier", *order)


def searched(items: DataFrame, key: str, trigram_path: str, cells: Cells, words: list[str], vector: list[float], limit: int = 25, meaning: int = 8, few: int = 3) -> DataFrame:
    """key, tier, closeness of one search, as of searched_all."""
    return searched_all(items, key, trigram_path, cells, [words], [vector], limit, meaning, few).drop("search")
