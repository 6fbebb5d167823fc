"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores from the windows around the terms.

A lexicon is learned from labelled documents: words whose odds of standing in a toxic document are high and which stand
there mostly in different surroundings, so that what only copies of one document say is no term. For each document word its
Levenshtein automaton (words within one edit; none for terms of under 4 letters) walks the lexicon's trie: a state is a pair of bit
sets, the places in the word reached with no edit and with one; a branch of the trie ends where both are empty. Each hit is
looked at in a window of words: hits inside quotation marks count apart from others. A logistic model over these counts,
fitted on the same bounded sample, gives the score.

The sample has at most TRAIN_ROWS labelled rows (a documented bound), one for each labelled id; the lexicon keeps every word that meets
SURROUNDINGS, VARIED and ODDS in it. Ties of nearest terms go to the first in order. Every document is scored, whole and on its
own, repeated rows and rows without doc_id like any other; null and empty texts have no hits. Other columns are ignored
whatever their names. Without examples of both classes, all scores are the share of label 1 (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import texts, written
from tidings.llm.folds import fold, labelled_sample

TRAIN_ROWS = 20_000
#: What makes a term: toxic documents that have it, its different surroundings there, their share of its uses, its log odds.
SUPPORT, SURROUNDINGS = 2, 4
VARIED = 0.4
ODDS = 2.5
WINDOW = 6
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¿¡"
QUOTES = ('"', "“", "”", "„", "«", "»")


def normal(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGE)


def places(bits: int):
    """The numbers of the set bits."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


class Lexicon:
    """Terms as a trie; nearest(word) intersects it with the word's Levenshtein automaton."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(t for t in terms if t))
        self.lengths = {len(t) for t in self.terms}
        self.trie: dict = {}
        for t in self.terms:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    @staticmethod
    def bound(length: int) -> int:
        return 0 if length < 4 else 1

    def nearest(self, w: str) -> tuple[str, int] | None:
        """The term within its bound at the smallest distance (then the first in order), and the distance."""
        n = len(w)
        if n < 3 or self.lengths.isdisjoint((n - 1, n, n + 1)):
            return None
        at: dict[str, int] = {}  # the places of each letter of the word, as bits
        for i, c in enumerate(w):
            at[c] = at.get(c, 0) | 1 << i
        end, best = 1 << n, None
        # bit i of `exact` / `edited`: i letters of the word are used up with no edit / with one at most
        stack = [(self.trie, 1, 3)]
        while stack:
            node, exact, edited = stack.pop()
            term = node.get("") if edited & end else None
            if term is not None:
                found = (0 if exact & end else 1, term)
                if found[0] <= self.bound(len(term)) and (best is None or found < best):
                    best = found
            # with the edit spent, only the letters that the word goes on with lead anywhere
            for c in node if exact else {w[i] for i in places(edited & end - 1)}:
                child = node.get(c) if c else None
                if child is None:
                    continue
                here = at.get(c, 0)
                now = (exact & here) << 1
                # the letter matches, is extra, stands for another, or matches after the word's next one is left out
                then = ((edited & here) << 1 | exact | exact << 1 | now << 1 | now) & (end << 1) - 1
                if then:
                    stack.append((child, now, then))
        return best and (best[1], best[0])


def learned(sample: DataFrame) -> list[str]:
    """The lexicon of a bounded sample with columns text, y.

    A word's surroundings are counted only if its share of toxic documents is at least e times that of others: a
    first pass counts documents, so that the second, of (word, neighbours), sends few rows on."""
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return []

    def documents(batches):
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(texts(b), b.column(b.schema.get_field_index("y")).to_pylist()):
                seen[y].update({x for x in map(normal, set(text.split())) if len(x) >= 3})
            words = list(seen[1] | seen[0])
            columns = [pa.array(words, pa.string()), *[pa.array([seen[y][w] for w in words], pa.int64()) for y in (1, 0)]]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "bad", "good"])

    def odds(bad, good):
        return F.log((bad + 0.5) / (n[1] + 1.0)) - F.log((good + 0.5) / (n[0] + 1.0))

    counts = sample.select("text", "y").mapInArrow(documents, "w string, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    likely = counts.filter((F.col("bad") >= SUPPORT) & (odds(F.col("bad"), F.col("good")) >= 1.0))
    likely = frozenset(r["w"] for r in likely.select("w").collect())  # words of at most TRAIN_ROWS texts, each in SUPPORT of them or more

    def run(batches):
        for b in batches:
            seen = Counter()
            for text, y in zip(texts(b), b.column(b.schema.get_field_index("y")).to_pylist()):
                w = [x for x in map(normal, text.split()) if x]
                for k, x in enumerate(w):
                    if x in likely:
                        seen[x, y, hash_of(w[k - 1] if k else "", w[k + 1] if k + 1 < len(w) else "")] += 1
            if seen:
                columns = [*zip(*seen), list(seen.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["w", "y", "around", "times"])

    found = sample.select("text", "y").mapInArrow(run, "w string, y int, around long, times long")
    around = found.groupBy("w", "y", "around").agg(F.sum("times").alias("times"))
    counts = around.groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"), F.sum(F.col("y") * F.col("times")).alias("times"))
    varied = (F.col("bad") >= SURROUNDINGS) & (F.col("bad") >= VARIED * F.col("times"))
    return sorted(r["w"] for r in counts.filter(varied & (odds(F.col("bad"), F.col("good")) >= ODDS)).collect())


def hash_of(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{a} {b}") >> 1


class Matcher(dict):
    """raw word -> 0 without a term, else 2 * (number of the term, from 1) and 1 more if it is misspelled. A cache of what
    the automaton says."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.number = {t: k for k, t in enumerate(lexicon.terms, 1)}
        self.normals: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        bare = normal(word)
        value = self.normals.get(bare)
        if value is None:
            near = self.lexicon.nearest(bare)
            value = self.normals[bare] = 0 if near is None else 2 * self.number[near[0]] + near[1]
        self[word] = value
        return value

    def features(self, text: bytes) -> list[float]:
        if len(self) > 500_000:
            self.clear()
            self.normals.clear()
        words = text.split()
        kinds = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        hits = np.flatnonzero(kinds)
        exact = fuzzy = quoted = 0
        for k in hits.tolist():
            if self.in_quotes(words, k):
                quoted += 1
            elif kinds[k] % 2 == 0:
                exact += 1
            else:
                fuzzy += 1
        terms = len(np.unique(kinds[hits] // 2))
        rate = 100.0 * (exact + fuzzy) / max(20, len(words))
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(rate), np.log1p(terms), float(exact + fuzzy >= 2)]

    @staticmethod
    def in_quotes(words: list[bytes], k: int) -> bool:
        """Whether a quotation opens in the window before word k (or on it) and closes after it (or on it)."""
        before = b" ".join(words[max(0, k - WINDOW) : k + 1]).decode("utf-8", "replace")
        after = b" ".join(words[k : k + WINDOW + 1]).decode("utf-8", "replace")
        bare = normal(words[k])
        before, after = before[: before.lower().rfind(bare)], after[after.lower().find(bare) + len(bare) :]
        return any(q in before for q in QUOTES) and any(q in after for q in QUOTES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps on the penalised likelihood."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pen = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out():
    return fold(F.col("doc_id"), 4) == 2


def per_worker(lexicon) -> Matcher:
    """One matcher for each Python worker, whose cache lasts over tasks with the same lexicon."""
    got = _matchers.get("m")
    if got is None or got[0] != lexicon:
        got = _matchers["m"] = (lexicon, Matcher(Lexicon(lexicon)))
    return got[1]


_matchers: dict = {}


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray | float]:
    sample = labelled_sample(docs, labels, "toxic", held_out(), rows)
    terms = learned(sample)

    def run(batches):
        m = per_worker(terms)
        for b in batches:
            x = [m.features(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(b.schema.get_field_index("y"))], names=["x", "y"])

    got = sample.select("text", "y").mapInArrow(run, "x array<double>, y int").toPandas()
    got = got.assign(key=got["x"].map(tuple)).sort_values(["key", "y"])
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return terms, float(y.mean()) if len(y) else 0.5
    return terms, logistic(np.array(got["x"].tolist()), y)


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, rows))  # the terms of a bounded sample

    def run(batches):
        terms, w = model.value
        m = per_worker(terms)
        for b in batches:
            x = np.array([m.features(t) for t in texts(b)], float).reshape(b.num_rows, -1)
            s = np.full(b.num_rows, w) if isinstance(w, float) else 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
