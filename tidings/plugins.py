"""Where a user's own code plugs in (UD2-UD6): embedders, deciders, judges, collectors and locators.

Each is a small object whose method takes a batch (lists of plain values) and returns one answer for each row; the
functions here run it over Arrow batches of a DataFrame, so work is partitioned by Spark and an object is shipped once to each
task. Answers are checked in length; None is no answer."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """UD2: unit vectors of texts."""

    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Decider(Protocol):
    """UD3: (desk or None, significance, confidence) of stories' contexts, given the desks."""

    def decide(self, contexts: list[str], desks: list[str]) -> list[tuple[str | None, float, float]]: ...


class Judge(Protocol):
    """UD4: whether two texts tell the same event; None if it can't tell."""

    def same(self, pairs: list[tuple[str, str]]) -> list[bool | None]: ...


class Collector(Protocol):
    """UD5: rows (url, title, published_at in seconds) of a source."""

    def collect(self, source: SourceSpec) -> list[tuple[str, str, int]]: ...


class Locator(Protocol):
    """UD6: (lat, lon) of names, or None."""

    def locate(self, names: list[str]) -> list[tuple[float, float] | None]: ...


@dataclass(frozen=True)
class SourceSpec:
    """UD5: what a collector needs to know of a source."""

    name: str
    kind: str
    url: str
    options: dict = field(default_factory=dict)


def answered(df: DataFrame, columns: list[str], ask, kinds: list[tuple[str, str]], types: list[pa.DataType]) -> DataFrame:
    """df's first column with the answers of ask(batch of value tuples) beside it."""
    names = [df.columns[0], *(n for n, _ in kinds)]
    key = dict(df.dtypes)[df.columns[0]]

    def run(batches):
        for b in batches:
            rows = list(zip(*[b.column(k).to_pylist() for k in range(1, b.num_columns)]))
            out = ask(rows) if rows else []
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} answers for {len(rows)} rows")
            out = [(None,) * len(kinds) if o is None else o for o in out]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(types)]], names=names)

    return df.select(df.columns[0], *columns).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [(df.columns[0], key), *kinds]))


def embedded(items: DataFrame, embedder: Embedder) -> DataFrame:
    """id, v; items: id, text."""
    ask = lambda rows: [(v,) for v in embedder.embed([t or "" for (t,) in rows])]
    return answered(items.select("id", "text"), ["text"], ask, [("v", "array<double>")], [pa.list_(pa.float64())])


def decided(stories: DataFrame, decider: Decider, desks: list[str]) -> DataFrame:
    """story_id, desk, significance, confidence; stories: story_id, context. A desk that is not among the given ones is no answer."""

    def ask(rows):
        out = decider.decide([c or "" for (c,) in rows], desks)
        return [None if o is None or (o[0] is not None and o[0] not in desks) else o for o in out]

    return answered(stories.select("story_id", "context"), ["context"], ask, [("desk", "string"), ("significance", "double"), ("confidence", "double")], [pa.string(), pa.float64(), pa.float64()])


def judged(pairs: DataFrame, judge: Judge) -> DataFrame:
    """a, b, same; pairs: a, b, left, right (texts). Pairs without a verdict stay out: they are asked again later."""
    p = pairs.select(F.struct("a", "b").alias("pair"), "left", "right")
    ask = lambda rows: [(x,) for x in judge.same([(s or "", t or "") for s, t in rows])]
    return answered(p, ["left", "right"], ask, [("same", "boolean")], [pa.bool_()]).filter("same is not null").select("pair.a", "pair.b", "same")


def collected(spark, sources: list[SourceSpec], collector: Collector) -> DataFrame:
    """source, url, title, published_at: what the collector brings from each source, a task for each."""
    specs = spark.createDataFrame([(k, s.name) for k, s in enumerate(sources)], "k int, name string").repartition(max(1, len(sources)), "k")

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                rows = collector.collect(sources[k])
                columns = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([sources[k].name] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["source", "url", "title", "at"])

    return specs.mapInArrow(run, "source string, url string, title string, at long").select("source", "url", "title", F.timestamp_seconds("at").alias("published_at"))


def located(asks: DataFrame, locator: Locator) -> DataFrame:
    """ask, lat, lon; asks: ask, name. Each distinct name is asked once."""
    names = asks.select(F.col("name").alias("n"), "name").distinct()
    ask = lambda rows: locator.locate([n or "" for (n,) in rows])
    known = answered(names, ["name"], ask, [("lat", "double"), ("lon", "double")], [pa.float64(), pa.float64()])
    return asks.join(known, asks["name"].eqNullSafe(known["n"])).select("ask", "lat", "lon")
