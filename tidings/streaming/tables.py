"""Tables that streams write to, batch by batch: appends, merges by key, and roll-ups of what a batch has touched.

A BatchTable is a folder of Parquet files, dealt into buckets of its key. A batch writes files of its own, and then a manifest that
names, for each bucket, the folders that make it up: the batch counts from the moment its manifest is there. What a failed attempt
has written is named by no manifest and never read, and a batch that comes again after its manifest was written is skipped: so a
stream that dies anywhere and starts again leaves the table that an undisturbed one would have left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidings.operators.rollup import stories


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | StructType, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def batches(self) -> list[int]:
        """The batches that count, oldest first."""
        fs, at = self._at("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def folders(self) -> dict[int, list[str]]:
        """For each bucket that holds anything, the folders that make it up."""
        known = self.batches()
        if not known:
            return {}
        found = self.spark.read.text(f"{self.path}/manifests/{known[-1]:012d}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(found).items()}

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: as many numbers as there are buckets, at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of the last batch, of some buckets or of all; files of other buckets are not opened."""
        made = self.folders()
        paths = [f"{self.path}/rows/{f}/bucket={b}" for b in (made if buckets is None else buckets) for f in made.get(b, [])]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _written(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows to a new folder; its name and the buckets it has. Spark splits a bucket that is large, for nobody needs it in one file."""
        name = uuid.uuid4().hex
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{name}")
        fs, at = self._at(f"rows/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(at)]
        return name, [int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket=")]

    def _commit(self, batch: int, folders: dict[int, list[str]]) -> None:
        """Publishes a manifest: written aside, then renamed, which happens at once or not at all."""
        fs, aside = self._at(f"manifests/{uuid.uuid4().hex}.new")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.rename(aside, self._at(f"manifests/{batch:012d}.json")[1]):
            raise RuntimeError(f"batch {batch} of {self.path} could not be published")

    def append(self, rows: DataFrame, batch: int) -> None:
        if batch in self.batches():
            return
        made = self.folders()
        name, held = self._written(rows)
        self._commit(batch, made | {b: [*made.get(b, []), name] for b in held})

    def merge(self, rows: DataFrame, batch: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets that rows touch by merged(their rows so far, rows)."""
        if batch in self.batches():
            return
        made, touched = self.folders(), self.buckets_of(rows)
        name, held = self._written(merged(self.read(touched), rows))
        kept = {b: f for b, f in made.items() if b not in touched}
        self._commit(batch, kept | {b: [name] for b in held})

    def vacuumed(self, keep: int = 2) -> None:
        """Deletes the manifests but the last ``keep``, and the folders that none of these names. Not while a batch is being written."""
        known = self.batches()
        for batch in known[:-keep]:
            fs, at = self._at(f"manifests/{batch:012d}.json")
            fs.delete(at, False)
        named = set()
        for batch in known[-keep:]:
            found = self.spark.read.text(f"{self.path}/manifests/{batch:012d}.json", wholetext=True).first()[0]
            named.update(f for own in json.loads(found).values() for f in own)
        fs, at = self._at("rows")
        for status in fs.listStatus(at) if fs.exists(at) else ():
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)


def written_by(stream: DataFrame, state: str, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all input that is there now; write(rows, batch) takes each batch, and may see one again after a failure (ST1, ST9)."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def state_schema(rows: DataFrame, key: str, order: list[str], latest: list[str], known: list[str]) -> StructType:
    """Columns of merged(): key, newest (the order columns of the newest row), latest, and each of known with where it is from."""
    kinds = {f.name: f.dataType for f in rows.schema}
    place = StructType([f for c in order for f in rows.schema if f.name == c])
    out = StructType().add(key, kinds[key]).add("newest", place)
    for c in latest:
        out = out.add(c, kinds[c])
    for c in known:
        out = out.add(c, kinds[c]).add(f"{c}_from", place)
    return out


def merged_states(key: str, order: list[str], latest: list[str], known: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge (ST4, SNK3): a row for each key with the latest columns of its newest row, nulls too, and the newest known value of
    the others. ``order`` is a total order within a key, so batches may come in any order and with rows that are known already."""

    def merged(current: DataFrame, rows: DataFrame) -> DataFrame:
        place = F.struct(*order)
        fresh = rows.select(key, place.alias("newest"), *latest, *[x for c in known for x in (F.col(c), F.when(F.col(c).isNotNull(), place).alias(f"{c}_from"))])
        both = current.unionByName(fresh)
        newest = [F.max_by(c, "newest").alias(c) for c in latest]
        return both.groupBy(key).agg(F.max("newest").alias("newest"), *newest, *[x for c in known for x in (F.max_by(c, f"{c}_from").alias(c), F.max(f"{c}_from").alias(f"{c}_from"))])

    return merged


def refreshed_stories(history: BatchTable, rollup: BatchTable, roll: Callable[[DataFrame], DataFrame] = stories) -> Callable[[DataFrame, int], None]:
    """A batch writer (ST6, AG1): items go to the history; of stories that the batch has items of, all items are read again and rolled up.

    Only buckets that hold such stories are read and rewritten. Should the batch come again after its items were kept, the stories are
    rolled up from what the history holds, which is the same."""

    def write(items: DataFrame, batch: int) -> None:
        items = items.persist()
        try:
            history.append(items, batch)
            dirty = items.select(history.key).distinct()
            own = history.read(history.buckets_of(dirty)).join(dirty, history.key, "left_semi")
            rollup.merge(roll(own), batch, lambda current, fresh: current.join(fresh.select(rollup.key), rollup.key, "left_anti").unionByName(fresh))
        finally:
            items.unpersist()

    return write
