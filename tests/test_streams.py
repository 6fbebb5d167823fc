"""Streams that keep tables: failures between writing and publishing, what a batch reads, and clusters as keyed state."""

import pytest
from pyspark.sql import functions as F

from tidings.operators import cluster
from tidings.operators.rollup import stories
from tidings.plans import incremental
from tidings.streaming import flows, leaders, tables
from tidings.tables import Tables

SF = "/root/testdata/sf0.001"
SPEC = ("user_id", ["ts", "event_id"], ["event_type"], ["value"])


class Lost(Exception):
    pass


@pytest.fixture(scope="module")
def feed(spark):
    return incremental.in_time(Tables(spark, SF).events.select("user_id", "event_id", "ts", "event_type", "value"), "ts", "events", 3)


def states(spark, feed, place):
    stream = flows.file_stream(spark, feed, "events", 1)
    return stream, tables.BatchTable(spark, f"{place}/table", "user_id", tables.state_schema(stream, *SPEC), 4), tables.merged_states(*SPEC)


def as_rows(frame):
    return sorted(tuple(map(str, r)) for r in frame.collect())


@pytest.mark.parametrize("where", ["before", "between", "after"])
def test_a_stream_that_dies_and_starts_again_leaves_the_same_table(spark, feed, tmp_path, where):
    """It dies in its second batch: before it writes, between its files and its manifest, or after the manifest but before Spark knows."""
    stream, table, merge = states(spark, feed, tmp_path / "a")
    tables.written_by(stream, f"{tmp_path}/a/state", lambda rows, batch: table.merge(rows, batch, merge))
    want = as_rows(table.read())

    stream, table, merge = states(spark, feed, tmp_path / "b")
    publish, died = table._commit, []

    def write(rows, batch):
        fails = batch == 1 and not died
        if fails:
            died.append(batch)
            if where == "before":
                raise Lost
            if where == "between":
                table._commit = lambda *a: (_ for _ in ()).throw(Lost())
        table.merge(rows, batch, merge)
        if fails:
            raise Lost

    with pytest.raises(Exception, match="Lost"):
        tables.written_by(stream, f"{tmp_path}/b/state", write)
    assert table.batches() == ([0, 1] if where == "after" else [0])
    table._commit = publish
    tables.written_by(stream, f"{tmp_path}/b/state", write)
    assert table.batches() == [0, 1, 2] and as_rows(table.read()) == want
    table.vacuumed(1)
    assert table.batches() == [2] and as_rows(table.read()) == want
    folders = {f for own in table.folders().values() for f in own}
    assert {p.name for p in (tmp_path / "b" / "table" / "rows").iterdir() if not p.name.startswith(".")} == folders


def test_a_batch_that_comes_twice_changes_nothing(spark, feed, tmp_path):
    rows = spark.read.parquet(f"{feed}/events.parquet")
    _, table, merge = states(spark, feed, tmp_path)
    for _ in range(2):
        table.merge(rows, 0, merge)
    once = as_rows(table.read())
    table.merge(rows, 1, merge)  # the same rows as a new batch: states don't change either
    assert as_rows(table.read()) == once and len(once) == rows.select("user_id").distinct().count()
    table.append(table.read(), 1)
    assert table.read().count() == len(once)


def test_a_null_does_not_replace_a_known_value_and_does_replace_a_latest_one(spark, tmp_path):
    kind = "user_id long, ts timestamp, event_id long, event_type string, value double"
    at = lambda k: F.timestamp_seconds(F.lit(k))
    one = spark.createDataFrame([(1, 1, "a", 5.0)], "user_id long, event_id long, event_type string, value double").withColumn("ts", at(100))
    two = spark.createDataFrame([(1, 2, None, None), (2, 3, "b", None)], "user_id long, event_id long, event_type string, value double").withColumn("ts", at(200))
    late = spark.createDataFrame([(1, 0, "z", 9.0)], "user_id long, event_id long, event_type string, value double").withColumn("ts", at(50))
    table, merge = tables.BatchTable(spark, str(tmp_path), "user_id", tables.state_schema(spark.createDataFrame([], kind), *SPEC), 4), tables.merged_states(*SPEC)
    for batch, rows in enumerate((two, one, late)):  # out of order
        table.merge(rows, batch, merge)
    assert sorted((r["user_id"], r["event_type"], r["value"]) for r in table.read().collect()) == [(1, None, 5.0), (2, "b", None)]


def test_a_batch_reads_and_rewrites_only_what_it_touches(spark, tmp_path):
    items = Tables(spark, SF).items()
    history = tables.BatchTable(spark, f"{tmp_path}/history", "story_id", items.schema, 8)
    rollup = tables.BatchTable(spark, f"{tmp_path}/stories", "story_id", stories(items).schema, 8)
    write = tables.refreshed_stories(history, rollup)
    write(items, 0)
    before, opened = rollup.folders(), []
    read = history.read
    history.read = lambda buckets=None: opened.append(read(buckets)) or opened[-1]
    some = items.filter("story_id in (3, 5)").withColumn("item_id", F.col("item_id") + 1_000_000)
    write(some, 1)
    touched = set(history.buckets_of(some))
    files = {f.split("bucket=")[1].split("/")[0] for f in opened[-1].inputFiles()}
    assert files == set(map(str, touched)) and len(touched) < 8
    after = rollup.folders()
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert as_rows(rollup.read()) == as_rows(stories(items.unionByName(some)))


def items_of(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 2000)
    return Tables(spark, SF).embeddings.select((F.col("label").cast("long") % 3).alias("shard"), F.col("vec_id").alias("item"), at.alias("at"), F.col("embedding").alias("v"))


def test_clusters_of_a_stream_are_those_of_the_table(spark):
    items = items_of(spark)
    stream = flows.file_stream(spark, incremental.in_time(items, "at", "items", 5), "items", 1)
    assert as_rows(flows.drained(leaders.online_stream(stream, 0.3))) == as_rows(cluster.online(items, 0.3))


def test_leaders_keep_what_can_still_be_joined():
    """State by hand: a story leaves once the shard's news is 72 hours younger, and with the timer of a silent shard."""
    import pandas as pd

    class Map(dict):
        iterator, containsKey, updateValue, removeKey = dict.items, dict.__contains__, dict.__setitem__, dict.__delitem__

    class Timer:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    timers = []
    shard = leaders.Leaders(0.75, 72)
    shard.stories, shard.handle = Map(), type("H", (), {"registerTimer": staticmethod(timers.append)})
    at = pd.Timestamp("2024-01-01")
    hours = lambda *hs: pd.DataFrame({"item": [int(h) for h in hs], "at": [at + pd.Timedelta(hours=h) for h in hs], "v": [[1.0, 0.0] if h % 2 == 0 else [0.0, 1.0] for h in hs]})
    first = pd.concat(shard.handleInputRows((1,), iter([hours(2, 0), hours(1)]), None))
    assert first["story"].tolist() == [0, 1, 0] and len(shard.stories) == 2
    later = pd.concat(shard.handleInputRows((1,), iter([hours(74)]), None))
    assert later["story"].tolist() == [0] and sorted(k[0] for k in shard.stories) == [0]  # 1 was 73 hours old
    list(shard.handleExpiredTimer((1,), None, Timer(timers[-1])))
    assert not shard.stories
