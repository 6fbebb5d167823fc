"""Streams that keep tables up to date, bound to the given tables. Their input comes in files by time, a file a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.graph import shared_folder
from tidings.operators.rollup import stories
from tidings.plans.registry import query
from tidings.streaming import flows, leaders, tables
from tidings.tables import Tables


def in_time(rows: DataFrame, at: str, name: str, files: int = 4) -> str:
    """Writes rows as ``files`` equal spans of time, one after the other; the folder that holds them as table ``name``."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    folder = f"{shared_folder(rows.sparkSession)}/feed-{uuid.uuid4().hex}"
    for k in range(files):
        a, z = (low + (high - low) * x / files for x in (k, k + 1))
        rows.filter((F.col(at) >= a) & ((F.col(at) < z) | F.lit(k == files - 1))).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
    return folder


@query("st1_st4_snk3_flushed", """select user_id, epoch_us(max(ts)) as at_us, arg_max(event_type, {'t': ts, 'e': event_id}) as last_type, arg_max(value, {'t': ts, 'e': event_id}) filter (where value > 50) as high,
 arg_max(event_id, {'t': ts, 'e': event_id}) filter (where event_type = 'purchase') as bought from events group by 1""")
def flushed(spark, d):
    """The state of each user as a stream of four batches leaves it in a table."""
    e = Tables(spark, d).events.select("user_id", "event_id", "ts", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("high"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("bought"))
    stream = flows.file_stream(spark, in_time(e, "ts", "events"), "events", 1)
    place = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    spec = ("user_id", ["ts", "event_id"], ["event_type"], ["high", "bought"])
    table, merge = tables.BatchTable(spark, f"{place}/table", "user_id", tables.state_schema(stream, *spec)), tables.merged_states(*spec)
    tables.written_by(stream, f"{place}/state", lambda rows, batch: table.merge(rows, batch, merge))
    return table.read().select("user_id", F.unix_micros("newest.ts").alias("at_us"), F.col("event_type").alias("last_type"), "high", "bought")


@query("st6_ag1_refreshed", """select user_id as story_id, count(*) as items, count(distinct event_type) as outlets, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, round(1000 * avg(value) * count(*))::bigint as thousandths from events group by 1""")
def refreshed(spark, d):
    """Stories as the batches of a stream leave them, each of which rolls up only the stories it has touched."""
    stream = flows.file_stream(spark, in_time(Tables(spark, d).items(), "published_at", "items"), "items", 1)
    place = f"{shared_folder(spark)}/stories-{uuid.uuid4().hex}"
    history = tables.BatchTable(spark, f"{place}/history", "story_id", stream.schema)
    rollup = tables.BatchTable(spark, f"{place}/stories", "story_id", stories(spark.createDataFrame([], stream.schema)).schema)
    tables.written_by(stream, f"{place}/state", tables.refreshed_stories(history, rollup))
    return rollup.read().select("story_id", "items", "outlets", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.round(F.col("importance") * F.col("items") * 1000).cast("long").alias("thousandths"))


@query("cl1b_online_stream")
def online_stream(spark, d):
    """Each label's vectors in order of time, joined to stories as they come; equal to cl1_online_clusters."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 600)
    items = Tables(spark, d).embeddings.select(F.col("label").cast("long").alias("shard"), F.col("vec_id").alias("item"), at.alias("at"), F.col("embedding").alias("v"))
    return flows.drained(leaders.online_stream(flows.file_stream(spark, in_time(items, "at", "items"), "items", 1), 0.3))
