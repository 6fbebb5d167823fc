"""Streams: counts in windows, deduplication, latest state by key, sessions, and running a stream to a table."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tidings.operators.graph import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 8) -> DataFrame:
    """A table's files as a stream in micro-batches of ``per_batch`` files (ST1)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/{name}*.parquet")
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all input that is there now, into a Parquet table beside its checkpoint (ST9)."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def clamped(stream: DataFrame, at: str, as_of: Column) -> DataFrame:
    """Times in the future count as now (ST6)."""
    return stream.withColumn(at, F.least(F.col(at), as_of))


def tumbling(stream: DataFrame, at: str, keys: list[str], size: str, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows that close when the watermark passes (ST2, ST7)."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("slot"), *keys, "n")


def sliding(stream: DataFrame, at: str, keys: list[str], size: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts in sliding windows, for breaking stories (ST2)."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, size, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.end").alias("upto"), *keys, "n")


def first_seen(stream: DataFrame, at: str, keys: list[str], within: str = "3 days") -> DataFrame:
    """Each key once within the watermark's span (ST3)."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a silence of ``gap`` (ST8)."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")


def latest_state(stream: DataFrame, key: str, at: str, fields: list[str], keep: str = "3 days") -> DataFrame:
    """The merged state of each key after each batch (ST4): newest non-null value of each field; forgotten after ``keep``
    without news (ST5). The stream has long key, timestamp ``at`` and double fields."""
    names = [key, at, *fields]
    out = StructType().add(key, "long").add("at_us", "long")
    for f in fields:
        out = out.add(f, "double")
    state = StructType()
    for f in fields:
        state = state.add(f, "double").add(f"{f}_us", "long")
    state = state.add("last_us", "long")
    hold = pd.Timedelta(keep)

    def step(k, frames, held):
        if held.hasTimedOut:
            held.remove()
            return
        now = dict(zip([x.name for x in state], held.get)) if held.exists else {}
        for f in frames:  # plain arrays: a key has few rows, and frames of frames would cost more than they
            us = f[at].to_numpy().astype("datetime64[us]").astype("int64")
            for name in fields:
                x = f[name].to_numpy()
                known = np.flatnonzero(~np.isnan(x))
                if len(known):
                    r = known[us[known].argmax()]
                    if us[r] >= (now.get(f"{name}_us") or -1):
                        now[name], now[f"{name}_us"] = float(x[r]), int(us[r])
            now["last_us"] = max(now.get("last_us") or 0, int(us.max()))
        held.update(tuple(now.get(x.name) for x in state))
        held.setTimeoutTimestamp(int(now["last_us"] // 1000 + hold.value // 1_000_000))
        yield pd.DataFrame([[k[0], now["last_us"], *[now.get(f) for f in fields]]], columns=[key, "at_us", *fields])

    s = stream.select(*names).withWatermark(at, keep)
    return s.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
