"""Tables by name. Zone-less timestamps become timestamps of the session (UTC), which watermarks need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})

    def items(self) -> DataFrame:
        """Events as reports of a story: the user is the story, the type is the outlet."""
        return self.events.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("story_id"), F.col("event_type").alias("outlet"), F.col("ts").alias("published_at"), "value", "props")

    def latest(self) -> DataFrame:
        """One row, as_of: the newest time of any item. Queries that ask about 'now' ask about this time."""
        return self.items().agg(F.max("published_at").alias("as_of"))


def shared_folder(spark) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session may leave it unset; it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidings-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df through a table in the shared folder: cuts the lineage of a loop and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
