"""Tables between the steps of an iteration, in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only by a local session that sets no spark.checkpoint.dir (tests).
LOCAL_DIR = "/tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy", **options) -> DataFrame:
    """df written as Parquet and read back: the lineage ends there, and a lost executor loses nothing. The options are
    the writer's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """stored(df) and aggregates of its rows, taken while it is written."""
    seen = Observation()
    table = stored(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return table, seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder below spark.checkpoint.dir."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored() table that nothing reads any more."""
    remove(df.sparkSession, df.stored_at)


class Scratch:
    """Stored tables of one computation, to be discarded together but for those that its result reads."""

    def __init__(self, codec: str = "snappy"):
        self.codec, self.tables = codec, []

    def __call__(self, df: DataFrame, name: str, codec: str | None = None, **options) -> DataFrame:
        self.tables.append(stored(df, name, codec or self.codec, **options))
        return self.tables[-1]

    def discard_but(self, *held: DataFrame) -> None:
        for t in self.tables:
            if not any(t is h for h in held):
                discard(t)
        self.tables = list(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
