"""A session with the settings that the queries expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tarnflow", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/tarnflow-{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() write to that folder, unless the session has one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "rounds"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """A frame written once to the shared folder and read back: its plan isn't run again, and a lost executor costs a re-read only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to four tasks for each core or shuffle partition. For groups of few bytes and much work: a stated number keeps small partitions from being put together into one task."""
    spark = df.sparkSession
    return df.repartition(4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
