"""Cutting plans: results that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Only a local session without
    one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", "")
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="scanloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder as Parquet, of which later steps
    read only the columns and rows they need. It goes when the application ends."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_path(spark)}/cut-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many parts as the session shuffles to. For groups that go to Python:
    they cost far more than their few bytes, for which adaptive execution would pack them
    into one task. What lies in one part already by the keys is left there: cut() it first."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_scan(df: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
    """df, kept in the shared folder in buckets of keys (scan_id), in each of which it is
    sorted: a join on them reads it where it lies, and only what it is joined with is
    exchanged."""
    spark, keys = df.sparkSession, keys or ("scan_id",)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"kept_{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_path(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path.toString()).saveAsTable(name)
    return spark.table(name)
