"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="wedgeworks-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes stored tables that no later plan reads; others are left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Holds Arrow batches for Python to so many rows and bytes, unless the session asks for less."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647")) > size:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bounded_broadcast(df: DataFrame, size: int = 32 << 20) -> DataFrame:
    """Marks a table of numbers and strings for broadcast if its values take no more than size bytes; else leaves the join to Spark."""
    wide = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(wide.cast("long"))).first()[0] or 0) <= size else df


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marks a table of narrow rows for broadcast if a count finds no more than so many; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
