"""The folder that driver and executors share, tables written to it, and its files read from Python."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table of identifiers that is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of our own only where it is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='bundlelens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder URI; plain paths are local."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until `df` has no such column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def drop_ids(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `df` whose doc_id is not in the one column of `gone`. Rows without an id stay."""
    (name,) = free_names(df, "_gone")
    ids = stash(gone.toDF(name).where(F.col(name).isNotNull()).distinct(), "gone")
    ids = F.broadcast(ids) if ids.count() * 64 <= BROADCAST_BYTES else ids
    return df.join(ids, F.col("doc_id") == F.col(name), "left_anti")
