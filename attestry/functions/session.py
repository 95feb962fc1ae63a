"""Session helpers: lineage cuts in the shared folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Rows of a stored frame that are sent to all tasks of a join, at most; Spark does not know how many a checkpoint has.
BROADCAST_ROWS = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="attestry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once, compressed, below the checkpoint folder; for frames that grow with the corpus."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A stored frame, marked as one to send to all tasks if it has few rows, so that the table it meets stays where it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the cores when the input has fewer files than cores.

    A large table comes in many files and is left alone, so this adds no shuffle there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def opened(folder: str) -> tuple[fs.FileSystem, list[str]]:
    """The file system of a stored table that a task reads from the folder that all machines share, and its files in order."""
    place = folder.replace("s3a://", "s3://", 1)
    system, path = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return system, []
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet"))


def read_table(folder: str) -> pa.Table:
    """A small stored table read inside a task, from the folder that all machines share; empty if it is not there."""
    system, files = opened(folder)
    if not files:
        return pa.table({"query_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float64()))})
    return pa.concat_tables([pq.read_table(f, filesystem=system, partitioning=None) for f in files])
