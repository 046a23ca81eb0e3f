"""The folder that the driver and all executors share, for tables between two steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``, or a temporary one where the session names none (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system that a path lies in, and the path, as Spark's own JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, kind: str = "files") -> str:
    """A new folder that goes when the session's JVM ends: until then a frame that reads it may be asked."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    files, at = hadoop(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    files, at = hadoop(spark, path)
    files.delete(at, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table of the shared folder: it survives lost executors, and what made it isn't run again."""
    path = path or f"{new_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to the shared folder and reads it again; all but the last one written go at the end, and
    all of them if a step fails.

    For loops: a checkpoint keeps what is known of its columns and every way in which its joins were dealt, which grows from
    round to round until planning takes minutes. A table that is read is known by its columns and size alone.
    """
    folder, paths, ended = new_folder(spark, "scratch"), [], False

    def put(df: DataFrame) -> DataFrame:
        paths.append(f"{folder}/{len(paths)}")
        return written(df, paths[-1])

    try:
        yield put
        ended = True
    finally:
        for path in paths[:-1] if ended else [folder]:
            remove(spark, path)
