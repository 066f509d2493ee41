"""Stored intermediate and final datasets (Parquet)."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Paths staged inside the innermost ``temporary_tables`` block of this thread.
_in_block: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables, shared by all executors.

    ``spark.checkpoint.dir`` of the session, else a folder in its warehouse, which has to
    be a shared one where executors run on other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    if not spark.sparkContext.master.startswith("local") and qualified(spark, folder).startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on one machine")
    return folder


def _folder(spark: SparkSession, path: str):
    """A path with its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The full path with its file system, the same for every spelling of a folder."""
    folder, system = _folder(spark, path)
    return system.makeQualified(folder).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tomewright/{uuid.uuid4().hex}/{name}"


def temporary_path(spark: SparkSession, name: str) -> str:
    """A ``new_path`` in a folder of its own, which is deleted with all that is written there when the application ends."""
    path = new_path(spark, name)
    folder, system = _folder(spark, path.rpartition("/")[0])
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return path


def store(df: DataFrame, path: str | None = None, mode: str = "errorifexists") -> str:
    """Write a dataset and return its path; without a path a new one is chosen."""
    path = path or new_path(df.sparkSession, "artifact")
    df.write.mode(mode).parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    This cuts the lineage: work that several branches share runs once, a lost
    executor costs a re-read instead of a recomputation, and the planner sees
    the table's real size when it decides about broadcasting.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage(df, name))


def stage(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder and return the path.

    The table is deleted when the application ends, or before by ``temporary_tables``.
    """
    path = new_path(df.sparkSession, name)
    store(df, path)
    delete_at_end(df.sparkSession, path)
    block = _in_block.get()
    if block is not None:
        block.append(path)
    return path


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete an existing path when the application ends."""
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)


def discard(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads, before the application ends; other files are left alone.

    For tables that have been read for the last time.
    """
    spark = df.sparkSession
    top = qualified(spark, f"{shared_folder(spark).rstrip('/')}/tomewright").rstrip("/") + "/"
    found = {qualified(spark, file).rpartition("/")[0] for file in df.inputFiles()}
    for path in found:
        if path.startswith(top):
            folder, system = _folder(spark, path)
            system.delete(folder, True)
    delete_shuffles(spark)


def delete_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no DataFrame needs any more.

    It does so when the driver collects its garbage, which is not done for want of disk.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were staged inside the block when it ends.

    For results that have been written by then; a DataFrame that still reads a
    staged table must not leave the block.
    """
    paths: list[str] = []
    outer = _in_block.set(paths)
    try:
        yield
    finally:
        _in_block.reset(outer)
        for path in paths:
            folder, system = _folder(spark, path)
            system.delete(folder, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its success marker at ``path``."""
    marker, system = _folder(spark, f"{path}/_SUCCESS")
    return system.exists(marker)


def _refuse_foreign_files(spark: SparkSession, path: str) -> None:
    folder, system = _folder(spark, path)
    if system.exists(folder):
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        foreign = [name for name in names if not name.startswith(("part-", "_", "."))]
        if foreign:
            raise FileExistsError(f"{path} holds other files than an interrupted write would leave: {foreign[:3]}")


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Load a finished artifact, or build and store it first.

    The leftovers of an interrupted write carry no marker and are replaced; a
    folder with anything else in it is refused.  Tables that ``build`` stages
    are deleted once the artifact is complete.
    """
    if not is_complete(spark, path):
        _refuse_foreign_files(spark, path)
        with temporary_tables(spark):
            store(build(), path, mode="overwrite")
    return load(spark, path)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """A dataset cached for several uses inside the block, spilling to disk; it is released when the block ends.

    Results that leave the block must have been collected or written by then.  For what
    is used again within seconds; ``staged`` is for what has to survive a lost executor.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()
