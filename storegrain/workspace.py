"""The shared folder for written tables, and the few file-system calls we need."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback_roots: dict[str, str] = {}
_staged_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (unit tests) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_roots:
        _fallback_roots[app] = tempfile.mkdtemp(prefix="storegrain-")
    return _fallback_roots[app]


def new_folder(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/storegrain/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    planner the real size of the table for its join choices.
    """
    return stage_counted(df, label)[0]


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As :func:`stage`, with the row count taken while writing."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _staged_at[staged] = path
    return staged, seen.get["rows"]


def release(*staged: DataFrame) -> None:
    """Delete staged tables (as :func:`stage` gave them) that nothing still to run reads.

    What was made of them must have been staged itself, so that a lost executor
    never asks for them again.
    """
    for df in staged:
        delete_folder(df.sparkSession, _staged_at.pop(df))


@contextmanager
def session_settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings while something runs inside; its own are put back."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of what runs inside go as soon as it ends, as its table is written.

    Else they stay on the executors' disks until the driver happens to collect garbage.
    The session's own setting is put back.
    """
    return session_settings(spark, {DROP_SHUFFLES: "true"})


def empty_table(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows of the given columns, known to the planner as empty."""
    columns = T.StructType.fromDDL(ddl).fields
    return spark.range(0).select(
        *[F.lit(None).cast(c.dataType).alias(c.name) for c in columns]
    )


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return bool(fs.exists(hadoop_path))


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """Name, full path and modification time (ms) of each entry; none if absent."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [
        (s.getPath().getName(), s.getPath().toString(), s.getModificationTime())
        for s in fs.listStatus(hadoop_path)
    ]


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    fs, hadoop_path = _file_system(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(hadoop_path) or []]


def finished_folders(spark: SparkSession, path: str, prefix: str) -> dict[str, str]:
    """``<prefix><name>`` sub-folders whose write finished, by name."""
    marks = matching_paths(spark, f"{path}/{prefix}*/_SUCCESS")
    folders = [mark.removesuffix("/_SUCCESS") for mark in marks]
    return {folder.rsplit("/", 1)[1].removeprefix(prefix): folder for folder in folders}


def feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint; a new checkpoint has another."""
    return spark.read.json(f"{checkpoint}/metadata").head()["id"].replace("-", "")


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder and what it holds; False if it was not there."""
    fs, hadoop_path = _file_system(spark, path)
    return bool(fs.delete(hadoop_path, True))


def expire_staged(spark: SparkSession, hours: float) -> list[str]:
    """Delete what other applications staged and did not touch for so many hours; returns their ids.

    An application that failed leaves its staged tables behind; call this from time
    to time with more hours than any application runs.
    """
    root = f"{shared_root(spark)}/storegrain"
    oldest = (time.time() - 3600 * hours) * 1000
    gone = []
    for name, path, modified in list_folder(spark, root):
        if name != spark.sparkContext.applicationId and modified < oldest:
            delete_folder(spark, path)
            gone.append(name)
    return sorted(gone)


def drop_staged(spark: SparkSession) -> bool:
    """Delete what this application staged; call it when its results are no longer read."""
    app = spark.sparkContext.applicationId
    return delete_folder(spark, f"{shared_root(spark)}/storegrain/{app}")
