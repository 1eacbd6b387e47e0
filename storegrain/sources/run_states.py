"""Saved run states, one ``.progress-<key>.json`` file per run in flight.

Spark's file sources pass over names that start with a dot, so the names are
listed on the driver and the files are opened inside tasks; all parsing is done
by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.workspace import list_folder

# How a state file is named.
PREFIX, SUFFIX = ".progress-", ".json"

# A state file lists the ids of its run, so few are held at once.
FILES_AT_ONCE = 32


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each file's text; a file that vanished meanwhile is left out."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            try:
                system, at = fs.FileSystem.from_uri(row.pop("path"))
                with system.open_input_stream(at) as opened:
                    rows.append(row | {"text": opened.read().decode("utf-8")})
            except FileNotFoundError:
                continue
            if len(rows) == FILES_AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows)


def parse_run_states(files: DataFrame) -> DataFrame:
    """Typed states from (file, mtime, text) rows; broken JSON fails the job."""
    state = files.withColumn("state", F.parse_json("text"))
    return state.select(
        "file",
        "mtime",
        F.try_variant_get("state", "$.cursor", "string").alias("cursor"),
        F.try_variant_get("state", "$.pageNum", "int").alias("page_num"),
        F.try_variant_get("state", "$.collectedIds", "array<bigint>").alias("collected_ids"),
        F.try_variant_get("state", "$.processedIdIndex", "int").alias("processed_id_index"),
    )


def read_run_states(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """States of all runs found in one or more folders."""
    folders = [folders] if isinstance(folders, str) else folders
    listed = [
        (name, full if "://" in full else full.replace("file:", "file://", 1), mtime)
        for folder in folders
        for name, full, mtime in list_folder(spark, folder)
        if name.startswith(PREFIX) and name.endswith(SUFFIX)
    ]
    found = spark.createDataFrame(listed, "file STRING, path STRING, mtime_ms BIGINT")
    texts = found.mapInArrow(_with_text, "file STRING, mtime_ms BIGINT, text STRING")
    return parse_run_states(
        texts.select("file", F.timestamp_millis("mtime_ms").alias("mtime"), "text")
    )
