"""A segment scan that can stop and resume: each landed page is read once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions.text import slug_of
from storegrain.operators.segments import matching_values
from storegrain.sources.landed import stream_field_values
from storegrain.workspace import list_folder

SCAN = "scan="


def scan_folder(root: str, key: str, field: str, value: str) -> str:
    asked = hashlib.sha256(json.dumps([field, value]).encode()).hexdigest()[:16]
    return f"{root}/{slug_of(key)}/asked={asked}"


def _newest_scan(spark: SparkSession, folder: str) -> int:
    names = [name for name, _, _ in list_folder(spark, folder)]
    return max((int(n.removeprefix(SCAN)) for n in names if n.startswith(SCAN)), default=0)


def collect_segment(spark: SparkSession, pages: str, root: str, key: str, field: str, value: str,
                    *, resume: bool = True, multiline: bool = True,
                    files_per_batch: int | None = None) -> DataFrame:
    """Read the pages not yet seen under ``key`` and return all ids matched so far.

    Field and value belong to the scan: another field or value under the same key
    is a scan of its own. ``resume=False`` starts a new scan of all pages.  Matches are kept by the
    file sink exactly once; repeated ids are removed on reading, so the stream
    holds no state that grows.
    """
    folder = scan_folder(root, key, field, value)
    newest = _newest_scan(spark, folder)
    scan = f"{folder}/{SCAN}{newest if resume and newest else newest + 1}"
    values = stream_field_values(spark, pages, multiline=multiline,
                                 files_per_batch=files_per_batch)
    query = (
        matching_values(values, field, value)
        .select(F.col("customer_id").alias("id"))
        .writeStream.format("parquet")
        .option("path", f"{scan}/matches")
        .option("checkpointLocation", f"{scan}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return collected_ids(spark, root, key, field, value)


def collected_ids(spark: SparkSession, root: str, key: str, field: str, value: str) -> DataFrame:
    """Distinct ids matched by the newest scan of ``key`` for a field and value."""
    folder = scan_folder(root, key, field, value)
    matches = f"{folder}/{SCAN}{_newest_scan(spark, folder)}/matches"
    return spark.read.schema("id BIGINT").parquet(matches).distinct()
