"""Report on runs in flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phase texts, and the key inside a state file's name.
COLLECTING = "collecting IDs (phase 1)"
READY = "ready for phase 2"
FETCHING = "fetching customers (phase 2)"
KEY_OF_FILE = r"^\.progress-(.*)\.json$"


def phase() -> Column:
    collected = F.coalesce(F.size("collected_ids"), F.lit(0))
    no_cursor = F.coalesce(F.col("cursor"), F.lit("")) == ""
    return (
        F.when(F.col("processed_id_index") > 0, FETCHING)
        .when((collected > 0) & no_cursor, READY)
        .otherwise(COLLECTING)
    )


def percent() -> Column:
    """Share of the collected ids that were fetched; unknown before phase 2."""
    done = F.col("processed_id_index")
    total = F.nullif(F.size("collected_ids"), F.lit(0))
    return F.when(done > 0, F.round(100 * done / total)).cast("int")


def run_report(states: DataFrame, key: str | None = None) -> DataFrame:
    """One row per run: key, phase, percent and modification time.

    Asking for one key that has no state is an error.
    """
    report = states.select(
        F.regexp_extract("file", KEY_OF_FILE, 1).alias("key"),
        phase().alias("phase"),
        percent().alias("percent"),
        "page_num",
        F.coalesce(F.size("collected_ids"), F.lit(0)).alias("collected"),
        "mtime",
    )
    if key is None:
        return report
    found = report.where(F.col("key") == key)
    if found.isEmpty():
        raise LookupError(f"no run in flight for {key!r}")
    return found
