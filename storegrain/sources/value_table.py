"""The current (customer, field) -> value table, kept as a base plus change batches.

``<root>/base/upto=<n>``      a whole table holding every batch up to ``n``
``<root>/changes/batch=<n>-<feed>-<batch>``  the deduplicated changes of one batch

A batch is known by its feed and its number there; ``n`` is its place in the
order in which batches arrived, over all feeds. A feed that starts anew (another
checkpoint, hence another feed id) never meets the folders of the one before.

Applying a batch costs as much as the batch, not the table.  Reading merges the
batches newer than the newest base, and :func:`compact` folds them into a new
base.  A folder counts only once its write has finished, so nothing that is
being read is ever overwritten. What no reader needs any more goes with
:func:`storegrain.sources.batches.vacuum`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storegrain import schemas
from storegrain.operators.values import last_writes, upsert_values
from storegrain.sources.batches import BASE, batch_name, batch_number, newest_base, pending_batches
from storegrain.workspace import empty_table


def append_changes(changes: DataFrame, root: str, batch: int, feed: str = "table") -> str:
    """Store the last write per key of a batch; a replay overwrites its own folder.

    Returns the name of the folder.
    """
    name = batch_name(changes.sparkSession, root, feed, batch)
    rows = last_writes(changes).select(*schemas.CHANGE_COLUMNS)
    rows.write.mode("overwrite").parquet(f"{root}/changes/{name}")
    return name


def _newest_base(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    upto, folder = newest_base(spark, root)
    schema = schemas.FORM_FIELD_VALUES
    return upto, spark.read.schema(schema).parquet(folder) if folder else empty_table(spark, schema)


def _pending(spark: SparkSession, root: str, after: int) -> tuple[int, DataFrame | None]:
    newer = pending_batches(spark, root, after)
    if not newer:
        return after, None
    changes = spark.read.schema(schemas.CHANGES).parquet(*newer.values())
    return max(newer), changes.withColumn("batch", batch_number())


def read_values(spark: SparkSession, root: str) -> DataFrame:
    upto, current = _newest_base(spark, root)
    _, changes = _pending(spark, root, upto)
    return current if changes is None else upsert_values(current, changes)


def compact(spark: SparkSession, root: str) -> bool:
    """Write base plus pending batches as a new base; False if nothing is pending."""
    upto, current = _newest_base(spark, root)
    newest, changes = _pending(spark, root, upto)
    if changes is None:
        return False
    merged = upsert_values(current, changes)
    merged.write.mode("overwrite").parquet(f"{root}/base/{BASE}{newest}")
    return True
