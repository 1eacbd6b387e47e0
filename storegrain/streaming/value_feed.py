"""Current field values kept up to date from a feed of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storegrain import schemas
from storegrain.operators.values import split_changes
from storegrain.sources.value_table import append_changes
from storegrain.workspace import feed_id

FEED = "customer_id STRING, name STRING, value STRING, ts TIMESTAMP, seq BIGINT"


def stream_changes(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Landed changes, one JSON object per line."""
    reader = spark.readStream.schema(FEED).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def run_value_feed(changes: DataFrame, root: str, checkpoint: str) -> None:
    """Add each batch's last writes to the value table, rejects beside it.

    All state is in the table, none in the stream; a replayed batch overwrites
    what it wrote before, and no batch of another checkpoint.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        sound, rejects = split_changes(batch)
        typed = {name: sound[name].cast(kind) for name, kind in schemas.CHANGE_COLUMNS.items()}
        feed = feed_id(batch.sparkSession, checkpoint)
        name = append_changes(sound.withColumns(typed), root, batch_id, feed)
        rejects.write.mode("overwrite").parquet(f"{root}/rejects/{name}")

    query = (
        changes.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
