"""Incremental export driven by landed pages: each batch exports the new customers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from storegrain.functions.cells import parse_columns
from storegrain.plans.export import export_segment
from storegrain.sources.landed import stream_field_values
from storegrain.workspace import feed_id


def run_export_feed(spark: SparkSession, pages: str, customers: DataFrame, *, checkpoint: str,
                    key: str, field: str, value: str, columns: str, out_dir: str,
                    full_columns: str | None = None, prefix: str | None = None,
                    run_date: date | None = None, multiline: bool = True,
                    files_per_batch: int | None = None) -> None:
    """Export customers that match in pages not yet seen and are not in the base.

    The run id is the id of the checkpoint's stream and the batch id: a replayed
    batch leaves its own earlier rows out of the comparison with the base and
    overwrites them, and never those of another checkpoint.
    """
    parse_columns(columns)
    values = stream_field_values(spark, pages, multiline=multiline,
                                 files_per_batch=files_per_batch)

    def export_batch(batch: DataFrame, batch_id: int) -> None:
        export_segment(batch, customers, key=key, field=field, value=value, columns=columns,
                       full_columns=full_columns, prefix=prefix, out_dir=out_dir,
                       run_date=run_date, run=f"{feed_id(batch.sparkSession, checkpoint)}-{batch_id}", incremental=True, write=True)

    query = (
        values.writeStream.foreachBatch(export_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
