"""Landed pages taken into a landing store as they arrive, each page once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storegrain.sources.checks import QUARANTINE
from storegrain.sources.landed import stream_pages
from storegrain.sources.landing_store import KINDS, store_batch
from storegrain.workspace import feed_id


def run_landing_feed(spark: SparkSession, pages: str, root: str, kind: str, *, checkpoint: str,
                     mode: str = QUARANTINE, multiline: bool = True,
                     files_per_batch: int | None = None) -> None:
    """Store the rows of the pages not yet seen; bad ones are set aside beside them.

    All state is in the store. A replayed batch overwrites what it wrote before,
    and no batch of another checkpoint.
    """
    if kind not in KINDS:
        raise ValueError(f"no such kind of rows: {kind!r}; known are {', '.join(KINDS)}")
    landing = stream_pages(spark, pages, multiline=multiline, files_per_batch=files_per_batch,
                           strict=mode != QUARANTINE)

    def take(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, root, kind, batch_id, feed_id(batch.sparkSession, checkpoint), mode)

    query = (
        landing.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
