"""Two-pass external shuffle into shards.

The first pass scatters records by a seeded hash into buckets that fit in memory;
the second gives each bucket a Fisher-Yates permutation (Spark's ``shuffle`` of an
array) and writes it. Buckets follow one another in one long row, which is cut
into shards of equal row counts (at most one apart).

Only DataFrame functions. Texts are shuffled once. What must be known before the
second pass, the rows of each bucket, is counted from the same hash: one small row
a bucket, ``bytes / bucket_bytes`` of them.

Defined results: a null text has no bytes; null and repeated ids are scattered by
their texts too; rows equal in id and text lie in one bucket; an empty table gives
no shard. Columns must have an order (no maps or variants), which makes a
permutation depend on rows and seed alone; names never clash, as records travel in
a struct.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.workspace import new_folder, stage

LAW = "rows"


def scattered(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Each record with its size and its place on the hash ring."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("record"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(text)).alias("place"),
    )


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int,
    seed: int = 0,
    bucket_bytes: int = 8 << 20,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the records in shuffled shards and return them as read from the files.

    Columns: ``record`` (all columns of ``docs``), ``size``, ``slot`` and ``shard``.
    A file holds its rows in the order of their slots.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    sizes = scattered(docs, seed, id_col, text_col)
    total = sizes.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    n_rows, n_buckets = total["rows"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    placed = sizes.withColumn("bucket", F.pmod("place", F.lit(n_buckets)))

    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), "bucket-rows")
    offsets = counts.select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))

    buckets = placed.groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("place", "size", "record"))).alias("rows")
    )
    rank = F.col("before") + F.col("pos")
    shuffled = (
        buckets.join(offsets, "bucket")
        .select("before", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
        .select("row.record", "row.size", rank.alias("rank"))
        .withColumn("shard", F.expr(f"cast(rank * {n_shards} div {max(1, n_rows)} as int)"))
        .withColumn("slot", F.expr(f"rank - (shard * {n_rows}L + {n_shards - 1}) div {n_shards}"))
        .select("record", "size", "slot", "shard")
        .sortWithinPartitions("shard", "slot")
    )
    shuffled.write.partitionBy("shard").parquet(folder)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in shuffled.schema])
    return spark.read.schema(schema).parquet(folder)
