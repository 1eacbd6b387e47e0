"""Customer segments: who holds a field value, and who is new since last time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.operators.keys import keep_matching
from storegrain.workspace import stage, stage_counted


def field_match(field: str, value: str) -> Column:
    """Exact, case-sensitive match on field and value; only positive ids count."""
    return (F.col("name") == field) & (F.col("value") == value) & (F.col("customer_id") > 0)


def matching_values(values: DataFrame, field: str, value: str) -> DataFrame:
    return values.where(field_match(field, value))


def segment_ids(values: DataFrame, field: str, value: str) -> DataFrame:
    """Distinct ids of the customers whose field equals the value."""
    matches = matching_values(values, field, value)
    return matches.select(F.col("customer_id").alias("id")).distinct()


def find_segment(values: DataFrame, field: str, value: str) -> tuple[DataFrame, int]:
    """:func:`segment_ids` as a written table, and how many there are.

    The table's size is known, so a small segment is broadcast and the customers
    are scanned without a shuffle.
    """
    return stage_counted(segment_ids(values, field, value), "segment")


def customers_of(customers: DataFrame, ids: DataFrame) -> DataFrame:
    """Customer rows of the ids; an id without a customer vanishes."""
    return keep_matching(customers, ids, "id")


def not_exported(ids: DataFrame, exported: DataFrame, column: str) -> DataFrame:
    """Ids that are not yet in an earlier export, whose cells are text."""
    seen = exported.select(F.col(f"`{column}`").alias("_seen"))
    return ids.join(seen, ids["id"].cast("string") == seen["_seen"], "left_anti")


def not_listed(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ids (a written table) that a ledger of ids does not hold.

    The ledger meets the ids first, so where these are few it is scanned only.
    """
    seen = keep_matching(ledger, ids, "id").select(F.col("id").alias("_seen"))
    return ids.join(seen, ids["id"] == seen["_seen"], "left_anti")


def segment_counts(values: DataFrame, customers: DataFrame, field: str, value: str) -> DataFrame:
    """One row: matching value rows, matched customers and customers found."""
    per_id = stage(
        matching_values(values, field, value)
        .groupBy(F.col("customer_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("rows")),
        "segment",
    )
    known = customers_of(customers.select("id"), per_id).distinct().withColumn("known", F.lit(1))
    return per_id.join(known, "id", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("matched_rows"),
        F.count(F.lit(1)).alias("matched"),
        F.count("known").alias("fetched"),
    )


def pivot_fields(values: DataFrame, names: list[str], order: str) -> DataFrame:
    """One column per named field; where a name repeats the first in ``order`` wins."""
    return (
        values.where(F.col("name").isin(names))
        .groupBy("customer_id")
        .pivot("name", names)
        .agg(F.min_by("value", order))
    )

