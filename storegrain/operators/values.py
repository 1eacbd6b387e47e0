"""Updates of (customer, field) values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.workspace import stage

KEY = ("customer_id", "name")
WRITTEN_NUMBER = r"^\s*[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?\s*$"


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes with a usable id, rejects).

    A usable id is a whole finite number above 0, as a number or as text that
    writes one (no type suffix as in ``12d``).
    """
    written = F.col("customer_id").cast("string").rlike(WRITTEN_NUMBER)
    number = F.when(written, F.expr("try_cast(customer_id as double)"))
    whole = F.when(number == F.floor(number), F.expr("try_cast(try_cast(customer_id as double) as bigint)"))
    read = changes.withColumn(
        "_id", F.coalesce(F.expr("try_cast(customer_id as bigint)"), whole)
    )
    usable = F.coalesce(written & (F.col("_id") > 0), F.lit(False))
    sound = read.where(usable).withColumn("customer_id", F.col("_id")).drop("_id")
    return sound, read.where(~usable).drop("_id")


def last_writes(changes: DataFrame) -> DataFrame:
    """The last change per (customer, field).

    Batches come first if the rows carry a ``batch``, then ``ts`` and ``seq``.
    The maximum is taken inside each task first, so a hot key stays cheap.
    """
    order = [c for c in ("batch", "ts", "seq") if c in changes.columns]
    rest = [c for c in changes.columns if c not in KEY and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return changes.groupBy(*KEY).agg(newest).select(*KEY, "_newest.*")


def upsert_values(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current`` with the last change of each key put in place of its row."""
    return _replace(current, last_writes(changes).select(*KEY, "value"))


def _replace(current: DataFrame, applied: DataFrame) -> DataFrame:
    kept = current.join(applied, list(KEY), "left_anti").select(*KEY, "value")
    return kept.unionByName(applied)


def apply_updates(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated table, applied rows, rejected rows) for a table of changes.

    The applied rows are a written table: if they are few, the current table is
    not shuffled.
    """
    sound, rejects = split_changes(changes)
    applied = stage(last_writes(sound).select(*KEY, "value"), "applied")
    return _replace(current, applied), applied, rejects
