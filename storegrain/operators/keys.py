"""Joins and top-N on keys that may be unevenly spread.

Joins are plain equalities. The planner broadcasts a side whose size in bytes it
knows to be small (tables of keys are written first, so it knows) and shuffles
otherwise; an aggregate or window on the same key then needs no further exchange.
A hot key in such a join below a window is split where the session sets
``spark.sql.adaptive.forceOptimizeSkewedJoin``, at the price of one more exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.workspace import stage


def keep_matching(df: DataFrame, keys: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Rows whose ``column`` is among the keys (left semi join); repeated keys do no harm."""
    wanted = keys.select(F.col(key or column).alias("_key"))
    return df.join(wanted, df[column] == wanted["_key"], "left_semi")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the greatest, where copies of a row may have landed.

    Null keys are left out: they name nothing. Columns without an order
    (variants) are compared by their text.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(*[
        (F.to_json(F.col(c)) if "variant" in df.schema[c].dataType.simpleString() else F.col(c)).alias(f"k{n}")
        for n, c in enumerate(rest)
    ])
    greatest = F.max_by(F.struct(*rest), order).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(greatest).select(key, "_row.*")


def left_join_filled(left: DataFrame, right: DataFrame, column: str, key: str,
                     spread: str) -> DataFrame:
    """Left join in which rows with a null or empty ``column`` match nothing.

    Those rows may be a large share; they are spread by ``spread`` rather than
    meeting in the partition of the null key.
    """
    value = F.nullif(left[column], F.lit(""))
    spread_value = F.coalesce(value, left[spread].cast("string"))
    return left.join(right, (spread_value == right[key]) & value.isNotNull(), "left")


def top_n(df: DataFrame, key: str, order: list[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per key in ``order``, numbered from 1 in ``rank``.

    Spark limits each key inside every task before the exchange, so a hot key
    sends at most ``n`` rows per task, for ``n`` up to the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def asked_keys(keys: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a lookup in a written table (column ``_key``)."""
    wanted = keys.select(F.col(key).alias("_key")).where(F.col(key).isNotNull())
    return stage(wanted.distinct(), "asked")


def top_n_of(df: DataFrame, asked: DataFrame, column: str, order: list[Column], n: int,
             rank: str) -> DataFrame:
    """:func:`top_n` of the keys asked for: first only their rows, then the ranks."""
    return top_n(keep_matching(df, asked, column, "_key"), column, order, n, rank)
