"""Packing by optimal length buckets.

The lengths of all documents give one histogram. Dynamic programming over it
chooses the upper bounds of the buckets that need the least padding; documents of
a bucket are then put into batches of as many as a token budget holds.

Up to ``FINE`` every length is a cell of the histogram; beyond, cells end at numbers
with eight significant bits, so there is a bounded number of them at any size. A
bucket ends at the longest length of a cell, and padding is counted exactly, from
the sum of the lengths in each cell: buckets are the best of all whose ends do not
part a cell.

Numbering a bucket, which may hold most rows, goes by cells of rows with equal
hashes: counts of the cells give each its first number, so that no task numbers a
whole bucket.

Defined results: a document of no tokens lies in the first bucket; one longer than
the budget is a batch of its own; rows with one id get places of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.workspace import stage, stage_counted

FINE = 2048
CELL_ROWS = 20_000


def cell_end(length: Column) -> Column:
    """The end of the cell of a length (1 at least)."""
    low_bits = F.greatest(F.length(F.bin(length)) - 8, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), low_bits)
    coarse = F.ceil(length / step).cast("bigint") * step
    return F.when(length <= FINE, F.greatest(length, F.lit(1))).otherwise(coarse).cast("bigint")


def optimal_bounds(bounds: np.ndarray, rows: np.ndarray, tokens: np.ndarray, n_buckets: int) -> tuple[list[int], int]:
    """Upper bounds of ``n_buckets`` buckets (fewer cells: one each) with the least padding, and that padding.

    ``bounds`` ascend; ``rows`` and ``tokens`` are counts and summed lengths of each
    cell. The best last bucket of a shorter range never begins after that of a
    longer one, so each level is solved by divide and conquer.
    """
    n = len(bounds)
    if not n:
        return [], 0
    n_before = np.concatenate([[0], np.cumsum(rows, dtype=np.int64)])
    t_before = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])

    def padding(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return bounds[last] * (n_before[last + 1] - n_before[first]) - (t_before[last + 1] - t_before[first])

    best = padding(np.zeros(n, np.int64), np.arange(n))
    choices = []
    for level in range(1, min(n_buckets, n)):
        better, chosen = best.copy(), np.zeros(n, np.int64)
        ranges = [(level, n - 1, level, n - 1)]
        while ranges:
            low, high, least, most = ranges.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            first = np.arange(least, min(middle, most) + 1)
            costs = best[first - 1] + padding(first, np.full(len(first), middle))
            at = int(np.argmin(costs))
            better[middle], chosen[middle] = costs[at], first[at]
            ranges += [(low, middle - 1, least, int(first[at])), (middle + 1, high, int(first[at]), most)]
        choices.append(chosen)
        best = better
    picked, last = [], n - 1
    for chosen in reversed(choices):
        picked.append(int(bounds[last]))
        last = int(chosen[last]) - 1
    picked.append(int(bounds[last]))
    return sorted(picked), int(best[n - 1])


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``bound`` (the longest length, 1 at least), ``rows`` and ``tokens`` of the cells of ``n_tokens``."""
    return lengths.groupBy(cell_end(F.col("n_tokens")).alias("cell")).agg(
        F.greatest(F.max("n_tokens"), F.lit(1)).cast("bigint").alias("bound"),
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"),
    ).drop("cell")


def pack(lengths: DataFrame, n_buckets: int = 16, budget: int = 65_536, seed: int = 0) -> DataFrame:
    """``doc_id, n_tokens, bucket, bound, batch, slot, padding`` of each row of ``doc_id, n_tokens``.

    ``batch`` counts from 0 in each bucket; ``bound`` times the documents of a
    batch is within ``budget``.
    """
    lengths, n_rows = stage_counted(lengths.select("doc_id", "n_tokens"), "lengths")
    cells = length_histogram(lengths).orderBy("bound").collect()  # bounded: see cell_end
    bounds, _ = optimal_bounds(*(np.array([c[k] for c in cells], np.int64) for k in ("bound", "rows", "tokens")), n_buckets)
    bucket, bound = F.lit(len(bounds) - 1), F.lit(bounds[-1] if bounds else 1)
    for number, upper in reversed(list(enumerate(bounds[:-1]))):
        bucket = F.when(F.col("n_tokens") <= upper, number).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= upper, upper).otherwise(bound)
    n_cells = max(1, -(-n_rows // CELL_ROWS))
    placed = lengths.select(
        "doc_id", "n_tokens", bucket.cast("int").alias("bucket"), bound.cast("bigint").alias("bound"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(n_cells)).alias("cell"),
    )
    counts = stage(placed.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("rows")), "cell-rows")
    earlier = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("bucket", "cell", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("bucket", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "n_tokens")
    place = F.col("first") + F.row_number().over(inside) - 1
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bound")), F.lit(1)).cast("bigint")
    return (
        placed.join(firsts, ["bucket", "cell"])
        .withColumn("place", place)
        .select(
            "doc_id", "n_tokens", "bucket", "bound",
            F.floor(F.col("place") / per_batch).cast("bigint").alias("batch"),
            F.pmod("place", per_batch).alias("slot"),
            (F.col("bound") - F.col("n_tokens")).alias("padding"),
        )
    )
