"""Importance resampling towards a target distribution.

1. Every run of words of a text is a feature, hashed into a bucket. Counts of the
   buckets over all documents and over the target texts give each bucket a gain,
   the logarithm of how much commoner it is in the target.
2. A document's weight is the sum of the gains of its features, taken from one
   array; noise of a Gumbel distribution, drawn from a hash of its id, makes the
   highest scores a sample without replacement.
3. The last score drawn is found by distributed quickselect: pivot keys are picked
   at random, an exact count of the rows below, at and above each narrows the
   search, and so on down to one key. Nothing else is sorted but what is drawn.

Keys are composite (score, id, hash of the text, number of the row), hence no two
are equal and exactly the wanted number of rows is drawn.

Defined results: a null text has no words; a null id is hashed as an empty one and
comes after others of its score; rows equal in id and text are drawn one by one;
an empty table gives no rows; without target texts all gains favour rare buckets.
Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from storegrain.workspace import stage, stage_counted

#: Lower-cases A-Z; other ASCII but digits and letters becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
REMEMBERED = 500_000
CHUNK_FEATURES = 200_000
PIVOTS = 16
KEY = ("fall", "no_id", "doc_id", "text_hash", "row")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def runs_of(words: list[bytes], max_run: int) -> list[bytes]:
    """Runs of 1 to ``max_run`` consecutive words, joined by blanks."""
    runs = words
    for length in range(2, max_run + 1):
        runs = runs + [b" ".join(run) for run in zip(*(words[k:] for k in range(length)), strict=False)]
    return runs


class Buckets(dict):
    """Bucket of a feature, worked out when first asked for; holds ``REMEMBERED`` at most."""

    def __init__(self, n_buckets: int):
        super().__init__()
        self.n_buckets = n_buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.n_buckets
        return bucket

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.binary()):
        yield text.as_py() or b""


def count_buckets(texts: DataFrame, text_col: str, n_buckets: int, max_run: int) -> np.ndarray:
    """Features in each bucket over all texts; a task sends its own counts alone."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(n_buckets), np.zeros(n_buckets, np.int64)
        waiting: list[bytes] = []
        for batch in batches:
            for data in _texts(batch, 0):
                waiting += runs_of(words_of(data), max_run)
                if len(waiting) >= CHUNK_FEATURES:
                    total += np.bincount(buckets.of(waiting), minlength=n_buckets)
                    waiting = []
        total += np.bincount(buckets.of(waiting), minlength=n_buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled.astype(np.int32)), pa.array(total[filled])], names=["bucket", "n"]
        )

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(counted, "bucket int, n bigint")
    total = np.zeros(n_buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most n_buckets rows
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of each bucket's smoothed share in the target over that in the corpus."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """``floor(1000 x)`` of a Gumbel-distributed x that the id and seed decide."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share)))


def score_documents(
    docs: DataFrame, gains: np.ndarray, seed: int, max_run: int, id_col: str, text_col: str
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, text_hash`` of each row."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(len(gains))
        for batch in batches:
            rows = []
            for data in _texts(batch, 2):
                words = words_of(data)
                runs = runs_of(words, max_run)
                rows.append((len(words), len(runs), int(gains[buckets.of(runs)].sum())))
            counts = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, counts)],
                names=["doc_id", "text_hash", "n_words", "n_features", "weight"],
            )

    kind = dict(picked.dtypes)["doc_id"]
    weights = picked.mapInArrow(
        weighed, f"doc_id {kind}, text_hash bigint, n_words bigint, n_features bigint, weight bigint"
    )
    return weights.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))


def _key(row: Row | None = None, kinds: dict[str, str] | None = None) -> Column:
    """The composite key of a row of the table, or that of a given row."""
    if row is None:
        return F.struct(*KEY)
    return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in KEY])


def select_kth(keyed: DataFrame, k: int, pivots: int = PIVOTS) -> Row:
    """The ``k``-th row (from 1) in the order of the composite key, whose columns ``keyed`` has.

    Each round draws pivots at random, counts the rows below, at and above them
    exactly, and keeps the stretch that holds the k-th as a written table: its
    size falls by about ``pivots`` each time. Ends as soon as a pivot is the k-th.
    """
    kinds, left, round_no = dict(keyed.dtypes), keyed.select(*KEY), 0
    while True:
        lots = F.xxhash64(F.lit(round_no), "row")
        drawn = left.orderBy(lots, "row").limit(pivots).orderBy(*KEY).collect()
        keys = [_key(row, kinds) for row in drawn]
        below = sum((key < _key()).cast("int") for key in keys)
        at = sum((key == _key()).cast("int") for key in keys)
        placed = left.withColumn("place", 2 * below + at)  # odd: a pivot itself
        counts = {row["place"]: row["count"] for row in placed.groupBy("place").count().collect()}
        for place in sorted(counts):
            if k <= counts[place]:
                break
            k -= counts[place]
        else:
            raise ValueError("fewer rows than k")
        if place % 2:
            return drawn[place // 2]
        left, round_no = stage(placed.where(F.col("place") == place).select(*KEY), "select-left"), round_no + 1


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of the composite key.

    Rows are sorted by range; the running sum is over one row a partition.
    """
    at = F.monotonically_increasing_id()
    placed = stage(rows.orderBy(*KEY).withColumn("at", at), "ranked-parts")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(parts, "part").withColumn("rank", rank).drop("at", "part", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    seed: int = 2024,
    n_buckets: int = 10_000,
    max_run: int = 1,
    min_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row; ``rank`` is null where not drawn.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred (rounded
    down) are drawn.
    """
    gains = bucket_gains(
        count_buckets(docs, text_col, n_buckets, max_run), count_buckets(target, target_col, n_buckets, max_run)
    )
    scored = score_documents(docs, gains, seed, max_run, id_col, text_col)
    scored, _ = stage_counted(scored.withColumn("row", F.monotonically_increasing_id()), "scored-documents")
    keyed = scored.withColumn("fall", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull())
    large = keyed.where(F.col("n_words") >= min_words)
    k = percent * large.count() // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    if not k:
        return keyed.withColumn("rank", F.lit(None).cast("bigint")).select(*out)
    last = _key(select_kth(large, k), dict(keyed.dtypes))
    won = (F.col("n_words") >= min_words) & (_key() <= last)
    lost = keyed.where(~won).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(keyed.where(won)).select(*out).unionByName(lost.select(*out))
