"""Whitening of embedding vectors on their largest principal components.

Entries become whole numbers, so counts and sums are exact. The covariance matrix
is never formed: the components are found by Jacobi-Davidson iteration
(``jacobi_davidson``), whose every product is one distributed pass over the centred
vectors. Vectors are packed into blocks of a written table, so a pass reads bytes
and multiplies matrices; a task sends one small block, and these are added up by
position, so the driver receives as many numbers as the block has, whatever the
number of tasks.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries fall away, and so do vectors whose length is not the commonest one (of
equally common ones the longest is); each other row gives a row a component,
repeated ids included, also a null id; fewer dimensions than components give a row
a dimension. A component without variance (to double precision) has ``whitened``
null. An empty table gives no rows. Entries whose whole number has more than 53
bits raise. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.jacobi_davidson import EPS, largest_eigenpairs
from storegrain.workspace import stage

FACTOR = 1024
SHIFT = 100_000
BLOCK_BYTES = 4 << 20
LONG_MAX = 2.0**62
#: An eigenvalue of so small a share of the largest can't be told from none.
NO_VARIANCE = 64 * EPS


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """``floor(1024 c) + 100000`` of each entry."""
    made = np.floor(FACTOR * entries.astype(np.float64))
    if len(made) and np.abs(made).max() >= 2.0**53:
        raise OverflowError("an entry is too large for an exact whole number")
    return made.astype(np.int64) + SHIFT


def pack_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``dim, n, ids, data``: usable vectors in blocks of one dimension, as little-endian 64-bit integers."""
    entry = F.col("v").cast("array<double>")
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    picked = picked.where("v IS NOT NULL AND size(v) > 0").where(usable)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = max(batch.column(1).value_lengths().to_pylist(), default=1)
            n_rows = max(1, BLOCK_BYTES // (8 * longest))
            for first in range(0, batch.num_rows, n_rows):
                part = batch.slice(first, n_rows)
                lists = part.column(1)
                numbers = whole_numbers(lists.flatten().to_numpy(zero_copy_only=False))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                rows = []
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    at = (ends[own] - dim)[:, None] + np.arange(dim)
                    rows.append((dim, len(own), part.column(0).take(pa.array(own)), numbers[at].astype("<i8").tobytes()))
                if rows:
                    dims, counts, ids, data = zip(*rows, strict=True)
                    offsets = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(dims, pa.int32()), pa.array(counts, pa.int64()),
                            pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids)), pa.array(data, pa.binary()),
                        ],
                        names=["dim", "n", "ids", "data"],
                    )

    kind = dict(picked.dtypes)["id"]
    return picked.mapInArrow(packed, f"dim int, n bigint, ids array<{kind}>, data binary")


@dataclass
class Vectors:
    """Packed vectors of one dimension, their number and exact sums."""

    blocks: DataFrame
    dim: int
    n: int
    sums: list[int]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean in two parts, a whole number and what is left, so that centring loses nothing."""
        whole = [s // self.n for s in self.sums]
        rest = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest)


def _numbers(data, dim: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def load_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> Vectors | None:
    """The usable vectors of the commonest dimension; none if there are no usable ones."""
    blocks = stage(pack_vectors(vectors, id_col, vector_col), "vector-blocks")
    dims = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not dims:
        return None
    dim, n = dims[0]["dim"], dims[0]["n"]
    blocks = blocks.where(F.col("dim") == dim)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            for data in _column(batch, "data"):
                block = _numbers(data, dim)
                # Two halves of each number, so that no sum of a block can overflow.
                high, low = (block >> 26).sum(axis=0), (block & ((1 << 26) - 1)).sum(axis=0)
                total = [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array(list(map(str, total)))], names=["at", "total"]
        )

    parts = blocks.select("data").mapInArrow(added, "at int, total string")
    sums = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return Vectors(blocks, dim, n, [int(total) for _, total in sorted(map(tuple, sums))])


def add_up(vectors: Vectors, shape: tuple[int, ...], of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what ``of_block`` makes (of ``shape``) of their centred vectors.

    Each task adds up its own blocks and sends one array, position by position.
    """
    dim, (whole, rest) = vectors.dim, vectors.centre()

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(shape)
        for batch in batches:
            for data in _column(batch, "data"):
                part += of_block((_numbers(data, dim) - whole) - rest)
        flat = part.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "part"]
        )

    parts = vectors.blocks.select("data").mapInArrow(added, "at int, part double")
    total = np.zeros(int(np.prod(shape)))
    for at, value in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():
        total[at] = value
    return total.reshape(shape)


@dataclass
class Whitening:
    """Components (columns), their eigenvalues, the trace, and how far whitened covariance is from the identity."""

    vectors: Vectors
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def scales(self) -> np.ndarray:
        """What projections are multiplied with; NaN where there is no variance."""
        found = self.variances > NO_VARIANCE * self.variances.max(initial=0.0)
        return np.where(found, 1 / np.sqrt(np.where(found, self.variances, 1.0)), np.nan)


def fit_whitening(vectors: Vectors, count: int = 8, seed: int = 0, depth: int = 4) -> Whitening:
    """Components of the covariance of all vectors, by passes over them alone."""
    dim, n = vectors.dim, vectors.n

    def product(block: np.ndarray) -> np.ndarray:
        return add_up(vectors, block.shape, lambda centred: centred.T @ (centred @ block)) / n

    variances, components = largest_eigenpairs(product, dim, count, seed, depth)
    trace = float(add_up(vectors, (1,), lambda centred: np.array([np.einsum("ij,ij->", centred, centred)]))[0]) / n
    fitted = Whitening(vectors, components, np.maximum(variances, 0.0), trace, 0.0)
    kept = np.isfinite(fitted.scales())
    if kept.any():
        turn = components[:, kept] * fitted.scales()[kept]
        width = turn.shape[1]
        mean = add_up(vectors, (width,), lambda centred: (centred @ turn).sum(axis=0)) / n

        def spread(centred: np.ndarray) -> np.ndarray:
            whitened = centred @ turn - mean
            return whitened.T @ whitened

        covariance = add_up(vectors, (width, width), spread) / n
        fitted.identity_error = float(np.abs(covariance - np.eye(width)).max())
    return fitted


def _deviations(block: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the dimensions of ``(n x - S)^2`` of each vector, exact."""
    rough = n * block.astype(np.float64) - np.array(sums, np.float64)
    if max(float(np.abs(block).max()) * n, max(map(abs, sums)), float((rough**2).sum(axis=1).max())) < LONG_MAX:
        return pa.array(((n * block - np.array(sums, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in block.tolist()]
    return pa.array(exact, pa.decimal128(38, 0))


def whiten(vectors: DataFrame, count: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row a vector and component.

    ``deviation`` is a decimal of 38 digits. ``explained`` is the component's share
    of the total variance, null if there is none.
    """
    kind = dict(vectors.select(F.col(id_col).alias("id")).dtypes)["id"]
    ddl = (
        f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    loaded = load_vectors(vectors, id_col, vector_col)
    if loaded is None:
        none = vectors.select(F.col(id_col).alias("id")).where(F.lit(False))
        return none.mapInArrow(lambda batches: iter(()), ddl)
    fitted = fit_whitening(loaded, count, seed)
    dim, n, sums, (whole, rest) = loaded.dim, loaded.n, loaded.sums, loaded.centre()
    turn = fitted.components * np.nan_to_num(fitted.scales())
    flat = np.isnan(fitted.scales())
    width, error = turn.shape[1], fitted.identity_error
    shares = [float(v) / fitted.trace if fitted.trace else None for v in fitted.variances]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(_column(batch, "ids"), _column(batch, "data"), strict=True):
                block = _numbers(data, dim)
                made = ((block - whole) - rest) @ turn
                each = pa.array(np.repeat(np.arange(len(block)), width))
                mask = np.tile(flat, len(block))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(each), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(block))),
                        pa.array(np.full(len(mask), n)), _deviations(block, n, sums).take(each),
                        pa.array(made.ravel(), mask=mask), pa.array(shares * len(block), pa.float64()),
                        pa.array(np.full(len(mask), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return loaded.blocks.select("ids", "data").mapInArrow(rows, ddl)
