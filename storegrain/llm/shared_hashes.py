"""Which hashes of a row occur in other rows too.

Rows ("owners") give sets of 64-bit hashes, far too many to shuffle one by one.
Tasks pack them by hash bucket into binary columns; each bucket counts the owners
of its hashes and sends those with two owners or more back, packed by owner. Only
these can take part in any match.

A hash is known by its bucket and ``FP_BITS`` further bits, so the number of
different names grows with the number of buckets, that is with the data. Buckets
hold about ``BUCKET_ENTRIES`` hashes, which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FP_BITS = 40
FP_BYTES = FP_BITS // 8
FP_MASK = np.uint64((1 << FP_BITS) - 1)
BUCKET_ENTRIES = 2_000_000
FLUSH_ENTRIES = 600_000
PACKED = "bucket int, owners binary, sizes binary, runs binary, tokens binary, seen binary"

#: owner, size of its set, its distinct hashes
Owned = tuple[int, int, np.ndarray]


def bucket_count(n_hashes: int | None) -> int:
    return min(1 << 22, max(1, -(-(n_hashes or 0) // BUCKET_ENTRIES)))


def token_names(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and further bits of each hash as one number."""
    bucket = (hashes >> np.uint64(FP_BITS)) % np.uint64(n_buckets)
    return ((bucket << np.uint64(FP_BITS)) | (hashes & FP_MASK)).astype(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _narrow(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs: one, two or four."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32).tobytes()


def _wide(packed: list[bytes], counts: list[int]) -> np.ndarray:
    """The counts of several rows, of which each has so many."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.int32}
    parts = [np.frombuffer(p, kinds[len(p) // n]).astype(np.int32) for p, n in zip(packed, counts, strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _packed(keys: np.ndarray, owners, sizes, tokens: np.ndarray, seen) -> Iterator[tuple]:
    """One row for each run of ``keys``; within it owners are in runs."""
    starts, lengths = _runs(keys)
    for at, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        part = slice(at, at + length)
        first, runs = _runs(owners[part])
        low = tokens[part].astype("<u8").view(np.uint8).reshape(-1, 8)
        width = FP_BYTES if seen is None else 8
        yield (
            int(keys[at]),
            owners[part][first].tobytes(),
            _narrow(sizes[part][first]),
            _narrow(runs),
            np.ascontiguousarray(low[:, :width]).tobytes(),
            b"" if seen is None else _narrow(seen[part]),
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 5]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _flushed(owned: list[Owned], n_buckets: int) -> pa.RecordBatch:
    owners = np.repeat(np.array([o for o, _, _ in owned], np.int64), [len(h) for *_, h in owned])
    sizes = np.repeat(np.array([n for _, n, _ in owned], np.int32), [len(h) for *_, h in owned])
    names = token_names(np.concatenate([h for *_, h in owned]), n_buckets)
    buckets = names >> FP_BITS
    order = np.argsort(buckets, kind="stable")
    rows = list(_packed(buckets[order], owners[order], sizes[order], names[order], None))
    return _batch(rows)


def pack_hashes(
    batches: Iterable[pa.RecordBatch], owned_of: Callable[[pa.RecordBatch], Iterator[Owned]], n_buckets: int
) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` for all owners of the batches; an owner met twice in a row of flushes counts once."""
    waiting: dict[int, Owned] = {}
    n_waiting = 0
    for batch in batches:
        for owner, size, hashes in owned_of(batch):
            if len(hashes) and owner not in waiting:
                waiting[owner] = (owner, size, hashes)
                n_waiting += len(hashes)
            if n_waiting >= FLUSH_ENTRIES:
                yield _flushed(list(waiting.values()), n_buckets)
                waiting, n_waiting = {}, 0
    if waiting:
        yield _flushed(list(waiting.values()), n_buckets)


def _column(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def _unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """Owners, sizes and tokens, each owner's first run only where ``width`` is that of a bucket."""
    packed = _column(table, "owners")
    counts = [len(p) // 8 for p in packed]
    owners = np.frombuffer(b"".join(packed), np.int64)
    sizes, runs = (_wide(_column(table, name), counts) for name in ("sizes", "runs"))
    raw = np.frombuffer(b"".join(_column(table, "tokens")), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return owners, sizes, runs, wide.view("<i8").reshape(-1)


def _shared(table: pa.Table, n_parts: int) -> pa.Table:
    """Hashes of one bucket with two owners or more, packed by part of the owners."""
    bucket = table.column("bucket")[0].as_py()
    owners, sizes, runs, tokens = _unpacked(table, FP_BYTES)
    first = np.zeros(len(owners), bool)
    first[np.unique(owners, return_index=True)[1]] = True
    if not first.all():
        tokens = tokens[np.repeat(first, runs)]
        owners, sizes, runs = owners[first], sizes[first], runs[first]
    order = np.argsort(tokens)
    counts = _runs(tokens[order])[1].astype(np.int32)
    seen = np.empty(len(tokens), np.int32)
    seen[order] = np.repeat(counts, counts)
    del order, counts
    kept = seen > 1
    tokens, seen = tokens[kept] | (bucket << FP_BITS), seen[kept]
    owners, sizes = np.repeat(owners, runs)[kept], np.repeat(sizes, runs)[kept]
    parts = (owners.view(np.uint64) >> np.uint64(33)).astype(np.int64) % n_parts
    order = np.lexsort((owners, parts))
    rows = list(_packed(parts[order], owners[order], sizes[order], tokens[order], seen[order])) if len(order) else []
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema=_SCHEMA)


_SCHEMA = _batch([(0, b"", b"", b"", b"", b"")]).schema
FOUND = "owner bigint, size int, tokens array<bigint>"
_FOUND_SCHEMA = pa.schema([("owner", pa.int64()), ("size", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def _gathered(table: pa.Table, least_percent: int) -> pa.Table:
    """Each owner of a part with its shared hashes, rarest first."""
    owners, sizes, runs, tokens = _unpacked(table, 8)
    owners, sizes = np.repeat(owners, runs), np.repeat(sizes, runs)
    seen = _wide(_column(table, "seen"), [len(p) // 8 for p in _column(table, "tokens")])
    order = np.lexsort((tokens, seen, owners))
    starts, counts = _runs(owners[order])
    enough = 100 * counts >= least_percent * sizes[order][starts].astype(np.int64)
    tokens = tokens[order][np.repeat(enough, counts)]
    offsets = np.concatenate([[0], np.cumsum(counts[enough])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
    picked = order[starts][enough]
    return pa.Table.from_arrays([pa.array(owners[picked]), pa.array(sizes[picked]), lists], schema=_FOUND_SCHEMA)


def shared_hashes(
    docs: DataFrame,
    owned_of: Callable[[pa.RecordBatch], Iterator[Owned]],
    n_hashes: int | None,
    least_percent: int = 0,
) -> DataFrame:
    """``owner, size, tokens`` of owners with shared hashes (``least_percent`` of their set at least).

    ``tokens`` are the names of the shared hashes, those with the fewest owners
    first, equal counts by name. ``owned_of`` gives the owners of a batch; an
    owner that comes twice must come with the same hashes.
    """
    n_buckets = bucket_count(n_hashes)
    packed = docs.mapInArrow(lambda batches: pack_hashes(batches, owned_of, n_buckets), PACKED)
    shared = packed.groupBy("bucket").applyInArrow(lambda table: _shared(table, n_buckets), PACKED)
    return shared.groupBy("bucket").applyInArrow(lambda table: _gathered(table, least_percent), FOUND)
