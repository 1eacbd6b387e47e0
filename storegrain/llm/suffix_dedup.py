"""Exact substring deduplication with suffix arrays.

Every byte is removed that a string of ``length`` bytes covers which also starts
in a document with a smaller id.

1. The least hash of the ``SEED``-byte strings inside it names a ``length``-byte
   string, so equal strings have equal names. Names that one document alone has
   can't take part; they are found without shuffling text (``shared_hashes``).
2. Stretches of text whose strings have one shared name are sent to the shard of
   that name, equal stretches of a task once.
3. A shard is cut into blocks of bounded size. Each block gets its suffix array by
   Larsson-Sadakane refinement, and common prefixes by Kasai's order. Blocks are
   merged by binary search of the distinct strings of one in those of the others.
4. What is covered goes back to the documents as spans.

Defined results: a null text is empty; a row without id loses nothing and takes
nothing from others; rows with one id are one document for what counts as an
earlier document, and each loses by its own text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.jaccard_join import mixed
from storegrain.llm.shared_hashes import Owned, bucket_count, shared_hashes, token_names
from storegrain.workspace import stage

SEED = 24
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
NEVER = np.iinfo(np.int64).max


# Names of strings.


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from each position as one number (zeros after the end), first byte highest."""
    padded = data + b"\0" * 16
    out = np.empty(len(data), np.uint64)
    for at in range(min(8, len(data))):
        part = out[at::8]
        part[:] = np.frombuffer(padded, ">u8", count=len(part), offset=at)
    return out


def least_hashes(data: bytes, length: int) -> np.ndarray:
    """For each position the least hash of the seeds inside the string of ``length`` that starts there."""
    words = words_at(data + b"\0" * SEED)
    n = len(data) - SEED + 1
    hashes = (
        words[:n] * np.uint64(0x9E3779B97F4A7C15)
        + words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        + words[16 : n + 16] * np.uint64(0x165667B19E3779F9)
    )
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    width, reach = length - SEED + 1, 1
    while 2 * reach <= width:
        hashes = np.minimum(hashes[:-reach], hashes[reach:])
        reach *= 2
    return np.minimum(hashes[: len(hashes) - (width - reach)], hashes[width - reach :])


def named_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one name: text number, first start, number of starts, name.

    Texts are worked on joined; strings that reach into the next text are left out.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = b"".join(texts)
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    names = least_hashes(data, length)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(names)]
    valid = np.arange(len(names)) + length <= ends[text]
    change = np.empty(len(names), bool)
    change[0] = True
    change[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(names)))
    starts, counts = starts[valid[starts]], counts[valid[starts]]
    number = text[starts]
    return number, starts - (ends - sizes)[number], counts, mixed(names[starts])


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8 in lists of about ``CHUNK_BYTES``, each with its first row."""
    texts, size, first = [], 0, 0
    for row, text in enumerate(batch.column(column)):
        texts.append((text.as_py() or "").encode())
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield first, texts
            texts, size, first = [], 0, row + 1
    if texts:
        yield first, texts


# Suffix arrays of a block.


def suffix_array(data: bytes) -> np.ndarray:
    """Positions in the order of their suffixes, by Larsson-Sadakane refinement.

    Sorted by eight bytes first; then groups that are still equal are sorted by
    the rank of what follows, which doubles the depth each time.
    """
    n = len(data)
    words = words_at(data)
    order = np.argsort(words, kind="stable")
    if n < 2:
        return order
    # Zeros after the end are no text: of equal words, the shorter suffix comes first.
    short = np.arange(n) + 8 > n
    tail = np.flatnonzero(np.isin(words[order], words[short]))
    order[tail] = order[tail][np.lexsort((np.where(short, -np.arange(n), 0)[order[tail]], words[order[tail]]))]
    new = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    new |= short[order]
    new[1:] |= short[order[:-1]]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    depth = 8
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        follow = rank[np.minimum(at + depth, n)]
        key = rank[at] * (n + 1) + follow + 1
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        key = key[by]
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        new[tied] = differs
        rank[order[tied]] = tied[np.flatnonzero(differs)][np.cumsum(differs) - 1]
        depth *= 2


def common_prefixes(data: bytes, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before it.

    Kasai's observation in text order: where the bytes before both suffixes agree,
    the value is that of the position before less one. The other positions are
    compared directly, eight bytes at a time, all of them at once.
    """
    n = len(data)
    text = np.frombuffer(data, np.uint8)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    back = before > 0
    back[0] = False
    back[order[0]] = False
    at = np.flatnonzero(back)
    follows = np.zeros(n, bool)
    follows[at] = text[at - 1] == text[before[at] - 1]
    heads = np.flatnonzero(~follows)
    words = np.append(words_at(data), np.zeros(1, np.uint64))
    length = np.zeros(len(heads), np.int64)
    active = np.flatnonzero(before[heads] < n)
    while len(active):
        a, b = heads[active] + length[active], before[heads[active]] + length[active]
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = np.where(differ == 0, 8, (63 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64)))).astype(np.int64) // 8)
        room = n - np.maximum(a, b)
        length[active] += np.minimum(np.maximum(same, 0), room)
        active = active[(differ == 0) & (room > 8)]
    head_of = np.cumsum(~follows) - 1
    plcp = length[head_of] - (np.arange(n) - heads[head_of])
    return np.maximum(plcp, 0)[order]


def least_owner(data: bytes, length: int, valid: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least owner of the string of ``length`` bytes at each valid position of a block.

    Returns it by position (``NEVER`` where not valid), then one position and the
    least owner of each distinct string in suffix order, and by position the
    number of its string there (-1 where not valid).
    """
    order = suffix_array(data)
    prefix = common_prefixes(data, order)
    order, new = order[valid[order]], _starts_among(prefix, valid[order], length)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first) if len(first) else np.empty(0, np.int64)
    out, string = np.full(len(data), NEVER), np.full(len(data), -1)
    string[order] = np.cumsum(new) - 1
    out[order] = least[string[order]]
    return out, order[first], least, string


def _starts_among(prefix: np.ndarray, kept: np.ndarray, length: int) -> np.ndarray:
    """Where a new string begins among the kept suffixes."""
    string = np.cumsum(prefix < length)[kept]
    return np.concatenate([[True], string[1:] != string[:-1]]) if len(string) else np.empty(0, bool)


def merge_blocks(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Least owner over all blocks for the sorted distinct strings (fixed-size bytes) of each.

    The strings of every block are looked up in each other block by binary search.
    """
    merged = []
    for number, (strings, least) in enumerate(blocks):
        least = least.copy()
        for other, (others, theirs) in enumerate(blocks):
            if other != number and len(others):
                place = np.minimum(np.searchsorted(others, strings), len(others) - 1)
                hit = others[place] == strings
                least[hit] = np.minimum(least[hit], theirs[place[hit]])
        merged.append(least)
    return merged


def _strings(data: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """The strings at the given positions, comparable byte by byte (a byte above all text ends each)."""
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[at]
    ended = np.concatenate([view, np.full((len(at), 1), 255, np.uint8)], axis=1)
    return np.ascontiguousarray(ended).view(f"S{length + 1}").reshape(-1)


def covered_starts(pieces: list[bytes], owners: np.ndarray, length: int, block_bytes: int = BLOCK_BYTES) -> list[np.ndarray]:
    """For each distinct piece the least owner of the string at each of its starts."""
    blocks, at = [], 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end]) <= block_bytes):
            size += len(pieces[end])
            end += 1
        data = b"".join(pieces[at:end])
        sizes = np.array([len(p) for p in pieces[at:end]])
        ends = np.repeat(np.cumsum(sizes), sizes)
        valid = np.arange(len(data)) + length <= ends
        out, firsts, least, string = least_owner(data, length, valid, np.repeat(owners[at:end], sizes))
        blocks.append((data, sizes, out, firsts, least, string))
        at = end
    if len(blocks) > 1:
        tables = [(_strings(data, firsts, length), least) for data, _, _, firsts, least, _ in blocks]
        for block, better in zip(blocks, merge_blocks(tables), strict=True):
            _, _, out, _, _, string = block
            starts = string >= 0
            out[starts] = better[string[starts]]
    found = []
    for _, sizes, out, *_ in blocks:
        found += np.split(out, np.cumsum(sizes)[:-1])
    return [least[: max(0, len(piece) - length + 1)] for least, piece in zip(found, pieces, strict=True)]


# Shards.

PIECES = "shard int, pieces binary, lengths binary, counts binary, rows binary, docs binary, starts binary"
SPANS = "shard int, rows binary, lows binary, highs binary"


def _packed_pieces(texts, keys, docs, numbers, starts, counts, shards, length) -> pa.RecordBatch:
    """One row a shard: its distinct stretches (compressed), and for each where it lies."""
    rows = []
    order = np.argsort(shards, kind="stable")
    bounds = np.flatnonzero(np.diff(shards[order], prepend=-1, append=-1))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        places: dict[bytes, list[int]] = {}
        for at in order[low:high].tolist():
            start = int(starts[at])
            piece = texts[numbers[at]][start : start + int(counts[at]) + length - 1]
            places.setdefault(piece, []).append(at)
        at = np.array([a for found in places.values() for a in found])
        rows.append((
            int(shards[order[low]]),
            zstandard.compress(b"".join(places), 1),
            np.array([len(p) for p in places], np.int32).tobytes(),
            np.array([len(a) for a in places.values()], np.int32).tobytes(),
            keys[numbers[at]].tobytes(),
            docs[numbers[at]].tobytes(),
            starts[at].astype(np.int32).tobytes(),
        ))
    kinds = [pa.int32(), *[pa.binary()] * 6]
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _taken_runs(least: list[np.ndarray], number: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """For places of stretches (``number``) in documents: place, first and last start of each run that a smaller id has.

    Which starts are taken depends only on how many of a stretch's owners are below
    the document, so runs are found once for each stretch and such number, and not
    start by start for each place.
    """
    sizes = np.array([len(x) for x in least], np.int64)
    offsets = np.cumsum(sizes) - sizes
    flat = np.concatenate(least)
    values, rank = np.unique(flat, return_inverse=True)
    width = len(values) + 1
    owners = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + rank)
    first = np.searchsorted(owners, np.arange(len(sizes)) * width)
    at = np.searchsorted(owners, number * width + np.searchsorted(values, docs))
    below = at - first[number]
    hit = np.flatnonzero(below)
    if not len(hit):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    case, of = np.unique(number[hit] * (int(below.max()) + 1) + below[hit], return_inverse=True)
    example = hit[np.unique(of, return_index=True)[1]]
    piece, most = number[example], values[owners[at[example] - 1] % width]
    reps = sizes[piece]
    inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    taken = np.flatnonzero(flat[np.repeat(offsets[piece], reps) + inside] <= np.repeat(most, reps))
    begin, begin_case = inside[taken], np.repeat(np.arange(len(case)), reps)[taken]
    new = np.concatenate([[True], (begin_case[1:] != begin_case[:-1]) | (begin[1:] != begin[:-1] + 1)])
    low = np.flatnonzero(new)
    last = np.append(low[1:], len(begin)) - 1
    low, high, run_case = begin[low], begin[last], begin_case[low]
    # Each place gets the runs of its case.
    n_runs = np.bincount(run_case, minlength=len(case))
    start = np.cumsum(n_runs) - n_runs
    count = n_runs[of]
    run = np.repeat(start[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(hit, count), low[run], high[run]


def _shard_spans(table: pa.Table, length: int, n_shards: int) -> pa.Table:
    """What the strings of a shard cover, packed by part of the rows."""
    text = b"".join(zstandard.decompress(piece) for piece in table.column("pieces").to_pylist())
    lengths = _joined(table, "lengths", np.int32)
    counts, rows = _joined(table, "counts", np.int32), _joined(table, "rows", np.int64)
    docs, starts = _joined(table, "docs", np.int64), _joined(table, "starts", np.int32).astype(np.int64)
    ends = np.cumsum(lengths, dtype=np.int64)
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(text[e - n : e], len(known)) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], np.int64)
    number = np.repeat(number, counts)
    first = np.full(len(known), NEVER)
    np.minimum.at(first, number, docs)
    least = covered_starts(list(known), first, length)
    place, low, high = _taken_runs(least, number, docs)
    if not len(place):
        return pa.Table.from_batches([], schema=_SPAN_SCHEMA)
    low, high = low + starts[place], high + starts[place] + length
    owner = rows[place]
    parts = (owner.view(np.uint64) >> np.uint64(33)).astype(np.int64) % n_shards
    order = np.argsort(parts, kind="stable")
    bounds = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
    made = [
        (int(parts[order[a]]), owner[order[a:b]].tobytes(), low[order[a:b]].tobytes(), high[order[a:b]].tobytes())
        for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _SPAN_SCHEMA, strict=True)], schema=_SPAN_SCHEMA)


_SPAN_SCHEMA = pa.schema([("shard", pa.int32()), ("rows", pa.binary()), ("lows", pa.binary()), ("highs", pa.binary())])
MERGED = "row bigint, lows array<bigint>, highs array<bigint>"
_MERGED_SCHEMA = pa.schema([("row", pa.int64()), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64()))])


def _merged_spans(table: pa.Table) -> pa.Table:
    """Spans of each row, in order and joined where they touch."""
    rows, low, high = (_joined(table, c, np.int64) for c in ("rows", "lows", "highs"))
    order = np.lexsort((high, low, rows))
    rows, low, high = rows[order], low[order], high[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    base = np.cumsum(first) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + base)
    new = first.copy()
    new[1:] |= low[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    ends = (reach - base)[np.append(at[1:], len(rows)) - 1]
    row_at = np.flatnonzero(first[at])
    offsets = pa.array(np.append(row_at, len(at)).astype(np.int32))
    return pa.Table.from_arrays(
        [pa.array(rows[at][row_at]), pa.ListArray.from_arrays(offsets, pa.array(low[at])),
         pa.ListArray.from_arrays(offsets, pa.array(ends))],
        schema=_MERGED_SCHEMA,
    )


def repeated_spans(texts: DataFrame, length: int = 50) -> DataFrame:
    """``row, lows, highs`` of rows (``row, doc_id, text``) that lose something."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def owned_of(batch: pa.RecordBatch) -> Iterator[Owned]:
        rows = batch.column(0).to_numpy()
        for first, chunk in _chunks(batch, 1):
            number, _, _, names = named_runs(chunk, length)
            cuts = np.searchsorted(number, np.arange(1, len(chunk)))
            for at, own in enumerate(np.split(names, cuts)):
                yield int(rows[first + at]), len(own), np.unique(own)

    n_names = n_bytes * 2 // (length - SEED + 2)
    n_buckets = bucket_count(n_names)
    shared = stage(shared_hashes(texts.select("row", "text"), owned_of, n_names), "shared-names")
    n_shared = shared.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n_shards = max(1, -(-n_shared * (2 * length) // SHARD_BYTES))

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            tokens, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for first, chunk in _chunks(batch, 2):
                number, starts, counts, names = named_runs(chunk, length)
                named = token_names(names, n_buckets)
                cuts = np.searchsorted(number, np.arange(len(chunk) + 1))
                kept = np.zeros(len(named), bool)
                for at in range(len(chunk)):
                    own = slice(cuts[at], cuts[at + 1])
                    kept[own] = np.isin(named[own], tokens[offsets[first + at] : offsets[first + at + 1]])
                if kept.any():
                    shards = (mixed(named[kept].view(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
                    ids = slice(first, first + len(chunk))
                    yield _packed_pieces(chunk, rows[ids], docs[ids], number[kept], starts[kept], counts[kept], shards, length)

    met = texts.join(shared.select(F.col("owner").alias("row"), "tokens"), "row").select("row", "doc_id", "text", "tokens")
    packed = met.mapInArrow(pieces, PIECES)
    spans = packed.groupBy("shard").applyInArrow(lambda table: _shard_spans(table, length, n_shards), SPANS)
    return spans.groupBy("shard").applyInArrow(_merged_spans, MERGED)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "lows", "highs", "kept_bytes"]
    for batch in batches:
        done = 0
        for first, chunk in _chunks(batch, 1):
            kept, removed = [], []
            for at, text in enumerate(chunk):
                lows, highs = (batch.column(c)[first + at].as_py() or [] for c in (2, 3))
                edges = zip([0, *highs], [*lows, len(text)], strict=True)
                kept.append(b"".join(text[a:b] for a, b in edges))
                removed.append(len(text) - len(kept[-1]))
            part = batch.slice(done, len(chunk))
            done += len(chunk)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, chunk), pa.int64()), pa.array(removed, pa.int64()),
                 part.column(2), part.column(3), pa.array(kept, pa.binary())],
                names=names,
            )


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, lows, highs, kept_bytes`` of each row.

    ``lows`` and ``highs`` bound the removed runs in bytes; they are null where
    nothing goes. What is kept of a text may end inside a character, hence bytes.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    spans = stage(repeated_spans(texts.where("doc_id IS NOT NULL"), length), "repeat-spans")
    return texts.join(spans, "row", "left").select("doc_id", "text", "lows", "highs").mapInArrow(
        _cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, lows array<bigint>, highs array<bigint>, kept_bytes binary",
    )
