"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of its documents, one after the other, as little-endian
unsigned 32-bit integers, cut into frames that are compressed apart. After the
frames comes a skippable frame with compressed size, size and checksum of each
(the published seekable layout), so a reader finds and unpacks only the frames
that a wanted document touches, and plain zstandard tools read the file whole.

Files are written by tasks under names of their own; the index lists those of
tasks that ended well, so a lost executor leaves nothing but an unlisted file.

Defined results: a null text counts as empty and gets the end id alone; rows
without id come first; rows with one id are ordered by the hash of their text; an
empty table gives an empty index and no file.
"""

from __future__ import annotations

import struct
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storegrain.llm.memos import only
from storegrain.llm.token_counts import PieceMemo
from storegrain.workspace import new_folder, stage

# Fixed values of the published seekable zstandard layout.
SEEK_FRAME = 0x184D2A5E
SEEK_END = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

ID_BYTES = 4
FRAME_BYTES = 1 << 18
BATCH_BYTES = 4 << 20


class PieceIds(PieceMemo):
    """Ids of each piece as bytes."""

    joined = staticmethod(b"".join)

    def special_value(self, number: int) -> bytes:
        return struct.pack("<I", number)

    def word_value(self, word: str) -> bytes:
        ids = array("I", [token.id for token in self.model.tokenize(self.spelled(word))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def _ids(path: str) -> PieceIds:
    return only(("piece-ids", path), lambda: PieceIds(path))


class FrameWriter:
    """Cuts a stream of bytes into frames and ends it with the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out = out
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending = bytearray()
        self.table: list[tuple[int, int, int]] = []

    def write(self, data: bytes) -> None:
        self.pending += data
        while len(self.pending) >= self.frame_bytes:
            self._frame(bytes(self.pending[: self.frame_bytes]))
            del self.pending[: self.frame_bytes]

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class FrameReader:
    """Reads stretches of the unpacked bytes; unpacks and checks only the frames they touch."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n_frames, flags, mark = struct.unpack("<IBI", self._read(end - 9, 9))
        if mark != SEEK_END or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = self._read(end - 9 - 12 * n_frames, 12 * n_frames)
        self.frames, at, start = [], 0, 0
        for packed, size, check in struct.iter_unpack("<III", table):
            self.frames.append((at, packed, start, size, check))
            at, start = at + packed, start + size
        self.size = start
        self.starts = array("Q", [frame[2] for frame in self.frames])
        self.unpacked = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _frame(self, number: int) -> bytes:
        if self._last[0] != number:
            at, packed, _, size, check = self.frames[number]
            data = zstandard.ZstdDecompressor().decompress(self._read(at, packed), size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {number} is damaged")
            self._last = (number, data)
            self.unpacked += 1
        return self._last[1]

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError("stretch outside the file")
        low, high = 0, len(self.frames)
        while high - low > 1:  # the last frame that starts at or before
            middle = (low + high) // 2
            low, high = (middle, high) if self.starts[middle] <= start else (low, middle)
        parts, got = [], 0
        while got < length:
            skip = start + got - self.starts[low]
            part = self._frame(low)[skip : skip + length - got]
            parts.append(part)
            got, low = got + len(part), low + 1
        return b"".join(parts)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Write the ids of all documents, in ascending order of their ids, and return the index.

    One file for each range of document ids; the index (written too) has
    ``doc_id, file, file_no, first, n_tokens`` with ``first`` counted in ids from
    the start of the file. ``folder`` is one all executors reach.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = picked.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = _ids(tokenizer_path), struct.pack("<I", end_id)
        writer, first, number = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            firsts, counts = array("q"), array("q")
            for text in batch.column(1):
                if writer is None:
                    system, path = pafs.FileSystem.from_uri(folder)
                    system.create_dir(path, recursive=True)
                    name = f"tokens-{number:06d}-{uuid.uuid4().hex}.zst"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    writer = FrameWriter(out, frame_bytes)
                ids = memo.of_text(text.as_py() or "") + end
                writer.write(ids)
                firsts.append(first)
                counts.append(len(ids) // ID_BYTES)
                first += counts[-1]
            if firsts:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([f"{folder}/{name}"] * len(firsts)),
                        pa.array([number] * len(firsts), pa.int64()),
                        pa.array(firsts, pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["doc_id", "file", "file_no", "first", "n_tokens"],
                )
        if writer:
            writer.close()

    kind = dict(picked.dtypes)["doc_id"]
    index = ordered.mapInArrow(
        written, f"doc_id {kind}, file string, file_no bigint, first bigint, n_tokens bigint"
    )
    return stage(index, "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before, over all files.

    The running sum is over one row a file, never over documents.
    """
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("ids")).select(
        "file_no", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before")
    )
    return index.join(files, "file_no").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, opened = None, None
    for batch in batches:
        names = batch.schema.names
        wanted = zip(*(batch.column(names.index(n)).to_pylist() for n in ("file", "first", "n_tokens")), strict=True)
        made, size, done = [], 0, 0
        for file, first, count in wanted:
            if file != opened:
                system, path = pafs.FileSystem.from_uri(file)
                reader, opened = FrameReader(system.open_input_file(path)), file
            made.append(reader.read(first * ID_BYTES, count * ID_BYTES))
            size += len(made[-1])
            if size >= BATCH_BYTES:
                yield _with_ids(batch.slice(done, len(made)), made)
                made, size, done = [], 0, done + len(made)
        if made:
            yield _with_ids(batch.slice(done, len(made)), made)


def _with_ids(batch: pa.RecordBatch, made: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "ids"]
    )


def read_token_files(index: DataFrame) -> DataFrame:
    """The rows of an index (all, or those wanted) with ``ids``, read from the files."""
    columns = ", ".join(f"`{name}` {kind}" for name, kind in index.dtypes)
    return index.mapInArrow(_stretches, f"{columns}, ids binary")
