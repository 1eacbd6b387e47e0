"""WARC archives of pages, with a two-level capture index.

* Pages with equal payloads are one response and revisits of it. Which one, is
  decided over digests alone, so no payload is shuffled.
* Tasks write archives of records that are compressed apart, and one capture row a
  record: where it lies, under which key. A key is the URL with its host reversed,
  so captures of a host lie together.
* Capture rows are sorted by range of keys into shards. A shard is a file of
  compressed blocks of lines, and beside it a sparse directory with the first key
  and place of each block. A small table has the range of each shard.
* A look-up goes the other way: wanted keys go to the shards whose range holds
  them, binary search of the directory finds the blocks and binary search of a
  block the lines; only those blocks, and then only those records, are read, as
  ranges of bytes.

Files are written by tasks under names of their own, and only those of tasks that
ended well are listed, so a lost executor leaves nothing but unlisted files.

Defined results: a null payload is empty; a null URL is an empty one; a null page
id comes before all others, and of equal ids the last URL is the response; equal
rows are one response and revisits of it; an empty table gives no file and an
empty index. Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.workspace import new_folder, stage

# Fixed values of the published WARC format, version 1.1.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 1000
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
CHUNK_BYTES = 64 << 20
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
GZIP = 31  # window bits of zlib for a gzip member
BLANKS = "\t\n\r "  # written as %XX in keys and headers, where they would end a field or line


def url_key(url: Column) -> Column:
    """Reversed host, ``)`` and the rest of a URL, without scheme, user, usual port, ``www`` and fragment."""
    bare = F.coalesce(url, F.lit(""))
    for sign in BLANKS:
        bare = F.replace(bare, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    bare = F.regexp_replace(bare, r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    site = F.regexp_extract(bare, r"^[^/?]*", 0)
    rest = F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1)
    host = F.lower(F.regexp_replace(site, r"^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


# What is a response and what a revisit.


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest`` of each row with ``original`` (is a response) and what a revisit repeats.

    ``digest`` is the payload's SHA-1 in hex. Of payloads of ``least_bytes`` or more,
    the row with the largest ``(page_id, url)`` of each digest is the original.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    same = keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("rows"))
    top = same.groupBy("digest").agg(F.max(F.struct("page_id", "url", "rows")).alias("top"), F.sum("rows").alias("rows"))
    top = stage(top.where("rows > 1").select(
        F.col("digest").alias("of"), F.col("top.page_id").alias("first_id"), F.col("top.url").alias("first_url"), F.col("top.rows").alias("tied")
    ), "repeated-payloads")
    is_top = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("url") == F.col("first_url"))
    known = keyed.join(top, keyed["digest"] == F.col("of"), "left").withColumn("is_top", F.col("of").isNull() | is_top)
    columns = ["page_id", "url", "html", "digest", "first_id", "first_url", "original"]
    plain = known.where(~F.col("is_top") | (F.coalesce("tied", F.lit(1)) == 1)).withColumn("original", F.col("is_top")).select(*columns)
    ties = stage(top.where("tied > 1"), "tied-originals")
    if ties.isEmpty():
        return plain
    # Equal rows: one of them, by its number in the written table, is the original.
    tied = keyed.join(ties.drop("tied"), (keyed["digest"] == F.col("of")) & is_top)
    tied = stage(tied.withColumn("row", F.monotonically_increasing_id()), "tied-rows")
    chosen = tied.groupBy("of").agg(F.min("row").alias("row")).withColumn("original", F.lit(True))
    tied = tied.join(chosen, ["of", "row"], "left").withColumn("original", F.coalesce("original", F.lit(False)))
    return plain.unionByName(tied.select(*columns))


# Records.


def digest_text(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(*parts) -> str:
    name = hashlib.sha1("\n".join(map(str, parts)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def original_id(digest: str, page_id, url: str) -> str:
    return _record_id("response", digest, page_id, url)


def _header(name: str, value) -> bytes:
    return f"{name}: {value}\r\n".encode()


def _uri(url: str) -> str:
    for sign in BLANKS:
        url = url.replace(sign, f"%{ord(sign):02X}")
    return url


def make_record(headers: list[tuple[str, object]], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member."""
    lines = b"".join(_header(n, v) for n, v in headers)
    whole = b"".join((VERSION, b"\r\n", lines, _header("Content-Length", len(block)), b"\r\n", block, b"\r\n\r\n"))
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(whole) + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    whole = zlib.decompress(packed, GZIP)
    end = whole.find(b"\r\n\r\n")
    lines = whole[:end].split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode().lower()] = value.removeprefix(b" ").decode()
    size = int(headers["content-length"])
    block = whole[end + 4 : end + 4 + size]
    if len(block) != size or whole[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, block


def _page_record(date: str, name: str, page_id, url: str, html: bytes, digest: str, first_id, first_url, original: bool) -> bytes:
    """A response or revisit record; ``name`` tells records of equal pages apart."""
    payload = html if original else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _header("Content-Length", len(html)) + b"\r\n" + payload
    headers = [
        ("WARC-Type", "response" if original else "revisit"),
        ("WARC-Record-ID", original_id(digest, page_id, url) if original else _record_id("revisit", name)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("Content-Type", HTTP_RESPONSE),
        ("WARC-Payload-Digest", f"sha1:{digest_text(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
    ]
    if not original:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", original_id(digest, first_id, first_url)),
            ("WARC-Refers-To-Target-URI", _uri(first_url)),
            ("WARC-Refers-To-Date", date),
        ]
    return make_record(headers, block)


class ArchiveWriter:
    """Appends records to archives of bounded size, each beginning with a ``warcinfo`` record."""

    def __init__(self, folder: str, part: int, date: str, archive_bytes: int):
        self.system, self.path = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(self.path, recursive=True)
        self.part, self.date, self.archive_bytes = part, date, archive_bytes
        self.out = None

    def append(self, record: bytes) -> tuple[str, int, int]:
        """File, offset and length of the record."""
        if self.out is not None and self.at + len(record) > self.archive_bytes:
            self.close()
        if self.out is None:
            self.name = f"pages-{self.part:06d}-{uuid.uuid4().hex}.warc.gz"
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
            about = make_record([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("warcinfo", self.name)), ("WARC-Date", self.date),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
            ], b"software: storegrain\r\nformat: WARC File Format 1.1\r\n")
            self.out.write(about)
            self.at = len(about)
        self.out.write(record)
        place = (self.name, self.at, len(record))
        self.at += len(record)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


CAPTURE = ("key", "stamp", "page_id", "record_type", "digest", "file", "offset", "length")
#: Types of these in a shard, where the page id is JSON text.
LINE = "key string, stamp string, page_id string, record_type string, digest string, file string, offset bigint, length bigint"


def write_archives(
    pages: DataFrame,
    folder: str,
    captured: str | None = None,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record for each row and return the capture rows (``CAPTURE``, a written table).

    ``captured`` is the date of the records, as ``2024-05-01T00:00:00Z``; the present time if not given.
    """
    date = captured or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    stamp = "".join(c for c in date if c.isdigit())[:14]
    ready = with_originals(picked, least_bytes).withColumn("key", url_key(F.col("url")))

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer, run, number = ArchiveWriter(folder, part, date, archive_bytes), uuid.uuid4().hex, 0
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            html = column["html"].cast(pa.binary())
            plain = [column[n].to_pylist() for n in ("page_id", "url", "digest", "first_id", "first_url", "original")]
            places, kinds = [], []
            for k, (page_id, url, digest, first_id, first_url, original) in enumerate(zip(*plain, strict=True)):
                number += 1
                record = _page_record(date, f"{run}-{number}", page_id, url, html[k].as_py(), digest, first_id, first_url, original)
                places.append(writer.append(record))
                kinds.append("response" if original else "revisit")
            if places:
                files, offsets, lengths = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        column["key"], pa.array([stamp] * len(kinds)), column["page_id"], pa.array(kinds),
                        pa.array(list(map(digest_text, plain[2]))), pa.array(files),
                        pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                    ],
                    names=list(CAPTURE),
                )
        writer.close()

    kind = dict(picked.dtypes)["page_id"]
    rows = ready.mapInArrow(written, LINE.replace("page_id string", f"page_id {kind}"))
    return stage(rows, "captures")


# The index.


@dataclass
class CaptureIndex:
    """Shards of sorted capture lines. ``shards`` has a row a shard: its file and first and last key."""

    folder: str
    shards: DataFrame
    archives: str
    id_type: str


SHARD = "file string, first_key string, last_key string, n_blocks bigint, n_lines bigint"


def _open_output(folder: str, name: str):
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def write_index(captures: DataFrame, archives: str, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort capture rows by key, date and page into shards of compressed blocks with their directories."""
    kind = dict(captures.dtypes)["page_id"]
    order = ["key", "stamp", "page_id", "file", "offset"]
    ordered = captures.select(*CAPTURE).repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0
        directory: list[bytes] = []
        waiting: list[bytes] = []
        n_lines, first, last = 0, None, None

        def flush() -> None:
            nonlocal at, waiting
            packed = zlib.compress(b"\n".join(waiting), 6)
            out.write(packed)
            directory.append(b"%s\t%d\t%d" % (waiting[0].split(b"\t", 1)[0], at, len(packed)))
            at, waiting = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = _open_output(folder, f"{name}.blocks"), row[0]
                waiting.append("\t".join((*row[:2], json.dumps(row[2]), *row[3:6], str(row[6]), str(row[7]))).encode())
                n_lines, last = n_lines + 1, row[0]
                if len(waiting) >= block_lines:
                    flush()
        if out is None:
            return
        if waiting:
            flush()
        out.close()
        with _open_output(folder, f"{name}.directory") as beside:
            beside.write(b"\n".join(directory))
        yield pa.RecordBatch.from_pylist(
            [{"file": name, "first_key": first, "last_key": last, "n_blocks": len(directory), "n_lines": n_lines}]
        )

    safe = [F.col(c).cast("string").alias(c) if c == "page_id" else F.col(c) for c in CAPTURE]
    shards = stage(ordered.select(*safe).mapInArrow(blocks, SHARD), "index-shards")
    return CaptureIndex(folder, shards, archives, kind)


class ShardReader:
    """Looks keys up in one shard: binary search of the directory, then of the blocks it names."""

    def __init__(self, folder: str, name: str):
        system, path = pafs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{path}/{name}.directory", compression=None) as source:
            entries = [line.split(b"\t") for line in source.read().split(b"\n")]
        self.first_keys = [e[0] for e in entries]
        self.places = [(int(e[1]), int(e[2])) for e in entries]
        self.source = system.open_input_file(f"{path}/{name}.blocks")
        self.unpacked = 0
        self._block: tuple[int, list[bytes], list[bytes]] = (-1, [], [])

    def block(self, number: int) -> tuple[list[bytes], list[bytes]]:
        """Keys and lines of a block; the last one is remembered."""
        if self._block[0] != number:
            at, length = self.places[number]
            self.source.seek(at)
            lines = zlib.decompress(self.source.read(length)).split(b"\n")
            self._block = (number, [line.split(b"\t", 1)[0] for line in lines], lines)
            self.unpacked += 1
        return self._block[1:]

    def lines(self, key: bytes) -> Iterator[bytes]:
        """Lines of a key; the block before the first that starts with it may end with it."""
        number = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while number < len(self.first_keys) and self.first_keys[number] <= key:
            keys, lines = self.block(number)
            yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            number += 1


def _line_batch(lines: list[bytes]) -> pa.RecordBatch:
    columns = list(zip(*(line.decode().split("\t") for line in lines), strict=True))
    columns[2] = list(map(json.loads, columns[2]))
    made = [pa.array(c, pa.string()) for c in columns[:6]] + [pa.array(map(int, c), pa.int64()) for c in columns[6:]]
    return pa.RecordBatch.from_arrays(made, names=list(CAPTURE))


def find_captures(index: CaptureIndex, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures (``CAPTURE``) of all keys that the URLs have, each capture once.

    The ranges of the shards, one a partition of the index, go to each task;
    directories and blocks are opened where they are searched.
    """
    ranges = sorted(tuple(r) for r in index.shards.select("first_key", "last_key", "file").collect())
    firsts = [r[0].encode() for r in ranges]
    lasts = [r[1].encode() for r in ranges]
    folder = index.folder

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, files = [], []
            for key in batch.column(0).to_pylist():
                data = key.encode()
                for shard in range(bisect.bisect_left(lasts, data), bisect.bisect_right(firsts, data)):
                    keys.append(key)
                    files.append(ranges[shard][2])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string())], names=["key", "shard"])

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened, found = None, None, []
        for batch in batches:
            for key, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != opened:
                    reader, opened = ShardReader(folder, shard), shard
                for line in reader.lines(key.encode()):
                    found.append(line)
                    if len(found) >= BATCH_ROWS:
                        yield _line_batch(found)
                        found = []
        if found:
            yield _line_batch(found)

    keys = urls.select(url_key(F.col(url_col)).alias("key")).distinct()
    by_shard = keys.mapInArrow(routed, "key string, shard string").repartition("shard").sortWithinPartitions("shard", "key")
    found = by_shard.mapInArrow(searched, LINE)
    return found.withColumn("page_id", F.col("page_id").cast(index.id_type))


RECORD = "record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, refers_to_uri string"


def _read_ranges(system, path: str, places: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes at each ``(file, offset, length)``, in that order; what lies near is read at once."""
    source, opened, at = None, None, 0
    while at < len(places):
        file, start, length = places[at]
        end, till = at + 1, start + length
        while end < len(places):
            other, low, size = places[end]
            if other != file or low - till > GAP_BYTES or low + size - start > READ_BYTES:
                break
            end, till = end + 1, low + size
        if file != opened:
            source, opened = system.open_input_file(f"{path}/{file}"), file
        source.seek(start)
        data = memoryview(source.read(till - start))
        for _, low, size in places[at:end]:
            yield bytes(data[low - start : low - start + size])
        at = end


def _read_record(packed: bytes) -> tuple[tuple, bytes | None]:
    """The values of ``RECORD`` of a record, and the payload of a response; a damaged record raises."""
    headers, block = parse_record(packed)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if headers["warc-type"] == "response":
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    values = (
        headers["warc-record-id"], headers["warc-target-uri"], digest, None if payload is None else len(payload),
        headers.get("warc-refers-to"), headers.get("warc-refers-to-target-uri"),
    )
    return values, payload


def read_records(index: CaptureIndex, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The captures with ``RECORD``, read from the archives, and ``payload`` (null for revisits) if wanted.

    Captures of one stretch of an archive are read by one task in the order they lie.
    """
    folder, names = index.archives, [c for c in captures.columns if c not in ("file", "offset", "length")]
    kinds = dict(captures.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {RECORD}" + (", payload binary" if with_payload else "")
    chunk = F.expr(f"offset div {CHUNK_BYTES}")
    ordered = captures.select(*names, "file", "offset", "length").repartition("file", chunk).sortWithinPartitions("file", "offset")

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True))
            values, payloads, size, done = [], [], 0, 0
            for k, packed in enumerate(_read_ranges(system, path, places), 1):
                own, payload = _read_record(packed)
                values.append(own)
                payloads.append(payload if with_payload else None)
                size += len(payloads[-1] or b"")
                if size >= BATCH_BYTES or k == len(places):
                    yield _records(batch.slice(done, k - done), values, payloads if with_payload else None)
                    values, payloads, size, done = [], [], 0, k

    return ordered.mapInArrow(records, ddl)


def _records(captures: pa.RecordBatch, values: list[tuple], payloads: list | None) -> pa.RecordBatch:
    """Captures (without place) with what was read of them."""
    made = [
        pa.array(column, pa.int64() if kind == "bigint" else pa.string())
        for column, (_, kind) in zip(zip(*values, strict=True), map(str.split, RECORD.split(", ")), strict=True)
    ]
    names = [*captures.schema.names[:-3], *(c.split()[0] for c in RECORD.split(", "))]
    if payloads is not None:
        made, names = [*made, pa.array(payloads, pa.binary())], [*names, "payload"]
    return pa.RecordBatch.from_arrays([*captures.columns[:-3], *made], names=names)


def resolve_revisits(index: CaptureIndex, records: DataFrame) -> DataFrame:
    """``records`` (a written table) with ``original_page``, and the payload's size where it lies with the original.

    Each original is looked up and read once, whatever the number of its revisits.
    """
    revisits = records.where("record_type = 'revisit'")
    wanted = stage(revisits.select("refers_to", "refers_to_uri").distinct(), "revisited")
    found = stage(find_captures(index, wanted, "refers_to_uri").where("record_type = 'response'"), "revisited-captures")
    originals = read_records(index, found, with_payload=False).select(
        F.col("record_id").alias("of"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"),
        F.col("payload_digest").alias("original_digest"),
    )
    originals = stage(originals.join(wanted.select("refers_to").distinct(), F.col("of") == F.col("refers_to"), "left_semi"), "originals")
    joined = revisits.join(originals, F.col("refers_to") == F.col("of"), "left")
    whole = F.coalesce("original_bytes", F.raise_error(F.concat(F.lit("no original "), F.col("refers_to"))))
    resolved = joined.withColumn("payload_bytes", whole.cast("bigint")).drop("of", "original_bytes", "original_digest")
    plain = records.where("record_type = 'response'").withColumn("original_page", F.lit(None).cast(index.id_type))
    return plain.unionByName(resolved)


def archive(pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES, **options) -> CaptureIndex:
    """Write archives and index of all pages below ``folder``, which all executors reach."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archives", **options)
    return write_index(captures, f"{folder}/archives", f"{folder}/index", block_lines)
