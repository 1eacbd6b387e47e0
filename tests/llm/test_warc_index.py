"""Archives and their index against plain rules, and single shards against plain search."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storegrain.llm import warc_index

SCHEMA = "page_id long, url string, html string, digest string, file string, rows int"


def page_rows() -> list[tuple]:
    """Copies of a third of all, ties, repeated rows, odd URLs, nulls, long and empty pages."""
    chosen = random.Random(3)
    hosts = ["www.one.example.com", "two.example.org:8080", "ONE.example.com", "user@three.example.net:443", "hot.example.com"]
    made = []
    for k in range(150):
        host = "hot.example.com" if k % 3 == 0 else chosen.choice(hosts)
        path = "/same" if k % 3 == 0 else f"/p{chosen.randint(0, 60)}?q=a b#x{k}"
        html = "<p>common</p>" if k % 3 == 1 else f"<p>{chosen.randint(0, 80)} é日本</p>"
        made.append((k * 7 % 151, f"http://{host}{path}", html))
    made += [(900, None, None), (901, "", ""), (902, "x", "y" * 300_000), (None, "http://a/", "<p>common</p>"), (None, None, "alone")]
    made += [(903, "http://b/\n tab\t", "line\r\n\r\nends"), (904, "  http://b/ c ", "line\r\n\r\nends"), (905, "http://z.example", "y" * 300_000)]
    made += [(910, "http://c/", "three equal rows")] * 3 + [(911, "http://d/", "one id"), (911, "http://e/", "one id")]
    return made


def plain(rows: list[tuple], least_bytes: int = 0) -> list[tuple]:
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[html or ""].append((page_id, url))
    out = []
    for html, pages in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids = sorted((p for p, _ in pages), key=lambda p: -1 if p is None else p)
        if len(data) < least_bytes:
            out += [(p, len(data), digest, "response", None) for p in ids]
            continue
        out.append((ids[-1], len(data), digest, "response", None))
        out += [(p, len(data), digest, "revisit", ids[-1]) for p in ids[:-1]]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(5)


def read_back(index, pages):
    found = warc_index.find_captures(index, pages)
    records = warc_index.stage(warc_index.read_records(index, found, with_payload=False), "records")
    return warc_index.resolve_revisits(index, records)


def result(df) -> list[tuple]:
    return sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.original_page) for r in df.collect()), key=str
    )


@pytest.mark.parametrize("least_bytes", [0, 14])
def test_pages_come_back_as_written(spark, least_bytes):
    pages = frame(spark, page_rows())
    index = warc_index.archive(pages, block_lines=7, archive_bytes=3000, least_bytes=least_bytes)
    assert result(read_back(index, pages)) == plain(page_rows(), least_bytes)


def test_payloads_and_record_ids(spark, tmp_path):
    pages = frame(spark, page_rows())
    index = warc_index.archive(pages, str(tmp_path / "w"), captured="2024-05-01T00:00:00Z")
    rows = warc_index.read_records(index, warc_index.find_captures(index, pages)).collect()
    assert len({r.record_id for r in rows}) == len(rows) == len(page_rows())
    texts = Counter((p, (h or "").encode()) for p, _, h in page_rows())
    assert all(texts[r.page_id, r.payload] for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    assert {r.stamp for r in rows} == {"20240501000000"}
    # Any reader of gzip takes an archive whole; each begins with its own description.
    whole = [gzip.decompress(f.read_bytes()) for f in Path(tmp_path / "w" / "archives").iterdir()]
    assert all(w.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") for w in whole)
    assert sum(w.count(b"WARC-Type: response") + w.count(b"WARC-Type: revisit") for w in whole) == len(rows)


def test_wanted_urls_only(spark):
    pages = frame(spark, page_rows())
    index = warc_index.archive(pages, block_lines=5)
    wanted = spark.createDataFrame(
        [("https://hot.example.com/same#there",), ("http://hot.example.com/same",), ("http://not.there/",), (None,), ("zzz",)], "url string"
    )
    got = warc_index.find_captures(index, wanted).collect()
    assert sum(r.key == "com,example,hot)/same" for r in got) == 50
    assert {r.key for r in got} == {"com,example,hot)/same", ")/"}


@pytest.mark.parametrize(("url", "key"), [
    ("http://WWW.Shop.Example.com:80/A/b?c=D#e", "com,example,shop)/A/b?c=D"),
    ("https://user:pw@h.example:8443?x", "example:8443,h)?x"),
    ("h.example", "example,h)/"), ("", ")/"), (None, ")/"), ("http://a b/\tc\n", "a%20b)/%09c%0A"),
])
def test_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(warc_index.url_key(F.col("url"))).first()[0] == key


def test_a_shard_opens_only_the_blocks_of_a_key(spark, tmp_path):
    chosen = random.Random(8)
    keys = sorted(chosen.choice("abcdefghij") * chosen.randint(1, 2) for _ in range(400))
    rows = [(k, "1", n, "response", "D", "f", n, 5) for n, k in enumerate(keys)]
    captures = spark.createDataFrame(rows, warc_index.LINE.replace("page_id string", "page_id long")).coalesce(1)
    index = warc_index.write_index(captures, "none", str(tmp_path), block_lines=6)
    seen = Counter()
    for shard in index.shards.collect():
        reader = warc_index.ShardReader(str(tmp_path), shard["file"])
        for key in sorted({*keys, "", "aab", "zz", "bz"}):
            before = reader.unpacked
            lines = list(reader.lines(key.encode()))
            seen[key] += len(lines)
            assert reader.unpacked - before <= len(lines) // 6 + 2
    assert +seen == Counter(keys)


def test_damage_is_noticed():
    record = warc_index.make_record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Target-URI", "u"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    with pytest.raises(ValueError, match="damaged"):
        warc_index._read_record(record)
    with pytest.raises(Exception, match="incomplete"):
        warc_index.parse_record(record[:-9])


def test_text_ids_and_empty_table(spark):
    rows = [("a\tb", "http://x/", "same"), ("", "http://y/", "same"), (None, "http://z/", "same"), ("ü", "http://x/", None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    index = warc_index.archive(pages)
    assert {(r[0], r[3], r[4]) for r in result(read_back(index, pages))} == {
        ("a\tb", "response", None), ("", "revisit", "a\tb"), (None, "revisit", "a\tb"), ("ü", "response", None)}
    none = frame(spark, [])
    index = warc_index.archive(none)
    assert index.shards.count() == 0 and result(read_back(index, none)) == []
