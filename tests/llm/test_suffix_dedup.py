"""Exact substring removal against a table of all strings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from corpora import SCHEMA, frame, rows

from storegrain.llm import shared_hashes
from storegrain.llm import suffix_dedup as S


def brute(table: list[tuple], length: int = 50) -> list[tuple]:
    least: dict[bytes, int] = {}
    data = [(r[0], (r[1] or "").encode()) for r in table]
    for doc, text in data:
        if doc is not None:
            for at in range(len(text) - length + 1):
                least[text[at : at + length]] = min(least.get(text[at : at + length], doc), doc)
    out = []
    for doc, text in data:
        gone = bytearray(len(text))
        if doc is not None:
            for at in range(len(text) - length + 1):
                if least[text[at : at + length]] < doc:
                    gone[at : at + length] = b"\1" * length
        runs = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), runs, bytes(c for c, g in zip(text, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "entries", "shard", "chunk"), [(1, 3_000_000, 4 << 20, 2 << 20), (3, 400, 3000, 2000)])
def test_removed_bytes_are_those_of_the_definition(spark, monkeypatch, seed, entries, shard, chunk):
    monkeypatch.setattr(shared_hashes, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    got = S.remove_repeats(frame(spark, seed)).collect()
    wanted = brute(rows(seed))
    assert sum(w[2] for w in wanted) > 5000
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.lows or ()), bytes(r.kept_bytes)) for r in got), key=str) == wanted


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def common(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_arrays_and_common_prefixes():
    chosen = random.Random(4)
    for trial in range(300):
        letters = [b"a", b"ab", b"abc\0", bytes(range(256))][trial % 4]
        data = bytes(chosen.choice(letters) for _ in range(chosen.randint(1, 60)))
        order = S.suffix_array(data)
        wanted = sorted(range(len(data)), key=lambda k: data[k:])
        assert list(order) == wanted, data
        prefixes = S.common_prefixes(data, order)
        assert list(prefixes[1:]) == [common(data[a:], data[b:]) for a, b in zip(wanted, wanted[1:])], data


@pytest.mark.parametrize("block", [60, 200, 10_000])
def test_blocks_are_merged(block):
    """The least owner of each string, however the pieces are cut into blocks."""
    chosen = random.Random(6)
    source = bytes(chosen.choice(b"ab") for _ in range(400))
    cuts = [chosen.randrange(0, 380) for _ in range(60)]
    pieces = list({source[c : c + chosen.randint(20, 45)] + bytes([chosen.choice(b"xy")]) for c in cuts})
    owners = np.array([chosen.randrange(20) for _ in pieces])
    length = 12
    least: dict[bytes, int] = {}
    for piece, owner in zip(pieces, owners.tolist(), strict=True):
        for at in range(len(piece) - length + 1):
            least[piece[at : at + length]] = min(least.get(piece[at : at + length], owner), owner)
    found = S.covered_starts(pieces, owners, length, block)
    assert [list(f) for f in found] == [[least[p[k : k + length]] for k in range(len(p) - length + 1)] for p in pieces]


def test_equal_strings_have_equal_names():
    chosen = random.Random(8)
    passage = bytes(chosen.choice(b"abcd ") for _ in range(80))
    names = []
    for _ in range(5):
        text = bytes(chosen.choice(b"abcd ") for _ in range(chosen.randint(0, 90))) + passage
        names.append(list(S.least_hashes(text, 50)[-31:]))
    assert all(n == names[0] for n in names)


def test_runs_of_places_are_those_of_each_start():
    chosen = random.Random(9)
    for _ in range(60):
        least = [np.array([chosen.randint(0, 6) for _ in range(chosen.randint(1, 9))], np.int64) for _ in range(chosen.randint(1, 5))]
        number = np.array([chosen.randrange(len(least)) for _ in range(chosen.randint(1, 12))], np.int64)
        docs = np.array([chosen.randint(0, 7) for _ in number], np.int64)
        wanted = []
        for place, (n, doc) in enumerate(zip(number.tolist(), docs.tolist(), strict=True)):
            starts = [k for k, owner in enumerate(least[n].tolist()) if owner < doc]
            for k in starts:
                if k - 1 not in starts:
                    end = k
                    while end + 1 in starts:
                        end += 1
                    wanted.append((place, k, end))
        got = S._taken_runs(least, number, docs)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == wanted
