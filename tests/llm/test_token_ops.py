"""Token counts and token files against the tokenizer itself, run on whole texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from storegrain.llm import token_counts, token_frames

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "   ", "one", " one two  three\n four \n\n five.", "don't stop, it's 12 o'clock!",
    "a <|endoftext|> b<|endoftext|>", "naïve café 日本語 𝒳   x \x85 y \x1c z", "x" * 3000,
    "same text", "same text", "tab\t tab \t end ", "word " * 4000,
]


def random_texts(n: int) -> list[str]:
    chosen = random.Random(5)
    parts = [*"abcZ  '\n\t.!é ", " ", "\x1c", "\x85", "<|endoftext|>", "'s", "日本", "  ", "12", "​", "the", " of"]
    return ["".join(chosen.choice(parts) for _ in range(chosen.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate([*TEXTS, *random_texts(400)])) + [(None, "no id"), (3, "again")]
    return spark.createDataFrame(
        [(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n_tokens int, file string"
    ).repartition(5)


LIBRARY = token_counts.load_tokenizer(PATH)


def library_ids(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_are_those_of_the_tokenizer(docs):
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
    wanted = [(r.doc_id, len((r.text or "").encode()), len(library_ids(r.text))) for r in docs.collect()]
    assert got == sorted(wanted, key=str)


def test_proven_strings_are_one_token():
    proven = token_counts.whole_tokens(PATH)
    assert "Ġthe" in proven and "Ġthe of" not in proven
    assert all(len(LIBRARY.model.tokenize(word)) == 1 for word in random.Random(1).sample(sorted(proven), 500))


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counts = token_counts.PieceCounts(PATH)
    for text in random_texts(200):
        assert counts.of_text(text) == len(library_ids(text))
        assert len(counts) <= 5


def test_long_pieces_are_not_kept_and_marks_stay_few(monkeypatch):
    monkeypatch.setattr(token_counts, "MARKS", 3)
    counts, ids = token_counts.PieceCounts(PATH), token_frames.PieceIds(PATH)
    texts = ["a " + "é" * 5000 + "!" * 5000, "one " + "w" * 201 + " word... word!? word;; word-- word, wörd,, it's' end"]
    for text in texts + texts[::-1]:
        assert counts.of_text(text) == len(library_ids(text))
        assert ids.of_text(text) == np.array(library_ids(text), dtype="<u4").tobytes()
    for memo in (counts, ids):
        assert max(map(len, memo)) <= token_counts.LONGEST_KEPT and len(memo.marks) <= 3


def test_files_hold_the_ids_in_order(docs, tmp_path):
    index = token_frames.with_starts(
        token_frames.write_token_files(docs, PATH, 2, folder=str(tmp_path / "files"), frame_bytes=1000)
    )
    rows = sorted(token_frames.read_token_files(index).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    start = 0
    texts = {(r.doc_id, zlib.crc32(np.array([*library_ids(r.text), 2], dtype="<u4").tobytes())) for r in docs.collect()}
    for r in rows:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        assert (r.doc_id, zlib.crc32(r.ids)) in texts
        start += r.n_tokens


def test_a_reader_unpacks_only_what_is_asked(tmp_path):
    data = random.Random(2).randbytes(50_000)
    path = tmp_path / "frames.zst"
    writer = token_frames.FrameWriter(path.open("wb"), frame_bytes=1000)
    for at in range(0, len(data), 777):
        writer.write(data[at : at + 777])
    writer.close()
    from pyarrow import fs

    reader = token_frames.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    assert reader.read(12_345, 10) == data[12_345:12_355] and reader.unpacked == 1
    assert reader.read(0, len(data)) == data
    assert reader.read(50_000, 0) == b""
    with pytest.raises(ValueError):
        reader.read(49_999, 2)
    # Any zstandard reader takes the whole file.
    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert whole == data
    damaged = bytearray(path.read_bytes())
    damaged[700] ^= 1
    path.write_bytes(damaged)
    broken = token_frames.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.read(0, 10)


def test_wanted_documents_only(docs):
    index = token_frames.write_token_files(docs, PATH, 2)
    [row] = token_frames.read_token_files(index.where("doc_id = 9")).collect()
    assert list(np.frombuffer(row.ids, "<u4")) == [*library_ids("x" * 3000), 2]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = token_frames.with_starts(token_frames.write_token_files(none, PATH, 2))
    assert token_frames.read_token_files(index).collect() == []
    assert token_counts.count_tokens(none, PATH).agg(F.count("*")).first()[0] == 0
