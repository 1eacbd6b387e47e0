"""Decontamination against a plain search."""

from __future__ import annotations

import re

import pytest
from corpora import LOWER, SCHEMA, frame, rows

from storegrain.llm import decontaminate as D


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def items() -> list[tuple]:
    table = [r for r in rows() if r[1]]
    long, other = table[5][1].split(" "), table[43][1].split(" ")
    return [
        (1, " ".join(long[4:22])), (2, " ".join(other[10:25]).upper()), (3, "one two three four"), (4, "one"), (5, None),
        (6, "--- !"), (7, " ".join(long[4:22])), (8, "words that no document holds at all in this order ever"),
        (9, " ".join(long[6:15])), (10, "two three"), (None, " ".join(long[10:24])),
    ]


def brute(table: list[tuple], benchmark: list[tuple]) -> set[tuple]:
    out = set()
    for row in table:
        text = words(row[1])
        hit, found = set(), set()
        for item, content in benchmark:
            wanted = words(content)
            size = min(10, len(wanted))
            for k in range(len(wanted) - size + 1 if wanted else 0):
                for at in range(len(text) - size + 1):
                    if text[at : at + size] == wanted[k : k + size]:
                        hit.update(range(at, at + size))
                        found.add(str(item)) if item is not None else None
        out.add((row[0], len(text), len(hit), ",".join(sorted(found))))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, few):
    """With the items' shingles broadcast, and with both sides shuffled."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", D.BROADCAST_ROWS if few else 0)
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items()], "item_id long, text string, words string")
    got = D.find_contamination(frame(spark), benchmark).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got} == brute(rows(), items())
    assert any(r.n_hit for r in got)


def test_empty_tables(spark):
    docs, benchmark = frame(spark), spark.createDataFrame(items(), "item_id long, text string")
    assert D.find_contamination(docs.limit(0), benchmark).collect() == []
    assert all(r.n_hit == 0 and r["items"] == [] for r in D.find_contamination(docs, benchmark.limit(0)).collect())


def test_no_python_on_the_main_path(spark):
    plan = D.find_contamination(frame(spark), spark.createDataFrame(items(), "item_id long, text string"))
    assert "Python" not in plan._jdf.queryExecution().toString()
    assert SCHEMA  # the corpus has extra columns with clashing names


def test_each_row_gives_one_row(spark):
    """Rows equal in id and text too, with and without id and hits."""
    table = [*rows(), rows()[5], rows()[5], (None, rows()[5][1], *rows()[5][2:])] + [(None, None, *rows()[0][2:])] * 2
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    got = D.find_contamination(spark.createDataFrame(table, SCHEMA).repartition(5), benchmark).collect()
    wanted = [line for row in table for line in brute([row], items())]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got), key=str) == sorted(wanted, key=str)
