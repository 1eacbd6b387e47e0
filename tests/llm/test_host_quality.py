"""Host-level rules against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from storegrain.llm import host_quality as H


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [line for line in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(hit),
    )


def test_features_of_random_texts():
    chosen = random.Random(3)
    texts = [None, "", "a a a a", "a b c a b c", "a b \x1c c\nd\n\nd\n d", "é# <b>|&\r\nx"]
    texts += ["".join(chosen.choice("ab \n# \x1cé") for _ in range(chosen.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert H.text_features(text) == brute(text), repr(text)


GOOD = " ".join(f"word{i}" for i in range(80))
BAD = "spam eggs ham " * 40


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark):
    rows = [(i, GOOD, f"good{i % 10}") for i in range(200)]
    rows += [(1000 + i, BAD, "bad") for i in range(40)] + [(1100, GOOD, "bad")]
    rows += [(2000, BAD, "tiny"), (2001, GOOD, None), (2002, None, None), (None, GOOD, "good1"), (7, GOOD, "good7")]
    docs = spark.createDataFrame(
        [(i, t, h, 1, "x") for i, t, h in rows], "doc_id long, text string, source string, n_words int, host string"
    )
    out = H.judge_documents(docs).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert not by_id[1100].kept and by_id[1100].host_failed and not by_id[1100].base_failed
    assert not by_id[2000].kept and not by_id[2000].host_failed  # one page says little of a host
    assert by_id[2001].kept and not by_id[2002].kept and by_id[None].kept
    assert all(by_id[i].kept for i in range(200))
    verdicts = {r.host: r for r in H.host_verdicts(H.host_counts(H.document_features(docs)), {"repeated": 0.5}).collect()}
    assert 0 < verdicts["tiny"].rate_repeated < 1 and verdicts["bad"].rate_repeated < 40 / 41


def test_no_spread_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, GOOD, f"h{i % 3}") for i in range(9)], "doc_id long, text string, source string")
    assert all(strength == 1000.0 for _, strength in H.fit_priors(H.host_counts(H.document_features(docs))).values())
    assert H.judge_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rule", H.RULES)
def test_rules_are_conditions_over_features(spark, rule):
    none = spark.createDataFrame([], ", ".join(f"{f} long" for f in H.FEATURES))
    assert none.where(H.failed(rule)).count() == 0
