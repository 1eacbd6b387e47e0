"""Importance resampling against a plain version, and the distributed selection against sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpora
import pytest
from pyspark.sql import functions as F

from storegrain.llm import importance

TARGET = ["alpha beta gamma delta", None, "", "Alpha, BETA; café-au-lait 12 12", "mabo tipe"]


def features(text: str | None, max_run: int) -> list[str]:
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(corpora.LOWER)) if w]
    return [" ".join(words[k : k + n]) for n in range(1, max_run + 1) for k in range(len(words) - n + 1)]


def plain(rows, target, percent, seed, n_buckets, max_run, min_words):
    """(doc_id, n_features, weight, score) of all rows, and those drawn, best first."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % n_buckets for t in texts for f in features(t, max_run))

    s, t = counts([x for _, x in rows]), counts(target)
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    scored, large = [], []
    for doc_id, text in rows:
        own = features(text, max_run)
        weight = 0
        for f in own:
            b = zlib.crc32(f.encode()) % n_buckets
            weight += math.floor(1000 * math.log((t[b] + 1.0) * (big_s + n_buckets) / ((s[b] + 1.0) * (big_t + n_buckets))))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(own), weight, score))
        if len(features(text, 1)) >= min_words:
            large.append(scored[-1])
    large.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return scored, large[: percent * len(large) // 100]


@pytest.mark.parametrize(("percent", "n_buckets", "max_run", "min_words"), [(10, 10_000, 1, 20), (35, 50, 2, 3), (100, 7, 3, 0)])
def test_all_rows_are_scored_and_the_best_ranked(spark, percent, n_buckets, max_run, min_words):
    docs = corpora.frame(spark, 2).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.resample(docs, target, percent, 2024, n_buckets, max_run, min_words).collect()
    rows = [(r[0], r[1]) for r in corpora.rows(2)]
    scored, drawn = plain(rows, TARGET, percent, 2024, n_buckets, max_run, min_words)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(scored, key=str)
    ranks = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert ranks == [(k, r[0], r[3]) for k, r in enumerate(drawn, 1)]


def test_ties_and_equal_rows_are_drawn_exactly(spark):
    text = "many words that are all the same in each of these rows so that weights tie everywhere in it and on"
    rows = [(5, text)] * 30 + [(k, text) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([], "text string")
    got = importance.resample(docs, target, 50).collect()
    ranks = sorted((r.rank, r.doc_id) for r in got if r.rank)
    _, drawn = plain(rows, [], 50, 2024, 10_000, 1, 20)
    assert ranks == [(k, r[0]) for k, r in enumerate(drawn, 1)] and len(ranks) == 35 and len(got) == 70


def test_the_kth_key_is_that_of_a_sort(spark):
    chosen = random.Random(4)
    rows = [(chosen.randint(-20, 20), False, chosen.randint(0, 5), 0, n) for n in range(1500)]
    keyed = spark.createDataFrame(rows, "fall long, no_id boolean, doc_id long, text_hash long, row long").repartition(6)
    ordered = sorted(rows)
    for k in (1, 2, 700, 1499, 1500):
        assert tuple(importance.select_kth(keyed, k, pivots=4)) == ordered[k - 1]
    with pytest.raises(ValueError):
        importance.select_kth(keyed, 1501)


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " !")], "doc_id long, text string")
    got = importance.resample(docs, none, min_words=0, percent=100).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3] and {r.weight for r in got} == {0}
    assert [r.doc_id for r in sorted(got, key=lambda r: -r.score)] == [r.doc_id for r in sorted(got, key=lambda r: r.rank)]


def test_memory_of_buckets_is_bounded(monkeypatch):
    monkeypatch.setattr(importance, "REMEMBERED", 3)
    buckets = importance.Buckets(11)
    words = [bytes([97 + k % 9]) for k in range(50)]
    assert buckets.of(words).tolist() == [zlib.crc32(w) % 11 for w in words]
    assert len(buckets) <= 3
