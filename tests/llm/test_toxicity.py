"""The classifier chain: held-out accuracy, odd rows, bounds."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storegrain.llm import toxicity as T


def labelled(n: int, seed: int) -> list[tuple]:
    chosen = random.Random(seed)
    words = ["".join(chosen.choice("bdfgklmnprst") + chosen.choice("aeiou") for _ in range(3)) for _ in range(900)]
    out = []
    for _ in range(n):
        text = [chosen.choice(words) for _ in range(60)]
        toxic, good = int(chosen.random() < 0.2), int(chosen.random() < 0.7)
        if toxic:
            text[chosen.randrange(60)] = chosen.choice(["vilefoo", "vilebar", "horrid", "beastly"])
            text[chosen.randrange(60)] = chosen.choice(["vilebaz", "vilequx", "horrid", "beastly"])
        if not good:
            text[5:9] = ["click", "here", "buy", "now"]
        out.append((" ".join(text), good, toxic))
    return out


def telling(rows: list[np.ndarray], labels: np.ndarray, most: int) -> list[int]:
    """Brute force: the largest z-scores over all features, ties to the smaller."""
    scores = {}
    for feature in {f for row in rows for f in row.tolist()}:
        holds = np.array([feature in row for row in rows])
        if holds.sum() >= 4:
            shares = labels.mean(axis=0)
            z = [abs(labels[holds, k].sum() - holds.sum() * s) / np.sqrt(holds.sum() * s * (1 - s) + 1)
                 for k, s in enumerate(shares) if 0 < s < 1]
            scores[feature] = max(z, default=0.0)
    return sorted((f for f, z in scores.items() if z > 2), key=lambda f: (-scores[f], f))[:most]


def fitted(rows: list[tuple], folds: np.ndarray | None = None, most: int = 4096) -> T.Chain:
    values = np.array([[g, t] for _, g, t in rows], float).reshape(-1, 2)
    words = T.WordFeatures()
    made = [words.of_text(r[0]) for r in rows]
    known = {f: k for k, f in enumerate(telling(made, values, most))}
    numbers = [np.array([known[f] for f in row.tolist() if f in known], np.int32) for row in made]
    return T.fit_chain(numbers, values, np.arange(len(rows)) % T.FOLDS if folds is None else folds, ("quality", "toxic"), known)


def test_held_out_accuracy():
    chain, fresh = fitted(labelled(1200, 7)), labelled(1600, 7)[1200:]
    features = T.WordFeatures(chain.known)
    found = chain.probabilities([features.of_text(r[0]) for r in fresh]) >= 0.5
    toxic = np.array([r[2] for r in fresh]) == 1
    assert (found[:, 1] & toxic).sum() >= 0.9 * toxic.sum()
    assert (found[:, 1] & ~toxic).sum() <= 0.01 * (~toxic).sum()
    assert (found[:, 0] == np.array([r[1] == 1 for r in fresh])).mean() > 0.95


def test_later_models_take_earlier_categories():
    """Toxic if and only if not good: the second model leans on the first."""
    rows = [(t, g, 1 - g) for t, g, _ in labelled(600, 3)]
    chain = fitted(rows)
    assert chain.models[1].earlier.shape == (1,) and chain.models[1].earlier[0] < 0


def test_one_kind_of_label_and_none():
    chain = fitted([(t, 1, 0) for t, *_ in labelled(30, 1)])
    p = chain.probabilities([np.empty(0, np.int64)])
    assert p[0, 0] > 0.99 and p[0, 1] < 0.01
    assert fitted([]).probabilities([np.empty(0, np.int64)])[0, 1] < 0.01


@pytest.mark.parametrize("most", [4096, 7])
def test_training_gives_what_plain_python_gives(spark, most):
    rows = labelled(90, 11)
    docs = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(rows)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, g, t) for k, (_, g, t) in enumerate(rows)], "doc_id long, quality int, toxic int")
    places = {r.doc_id: r.place for r in labels.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("place")).collect()}
    sample = sorted(places, key=places.get)[:70]
    wanted = fitted([rows[k] for k in sample], np.array([places[k] % T.FOLDS for k in sample]), most)
    got = T.train_chain(docs, labels, sample=70, most_features=most)
    assert got.known == wanted.known and 0 < len(got.known) <= most
    for one, other in zip(got.models, wanted.models, strict=True):
        assert np.allclose(one.weights, other.weights) and np.allclose(one.earlier, other.earlier)


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = T.labelled_sample(docs, labels, ("quality", "toxic"), 10).select("labelled", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, None)]
    chain = T.train_chain(docs, labels)
    assert chain.known == {} and T.score(docs, chain).count() == 4


def test_scores_and_sample(spark):
    rows = [(k, *r) for k, r in enumerate(labelled(300, 5))]
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, *_ in rows] + [(None, "horrid", "x", 1.0), (5, None, None, None), (7, "", "", 0.0)],
                                 "doc_id long, text string, place string, labelled double")
    labels = spark.createDataFrame([(k, g, t) for k, _, g, t in rows] + [(9999, 1, 1), (None, 1, 0), (4, None, 1)],
                                   "doc_id long, quality int, toxic int")
    assert T.labelled_sample(docs.select("doc_id", "text"), labels, ("quality", "toxic"), 40).count() <= 45
    chain = T.train_chain(docs, labels, sample=250)
    again = T.train_chain(docs.repartition(7), labels.repartition(3), sample=250)
    assert np.allclose(chain.models[1].weights, again.models[1].weights)
    out = T.score(docs, chain)
    assert out.columns == ["doc_id", "text", "place", "labelled", "__p_quality", "__p_toxic"]
    got = out.collect()
    assert len(got) == 303 and all(0 <= r["__p_toxic"] <= 1 for r in got)
    counts = T.held_out_counts(docs.where("text <> ''"), labels, chain, "toxic")
    assert counts[1, True] > 10 * counts[0, True] + 10
    assert T.score(docs.limit(0), chain).collect() == []
    assert T.score(docs, T.train_chain(docs, labels.limit(0))).where("__p_toxic > 0.5").count() == 0
