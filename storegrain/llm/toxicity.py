"""Toxicity by a classifier chain over word features.

Categories are predicted one after the other, each by a logistic model over which
words and word beginnings a text has. The log-odds of earlier categories are
features of later ones; in training they are out-of-fold predictions, so a later
model sees an earlier one as it does on new texts.

The models are fitted on a sample of labelled rows of at most ``sample`` rows,
those with the smallest hashes of their ids. Their features are made and counted in
tasks, and the driver gathers the chosen ones alone; every document is then scored in
one scan without a shuffle.

Defined results: null and empty texts get the models' intercepts; a category
without both kinds of labels predicts its share of ones (0 without labels);
labels of ids without document and null labels are not used; rows with one id are
scored each, and the least of their texts is that to learn from; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.workspace import stage

SPACE_BITS = 22
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
FOLDS = 3
ROWS_OUT = 200


def features_of_word(word: str) -> set[int]:
    """Hashed features: the word and its beginnings."""
    parts = {f"={word}", *(word[:n] for n in BEGINNINGS if len(word) > n)}
    return {xxhash.xxh64_intdigest(part) >> (64 - SPACE_BITS) for part in parts}


class WordFeatures(dict):
    """Features of each word, out of ``known`` if given; starts anew when full."""

    LIMIT = 60_000

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> frozenset[int]:
        found = features_of_word(word)
        if self.known is not None:
            found = {self.known[f] for f in found if f in self.known}
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = made = frozenset(found)
        return made

    def of_text(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        return np.array(sorted(frozenset().union(*map(self.__getitem__, words))), np.int32)


@dataclass
class Linear:
    """A logistic model over present features and the log-odds of earlier categories."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def log_odds(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        sums = np.array([self.weights[row].sum() for row in rows], float)
        return sums + earlier @ self.earlier + self.intercept


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray, n_features: int,
               rounds: int = 150, penalty: float = 1e-4) -> Linear:
    """Logistic regression by full-batch gradient steps with a rate of their own for each weight."""
    share = labels.mean() if len(labels) else 0.0
    if share in (0.0, 1.0):
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Linear(np.zeros(n_features), np.zeros(earlier.shape[1]), float(odds))
    holder = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    weights, before, intercept = np.zeros(n_features), np.zeros(earlier.shape[1]), np.log(share / (1 - share))
    squares, squares_before, squares_intercept = np.full(n_features, 1e-8), np.full(len(before), 1e-8), 1e-8
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(rounds):
        odds = np.bincount(holder, weights[flat], len(rows)) + earlier @ before + intercept
        error = (1 / (1 + np.exp(-odds)) - labels) * balance / len(rows)
        slope = np.bincount(flat, error[holder], n_features) + penalty * weights / n_features
        slope_before = earlier.T @ error
        squares += slope**2
        squares_before += slope_before**2
        squares_intercept += error.sum() ** 2
        weights -= 0.3 * slope / np.sqrt(squares)
        before -= 0.3 * slope_before / np.sqrt(squares_before)
        intercept -= 0.3 * error.sum() / np.sqrt(squares_intercept)
    return Linear(weights, before, float(intercept))


@dataclass
class Chain:
    """Models in the order of their categories, over the chosen features."""

    categories: tuple[str, ...]
    known: dict[int, int]
    models: list[Linear]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """One line a text, one column a category."""
        odds = np.zeros((len(rows), 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.log_odds(rows, odds), -20, 20)])
        return 1 / (1 + np.exp(-odds))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...],
              known: dict[int, int]) -> Chain:
    """Fit the chain on rows of ``known`` features' numbers; ``folds`` says in which fold each row lies."""
    if not len(rows):
        constant = [Linear(np.zeros(1), np.zeros(k), -20.0) for k in range(len(categories))]
        return Chain(categories, {}, constant)
    n_features, models, outside = max(1, len(known)), [], np.zeros((len(rows), 0))
    for column in labels.T:
        models.append(fit_linear(rows, outside, column, n_features))
        predicted = np.zeros(len(rows))
        for fold in range(FOLDS):
            rest, held = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            model = fit_linear([rows[i] for i in rest], outside[rest], column[rest], n_features)
            predicted[held] = np.clip(model.log_odds([rows[i] for i in held], outside[held]), -20, 20)
        outside = np.column_stack([outside, predicted])
    return Chain(categories, known, models)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int, seed: int = 0) -> DataFrame:
    """At most ``sample`` labelled texts, those with the smallest hashes of their ids; an id gives its least text."""
    picked = labels.select(F.col("doc_id").alias("labelled"), *[F.col(c).cast("double").alias(f"is_{c}") for c in categories])
    whole = picked.dropna().dropDuplicates(["labelled"])
    chosen = whole.withColumn("place", F.xxhash64(F.lit(seed), "labelled")).orderBy("place", "labelled").limit(sample)
    met = docs.join(chosen, F.col("doc_id") == F.col("labelled"))
    return met.groupBy("place", "labelled", *[f"is_{c}" for c in categories]).agg(F.min("text").alias("text"))


def with_features(texts: DataFrame) -> DataFrame:
    """``features`` (ascending) in place of ``text``, made where the texts lie."""
    others = [c for c in texts.columns if c != "text"]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures()
        for batch in batches:
            for low in range(0, len(batch), ROWS_OUT):
                part = batch.slice(low, ROWS_OUT)
                made = [words.of_text(text.as_py()) for text in part.column("text")]
                kept = [part.column(c) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.list_(pa.int32()))], names=[*others, "features"])

    kinds = dict(texts.dtypes)
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in others), "features array<int>"])
    return texts.select(*others, "text").mapInArrow(featured, ddl)


def telling_features(rows: DataFrame, categories: tuple[str, ...], most: int, least_rows: int = 4) -> list[int]:
    """Features whose presence says most about any category, by the size of the z-score: ``most`` at most."""
    shares = rows.agg(*[F.avg(f"is_{c}").alias(c) for c in categories]).first()
    telling = [c for c in categories if shares[c] is not None and 0 < shares[c] < 1]
    if not telling:
        return []
    held = rows.select(F.explode("features").alias("feature"), *[f"is_{c}" for c in telling]).groupBy("feature").agg(
        F.count(F.lit(1)).alias("held"), *[F.count_if(F.col(f"is_{c}") != 0).alias(f"ones_{c}") for c in telling]
    )
    scores = [F.lit(0.0)]
    for c in telling:
        expected = F.col("held") * F.lit(shares[c])
        scores.append(F.abs(F.col(f"ones_{c}") - expected) / F.sqrt(expected * F.lit(1 - shares[c]) + 1))
    best = held.where(F.col("held") >= least_rows).select("feature", F.greatest(*scores).alias("score"))
    top = best.where("score > 2").orderBy(F.desc("score"), "feature").limit(most)
    return [r["feature"] for r in top.collect()]


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"),
                sample: int = 6000, seed: int = 0, most_features: int = 4096) -> Chain:
    """The chain fitted on a bounded sample.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and a 0/1 column for each category.
    Texts stay in tasks, and so does the count of rows a feature; the driver gathers at most
    ``sample`` rows of at most ``most_features`` numbers of four bytes.
    """
    sampled = labelled_sample(docs.select("doc_id", "text"), labels, categories, sample, seed)
    rows = stage(with_features(sampled), "sample-features")
    chosen = telling_features(rows, categories, most_features)
    known = F.array_intersect("features", F.lit(np.array(chosen, np.int32))) if chosen else F.array().cast("array<int>")
    table = rows.select("place", "labelled", *[f"is_{c}" for c in categories], known.alias("known")).toArrow()
    table = table.sort_by([("place", "ascending"), ("labelled", "ascending")]).combine_chunks()
    numbers = np.argsort(np.array(chosen, np.int32)).astype(np.int32)  # of the chosen features, in ascending order
    ascending = np.array(chosen, np.int32)[numbers]
    fitted = [numbers[np.searchsorted(ascending, row.values.to_numpy())] for row in table["known"]]
    values = np.column_stack([table[f"is_{c}"].to_numpy() for c in categories])
    folds = table["place"].to_numpy() % FOLDS
    return fit_chain(fitted, values, folds, categories, {f: k for k, f in enumerate(chosen)})


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and ``__p_<category>`` for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most `most_features` weights a category
    names = [f"__p_{c}" for c in chain.categories]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        features = WordFeatures(fitted.known)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            made = fitted.probabilities([features.of_text(text.as_py()) for text in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(p) for p in made.T)], names=[*batch.schema.names, *names]
            )

    ddl = ", ".join([*(f"`{n}` {k}" for n, k in docs.dtypes), *(f"{n} double" for n in names)])
    return docs.mapInArrow(scored, ddl)


def held_out_counts(docs: DataFrame, labels: DataFrame, chain: Chain, category: str, threshold: float = 0.5) -> Counter:
    """Documents by (label, verdict) over all labelled rows given."""
    verdict = (F.col(f"__p_{category}") >= threshold).alias("verdict")
    met = score(docs.select("doc_id", "text"), chain).join(labels.select("doc_id", category), "doc_id")
    return Counter({(r[category], r["verdict"]): r["count"] for r in met.groupBy(category, verdict).count().collect()})
