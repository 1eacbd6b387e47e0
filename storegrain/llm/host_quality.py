"""Host-level quality rules.

Each document gets counts over its words and lines. Failures of simple rules are
then added up by host, the rate of each host and rule is shrunk towards all
hosts by a beta prior fitted to the hosts, and a host whose shrunk rate passes
the limit of a rule is rejected with all its documents.

Defined results: a null text has no words; a null host is never rejected; each
input row gives one output row, repeated ids included; an empty table gives none.
Columns other than the three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.workspace import stage

#: Python's bytes.split() cuts at exactly these: space, and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: A document fails a rule where the condition holds (whole numbers, so that no rounding decides).
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_size": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
BASE_RULES = ("short", "repeated")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    pairs = pd.factorize(ids[:-1] * (ids.max() + 1) + ids[1:])[0].astype(np.int64)
    windows = pairs[:-1] * len(words) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for offset in range(3):
        covered[starts + offset] = True
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts named in ``FEATURES``."""
    if not text:
        return (0,) * len(FEATURES)
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(text.as_py()) for text in batch.column(2)]
        counts = np.array(rows, dtype=np.int64).reshape(-1, len(FEATURES)).T
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *map(pa.array, counts)],
            names=[batch.schema.names[0], batch.schema.names[1], *FEATURES],
        )


def document_features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Id (``doc_id``), host (``host``) and the counts of each document."""
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")
    )
    kinds = dict(picked.dtypes)
    counts = ", ".join(f"{name} bigint" for name in FEATURES)
    return picked.mapInArrow(
        _featured, f"doc_id {kinds['doc_id']}, host {kinds['host']}, {counts}"
    )


def failed(rule: str) -> Column:
    return F.expr(RULES[rule])


def host_counts(features: DataFrame) -> DataFrame:
    """Documents and failures of each rule, by host."""
    return (
        features.where("host IS NOT NULL")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.count_if(failed(rule)).alias(f"n_{rule}") for rule in RULES],
        )
    )


def fit_priors(
    hosts: DataFrame, min_strength: float = 10.0, max_strength: float = 1000.0
) -> dict[str, tuple[float, float]]:
    """Mean and strength (alpha + beta) of each rule's beta prior, by moments over the hosts.

    The spread of the rates less what chance alone adds for hosts of these sizes
    gives the strength, held between the two bounds: a prior counts as ten documents
    at least. No spread beyond chance, or fewer than two hosts: ``max_strength``.
    """
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.avg(1 / F.col("n_docs")).alias("chance"),
        *[F.sum(f"n_{rule}").alias(f"sum_{rule}") for rule in RULES],
        *[F.var_samp(F.col(f"n_{rule}") / F.col("n_docs")).alias(f"var_{rule}") for rule in RULES],
    ).first()
    priors = {}
    for rule in RULES:
        mean = sums[f"sum_{rule}"] / sums["docs"] if sums["docs"] else 0.0
        noise = mean * (1 - mean)
        spread = (sums[f"var_{rule}"] or 0.0) - noise * (sums["chance"] or 0.0)
        strength = noise / spread - 1 if spread > 0 else max_strength
        priors[rule] = (mean, min(max(strength, min_strength), max_strength))
    return priors


def host_verdicts(hosts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Shrunk failure rates of each host, and whether one is over its limit."""
    priors = fit_priors(hosts)
    rates = {
        rule: (F.col(f"n_{rule}") + mean * strength) / (F.col("n_docs") + strength)
        for rule, (mean, strength) in priors.items()
    }
    over = [rates[rule] > limit for rule, limit in limits.items()]
    return hosts.select(
        "host",
        "n_docs",
        *[rate.alias(f"rate_{rule}") for rule, rate in rates.items()],
        (F.array_contains(F.array(*over), True) if over else F.lit(False)).alias("host_failed"),
    )


def judge_documents(
    docs: DataFrame,
    limits: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Counts, ``base_failed``, ``host_failed`` and ``kept`` of each document.

    ``limits`` gives the highest shrunk failure rate of a host by rule, 0.5 for
    each rule if absent. The counts are staged, so texts are read once. Few
    rejected hosts are broadcast by their size on disk; many are joined by
    shuffling, where the adaptive planner splits a hot host.
    """
    limits = {rule: 0.5 for rule in RULES} if limits is None else limits
    features = stage(document_features(docs, id_col, text_col, host_col), "host-features")
    verdicts = host_verdicts(stage(host_counts(features), "host-counts"), limits)
    rejected = verdicts.where("host_failed").select("host", "host_failed")
    base_failed = F.expr(" OR ".join(f"({RULES[rule]})" for rule in BASE_RULES))
    return (
        features.join(rejected, "host", "left")
        .withColumn("base_failed", base_failed)
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )
