"""A small corpus with every awkward case, and brute-force answers."""

from __future__ import annotations

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, rows int"


def sentence(chosen: random.Random, words: list[str], low: int = 9, high: int = 16) -> str:
    return " ".join(chosen.choice(words) for _ in range(chosen.randint(low, high))).capitalize() + "."


def texts(seed: int = 1, n: int = 40) -> list[str | None]:
    """Own texts, near and exact copies, shared passages, one long text, and odd ones."""
    chosen = random.Random(seed)
    words = ["".join(chosen.choice("bcdfglmnprstvz") + chosen.choice("aeiouéö") for _ in range(chosen.randint(1, 4)))
             for _ in range(700)]
    made: list[str | None] = [" ".join(sentence(chosen, words) for _ in range(chosen.randint(3, 9))) for _ in range(n)]
    base = " ".join(sentence(chosen, words) for _ in range(8))
    for k in range(12):  # a group of near copies, some of them similar to some only
        parts = base.split(" ")
        for _ in range(k):
            parts[chosen.randrange(len(parts))] = chosen.choice(words)
        made.append(" ".join(parts))
    passage = " ".join(sentence(chosen, words) for _ in range(5))
    made += [f"{sentence(chosen, words)} {passage}\n{sentence(chosen, words)}" for _ in range(6)]
    made += [made[0], made[0], made[3].upper(), base, base]
    made += [" ".join(sentence(chosen, words) for _ in range(600))]
    made += [None, "", "   \n ", "one", "one two three four", "One two three FOUR", "x" * 400, "ab" * 300, "ab" * 300 + "c"]
    return made


def rows(seed: int = 1) -> list[tuple]:
    """Rows of ``SCHEMA``: ids out of order, one id twice, one row twice, nulls in every column."""
    made = [(k * 7 % 1009, t) for k, t in enumerate(texts(seed))]
    made += [(7, "another text under a used id, seven words and more of it here"), made[2], (None, made[0][1]), (None, None)]
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t) if t else None, "clash", 1) for k, (i, t) in enumerate(made)]


def frame(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(6)


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = [w for w in (text or "").translate(LOWER).encode().split() if w]
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def components(sets: list[frozenset], percent: int = 80) -> list[int]:
    """For each set the first position reachable by links."""
    roots = list(range(len(sets)))

    def root(k: int) -> int:
        while roots[k] != k:
            k = roots[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                one, other = root(a), root(b)
                roots[max(one, other)] = min(one, other)
    return [root(k) for k in range(len(sets))]
