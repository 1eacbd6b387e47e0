"""Repeated paragraphs against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from corpora import SCHEMA, components, frame, rows, shingles

from storegrain.llm import paragraph_dedup as P
from storegrain.llm.jaccard_join import LOWER


def brute(table: list[tuple], min_run: int = 30) -> list[tuple]:
    """Rows after removal, from all pairs of paragraphs."""
    places, sets = [], []
    for at, row in enumerate(table):
        if row[0] is not None and row[1] is not None:
            for number, (a, b) in enumerate(P.paragraphs_of(row[1])):
                if len(row[1][a:b].encode().split()) >= P.MIN_WORDS:
                    places.append((at, number))
                    sets.append(shingles(row[1][a:b]))
    roots = components(sets)
    docs: dict[int, set[int]] = {}
    for (at, _), root in zip(places, roots, strict=True):
        docs.setdefault(root, set()).add(table[at][0])
    repeated: dict[int, set[int]] = {}
    for (at, number), root in zip(places, roots, strict=True):
        if min(docs[root]) != table[at][0]:
            repeated.setdefault(at, set()).add(number)
    out = []
    for at, row in enumerate(table):
        bounds = P.paragraphs_of(row[1]) if row[1] else []
        words = [len(row[1][a:b].encode().split()) for a, b in bounds]
        gone = P.passages(words, repeated.get(at, set()), min_run)
        text = "".join(row[1][a:b] for k, (a, b) in enumerate(bounds) if k not in gone) if gone else row[1]
        out.append((row[0], text, len(gone)))
    return sorted(out, key=str)


def test_removal_is_that_of_all_pairs(spark):
    got = P.remove_repeated_paragraphs(frame(spark)).collect()
    wanted = brute(rows())
    assert sum(w[2] for w in wanted) > 20
    assert sorted(((r.doc_id, r.text, r["__removed"]) for r in got), key=str) == wanted
    assert all(r["__first_docs"] == [] if not r["__removed"] else min(r["__first_docs"]) < r.doc_id for r in got)
    assert got[0].__fields__[:7] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_empty_table(spark):
    assert P.remove_repeated_paragraphs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_paragraphs_make_up_the_text():
    chosen = random.Random(1)
    for _ in range(300):
        text = "".join(chosen.choice(["ab ", "c", ". ", "!", "\n", "\n\n", "  ", "word ", "é", "x" * 9 + " "]) for _ in range(chosen.randint(0, 300)))
        bounds = P.paragraphs_of(text)
        assert "".join(text[a:b] for a, b in bounds) == text
        assert all(a < b for a, b in bounds)


def test_a_passage_is_cut_alike_wherever_it_stands():
    passage = "Nine words make up this sentence of the passage. And ten words make up this other one of it too. "
    inside = {passage[a:b] for a, b in P.paragraphs_of(passage)}
    for before in ("", "Short. ", "A longer sentence that stands before it all here. ", "Line\n"):
        text = before + passage + "After it."
        assert len(inside & {text[a:b] for a, b in P.paragraphs_of(text)}) >= 1


def test_bands_find_similar_pairs():
    bands, rows_ = P.tune_bands()
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.998
    chosen, found, alike = random.Random(3), 0, 0
    for _ in range(400):
        one = {chosen.randrange(1 << 60) for _ in range(40)}
        other = set(list(one)[:36]) | {chosen.randrange(1 << 60) for _ in range(4)}
        if 100 * len(one & other) >= 80 * len(one | other):
            flat = np.array([*sorted(one), *sorted(other)], np.uint64)
            codes = P.band_hashes(flat, np.array([0, len(one)]), bands, rows_)
            alike += 1
            found += bool((codes[0] == codes[1]).any())
    assert found >= 0.98 * alike > 0


def test_a_stock_phrase_stays():
    assert P.passages([9, 9, 3, 20, 9], {0}, 30) == set()
    assert P.passages([9, 9, 3, 20, 9], {1, 3, 4}, 30) == {1, 3, 4}


def test_sets_of_many_texts_at_once():
    """As each paragraph's shingles on their own; with long sentences and texts of few words."""
    chosen = random.Random(9)
    texts = [None, "", "few words.", " ".join(f"W{chosen.randrange(50)}" for _ in range(400))]
    texts += [" ".join(chosen.choice(["ab", "Cd", "e.", "f\n", "g!  "]) for _ in range(chosen.randint(0, 120))) for _ in range(60)]
    found = P.paragraph_shingles(texts, 5)
    lists = np.split(found.flat, found.starts[1:])
    wanted = {}
    for at, text in enumerate(texts):
        bounds, counts, n_words = P.cut_text(text or "")
        assert sum(counts) == n_words == len((text or "").encode().split())
        for number, ((a, b), n) in enumerate(zip(bounds, counts, strict=True)):
            words = text[a:b].encode().translate(LOWER).split()
            assert len(words) == n
            if n >= P.MIN_WORDS:
                wanted[at, number] = [tuple(words[k : k + 5]) for k in range(n - 4)]
    assert list(zip(found.text.tolist(), found.number.tolist(), strict=True)) == list(wanted)
    # One hash for each shingle, another for another, wherever it stands.
    names = {}
    for hashes, shingles in zip(lists, wanted.values(), strict=True):
        assert [names.setdefault(s, h) for s, h in zip(shingles, hashes.tolist(), strict=True)] == hashes.tolist()
    assert len(set(names.values())) == len(names)
    kept = np.arange(0, len(lists), 3)
    sets = found.picked(kept)
    assert [x.tolist() for x in np.split(sets.flat, sets.starts[1:])] == [sorted(set(lists[k].tolist())) for k in kept]
    assert np.array_equal(sets.words, found.words[kept])
    same = {}
    for k, name in zip(kept.tolist(), sets.classes().tolist(), strict=True):
        assert same.setdefault(frozenset(list(wanted.values())[k]), name) == name
    assert any(len(text or "") > 1000 for text in texts) and len(P.cut_text(texts[3])[0]) > 5


def planted(seed: int, lengths: range, ends: list[str], least: int, most: int) -> list[tuple]:
    """Documents of own words, each with a passage of the one before it pasted at any word; lines or sentences of few words."""
    chosen = random.Random(seed)
    table = []

    def spelled(n: int) -> list[str]:
        out, left = [], chosen.randint(least, most)
        for _ in range(n):
            left -= 1
            out.append(f"w{chosen.randrange(10**6)}" + (" " if left else chosen.choice(ends)))
            left = left or chosen.randint(least, most)
        return out

    for k, size in enumerate(lengths):
        source, other = spelled(400), spelled(300)
        a, b = chosen.randrange(400 - size), chosen.randrange(300)
        table += [(2 * k, "".join(source)), (2 * k + 1, "".join(other[:b] + source[a : a + size] + other[b:]))]
    return table


def common_stretch(one: str, other: str, size: int = 51) -> bool:
    """Do the texts share a stretch of ``size`` words?"""
    one, other = one.split(), other.split()
    grams = {tuple(one[k : k + size]) for k in range(len(one) - size + 1)}
    return any(tuple(other[k : k + size]) in grams for k in range(len(other) - size + 1))


def removed_from(spark, table: list[tuple]) -> tuple[int, int, list[int]]:
    """How many pairs share a stretch of 51 words before and after, and the words lost by each second document."""
    found = P.remove_repeated_paragraphs(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    kept = {r.doc_id: r.text for r in found.collect()}
    texts = dict(table)
    pairs = [k for k in texts if k % 2]
    assert all(kept[k - 1] == texts[k - 1] for k in pairs)
    return (sum(common_stretch(texts[k - 1], texts[k]) for k in pairs),
            sum(common_stretch(texts[k - 1], kept[k]) for k in pairs),
            [len(texts[k].split()) - len(kept[k].split()) for k in pairs])


def test_passages_of_short_lines_and_sentences_go(spark):
    for seed, ends in enumerate((["\n"], [". "], ["\n", "! ", ".\n\n"])):
        sizes = range(90, 210, 4)
        before, after, lost = removed_from(spark, planted(seed, sizes, ends, 2, 6))
        assert (before, after) == (len(sizes), 0)
        assert all(size - 45 <= n <= size for size, n in zip(sizes, lost, strict=True))


def test_passages_of_51_to_80_words_go_from_any_place(spark):
    for seed, (ends, least, most) in enumerate([([". "], 9, 25), ([" "], 5, 5)], 5):
        sizes = [51 + k % 30 if k % 3 else 51 for k in range(90)]
        before, after, lost = removed_from(spark, planted(seed, sizes, ends, least, most))
        assert (before, after) == (len(sizes), 0)
        # a paragraph of 13 words or more is similar still with one strange word at its outer end
        assert all(30 <= n <= size + 2 for size, n in zip(sizes, lost, strict=True))
        assert sum(n == size for size, n in zip(sizes, lost, strict=True)) >= 3


def test_a_shared_stretch_of_less_than_51_words_without_long_run_stays(spark):
    own = [f"w{k}" for k in range(900)]
    for size, gone in ((28, 0), (51, 51)):
        found = P.remove_repeated_paragraphs(spark.createDataFrame(
            [(1, " ".join(own[:200])), (2, " ".join(own[300:400] + own[64 : 64 + size] + own[400:500]))], "doc_id long, text string"
        )).collect()
        lost = 200 + size - len({r.doc_id: r.text for r in found}[2].split())
        assert lost == gone or size > 28 and 30 <= lost <= 51


def test_word_hashes_tell_words_apart():
    words = [b"a", b"A", b"b", b"aaaaaaaa", b"aaaaaaaaa", b"aaaaaaaab", b"x" * 4000, b"x" * 3999, "é".encode(), b"12345678\x01", b"12345678"]
    starts, ends, hashes = P.hashed_words(b" \n".join(words) + b"  ")
    data = b" \n".join(words)
    assert [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == words
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == len(words) - 1
    assert [len(x) for x in P.hashed_words(b"")] == [0, 0, 0]


def texts_of_words(chosen: random.Random, sizes: list[int]) -> list[str]:
    return [" ".join(chosen.choice(["é", "ab.", "c\n"]) + str(chosen.randrange(300)) for _ in range(n)) for n in sizes]


def test_windows_of_many_texts_are_found_at_once():
    chosen = random.Random(4)
    texts = texts_of_words(chosen, [chosen.randint(8, 200) for _ in range(60)] + [50, 51, 52, 8])
    numbers = [sorted(chosen.sample(range(len(counts)), chosen.randint(1, len(counts)))) for counts in (P.cut_text(t)[1] for t in texts)]
    short = [[k for k in own if chosen.random() < 0.4] for own in numbers]
    lists = [pa.array(x, pa.list_(pa.int32())) for x in (numbers, short)]
    ids = [pa.array([f * k for k in range(len(texts))], pa.int64()) for f in (3, 5)]
    batch = pa.record_batch([*ids, pa.array(texts), *lists], names=["row", "doc_id", "text", "numbers", "short"])
    wanted, words_at, names = [], [], {}
    for at, text in enumerate(texts):
        words, counts = text.translate(str.maketrans("ABC", "abc")).encode().split(), P.cut_text(text)[1]
        first = [sum(counts[:k]) for k in range(len(counts) + 1)]
        for start in range(len(words) - 50):
            held = {k for k in range(len(counts)) if start <= first[k] and first[k + 1] <= start + 51}
            if held & set(numbers[at]):
                wanted.append((3 * at, 5 * at, start, bool(held & set(short[at]))))
                words_at.append(tuple(words[start : start + 51]))
    for part in ([batch], [batch.slice(0, 20), batch.slice(20)]):
        found = list(P._windows(iter(part)))
        assert len(found) == len(part)  # one batch of windows a chunk of texts, not one a text
        rows_ = [r for f in found for r in f.to_pylist()]
        assert [(r["row"], r["doc_id"], r["start"], r["wanted"]) for r in rows_] == wanted
        assert all(names.setdefault(w, r["code"]) == r["code"] for w, r in zip(words_at, rows_, strict=True))
    assert len(set(names.values())) == len(names) > 100


def test_texts_are_cut_at_once_as_one_by_one():
    chosen = random.Random(6)
    texts = ["", *texts_of_words(chosen, [chosen.randint(0, 90) for _ in range(50)]), "  ", "\n", "é" * 30, ""]
    for text, (cut, places) in zip(texts, P.cut_texts(texts), strict=True):
        assert cut == P.cut_text(text)
        assert [text[a:].split()[0] for a in places.tolist()] == text.split()


def test_least_values_of_short_and_long_sets():
    chosen = np.random.default_rng(2)
    for low, high in ((1, 2), (4, 12), (4, 17), (1, 40), (7, 8)):
        sizes = chosen.integers(low, high, 50)
        starts = np.cumsum(sizes) - sizes
        values = chosen.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
        spans = P._spans(starts, len(values))
        assert len(spans[1]) <= P.MOST_SPANS
        assert P._least(values, starts, spans).tolist() == [values[a : a + n].min() for a, n in zip(starts, sizes, strict=True)]


def test_only_texts_that_may_lose_words_are_cut(spark, monkeypatch):
    """A stock phrase that two texts have is repeated, but no text with it alone is taken apart for removal."""
    own = [f"w{k}" for k in range(400)]
    staged = {}
    keep = P.stage
    monkeypatch.setattr(P, "stage", lambda df, label: staged.setdefault(label, keep(df, label)))
    phrase = "ends. One two three four five six seven eight nine ten eleven."
    table = [(k, " ".join([*own[100 * k : 100 * k + 60], phrase, *own[100 * k + 60 : 100 * k + 100]])) for k in range(3)]
    table.append((9, table[0][1]))
    found = P.remove_repeated_paragraphs(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == dict(table[:3]) | {9: ""}
    assert len({r.row for r in staged["repeated-paragraphs"].where("doc_id <> first_doc").collect()}) > 1
    assert staged["removed-paragraphs"].count() == 1
