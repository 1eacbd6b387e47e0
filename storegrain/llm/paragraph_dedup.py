"""Near-duplicate paragraphs across documents: MinHash bands, exact Jaccard, components.

A paragraph ends where its own words say so, lines or not: places after a word are
taken in the order of a hash of the two words before them, ends of lines and
sentences first, each ``MIN_WORDS`` words or more from those taken before. That
leaves paragraphs of 8 to 15 words, also of short lines, and a passage pasted into
other surroundings is cut as in its source but for its outermost words. Only the
last paragraph of a text may be shorter, if a sentence or line ends before it.

Paragraphs of ``MIN_WORDS`` words or more get MinHash bands. Bands that one
document alone has are left out without shuffling text; paragraphs that collide
are compared by exact Jaccard similarity of word shingles, equal ones once, and
linked ones are clustered by components. A cluster that lies in two documents or
more stays in the document with the smallest id; in the others it is cut where
enough repeated words lie together. Where they are too few, the words around them
count too: windows of ``PASSAGE_WORDS`` words around them that a document with a
smaller id has word by word are cut, parts of paragraphs included.

Defined results: a null text stays null; rows without id lose nothing and count
for nothing; rows with one id are one document; a document may become empty; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storegrain.llm.components import connected_components
from storegrain.llm.jaccard_join import LOWER, links_at_hubs, mixed
from storegrain.llm.shared_hashes import Owned, bucket_count, shared_hashes, token_names
from storegrain.llm.suffix_dedup import words_at
from storegrain.workspace import release, stage

MIN_WORDS = 8
PASSAGE_WORDS = 51
CUT_ROUNDS = 3
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
STOP = np.isin(np.arange(256), list(b".!?"))
CHUNK_CHARS = 1 << 20
MOST_SPANS = 4


def tune_bands(percent: int = 80, recall: float = 0.998, noise: float = 0.1) -> tuple[int, int]:
    """The fewest bands, and rows a band, that find similar pairs and spare dissimilar ones.

    At the threshold the chance to collide is ``recall`` at least; at a quarter of
    it, ``noise`` at most.
    """
    high, low = percent / 100, percent / 400
    for bands in range(1, 200):
        for rows in range(1, 20):
            if 1 - (1 - high**rows) ** bands >= recall and 1 - (1 - low**rows) ** bands <= noise:
                return bands, rows
    raise ValueError("no bands give that recall with so little noise")


Cut = tuple[list[tuple[int, int]], list[int], int]


def cut_text(text: str) -> Cut:
    """Bounds and word counts of the paragraphs, which make up the text, and the number of all words."""
    return next(cut_texts([text]))[0]


def cut_texts(texts: list[str]) -> Iterator[tuple[Cut, np.ndarray]]:
    """For each text its :func:`cut_text` and where its words start."""
    for _, chunk in _chunks(texts):
        data, begin = _joined(chunk)
        hashes, starts, cuts = cut_words(data, begin)
        first = np.searchsorted(starts, begin)
        last = np.append(first[1:], len(hashes))
        chars = (np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1)[starts]
        before = np.cumsum([0, *(len(text) + 1 for text in chunk)])
        inner = np.searchsorted(cuts, np.append(first, len(hashes)))
        for k, text in enumerate(chunk):
            own = cuts[inner[k] : inner[k + 1]]
            places = chars[first[k] : last[k]] - before[k]
            at = [0, *places[own - first[k]].tolist(), len(text)]
            counts = np.diff(np.concatenate([first[k : k + 1], own, last[k : k + 1]])).tolist()
            bounds = list(zip(at[:-1], at[1:], strict=True))
            yield (bounds, counts, len(places)) if text else ([], [], 0), places


def _joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The encoded texts as lines, and where each starts."""
    data = [(text or "").encode() for text in texts]
    return b"\n".join(data), np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words (A-Z as a-z), eight bytes of all of them at a time."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[np.frombuffer(data, np.uint8)], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    eight = words_at(data.translate(LOWER) + b"\0" * 8)
    left = ends - starts
    hashes = left.astype(np.uint64)
    live, at = np.arange(len(starts)), starts
    while len(live):
        unused = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        hashes[live] = mixed(hashes[live] * np.uint64(0x9E3779B97F4A7C15) + (eight[at] >> unused))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return starts, ends, hashes


def cut_words(data: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and starts of the words of texts that start at ``texts`` in ``data``, and the words that start a further paragraph of a text."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends, hashes = hashed_words(data)
    lines = np.append(0, np.cumsum(raw == 10, dtype=np.int32))
    stop = STOP[raw[ends - 1]]
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    rank = np.zeros(len(hashes) + 1, np.uint64)
    rank[2:] = mixed(hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]) >> np.uint64(2) | np.uint64(1)
    rank[1:][stop] |= np.uint64(1 << 63)
    first = np.searchsorted(starts, texts)
    near = (first[:, None] + np.arange(MIN_WORDS)).ravel()
    rank[near[near <= len(hashes)]] = 0
    last = (np.append(first[1:], len(hashes))[:, None] - np.arange(MIN_WORDS)).ravel()
    last = last[last >= 0]
    rank[last[rank[last] < np.uint64(1 << 63)]] = 0
    rank[-1] = 0
    rank[first] = 0
    return hashes, starts, _chosen(rank)


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Places in order of their rank, the first of equal ones first, ``MIN_WORDS`` apart at least; rank 0 is none."""
    reach = MIN_WORDS - 1
    left = np.pad(rank, reach)
    chosen = np.zeros(len(left), bool)
    around = np.arange(-reach, reach + 1)
    for _ in range(CUT_ROUNDS):
        most, width = left, 1
        while width < reach:
            step = min(width, reach - width)
            most = np.maximum(most[:-step], most[step:])
            width += step
        own = left[reach:-reach]
        taken = np.flatnonzero((own > most[: len(own)]) & (own >= most[reach + 1 :])) + reach
        chosen[taken] = True
        left[(taken[:, None] + around).ravel()] = 0
    for place in (lambda at: at[np.lexsort((at, ~left[at]))])(np.flatnonzero(left)).tolist():
        if left[place]:
            chosen[place] = True
            left[place - reach : place + reach + 1] = 0
    return np.flatnonzero(chosen) - reach


def paragraphs_of(text: str) -> list[tuple[int, int]]:
    """Bounds of the paragraphs; together they make up the text."""
    return cut_text(text)[0]


@dataclass
class Paragraphs:
    """The paragraphs of ``MIN_WORDS`` words or more of some texts, with their shingles end to end.

    As they are cut, shingles stand in the order of the text and may repeat; ``picked``
    makes sets of them.
    """

    text: np.ndarray
    number: np.ndarray
    words: np.ndarray
    flat: np.ndarray
    starts: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.flat)))

    def picked(self, kept: np.ndarray) -> Paragraphs:
        """Some of the paragraphs, the shingles of each a sorted set."""
        sizes = self.sizes()[kept]
        which = np.repeat(np.arange(len(kept)), sizes)
        flat = self.flat[np.repeat(self.starts[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(which))]
        order = np.lexsort((flat, which))
        flat, which = flat[order], which[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (which[1:] != which[:-1])
        flat, which = flat[new], which[new]
        return Paragraphs(
            self.text[kept], self.number[kept], self.words[kept], flat, np.searchsorted(which, np.arange(len(kept)))
        )

    def classes(self) -> np.ndarray:
        """A name for each (picked) set, equal for equal sets."""
        sizes = self.sizes().astype(np.uint64)
        return np.add.reduceat(mixed(self.flat + np.repeat(sizes, self.sizes())), self.starts).view(np.int64)


def paragraph_shingles(texts: list[str | None], shingle: int) -> Paragraphs:
    """Paragraphs of a list of texts (about ``CHUNK_CHARS`` long in all); ``shingle`` is ``MIN_WORDS`` at most."""
    data, begin = _joined(texts)
    hashes, places, cuts = cut_words(data, begin)
    first = np.searchsorted(places, begin)
    filled = np.diff(np.append(first, len(hashes))) > 0
    starts = np.sort(np.concatenate([first[filled], cuts]))
    counts = np.diff(np.append(starts, len(hashes)))
    text = np.searchsorted(first[filled], starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(text, text)
    text = np.flatnonzero(filled)[text]
    made = np.full(max(0, len(hashes) - shingle + 1), shingle, np.uint64)
    for offset in range(shingle):
        made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + hashes[offset : len(made) + offset])
    kept = np.flatnonzero(counts >= MIN_WORDS)
    sizes = counts[kept] - shingle + 1
    which = np.repeat(np.arange(len(kept)), sizes)
    at = np.repeat(starts[kept], sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Paragraphs(text[kept], number[kept], counts[kept], made[at], np.cumsum(sizes) - sizes)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in lists of about ``CHUNK_CHARS``, each with the place of its first."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS or at == len(texts) - 1:
            yield first, texts[first : at + 1]
            first, size = at + 1, 0


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:n] | np.uint64(1), numbers[n:]


def band_hashes(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of each (non-empty) set, one line a set; sets lie end to end in ``flat``."""
    factors, shifts = _permutations(bands * rows)
    made = np.empty((len(starts), bands), np.uint64)
    if not len(starts):
        return made
    high = flat ^ (flat >> np.uint64(29))
    spans = _spans(starts, len(flat))
    for band in range(bands):
        code = np.full(len(starts), band + 1, np.uint64)
        for at in range(band * rows, (band + 1) * rows):
            least = _least(high * factors[at] + shifts[at], starts, spans)
            code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + least)
        made[:, band] = code
    return made


def _spans(starts: np.ndarray, end: int) -> tuple[int, list[np.ndarray]]:
    """The size of the smallest set, and where so many values in a row start that cover each set; none if that takes more than ``MOST_SPANS``."""
    sizes = np.diff(np.append(starts, end))
    width = int(sizes.min())
    n_spans = -(-int(sizes.max()) // width)
    return width, [starts + np.minimum(k * width, sizes - width) for k in range(n_spans if n_spans <= MOST_SPANS else 0)]


def _least(values: np.ndarray, starts: np.ndarray, spans: tuple[int, list[np.ndarray]]) -> np.ndarray:
    """The least value of each set: of sets alike in size by minima of all ``width`` values in a row, as sets are short."""
    width, covers = spans
    if not covers:
        return np.minimum.reduceat(values, starts)
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    least = values[covers[0]]
    for cover in covers[1:]:
        np.minimum(least, values[cover], out=least)
    return least


FOUND = "row bigint, doc_id bigint, number int, class bigint, words int, size int, tokens array<bigint>, bands array<bigint>"


def colliding_paragraphs(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Paragraphs (of ``row, doc_id, text``) with a band that another document has too."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bands = n_bytes // 64 * bands
    n_buckets = bucket_count(n_bands)

    def owned_of(batch: pa.RecordBatch) -> Iterator[Owned]:
        owners = batch.column(0).to_pylist()
        for first, chunk in _chunks(batch.column(1).to_pylist()):
            found = paragraph_shingles(chunk, shingle)
            codes = band_hashes(found.flat, found.starts, bands, rows)
            cuts = np.searchsorted(found.text, np.arange(len(chunk) + 1))
            for at in range(len(chunk)):
                own = np.unique(codes[cuts[at] : cuts[at + 1]])
                yield owners[first + at], len(own), own

    shared = stage(shared_hashes(texts.select("row", "text"), owned_of, n_bands), "shared-bands")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            for first, chunk in _chunks(batch.column(2).to_pylist()):
                made = paragraph_shingles(chunk, shingle)
                codes = band_hashes(made.flat, made.starts, bands, rows)
                names = token_names(codes.reshape(-1), n_buckets).reshape(-1, bands)
                cuts = np.searchsorted(made.text, np.arange(len(chunk) + 1))
                hit = np.zeros(names.shape, bool)
                for at in range(len(chunk)):
                    own = slice(cuts[at], cuts[at + 1])
                    hit[own] = np.isin(names[own], lists[first + at].values.to_numpy())
                kept = np.flatnonzero(hit.any(axis=1))
                sets = made.picked(kept)
                at = sets.text + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owners[at]), pa.array(docs[at]), pa.array(sets.number.astype(np.int32)),
                        pa.array(sets.classes()), pa.array(sets.words.astype(np.int32)),
                        pa.array(sets.sizes().astype(np.int32)),
                        _lists(sets.flat.view(np.int64), sets.sizes()),
                        _lists(names[kept][hit[kept]], hit[kept].sum(axis=1)),
                    ],
                    schema=_FOUND_SCHEMA,
                )

    met = texts.join(shared.select(F.col("owner").alias("row"), F.col("tokens").alias("bands")), "row")
    return met.select("row", "doc_id", "text", "bands").mapInArrow(found, FOUND)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


_FOUND_SCHEMA = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()), ("class", pa.int64()),
    ("words", pa.int32()), ("size", pa.int32()), ("tokens", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
])


def repeated_paragraphs(
    texts: DataFrame, shingle: int = 5, percent: int = 80, recall: float = 0.998
) -> DataFrame:
    """``row, doc_id, number, words, root, first_doc`` of paragraphs that lie in two documents or more."""
    bands, rows = tune_bands(percent, recall)
    found = stage(colliding_paragraphs(texts, shingle, bands, rows), "colliding-paragraphs")
    classes = stage(
        found.groupBy("class").agg(
            F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("bands").alias("bands")
        ), "paragraph-classes",
    )
    posts = classes.select(
        F.explode("bands").alias("token"), F.col("class").alias("group"), F.lit(1.0).alias("closeness"), F.lit(1).alias("members")
    )
    members = classes.select(F.col("class").alias("group"), F.col("class").alias("owner"), "size", "tokens")
    roots = connected_components(links_at_hubs(posts, members, percent)).withColumnRenamed("node", "class")
    rooted = (
        found.select("row", "doc_id", "number", "words", "class")
        .join(roots, "class", "left")
        .select("row", "doc_id", "number", "words", F.coalesce("root", "class").alias("root"))
    )
    rooted = stage(rooted, "paragraph-roots")
    release(found, classes)
    spread = rooted.groupBy("root").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # Staged, so that the join stands right above its exchanges and a hot root can be split.
    spread = stage(spread.where("first_doc < last_doc").drop("last_doc"), "root-spread")
    return rooted.join(spread, "root")


def passages(words: list[int], repeated: set[int], min_run: int) -> set[int]:
    """Repeated paragraphs in runs of ``min_run`` words or more; short paragraphs do not end a run."""
    taken, run, n_words = set(), [], 0
    for number in [*range(len(words)), None]:
        if number is not None and number in repeated:
            run.append(number)
            n_words += words[number]
        elif number is None or words[number] >= MIN_WORDS:
            taken.update(run if n_words >= min_run else ())
            run, n_words = [], 0
    return taken


WINDOWS = "row bigint, doc_id bigint, start int, code bigint, wanted boolean"


def window_codes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each ``PASSAGE_WORDS`` words in a row, of the hashes of the words."""
    if len(hashes) < PASSAGE_WORDS:
        return np.empty(0, np.uint64)
    factor = 0x9E3779B97F4A7C15
    powers = np.full(len(hashes), factor, np.uint64).cumprod()
    undone = np.full(len(hashes), pow(factor, -1, 1 << 64), np.uint64).cumprod()
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers, dtype=np.uint64))
    return mixed((sums[PASSAGE_WORDS:] - sums[:-PASSAGE_WORDS]) * undone[: len(hashes) - PASSAGE_WORDS + 1])


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a range from ``low`` to before ``high``."""
    filled = low < high
    return np.cumsum(np.bincount(low[filled], minlength=n + 1) - np.bincount(high[filled], minlength=n + 1))[:n] > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the paragraphs ``numbers`` of a text, those in short runs (``short``) wanted."""
    for batch in batches:
        rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, chunk in _chunks(batch.column(2).to_pylist()):
            data, begin = _joined(chunk)
            hashes, places, cuts = cut_words(data, begin)
            first = np.searchsorted(places, begin)
            last = np.append(first[1:], len(hashes))
            bounds = np.append(np.unique(np.concatenate([first, cuts])), len(hashes))
            codes = window_codes(hashes)

            def around(lists: pa.ListArray) -> np.ndarray:
                text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                own = np.searchsorted(bounds, first)[text] + lists.flatten().to_numpy()
                low = np.maximum(first[text], bounds[own + 1] - PASSAGE_WORDS)
                return _covered(len(codes), low, np.minimum(bounds[own], last[text] - PASSAGE_WORDS) + 1)

            wanted = around(batch.column(4).slice(at, len(chunk)))
            found = np.flatnonzero(wanted | around(batch.column(3).slice(at, len(chunk))))
            text = np.searchsorted(first, found, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[at + text]), pa.array(docs[at + text]), pa.array((found - first[text]).astype(np.int32)),
                    pa.array(codes[found].view(np.int64)), pa.array(wanted[found]),
                ],
                names=[c.split()[0] for c in WINDOWS.split(", ")],
            )


def common_windows(texts: DataFrame, repeated: DataFrame, min_run: int) -> DataFrame:
    """``row, starts, window_docs``: windows around too short runs that a smaller id has too.

    A window is known by its first word. The other documents of such paragraphs
    take part whatever the length of their runs.
    """
    later = repeated.where("doc_id <> first_doc").select("row", "number", "words", "root").distinct()
    own = Window.partitionBy("row").orderBy("number")
    runs = later.withColumn("run", F.col("number") - F.row_number().over(own))
    length = F.sum("words").over(Window.partitionBy("row", "run"))
    short = stage(runs.withColumn("length", length).where(F.col("length") < min_run).select("row", "number", "root"), "short-runs")
    # Staged, so that few roots are broadcast and ``repeated`` is not dealt by root, where one may be hot.
    roots = stage(short.select("root").distinct(), "short-roots")
    near = repeated.join(roots, "root", "left_semi").groupBy("row").agg(
        F.collect_set("number").alias("numbers")
    )
    near = near.join(short.groupBy("row").agg(F.collect_set("number").alias("short")), "row", "left").select(
        "row", "numbers", F.coalesce("short", F.array().cast("array<int>")).alias("short")
    )
    windows = texts.join(stage(near, "short-run-rows"), "row").select("row", "doc_id", "text", "numbers", "short")
    windows = stage(windows.mapInArrow(_windows, WINDOWS), "windows")
    shared = windows.groupBy("code").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = stage(shared.where("least < most").select("code", "least"), "shared-windows")
    return windows.where("wanted").join(shared, "code").where("doc_id > least").groupBy("row").agg(
        F.collect_set("start").alias("starts"), F.collect_set("least").alias("window_docs")
    )


def _left(text: str, gone: set[int], windows: list[int], cut: Cut, places: np.ndarray) -> tuple[str, int]:
    """The text without paragraphs ``gone`` and windows, and how many paragraphs lost words; its words start at ``places``."""
    bounds, counts, n_words = cut
    if not windows:
        return "".join(text[a:b] for k, (a, b) in enumerate(bounds) if k not in gone), len(gone)
    covered = np.zeros(n_words + 1, bool)
    for start in windows:
        covered[start : start + PASSAGE_WORDS] = True
    kept, lost, first = [], len(gone), 0
    for k, ((a, b), n) in enumerate(zip(bounds, counts, strict=True)):
        own = covered[first : first + n]
        if k not in gone and own.any():
            at = [a, *places[first + 1 : first + n].tolist(), b]
            kept += [text[at[i] : at[i + 1]] for i in np.flatnonzero(~own)]
            lost += 1
        elif k not in gone:
            kept.append(text[a:b])
        first += n
    return "".join(kept), lost


def _without(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, numbers, starts = (batch.column(batch.schema.names.index(n)) for n in ("__text", "__numbers", "__starts"))
        touched = np.asarray(numbers.is_valid())
        removed, by_run = np.zeros(len(touched), np.int64), np.zeros(len(touched), bool)
        kept, rows = [], np.flatnonzero(touched).tolist()
        cut = texts.filter(numbers.is_valid()).to_pylist()
        for at, text, (own, places) in zip(rows, cut, cut_texts(cut), strict=True):
            windows = starts[at].as_py() or []
            gone = passages(own[1], set(numbers[at].as_py()), min_run)
            left, removed[at] = _left(text, gone, windows, own, places) if gone or windows else (text, 0)
            kept.append(left)
            by_run[at] = len(gone) > 0
        left_over = pc.replace_with_mask(texts, pa.array(touched), pa.array(kept, texts.type))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-3], left_over, pa.array(removed), pa.array(by_run)],
            names=[*batch.schema.names[:-3], "__kept", "__removed", "__by_run"],
        )


def remove_repeated_paragraphs(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    recall: float = 0.998,
    min_run: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns of ``docs`` with the text cut, and ``__removed, __first_docs``.

    Repeated paragraphs go where ``min_run`` words or more of them lie together, and
    with the words around them where those make ``PASSAGE_WORDS`` in common: a stock
    phrase alone stays. ``__removed`` counts the paragraphs that lost words;
    ``__first_docs`` lists the documents that keep what was removed here.
    """
    row = F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))
    texts = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    repeated = stage(repeated_paragraphs(texts, shingle, percent, recall), "repeated-paragraphs")
    gone = repeated.where("doc_id <> first_doc").groupBy("row").agg(
        F.collect_set("number").alias("__numbers"), F.sort_array(F.collect_set("first_doc")).alias("__first_docs"),
        F.sum("words").alias("__words"),
    )
    windows = common_windows(texts, repeated, min_run).withColumnsRenamed({"starts": "__starts", "window_docs": "__window_docs"})
    # Texts with too few repeated words for any run, and without windows, stay as they are.
    gone = gone.join(windows, "row", "left").where((F.col("__words") >= min_run) | F.col("__starts").isNotNull())
    gone = stage(gone.drop("__words").withColumnRenamed("row", "__row"), "removed-paragraphs")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    none = F.array().cast("array<bigint>")
    joined = docs.withColumn("__row", row).join(gone, "__row", "left").select(
        *others, F.coalesce("__first_docs", none).alias("__first_docs"),
        F.coalesce("__window_docs", none).alias("__window_docs"), F.col(text_col).alias("__text"), "__numbers", "__starts",
    )
    kinds = dict(joined.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in joined.columns[:-3])
    cut = joined.mapInArrow(
        lambda batches: _without(batches, min_run), f"{ddl}, __kept string, __removed bigint, __by_run boolean"
    )
    by_run = F.when(F.col("__by_run"), F.col("__first_docs")).otherwise(none)
    return cut.select(
        *[F.col("__kept").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        "__removed",
        F.sort_array(F.array_union(by_run, "__window_docs")).alias("__first_docs"),
    )
