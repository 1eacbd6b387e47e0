"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of ``window`` consecutive words (one window if it
has fewer); a window is a set of word shingles. Shingles are ordered by how often
the corpus holds them. A document that contains a window contains all its
shingles, hence also the rarest one: that prefix of one shingle is what is joined.
The position of the shingle in the window gives where the window would lie; it
must begin and end inside the document (positional and length bound), and then its
words are compared one by one with the document's.

Only DataFrame functions. The big side is scanned and exploded next to a
broadcast table of the items' shingles, if those are counted to be few, and
shuffled to it otherwise.

Defined results: null texts and texts without words match nothing; an item
without words has no window; items with the same words are each reported; rows
with one id are judged by their own text; empty tables give no hits. Other
columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.workspace import stage, stage_counted

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of (hash, size) that are broadcast at most: about 64 MB in memory.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; none for null."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def shingle_hash(words: Column, at: Column, size: Column | int) -> Column:
    """Hash of ``size`` words from position ``at`` (from 0)."""
    length = F.lit(size) if isinstance(size, int) else size
    return F.xxhash64(length, F.slice(words, at + 1, length))


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Each window of each item: ``item_id, window_text, length``."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - length))
    return items.select("item_id", "words", length.alias("length"), starts.alias("start")).select(
        "item_id", "length", F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ").alias("window_text")
    )


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """The shingles of each distinct window: ``window_text, length, size, offset, hash``."""
    words = F.split("window_text", " ")
    sized = windows.select("window_text", "length").distinct().withColumn(
        "size", F.least(F.lit(shingle), "length")
    )
    offsets = F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset")
    return sized.select("*", offsets).withColumn("hash", shingle_hash(words, F.col("offset"), F.col("size")))


def shingle_matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], window: int, few: bool) -> DataFrame:
    """Where documents hold one of the shingles: row key, ``n_words, hash, pos``.

    ``docs`` has the row key and ``words``. Hashes of all sizes are exploded as
    one array, in which those of each size follow one another. Next to a broadcast
    table the rows also get the words ``around`` the shingle, from word ``begin``
    on: the exploded rows share their document's words and are not copied.
    """
    n_words = F.size("words")

    def hashes(size: int) -> Column:
        places = F.sequence(F.lit(0), n_words - size)
        made = F.transform(places, lambda at: shingle_hash(F.col("words"), at, size))
        return F.when(n_words >= size, made).otherwise(F.array().cast("array<bigint>"))

    arrays = [hashes(size) for size in sizes]
    exploded = docs.select(
        "doc_id", "text_hash", n_words.alias("n_words"), *(["words"] if few else []),
        F.posexplode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("at", "hash"),
    )
    known = shingles.select("hash", "size").distinct()
    before, skipped = F.lit(0), []
    for size in sizes:
        skipped.append(F.when(F.col("size") == size, before))
        before = before + F.greatest(F.col("n_words") - size + 1, F.lit(0))
    pos = F.col("at") - F.coalesce(*skipped)
    matched = exploded.join(F.broadcast(known) if few else known, "hash")
    if not few:
        return matched.select("doc_id", "text_hash", "n_words", "hash", pos.alias("pos"))
    begin = F.greatest(pos - window, F.lit(0))
    return matched.select(
        "doc_id", "text_hash", "n_words", "hash", pos.alias("pos"), begin.alias("begin"),
        F.array_join(F.slice("words", begin + 1, F.lit(2 * window)), " ").alias("around"),
    )


def rarest_shingles(shingles: DataFrame, matches: DataFrame) -> DataFrame:
    """The rarest shingle of each window, by occurrences in the corpus, then by hash.

    Windows with a shingle that never occurs are left out: no document holds them.
    """
    seen = matches.groupBy("hash").agg(F.count(F.lit(1)).alias("n_seen"))
    order = F.min_by(F.struct("hash", "offset"), F.struct("n_seen", "hash", "offset")).alias("rarest")
    return (
        shingles.join(seen, "hash", "left")
        .groupBy("window_text", "length")
        .agg(order, F.count_if(F.col("n_seen").isNull()).alias("unseen"))
        .where("unseen = 0")
        .select("window_text", "length", "rarest.hash", "rarest.offset")
    )


def covered_words(spans: Column) -> Column:
    """Words that an array of ``(start, length)`` covers, each counted once."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(done: Column, span: Column) -> Column:
        end = F.greatest(done["end"], span["start"] + span["length"])
        new = end - F.greatest(done["end"], span["start"])
        return F.struct(end.alias("end"), (done["n"] + F.greatest(new, F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), begin, step, lambda done: done["n"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_hash, n_words, spans, n_hit, items`` of each row, also of rows equal in id and text.

    ``spans`` are the places (``start, length`` in words) where a window of an
    item lies, ``items`` the sorted ids of the items with such a window.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text"
    )
    worded = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    windows = stage(item_windows(benchmark, window, item_id_col, item_text_col), "item-windows")
    shingles, n_shingles = stage_counted(window_shingles(windows, shingle), "item-shingles")
    few = n_shingles <= BROADCAST_ROWS
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # 1 to `shingle`
    matches = stage(shingle_matches(worded, shingles, sizes or [shingle], window, few), "shingle-matches")

    prefixes = rarest_shingles(shingles, matches)
    candidates = (
        matches.join(F.broadcast(prefixes) if few else prefixes, "hash")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0 AND start + length <= n_words")
    )
    if not few:
        whole = worded.select("doc_id", "text_hash", F.lit(0).alias("begin"), F.array_join("words", " ").alias("around"))
        candidates = candidates.alias("found").join(
            whole.dropDuplicates(["doc_id", "text_hash"]).alias("texts"), _same_row("found", "texts")
        ).select("found.*", "begin", "around")
    words = F.slice(F.split("around", " "), F.col("start") - F.col("begin") + 1, F.col("length"))
    hits = candidates.where(F.array_join(words, " ") == F.col("window_text"))
    hits = stage(hits.select("doc_id", "text_hash", "start", "length", "window_text").distinct(), "window-hits")

    spans = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans")
    )
    members = windows.select("window_text", "item_id").distinct()
    items = (
        hits.select("doc_id", "text_hash", "window_text").distinct()
        .join(F.broadcast(members) if few else members, "window_text")
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    found = spans.alias("found").join(items.alias("texts"), _same_row("found", "texts")).select("found.*", "items")
    rows = worded.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    no_spans = F.array().cast("array<struct<start:int,length:int>>")
    return (
        rows.alias("texts")
        .join(found.alias("found"), _same_row("texts", "found"), "left")
        .select("texts.doc_id", "texts.text_hash", "n_words", F.coalesce("spans", no_spans).alias("spans"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .withColumn("n_hit", covered_words(F.col("spans")))
    )


def _same_row(left: str, right: str) -> Column:
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("doc_id", "text_hash")]
    return reduce(Column.__and__, pairs)
