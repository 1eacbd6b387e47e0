"""Similarity join of documents on word shingles: a grouped prefix join.

Documents with equal shingle sets form a class, which is joined once. Shingles
that only one class has can't be in an intersection: a class with too few shared
shingles is out, and the others go on with their shared shingles alone, rarest
first. Of those the prefix filter keeps as many as a linked partner must touch.
Classes with equal prefixes and size are collapsed into a group; groups that share
a prefix shingle meet, and only then are groups expanded and members verified.

Groups that share a shingle gather at one hub instead of pair by pair, so a large
group of copies costs one row a member. At a hub, members that link with its
centre need no test among themselves, as components are all that is asked; each
other member is tested against all. A hub with more than ``TILE`` members is cut
into tiles, each pair of tiles a task.

Defined results: without words or text a document has an empty set and links with
nothing; fewer than ``shingle`` words make one shingle; rows without id take part
and never name a component; an empty table gives no rows. Shingles are compared by
hash; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.llm.components import connected_components
from storegrain.llm.memos import only
from storegrain.llm.shared_hashes import Owned, shared_hashes
from storegrain.workspace import stage

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
REMEMBERED_WORDS = 500_000
TILE = 2000
SHARD_TOKENS = 1_000_000


class WordHashes(dict):
    """Hash of each word; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def word_hashes() -> WordHashes:
    return only("word-hashes", WordHashes)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    made = np.full(len(words) - size + 1, size, np.uint64)
    for at in range(size):
        made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + hashes[at : len(words) - size + 1 + at])
    return np.unique(made)


def set_class(shingles: np.ndarray) -> int:
    """Names a set: equal for equal sets."""
    return int(mixed(shingles + np.uint64(len(shingles))).sum().astype(np.int64)) if len(shingles) else 0


def document_classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, n_shingles, class`` of each row of ``doc_id, text``."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(set_class, sets), pa.int64())],
                names=["doc_id", "n_shingles", "class"],
            )

    return docs.mapInArrow(classed, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, class bigint")


Edges = tuple[np.ndarray, np.ndarray]


def _hub_links(owners: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, percent: int) -> Edges:
    """Members (distinct) of a hub with the least member that they reach by links among them."""
    lengths = np.diff(offsets)
    holders = np.repeat(np.arange(len(owners)), lengths)
    by_token = np.argsort(tokens, kind="stable")
    held = holders[by_token]
    names, first = np.unique(tokens[by_token], return_index=True)
    counts = np.diff(np.append(first, len(tokens)))
    place = np.searchsorted(names, tokens)
    roots = np.arange(len(owners))

    def link(member: int) -> np.ndarray:
        own = place[offsets[member] - offsets[0] : offsets[member + 1] - offsets[0]]
        spans = counts[own]
        inside = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        common = np.bincount(held[np.repeat(first[own], spans) + inside], minlength=len(owners))
        linked = 100 * common >= percent * (sizes + sizes[member] - common)
        linked[member] = True
        return linked

    centre = int(np.lexsort((owners, -lengths / sizes))[0])
    linked = link(centre)
    roots[linked] = roots[linked].min()
    for member in np.flatnonzero(~linked):
        touched = np.unique(roots[link(member)])
        if len(touched) > 1:
            roots[np.isin(roots, touched)] = touched[0]
    away = roots != np.arange(len(owners))
    return owners[away], owners[roots[away]]


def _shard_links(table: pa.Table, percent: int) -> pa.Table:
    """Links at all hubs of a shard; those of two members are compared all at once."""
    keys = [table.column(c).to_numpy() for c in ("hub", "a", "b", "owner")]
    order = np.lexsort(keys[::-1])
    changes = [np.diff(key[order]) != 0 for key in keys]
    new_hub = np.concatenate([[True], changes[0] | changes[1] | changes[2]])
    single = new_hub | np.concatenate([[True], changes[3]])
    order, new_hub = order[single], new_hub[single]
    owners, sizes = keys[3][order], table.column("size").to_numpy()[order].astype(np.int64)
    lists = table.column("tokens").combine_chunks()
    flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(bounds)[order]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    tokens = flat[np.repeat(bounds[:-1][order] - bounds[0] - offsets[:-1], lengths) + np.arange(offsets[-1])]
    first = np.flatnonzero(new_hub)
    count = np.diff(np.append(first, len(owners)))
    # Two members: what both have stands twice among the tokens of the hub.
    pair = first[count == 2]
    hub = np.repeat(np.cumsum(new_hub) - 1, lengths)
    paired = np.flatnonzero(count[hub] == 2)
    by = paired[np.lexsort((tokens[paired], hub[paired]))]
    twice = (tokens[by[1:]] == tokens[by[:-1]]) & (hub[by[1:]] == hub[by[:-1]])
    common = np.bincount(hub[by[1:]][twice], minlength=len(first))[count == 2]
    linked = 100 * common >= percent * (sizes[pair] + sizes[pair + 1] - common)
    found = [(owners[pair + 1][linked], owners[pair][linked])]
    for low, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        own = offsets[low : low + n + 1]
        found.append(_hub_links(owners[low : low + n], sizes[low : low + n], tokens[own[0] : own[-1]], own - own[0], percent))
    u, v = (np.concatenate(side) for side in zip(*found, strict=True))
    return pa.table({"u": u, "v": v})


def class_links(docs: DataFrame, n_shingles: int | None, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Edges ``u, v`` between linked classes: enough of them to connect what links connect."""

    def owned_of(batch: pa.RecordBatch) -> Iterator[Owned]:
        for text in batch.column(0):
            shingles = shingle_set(text.as_py(), shingle)
            yield set_class(shingles), len(shingles), shingles

    found = stage(shared_hashes(docs.select("text"), owned_of, n_shingles, percent), "shared-shingles")
    needed = F.ceil(F.col("size") * percent / 100).cast("int")
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - needed + 1)
    members = found.withColumn("group", F.xxhash64("size", prefix))
    posts = members.groupBy("group").agg(
        F.first(prefix).alias("prefix"), F.max(closeness()).alias("closeness"), F.count(F.lit(1)).alias("members")
    ).select("group", "closeness", "members", F.explode("prefix").alias("token"))
    return links_at_hubs(stage(posts, "prefix-posts"), members, percent)


def closeness() -> Column:
    """The part of a set that others share: near 1 for what a group of copies has in common."""
    return F.size("tokens") / F.col("size")


def links_at_hubs(posts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges ``u, v`` that connect all members which link and meet at a token.

    ``posts`` (``token, group, closeness, members``) says which groups hold a
    token, ``members`` (``group, owner, size, tokens``, quick to read) who belongs to
    a group. Groups of a token gather at its closest group, the hub. Most hubs are
    small, so a task takes shards of many hubs, of about ``SHARD_TOKENS`` tokens.
    """
    hubs = posts.groupBy("token").agg(
        F.max_by("group", F.struct("closeness", "group")).alias("hub"), F.sum("members").alias("met")
    ).where("met > 1")
    stars = stage(posts.join(hubs, "token").select("hub", "group", "members").distinct(), "hub-groups")
    tiles = stars.groupBy("hub").agg(F.ceil(F.sum("members") / TILE).alias("tiles"), F.sum("members").alias("met"))
    rows = tiles.where("met > 1").agg(F.sum(F.col("met") * F.col("tiles"))).first()[0] or 0
    mean = members.agg(F.avg(F.size("tokens"))).first()[0] or 0
    n_shards = max(1, math.ceil(rows * mean / SHARD_TOKENS))
    met = (
        stars.join(tiles.where("met > 1").select("hub", "tiles"), "hub")
        .join(members, "group")
        .withColumn("side", F.pmod(F.xxhash64("owner"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        .select("hub", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"),
                "owner", "size", "tokens")
    )
    shard = F.pmod(F.xxhash64("hub", "a", "b"), F.lit(n_shards)).alias("shard")
    return met.groupBy(shard).applyInArrow(lambda table: _shard_links(table, percent), "u bigint, v bigint")


def similar_documents(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, class, component_id`` of each row.

    ``component_id`` is the least id reachable by links of ``percent`` of Jaccard
    similarity or more, the row's own included.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classed = stage(document_classes(texts, shingle), "shingle-classes")
    total = classed.agg(F.sum("n_shingles")).first()[0]
    links = class_links(texts, total, shingle, percent)
    roots = connected_components(links).withColumnRenamed("node", "class")
    filled = classed.where("n_shingles > 0")
    classes = filled.groupBy("class").agg(F.min("doc_id").alias("first_id"))
    rooted = stage(
        classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "class-roots"
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("named_id")), "root")
    joined = classed.join(
        named.select("class", "named_id"), "class", "left"
    )
    own = F.when(F.col("n_shingles") > 0, F.col("named_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", "class", own.alias("component_id"))
