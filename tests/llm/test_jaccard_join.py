"""The similarity join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from corpora import SCHEMA, components, frame, rows, shingles

from storegrain.llm import jaccard_join as J
from storegrain.llm import shared_hashes
from storegrain.llm.components import connected_components


def brute(table: list[tuple]) -> list[tuple]:
    sets = [shingles(r[1]) for r in table]
    roots = components(sets)
    least: dict[int, int] = {}
    for row, root in zip(table, roots, strict=True):
        if row[0] is not None:
            least[root] = min(least.get(root, row[0]), row[0])
    return sorted(
        ((r[0], len(s), least.get(root) if s else r[0]) for r, s, root in zip(table, sets, roots, strict=True)), key=str
    )


@pytest.mark.parametrize(("seed", "entries", "tile"), [(1, 3_000_000, 2000), (2, 500, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, entries, tile):
    """Also with many small buckets and with hubs cut into tiles."""
    monkeypatch.setattr(shared_hashes, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(J, "TILE", tile)
    got = J.similar_documents(frame(spark, seed)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows(seed))


def test_members_of_a_hub_that_miss_its_centre_still_meet():
    chosen = random.Random(4)
    sets = [frozenset(chosen.sample(range(30), chosen.randint(5, 25))) for _ in range(150)]
    sets += [sets[0] | {99}, sets[1] - set(list(sets[1])[:1])]
    links = J._shard_links(hub_table([(0, 0, 0, k, s) for k, s in enumerate(sets)]), 80).to_pydict()
    root = list(range(len(sets)))
    for u, v in zip(links["u"], links["v"], strict=True):
        root[u] = v
    assert root == components(sets)


def hub_table(members: list[tuple]) -> pa.Table:
    """Members as (hub, a, b, owner, set)."""
    hub, a, b, owner, sets = zip(*members, strict=True)
    return pa.table({
        "hub": pa.array(hub, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
        "owner": pa.array(owner, pa.int64()), "size": pa.array(map(len, sets), pa.int32()),
        "tokens": pa.array([sorted(s) for s in sets], pa.list_(pa.int64())),
    })


def test_hubs_of_a_shard_stay_apart():
    """Hubs of one, two and more members, some members met twice, in any order."""
    chosen = random.Random(6)
    members, wanted = [], []
    for hub in range(200):
        base = set(chosen.sample(range(60), 20))
        owners = chosen.sample(range(1000), chosen.choice([1, 2, 2, 2, 3, 5]))
        sets = [frozenset(base - set(chosen.sample(sorted(base), chosen.randint(0, 3)))) for _ in owners]
        own = [(hub % 50, hub // 50, 0, o, s) for o, s in zip(owners, sets, strict=True)]
        members += own + own[: chosen.randint(0, 1)]
        order = sorted(range(len(owners)), key=owners.__getitem__)
        roots = components([sets[k] for k in order])
        wanted += [(owners[order[k]], owners[order[r]]) for k, r in enumerate(roots) if r != k]
    chosen.shuffle(members)
    links = J._shard_links(hub_table(members), 80).to_pydict()
    assert sorted(zip(links["u"], links["v"], strict=True)) == sorted(wanted)


def test_short_and_empty_sets():
    assert len(J.shingle_set(None, 5)) == len(J.shingle_set(" \n", 5)) == 0
    assert len(J.shingle_set("a b c", 5)) == len(J.shingle_set("a b c d e", 5)) == 1
    assert np.array_equal(J.shingle_set("A b", 5), J.shingle_set("a B", 5))
    assert not np.array_equal(J.shingle_set("Éa", 5), J.shingle_set("éa", 5))


def test_empty_table(spark):
    assert J.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_and_stars(spark):
    chosen = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    edges = [(a, b) if chosen.random() < 0.5 else (b, a) for a, b in edges]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
