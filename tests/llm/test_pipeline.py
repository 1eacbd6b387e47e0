"""Registered queries and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import test_decontaminate
import test_paragraph_dedup
from corpora import SCHEMA, components, frame, rows, shingles

from storegrain.llm import queries, token_counts, toxicity

SF_DIR = "/root/testdata/sf0.001"
NUMBERS = range(1, 11)


def test_one_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in queries.REGISTERED) for k in NUMBERS] == [1] * 10
    assert set(queries.ORACLES) <= set(queries.REGISTERED)


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sizes = [docs.count()]
    for name, job in corpus_pipeline.STAGES:
        out = job(spark, docs, SF_DIR)
        if name != "packing":
            assert out.schema == docs.schema, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] == sizes[5] > 100
    assert docs.columns == ["doc_id", "n_tokens", "bucket", "bound", "batch", "slot", "padding"]


def test_one_document_of_each_group_stays(spark):
    table = rows()
    sets = [shingles(r[1]) for r in table]
    roots = components(sets)
    kept = corpus_pipeline.drop_similar(spark, frame(spark), SF_DIR).collect()
    least: dict[int, int] = {}
    for r, root in zip(table, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    gone = {r[0] for r, s, root in zip(table, sets, roots, strict=True) if s and r[0] is not None and r[0] != least[root]}
    wanted = {(r[0], r[1]) for r in table if r[0] not in gone}
    assert {(r.doc_id, r.text) for r in kept} == wanted
    assert len([r for r in kept if r.doc_id is not None]) == len([w for w in wanted if w[0] is not None])


def test_texts_under_one_id_are_judged_by_themselves(spark):
    own, other, third = (" ".join(f"{w}{k}" for k in range(60)) for w in ("a", "b", "c"))
    table = [
        (1, own), (2, f"{own} more"), (2, other), (2, other),  # the first text of 2 goes, the other stays once
        (3, third), (3, f"{third} more"), (3, f"{third} again"),  # similar texts under one id: one stays
        (4, f"{other} more"), (5, "no shingle"), (5, None), (5, ""), (None, own), (None, own),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 1) for i, t in table], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_similar(spark, docs, SF_DIR)
    assert kept.schema == docs.schema
    got = [(r.doc_id, r.text) for r in kept.collect()]
    thirds = [t for i, t in got if i == 3]
    assert len(thirds) == 1 and thirds[0].startswith(third)
    rest = [(1, own), (2, other), (5, "no shingle"), (5, None), (5, ""), (None, own), (None, own)]
    assert sorted((g for g in got if g[0] != 3), key=str) == sorted(rest, key=str)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_and_empty_tables(spark, stage):
    name, job = corpus_pipeline.STAGES[stage]
    for docs in (frame(spark), spark.createDataFrame([], SCHEMA)):
        out = job(spark, docs, SF_DIR)
        assert out.count() <= len(rows())
        if name != "packing":
            assert out.columns == docs.columns


def test_packing_counts_the_tokens_of_what_is_left(spark):
    docs = frame(spark).where("doc_id IS NOT NULL")
    path = public_tokenizers.path(queries.TOKENIZER)
    packed = corpus_pipeline.pack_batches(spark, docs, SF_DIR)
    wanted = token_counts.count_tokens(docs, path)
    assert sorted(packed.select("doc_id", "n_tokens").collect()) == sorted(wanted.select("doc_id", "n_tokens").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    wanted = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    got = queries.REGISTERED[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted.fetchall(), key=str)


def test_run_gives_what_plain_python_gives(spark, tmp_path):
    """All stages one after the other on a table of awkward rows, each computed here by brute force."""
    table = [(r[0], f"{r[1]} Horrid vile words." if r[0] and r[0] % 6 == 0 and r[1] else r[1], *r[2:]) for r in rows(4)]
    spark.createDataFrame(table, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted({r[0] for r in table if r[0] is not None})
    labels = spark.createDataFrame([(i, i % 2, int(i % 6 == 0)) for i in ids], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark = [(k, " ".join((table[k][1] or "").split(" ")[3:20])) for k in (5, 9, 20, 42, 55)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    chain = toxicity.train_chain(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    features = toxicity.WordFeatures(chain.known)
    odds = chain.probabilities([features.of_text(r[1]) for r in table])[:, 1]
    left = [r for r, p in zip(table, odds, strict=True) if p < 0.5]
    assert len(left) < len(table)

    sets = [shingles(r[1]) for r in left]
    roots = components(sets)
    least = {}
    for r, root in zip(left, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    gone = {r[0] for r, s, root in zip(left, sets, roots, strict=True) if s and r[0] is not None and r[0] != least[root]}
    kept = {}
    for k, r in enumerate(left):
        if r[0] not in gone:
            kept.setdefault((r[0], r[1]) if r[0] is not None else k, r)
    assert len(kept) < len(left)

    cut = test_paragraph_dedup.brute(list(kept.values()))
    clean = [(doc, text) for doc, text, _ in cut
             if not any(hit for _, _, hit, _ in test_decontaminate.brute([(doc, text)], benchmark))]
    assert any(n for *_, n in cut) and len(clean) < len(cut)

    tokenizer = token_counts.load_tokenizer(public_tokenizers.path(queries.TOKENIZER))
    wanted = sorted(((doc, len(tokenizer.encode(text or "", add_special_tokens=False).ids)) for doc, text in clean), key=str)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in packed), key=str) == wanted
    assert all(r.padding == r.bound - r.n_tokens >= 0 for r in packed)
