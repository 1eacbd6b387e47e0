"""The registered queries of this package: name -> job over (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm import (
    decontaminate,
    host_quality,
    importance,
    jaccard_join,
    length_buckets,
    oracles,
    paragraph_dedup,
    shard_shuffle,
    suffix_dedup,
    token_counts,
    token_frames,
    toxicity,
    warc_index,
    whitening,
)
from storegrain.workspace import stage

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_host_quality": oracles.OP1,
    "op10_decontamination": oracles.OP10,
    "op11_warc_index": oracles.OP11,
    "op12_importance_resampling": oracles.OP12,
}

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
END_ID = 2
SHARDS = 24
TOXIC_FROM = 0.5


def query(job: Query) -> Query:
    REGISTERED[job.__name__] = job
    return job


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_host_quality(spark, sf_dir):
    return host_quality.judge_documents(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_failed",
    )


@query
def op2_shard_shuffle(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shard_shuffle.shuffle_into_shards(docs, SHARDS, seed=17).select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce("record.text", F.lit(""))).alias("text_crc32"),
        F.lit(shard_shuffle.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_token_counts(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    return token_counts.count_tokens(documents(spark, sf_dir), path).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


@query
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_documents(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id"
    )


@query
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.coalesce(F.size("lows"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


@query
def op6_paragraph_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = paragraph_dedup.remove_repeated_paragraphs(docs)
    return cut.select(
        "doc_id",
        F.col("__removed").alias("n_removed"),
        F.col("__first_docs").alias("first_docs"),
        "text",
    )


@query
def op7_toxicity_chain(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain).select(
        "doc_id",
        F.col("__p_quality").alias("p_quality"),
        F.col("__p_toxic").alias("p_toxic"),
        (F.col("__p_toxic") >= TOXIC_FROM).alias("toxic"),
    )


@query
def op8_length_buckets(spark, sf_dir):
    lengths = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return length_buckets.pack(lengths)


@query
def op9_token_frames(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    index = token_frames.write_token_files(documents(spark, sf_dir), path, END_ID)
    read = token_frames.read_token_files(token_frames.with_starts(index))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_decontamination(spark, sf_dir):
    """One row a document: rows equal in id and text have one verdict."""
    docs = documents(spark, sf_dir)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op11_warc_index(spark, sf_dir):
    """Every page is looked up in the index by its URL and read from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc_index.archive(pages, least_bytes=0)
    found = warc_index.find_captures(index, pages.select("url"))
    records = stage(warc_index.read_records(index, found, with_payload=False), "records")
    return warc_index.resolve_revisits(index, records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("original_page").alias("refers_to")
    )


@query
def op12_importance_resampling(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = importance.resample(
        documents(spark, sf_dir), benchmark, percent=10, seed=2024, n_buckets=10_000, max_run=1, min_words=20
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_embedding_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, count=8).withColumn("deviation", F.col("deviation").cast("bigint"))
