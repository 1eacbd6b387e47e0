"""The corpus pipeline: stages over documents, each written as Parquet and read again.

A stage works on all that the one before kept. All but the last return the columns
of ``documents``; the last gives each document its place in a batch. Rows without
id pass the stages that compare ids. Where a later stage needs one row an id,
it takes the rows as they come.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm import decontaminate, jaccard_join, length_buckets, paragraph_dedup, token_counts, toxicity
from storegrain.llm.queries import TOKENIZER, TOXIC_FROM
from storegrain.workspace import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxicity.train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, chain)
    return scored.where(F.col("__p_toxic") < TOXIC_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id.

    Where ids repeat, a document is known by its id and the hash of its text: each text
    under an id is judged by itself, of similar ones under the smallest id one stays, and
    rows equal in id and text are one document. Documents without words, and those
    without id, all stay.
    """
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).where("doc_id IS NOT NULL AND __rows > 1")
    again = stage(again.select(F.col("doc_id").alias("__again")), "repeated-ids")
    repeats = not again.isEmpty()
    key = docs["doc_id"]
    if repeats:
        key = F.when(key.isNotNull(), F.struct(key.alias("id"), F.xxhash64(docs["text"]).alias("text_hash")))
    found = jaccard_join.similar_documents(docs.select(key.alias("__key"), "text"), id_col="__key")
    similar = found.where("doc_id IS NOT NULL AND n_shingles > 0 AND doc_id <> component_id")
    similar = similar.select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(stage(similar, "similar-documents"), key == F.col("__gone"), "left_anti")
    if not repeats:
        return kept
    single = kept.join(again, kept["doc_id"] == F.col("__again"), "left_anti")
    repeated = kept.join(again, kept["doc_id"] == F.col("__again"), "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id keeps."""
    cut = paragraph_dedup.remove_repeated_paragraphs(docs)
    size = F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.find_contamination(docs, benchmark).where("n_hit > 0")
    hit = stage(hit.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash")), "contaminated")
    same = docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(docs["text"]) == F.col("__text_hash"))
    return docs.join(hit, same, "left_anti")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in length buckets and batches."""
    return length_buckets.pack(token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("similar", drop_similar),
    ("repeats", cut_repeats),
    ("benchmark", drop_contaminated),
    ("packing", pack_batches),
]

#: The first stage trains a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, job in STAGES:
        docs = stage(job(spark, docs, sf_dir), name)
    return docs
