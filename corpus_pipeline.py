"""A corpus from raw documents to packed token files, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read back as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakeep.llm.additive_model import fit_quality, score_quality
from stratakeep.llm.decontaminate import decontaminate
from stratakeep.llm.mixing import mix
from stratakeep.llm.near_documents import near_documents
from stratakeep.llm.queries import ship, table
from stratakeep.llm.store import new_path
from stratakeep.llm.tokenise import digest, tokenise_to_files

TOKENIZER, VOCABULARY = "word_bpe_49k.json", 49_408


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.3 or more; the others go."""
    ship(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model, "row")
    return scored.where(F.col("score") >= 0.3).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, J >= 0.8), that of the least doc_id.

    Rows of one doc_id are one document, of which the one of the least text that is there stays; rows without a
    doc_id all stay.
    """
    ship(spark)
    kept = near_documents(docs, shingle=5).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    known = docs.join(kept, docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = known.groupBy(F.col("doc_id").alias("kept_id")).agg(F.min_by(F.struct(*columns), F.struct(F.col("text").isNull(), "text", F.xxhash64(*columns))).alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are mostly benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix; sources that the targets lift come again."""
    ship(spark)
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files in the order of the mix, and of each document in them: doc_id, start, n_tokens, ids_crc32.

    That order is the one in which the mix stage's table was written: by task, file and row.
    """
    ship(spark)
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("long")
    place = F.shiftleft(number(r"^part-(\d+)"), 44) + F.shiftleft(F.coalesce(number(r"-c(\d+)\."), F.lit(0)), 32) + F.col("_metadata.row_index")
    placed = docs.select("doc_id", "text", place.alias("mix_place"))
    return digest(tokenise_to_files(placed, public_tokenizers.path(TOKENIZER), VOCABULARY, order="mix_place"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixed),
    ("token_files", token_files),
]

#: Trained models, hashing and a tokenizer are beyond SQL; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result goes through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
