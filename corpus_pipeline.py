"""Clean a document corpus: language, near copies, benchmark passages, packing.

Every stage reads what its predecessor kept. Rows a filtering stage keeps are unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab.llm import decontam, language, packing, partenum
from ticketlab.operators.order_stats import delete, pin, shared_folder


# What a task hands to its Python worker at a time, whatever the lengths of the texts.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of workers; rows and results do not depend on it.

    A stage is run after its function has returned, so the setting stays for the session.
    """
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language that makes up half of the text or more."""
    small_batches(spark)
    model = language.learn(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out()))
    rows = docs.select(F.struct("*").alias("row"), "text")
    judged = language.identify(rows, model, id_col="row")
    return judged.filter(language.accepted()).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    A row is named by its id and a hash of all its columns, so that rows which repeat an
    id with another text are not mixed up; of rows equal in all columns one stays. Rows
    whose name is kept and not repeated pass in the scan, those of the other names (and a
    few with the same hash) are the only ones that are shuffled.
    """
    small_batches(spark)
    name = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns))
    rows = docs.select(F.struct("*").alias("row"), name.alias("name"), "text")
    groups = partenum.similar_groups(rows, id_col="name")
    named = pin(
        groups.groupBy(F.col("name").alias("id"))
        .agg(F.count("*").alias("n"), F.max(F.col("name") == F.col("component_id")).alias("kept"))
    )
    doubtful = partenum.perhaps_in(named.filter("n > 1 or not kept").select("id"), "name")
    told = rows.select("row", "name", doubtful.alias("doubtful"))
    kept = named.filter("kept").select(F.col("id").alias("name"))
    looked_up = told.filter("doubtful").join(kept, "name", "left_semi").dropDuplicates(["name"])
    return told.filter("not doubtful").select("row.*").union(looked_up.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no test item, neither as it is nor edited."""
    small_batches(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("languages", languages),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("packed", packed),
]
ORACLE_SQL = None  # near copies and alignment scores have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = None
    for name, stage in STAGES:
        out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if folder:
            delete(spark, folder)
        folder = out
    return docs
