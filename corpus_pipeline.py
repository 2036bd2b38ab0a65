"""From documents to token files: five operators in a row, each on what the one before it kept.

Defined cases: rows without doc_id are kept by the duplicate stage, and nothing is dropped for a null in another
column. Of equal rows the duplicate stage keeps one. Columns beyond those of documents pass through every stage but the
last. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incognita.llm import session, toxicity
from incognita.llm.decontamination import contaminated, decontaminate
from incognita.llm.mixing import mix
from incognita.llm.near_duplicates import near_duplicates
from incognita.llm.queries import TOKENIZER
from incognita.llm.token_ids import token_ids


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no column made on the way clashes with one of the row."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str], list[Column]]:
    """docs with its other columns under names that clash with none, these names, and what gives the columns of docs again.

    So a text goes through Python once, and not once more as part of its row.
    """
    others = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in others.items()])
    return named, list(others.values()), [F.col(others.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model sees the labels that op2 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    named, _, back = _carried(docs)
    return toxicity.score(named, model).filter("score < 0.5").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that share 0.8 of their five-word shingles, directly or through others, are one group."""
    kept = near_duplicates(docs, shingle_words=5, percent=80).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = _with_row(docs).select("row", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"))
    stay = rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    # Rows that repeat doc_id and text are one document.
    number = F.row_number().over(Window.partitionBy("id", "version").orderBy("version"))
    one = stay.withColumn("number", number).filter("number = 1")
    return one.select("row.*").union(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    named, others, back = _carried(docs)
    scanned = decontaminate(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", *others))
    return contaminated(scanned).filter("not contaminated").select(back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    copies = mix(docs).filter("taken > 0").groupBy("row_key").agg(F.sum(F.expr("taken div size")).alias("copies"), F.count("*").alias("rows"))
    rows = _with_row(docs).select("row", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    taken = rows.join(copies, F.col("key") == F.col("row_key"))
    # Equal rows share the copies that the mix gives them.
    number = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    own = F.expr("copies div rows + if(number <= copies % rows, 1, 0)").cast("int")
    return taken.withColumn("number", number).select("row", F.explode(F.array_repeat(F.lit(0), own)).alias("copy")).select("row.*")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids begin in the files, how many they are, and their checksum."""
    return token_ids(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-id output", write_token_ids),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    session.prepare(spark)
    folder = f"{session.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
