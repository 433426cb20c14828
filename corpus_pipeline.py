"""A corpus in five stages, each an operator of ``wayspark.llm``. Every stage is written and read again by the next one.

A stage that needs a further table (labels, benchmark) reads it from ``sf_dir``. All but the last return the columns of ``documents``.
Null ids, repeated rows, empty texts and empty tables are handled as the operators say. SQL cannot express the fit of the first stage,
so ``ORACLE_SQL`` is None and the run is tested against a brute-force version of each stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm import decontaminate, jaccard, mixing, repeats, toxicity
from wayspark.llm._scratch import table
from wayspark.session import ship_code, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship_code(spark)
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    ship_code(spark)
    return jaccard.first_of_class(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out; documents of which no word is left go, those that had none stay as they are."""
    ship_code(spark)
    cut = repeats.remove_repeats(docs.select(*COLUMNS)).filter("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship_code(spark)
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes."""
    ship_code(spark)
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages),
          ("benchmark decontamination", benchmark_leaks), ("source mix", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
