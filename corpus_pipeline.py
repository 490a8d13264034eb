"""Cleaning pipeline of a text corpus: five stages, each an operator of cardloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again for the
next one. All but the last return the columns of ``documents``. As a stage's result is written before the next begins,
each stage deletes what the operators of the ones before have left in the shared folder (not its own input).

Rows are never lost to nulls: a null language or source is a value of its own to the mixture, a null id counts as last
and is kept, a null or empty text has no language and goes in the first stage. Repeated rows are near copies of each
other. Extra columns are left out. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import bpe, jaccard, langid, mixing, substring
from cardloom.llm.shared import clear, workspace, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
BUDGET_PERCENT, MAX_EPOCHS = 90, 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of LEAST_SCORE or more; lang becomes the predicted one."""
    clear(spark, docs)
    found = langid.predict(docs.select(*COLUMNS), langid.learned(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id (null last), and every row that is linked with none.

    Rows are told apart by a key of their own, so rows that share an id, or have none, are decided by their texts.
    """
    clear(spark, docs)
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), workspace(spark))
    links = jaccard.link_classes(rows.withColumn("doc_id", F.col("_row"))).select(F.col("doc_id").alias("_row"), "component_id")
    ranked = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("_rank")).join(links, "_row")
    firsts = ranked.groupBy("component_id").agg(F.min("_rank").alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(firsts, "_row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that occur earlier; one that keeps nothing stays, empty."""
    clear(spark, docs)
    found = substring.dedup(docs.select(*COLUMNS))
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budgets of their sources: one row for each reading, the last reading of a source cut to fit."""
    clear(spark, docs)
    mixed = mixing.mix(docs.select(*COLUMNS), BUDGET_PERCENT, MAX_EPOCHS)
    readings = F.col("copies") + F.when(F.col("cut_tokens") > 0, 1).otherwise(0)
    rows = mixed.where(readings > 0).withColumn("_reading", F.explode(F.sequence(F.lit(1).cast("long"), readings)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_reading") > F.col("copies"), F.array_join(F.slice(words, F.lit(1), F.col("cut_tokens").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes of each reading."""
    clear(spark, docs)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("mix_sources", mixture),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, workspace(spark))
    return docs
