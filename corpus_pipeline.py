"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import decontaminate, near_dedup, packing, substring_dedup, toxicity
from callscope.llm._frames import let_go, read, remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay, each row by its own text; null and empty texts score as clean ones."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id.

    A null id or a text without words belongs to no group and stays; rows that repeat an id go or stay together.
    """
    away = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("away_id")).distinct()
    return docs.join(away, docs["doc_id"] == away["away_id"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; a text loses the passages that a smaller id has, an exact copy all of its words. Null texts stay null, rows with a null id whole."""
    return _measured(substring_dedup.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go. Null and empty texts stay; ids and repeats play no part."""
    return _measured(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end token alone, rows that repeat an id are documents of their own."""
    return packing.pack(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("decontamination", cut_benchmark), ("packing", pack)]

#: SQL can't express the classifier and the tokenizer; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written as Parquet in the shared folder and read again."""
    docs, path = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        last, path = path, scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        let_go(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
