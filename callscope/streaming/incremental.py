"""Manifest and feature tables that grow with new transcript files, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.sources import tables

_LINE = r"^\s*sw(\d{4})([AB])-ms98-a-(\d{4,})\s+(\S+)\s+(\S+)\s+(.*?)\s*$"


def utterance_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (call_id, side, utt_num, start, end, text) from the transcript files that arrive below root; bad lines are dropped."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*-trans.text").text(root)
    part = lambda i: F.regexp_extract("value", _LINE, i)
    return raw.where(F.col("value").rlike(_LINE)).select(part(1).cast("long").alias("call_id"), part(2).alias("side"), part(3).cast("long").alias("utt_num"), part(4).try_cast("double").alias("start"), part(5).try_cast("double").alias("end"), part(6).alias("text")).where("start IS NOT NULL AND end IS NOT NULL")


def grow_manifest(utterances: DataFrame, manifest_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the manifest rows of new files and stops when none is left.

    Each batch writes its own folder, replaced if the batch runs again, so that a failure between write and commit leaves no row twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        rows = tables.build_manifest(batch.dropDuplicates(tables.KEY))
        rows.write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")

    return utterances.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_to_compute(rows: DataFrame, cached: DataFrame, key: list[str], version: str, required: str | None = None) -> DataFrame:
    """Rows that the cache doesn't hold under this version, or holds without the required value."""
    good = cached.where(F.col("version") == version)
    good = good.where(F.col(required).isNotNull()) if required else good
    return rows.join(good.select(*key), key, "left_anti")


def with_cache(rows: DataFrame, cached: DataFrame, compute, key: list[str], version: str, required: str | None = None) -> DataFrame:
    """The feature rows of all rows: cached ones where they are good, computed ones elsewhere."""
    missing = rows_to_compute(rows, cached, key, version, required)
    new = compute(missing).withColumn("version", F.lit(version))
    old = cached.where(F.col("version") == version).join(missing.select(*key), key, "left_anti").join(rows.select(*key), key, "left_semi")
    return old.unionByName(new)
