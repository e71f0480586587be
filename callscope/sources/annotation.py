"""Gold annotation from XML through Spark's xml source, and corpus tables without header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"sw(\d{4})\.([AB])\.[A-Za-z]+\.xml$"


def _xml(spark: SparkSession, root: str, layer: str, tag: str, schema: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{layer}.xml").schema(schema).load(root)
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, _NAME, 1).cast("int").alias("call_id"), F.regexp_extract(path, _NAME, 2).alias("side"), *raw.columns)


def _ids(children: Column) -> Column:
    """Terminal ids out of child references."""
    return F.coalesce(F.transform(F.filter(children, lambda c: c["_href"].isNotNull()), lambda c: F.regexp_extract(c["_href"], r"#id\(([^)]+)\)", 1)), F.array().cast("array<string>"))


def read_dialacts(spark: SparkSession, root: str) -> DataFrame:
    """(call_id, side, da_id, nite_type, tag, ids)."""
    raw = _xml(spark, root, "dialAct", "da", "`_nite:id` string, _niteType string, _swbdType string, `nite:child` array<struct<_href: string>>")
    return raw.select("call_id", "side", F.col("`_nite:id`").alias("da_id"), F.col("_niteType").alias("nite_type"), F.col("_swbdType").alias("tag"), _ids(F.col("`nite:child`")).alias("ids"))


def read_terminals(spark: SparkSession, root: str) -> DataFrame:
    """(call_id, side, terminal_id, orth, pos, start, end) of the timed words; others are skipped."""
    raw = _xml(spark, root, "terminals", "word", "`_nite:id` string, _orth string, _pos string, `_nite:start` string, `_nite:end` string")
    t = raw.select("call_id", "side", F.col("`_nite:id`").alias("terminal_id"), F.col("_orth").alias("orth"), F.col("_pos").alias("pos"), F.col("`_nite:start`").try_cast("double").alias("start"), F.col("`_nite:end`").try_cast("double").alias("end"))
    return t.where("start IS NOT NULL AND end IS NOT NULL")


def read_disfluencies(spark: SparkSession, root: str) -> DataFrame:
    """(call_id, side, disfluency_id, reparandum_ids, repair_ids); a missing repair has no ids."""
    part = "struct<`nite:child`: array<struct<_href: string>>>"
    raw = _xml(spark, root, "disfluency", "disfluency", f"`_nite:id` string, reparandum {part}, repair {part}")
    return raw.select("call_id", "side", F.col("`_nite:id`").alias("disfluency_id"), _ids(F.col("reparandum.`nite:child`")).alias("reparandum_ids"), _ids(F.col("repair.`nite:child`")).alias("repair_ids"))


def _csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Header-less quoted rows of at least `width` fields, as _c0, _c1 ..., blanks and stray quotes stripped."""
    schema = ", ".join(f"_c{i} string" for i in range(width))
    raw = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return raw.select(*[F.trim(F.replace(f"_c{i}", F.lit('"'), F.lit(""))).alias(f"_c{i}") for i in range(width)])


def read_callers(spark: SparkSession, path: str) -> DataFrame:
    """(caller, sex, birth_year, dialect, education); rows without a number are skipped."""
    c = _csv(spark, path, 7)
    return c.select(F.col("_c0").try_cast("long").alias("caller"), F.col("_c3").alias("sex"), F.col("_c4").alias("birth_year"), F.col("_c5").alias("dialect"), F.col("_c6").alias("education")).where("caller IS NOT NULL AND education IS NOT NULL")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, caller_from, caller_to, topic_no)."""
    c = _csv(spark, path, 5)
    return c.select(F.col("_c0").try_cast("long").alias("call_id"), F.col("_c2").try_cast("long").alias("caller_from"), F.col("_c3").try_cast("long").alias("caller_to"), F.col("_c4").alias("topic_no")).where("call_id IS NOT NULL")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic_no, topic)."""
    c = _csv(spark, path, 2)
    return c.select(F.col("_c1").try_cast("int").alias("topic_no"), F.col("_c0").alias("topic")).where("topic_no IS NOT NULL")


def read_sides(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, side, caller)."""
    c = _csv(spark, path, 3)
    return c.select(F.col("_c0").try_cast("long").alias("call_id"), F.col("_c1").alias("side"), F.col("_c2").try_cast("long").alias("caller")).where("call_id IS NOT NULL AND caller IS NOT NULL")
