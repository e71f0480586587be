"""Transcript, word and audio-inventory readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = r"^sw(\d{4})([AB])-ms98-a-(\d{4,})$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_FILE = r"sw(\d{4})([AB])-ms98-a-(?:trans|word)\.text$"


def _lines(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The non-empty lines of all files of a kind below root: (path, parts)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*-{kind}.text").text(root)
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.split(line, r"\s+", 4).alias("parts")).where(line != "")


def _number(text: Column) -> Column:
    """A finite number, null for anything else."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _fields(lines: DataFrame, text_name: str) -> DataFrame:
    part = lambda i: F.get("parts", F.lit(i))
    return lines.select(
        "path",
        F.size("parts").alias("n"),
        part(0).alias("id"),
        F.regexp_extract(part(0), _ID, 1).try_cast("int").alias("call_id"),
        F.nullif(F.regexp_extract(part(0), _ID, 2), F.lit("")).alias("side"),
        F.regexp_extract(part(0), _ID, 3).try_cast("int").alias("utt_num"),
        _number(part(1)).alias("start"),
        _number(part(2)).alias("end"),
        part(3).alias(text_name),
        F.regexp_extract("path", _FILE, 1).try_cast("int").alias("file_call"),
        F.nullif(F.regexp_extract("path", _FILE, 2), F.lit("")).alias("file_side"),
    )


def read_utterances(spark: SparkSession, root: str, mode: str = "strict") -> DataFrame:
    """(call_id, side, utt_num, start, end, text). Lines of fewer than four fields are skipped.

    strict: a bad id, an id of another file or a bad number fails the job, naming the line; tolerant: such lines are dropped.
    """
    f = _fields(_lines(spark, root, "trans"), "text").where("n >= 4")
    good = F.col("call_id").isNotNull() & F.col("call_id").eqNullSafe(F.col("file_call")) & F.col("side").eqNullSafe(F.col("file_side")) & F.col("start").isNotNull() & F.col("end").isNotNull()
    if mode == "strict":
        problem = F.concat(F.lit("bad transcript line in "), F.col("path"), F.lit(": "), F.col("id"))
        f = f.withColumn("call_id", F.when(good, F.col("call_id")).otherwise(F.raise_error(problem).cast("int")))
    elif mode == "tolerant":
        f = f.where(good)
    else:
        raise ValueError(f"mode must be strict or tolerant, not {mode!r}")
    return f.select("call_id", "side", "utt_num", "start", "end", "text")


def read_words(spark: SparkSession, root: str) -> DataFrame:
    """(call_id, side, utt_num, start, end, token); malformed lines and those that end before they start are dropped."""
    f = _fields(_lines(spark, root, "word"), "token").where("n >= 4")
    good = F.col("call_id").isNotNull() & (F.col("call_id") == F.col("file_call")) & (F.col("side") == F.col("file_side")) & (F.col("end") >= F.col("start"))
    return f.where(good).select("call_id", "side", "utt_num", "start", "end", F.trim("token").alias("token"))


def audio_index(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(call_id, side, path) of the audio files below root, from their listing alone; two paths for one side are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    name = F.regexp_extract("path", r"sw(\d{4})([AB])[^/]*$", 1)
    keyed = files.select(name.try_cast("int").alias("call_id"), F.regexp_extract("path", r"sw(\d{4})([AB])[^/]*$", 2).alias("side"), "path").where("call_id IS NOT NULL")
    one = keyed.groupBy("call_id", "side").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.max("path").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two audio files for one side: "), F.col("path"), F.lit(", "), F.col("other")))
    return one.select("call_id", "side", F.when(F.col("n") == 1, F.col("path")).otherwise(clash).alias("path"))


def index_to_json(index: DataFrame) -> DataFrame:
    """(value) JSON lines of an audio index, for a text sink."""
    return index.select(F.to_json(F.struct("call_id", "side", "path")).alias("value"))


def index_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", "call_id int, side string, path string").alias("x")).select("x.*").where("call_id IS NOT NULL")


def resolve_audio(units: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units with their path, units without audio)."""
    return units.join(index, ["call_id", "side"]), units.join(index, ["call_id", "side"], "left_anti")


def without_transcript(units: DataFrame, utterances: DataFrame) -> DataFrame:
    """Wanted units (call_id, side) that have no utterance, each once with the reason; the others can be worked on."""
    lost = units.select("call_id", "side").distinct().join(utterances.select("call_id", "side"), ["call_id", "side"], "left_anti")
    return lost.withColumn("reason", F.lit("transcript missing"))
