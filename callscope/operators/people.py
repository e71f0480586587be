"""Speakers and topics joined to calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sex(raw: Column) -> Column:
    """male or female; anything else is an error."""
    s = F.upper(F.trim(raw))
    return F.when(s == "MALE", "male").when(s == "FEMALE", "female").otherwise(F.raise_error(F.concat(F.lit("unrecognized sex: "), F.coalesce(raw, F.lit("null")))))


def region(raw: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin("", "UNK"), "unk").otherwise(F.replace(F.lower(s), F.lit(" "), F.lit("_")))


def generation(year: Column) -> Column:
    return F.when(year <= 1926, "GI").when(year <= 1944, "Silent").when(year <= 1964, "Baby_Boomer").otherwise("Generation_X")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def normalised_callers(callers: DataFrame) -> DataFrame:
    """(caller, gender, region, birth_year, generation, decade, education); callers without a numeric birth year go."""
    year = F.col("birth_year").try_cast("int")
    return callers.where(year.isNotNull()).select("caller", sex(F.col("sex")).alias("gender"), region(F.col("dialect")).alias("region"), year.alias("birth_year"), generation(year).alias("generation"), decade(year).alias("decade"), F.col("education").cast("string").alias("education"))


def with_demographics(utterances: DataFrame, sides: DataFrame, callers: DataFrame, strict: bool = False) -> DataFrame:
    """Adds the speaker's columns by (call_id, side); with `strict` an utterance without a speaker is an error.

    The caller tables are joined as they are: Spark broadcasts them while they are small.
    """
    who = sides.join(normalised_callers(callers), "caller")
    out = utterances.join(who, ["call_id", "side"], "left")
    return out.withColumn("caller", F.when(F.col("caller").isNull(), F.raise_error(F.lit("an utterance has no speaker")).cast("long")).otherwise(F.col("caller"))) if strict else out


def roles_to_sides(conversations: DataFrame) -> DataFrame:
    """(call_id, caller_from, caller_to) -> (call_id, side, caller): the calling party is side A."""
    return conversations.select("call_id", F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("caller_from").alias("caller")), F.struct(F.lit("B").alias("side"), F.col("caller_to").alias("caller")))).alias("r")).select("call_id", "r.*")


def with_topic(calls: DataFrame, conversations: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds topic by the call's topic number; UNK if it is no number, names no topic or the call is unknown."""
    known = conversations.select("call_id", F.col("topic_no").try_cast("int").alias("topic_no"))
    return calls.join(known, "call_id", "left").join(topics, "topic_no", "left").withColumn("topic", F.coalesce("topic", F.lit("UNK"))).drop("topic_no")


def mapped_rows(utterances: DataFrame, sides: DataFrame) -> DataFrame:
    """Utterances with their caller; those of unmapped sides are dropped (see unmapped_count)."""
    return utterances.join(sides, ["call_id", "side"])


def unmapped_count(utterances: DataFrame, sides: DataFrame) -> DataFrame:
    return utterances.join(sides, ["call_id", "side"], "left_anti").agg(F.count(F.lit(1)).alias("n_unmapped"))
