"""Word-level overlap between sides and pauses inside utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["call_id", "side", "utt_num"]
BIN_SECONDS = 10.0
LONG_PAUSE = 0.25


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions: left to itself Spark merges them to a few large ones, whose rows a task then sorts at once."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def merge_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Touching or overlapping intervals (start, end) of each group as one: gaps and islands."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return new.withColumn("island", island).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _bins(df: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = F.floor(F.col(start) / BIN_SECONDS), F.floor(F.col(end) / BIN_SECONDS)
    return df.withColumn("bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def word_overlap(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """(key, overlap_sec, overlap_count, overlap_onset): own words against the other side's words of the call.

    A range join in time bins: both sides' intervals go to each bin they touch, and a pair counts in the later of their first
    bins only. Candidates touch the utterance's word bounds; the duration is the measure of own and their merged spans.
    """
    span = words.groupBy(*KEY).agg(F.min("start").alias("u_start"), F.max("end").alias("u_end"))
    own = merge_spans(words.select(*KEY, "start", "end"), *KEY)
    other = F.when(F.col("side") == "A", "B").otherwise("A")
    heard = words.select("call_id", other.alias("side"), F.col("utt_num").alias("o_utt"), F.col("i").alias("o_i"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    met = _bins(own, "start", "end").join(_bins(heard, "o_start", "o_end"), ["call_id", "side", "bin"])
    met = met.where((F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start")) & (F.col("bin") == F.floor(F.greatest("start", "o_start") / BIN_SECONDS)))
    count = met.groupBy(*KEY).agg(F.countDistinct("o_utt", "o_i").alias("overlap_count"))
    cut = met.select(*KEY, F.greatest("start", "o_start").alias("start"), F.least("end", "o_end").alias("end"))
    seconds = merge_spans(cut, *KEY).groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("overlap_sec"))
    at_onset = _bins(span.select(*KEY, "u_start", F.col("u_start").alias("u_same")), "u_start", "u_same").join(_bins(heard, "o_start", "o_end"), ["call_id", "side", "bin"]).where((F.col("o_start") <= F.col("u_start")) & (F.col("u_start") < F.col("o_end"))).select(*KEY).distinct().withColumn("onset", F.lit(1))
    out = utterances.select(*KEY).join(span, KEY, "left").join(count, KEY, "left").join(seconds, KEY, "left").join(at_onset, KEY, "left")
    known = F.col("u_start").isNotNull()
    return out.select(*KEY, F.when(known, F.round(F.coalesce("overlap_sec", F.lit(0.0)), 6)).alias("overlap_sec"), F.when(known, F.coalesce("overlap_count", F.lit(0))).cast("int").alias("overlap_count"), F.when(known, F.coalesce("onset", F.lit(0))).alias("overlap_onset"))


def pauses(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """(key, pause_total, pause_count, pause_rate, pause_max): gaps between an utterance's words; null without words."""
    order = Window.partitionBy(*KEY).orderBy("start", "end", "token")
    gap = F.round(F.lead("start").over(order) - F.col("end"), 6)
    dealt = spread(words.select(*KEY, "start", "end", "token"), *KEY)
    g = dealt.withColumn("gap", gap).groupBy(*KEY).agg(
        F.sum(F.when(F.col("gap") > 0, F.col("gap")).otherwise(0.0)).alias("total"),
        F.count_if(F.col("gap") >= LONG_PAUSE).alias("n"),
        F.max(F.when(F.col("gap") > 0, F.col("gap")).otherwise(0.0)).alias("longest"),
        (F.max("end") - F.min("start")).alias("span"),
    )
    rate = F.when(F.col("span") > 0, F.col("total") / F.col("span")).otherwise(0.0)
    found = g.select(*KEY, F.round("total", 6).alias("pause_total"), F.col("n").cast("int").alias("pause_count"), F.round(rate, 6).alias("pause_rate"), F.round("longest", 6).alias("pause_max"))
    return utterances.select(*KEY).join(found, KEY, "left")
