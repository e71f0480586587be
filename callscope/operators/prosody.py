"""Roll-ups over frames of pitch and loudness, terminal slopes and the marked-question score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators import analysis

KEY = ["call_id", "side", "utt_num"]
WINDOW_SECONDS, MIN_FRAMES, RISE_SEMITONES = 0.3, 3, 3.07
MAX_TOKENS, MAX_ONSET, HIGH_PITCH, MIN_PITCHED = 4, 0.5, 0.75, 10


def semitones(hz: Column) -> Column:
    return 12 * F.log2(hz)


def pitch(frames: DataFrame) -> DataFrame:
    """(key, pitch_mean, pitch_std, pitch_range) over voiced frames, population spread; all null without one."""
    return frames.groupBy(*KEY).agg(F.avg("f0").alias("pitch_mean"), F.stddev_pop("f0").alias("pitch_std"), (F.max("f0") - F.min("f0")).alias("pitch_range"))


def loudness(frames: DataFrame) -> DataFrame:
    """(key, loudness_mean, loudness_std, loudness_range) over frame RMS; 0 is a value."""
    return frames.groupBy(*KEY).agg(F.avg("rms").alias("loudness_mean"), F.stddev_pop("rms").alias("loudness_std"), (F.max("rms") - F.min("rms")).alias("loudness_range"))


def frame_rms(audio: DataFrame, samples: str = "samples", size: int = 512, hop: int = 128, block: str | None = None) -> DataFrame:
    """(key, t, rms) from sample arrays: the root mean square of each Hann-windowed frame, t its first sample.

    An utterance is one row, or several in the order of `block`; frames reach over them.
    """
    rows = audio.select(*KEY, F.col(samples).alias("samples"), (F.col(block) if block else F.lit(0)).alias("block"))
    return analysis.analyse(rows, lambda: lambda: analysis.FrameRms(size, hop), "t long, rms double", ["samples"], ["block"])


def speech_end(bounds: DataFrame) -> DataFrame:
    """(key, anchor): the last word's end, counted from the utterance's start, where it is positive."""
    return bounds.select(*KEY, F.round(F.col("w_end") - F.col("start"), 6).alias("anchor")).where("anchor > 0")


def terminal_slope(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, slope_hz, slope_st, rising): least-squares slopes of the voiced frames in the last 0.3 s before the anchor.

    The anchor is the last frame where there is none; fewer than three voiced frames give no row.
    """
    last = frames.groupBy(*KEY).agg(F.max("t").alias("last"))
    at = last.join(anchors, KEY, "left").select(*KEY, F.coalesce("anchor", "last").alias("anchor"))
    near = frames.join(at, KEY).where(F.col("f0").isNotNull() & (F.col("t") <= F.col("anchor")) & (F.col("t") >= F.round(F.col("anchor") - WINDOW_SECONDS, 6)))
    slopes = near.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("f0", "t").alias("slope_hz"), F.regr_slope(semitones(F.col("f0")), F.col("t")).alias("slope_st")).where(f"n >= {MIN_FRAMES}")
    return slopes.select(*KEY, F.round("slope_hz", 6).alias("slope_hz"), F.round("slope_st", 6).alias("slope_st"), (F.round("slope_st", 6) >= RISE_SEMITONES).cast("int").alias("rising"))


def clip_slope(slope: Column, bound: float = 1000.0) -> Column:
    return F.least(F.greatest(slope, F.lit(-bound)), F.lit(bound))


def side_pitch_baseline(pitch_table: DataFrame) -> DataFrame:
    """(call_id, side, high_pitch): the upper quartile of utterance pitch, for sides with ten pitched utterances."""
    known = pitch_table.where("pitch_mean IS NOT NULL")
    return known.groupBy("call_id", "side").agg(F.percentile("pitch_mean", F.lit(HIGH_PITCH)).alias("high_pitch"), F.count(F.lit(1)).alias("n")).where(f"n >= {MIN_PITCHED}").drop("n")


def marked_question(f: DataFrame) -> DataFrame:
    """(key, mgq_score, mgq_flag) from backchannel, question_flag, rising, token_count, onset_gap, pitch_mean, high_pitch."""
    syntactic = F.coalesce(F.col("question_flag") == 1, F.lit(False))
    intent = syntactic | (F.col("rising") == 1)
    points = 1 + (F.col("token_count") <= MAX_TOKENS).cast("int") + F.coalesce((F.col("onset_gap") <= MAX_ONSET).cast("int"), F.lit(0)) + F.coalesce((F.col("pitch_mean") >= F.col("high_pitch")).cast("int"), F.lit(0))
    score = F.when(F.col("backchannel") == 1, None).when(~syntactic & F.col("rising").isNull(), None).when(~intent, 0).otherwise(points)
    return f.select(*KEY, score.alias("mgq_score"), (score == 4).cast("int").alias("mgq_flag"))


class MissingInput(ValueError):
    """A feature table that a composite needs is absent or lacks columns."""


#: What the marked-question score reads: table -> its columns beside the key.
MARKED_QUESTION_INPUTS = {"question_flags": ["question_flag"], "rising_terminal": ["rising"], "token_count": ["token_count"], "fto": ["onset_gap", "backchannel"], "pitch": ["pitch_mean"]}


def composite(utterances: DataFrame, tables: dict[str, DataFrame], needs: dict[str, list[str]]) -> DataFrame:
    """Utterance keys with the columns of all tables that a composite needs.

    A table that isn't given, or lacks a column, raises MissingInput now; an utterance without a row in a table, or with
    several, fails the job with the table's name. A row may hold nulls.
    """
    for name, columns in needs.items():
        if name not in tables:
            raise MissingInput(f"missing input {name}: compute that feature first")
        lost = [c for c in [*KEY, *columns] if c not in tables[name].columns]
        if lost:
            raise MissingInput(f"{name} has no column {', '.join(lost)}: compute that feature again")
    out = utterances.select(*KEY)
    for name, columns in needs.items():
        rows = tables[name].groupBy(*KEY).agg(*[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("rows_"))
        bad = F.raise_error(F.concat(F.lit(f"{name} has not one row for utterance "), F.concat_ws("/", *KEY)))
        out = out.join(rows, KEY, "left").withColumn("rows_", F.when(F.coalesce(F.col("rows_"), F.lit(0)) != 1, bad.cast("long")).otherwise(F.col("rows_"))).where("rows_ = 1").drop("rows_")
    return out


def marked_question_of(utterances: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """marked_question over the five feature tables, checked by `composite`; high_pitch comes from the pitch table."""
    high = side_pitch_baseline(tables["pitch"]) if "pitch" in tables and "pitch_mean" in tables["pitch"].columns else None
    f = composite(utterances, tables, MARKED_QUESTION_INPUTS)
    return marked_question(f.join(high.withColumn("high_pitch", F.round("high_pitch", 9)), ["call_id", "side"], "left"))
