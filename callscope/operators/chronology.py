"""Each call's merged chronology and look-ups in it. All windows share one partitioning, by call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import text as X

KEY = ["call_id", "side", "utt_num"]


def by_call() -> Window:
    """Chronological order; ties keep side A before B."""
    return Window.partitionBy("call_id").orderBy("start", "end", "utt_num", "side")


def position(utterances: DataFrame) -> DataFrame:
    """Adds position, from 1."""
    return utterances.withColumn("position", F.row_number().over(by_call()))


def predecessor(utterances: DataFrame) -> DataFrame:
    """Adds the text, side and end of the utterance before, whatever its side, and turn_gap to its end."""
    w = by_call()
    out = utterances.select("*", F.lag("text").over(w).alias("prev_text"), F.lag("side").over(w).alias("prev_side"), F.lag("end").over(w).alias("prev_end"))
    return out.withColumn("turn_gap", F.col("start") - F.col("prev_end"))


def other_side_before(utterances: DataFrame) -> DataFrame:
    """Adds other_text: the nearest earlier utterance of the other side."""
    w = by_call().rowsBetween(Window.unboundedPreceding, -1)
    a = F.last(F.when(F.col("side") == "A", F.col("text")), ignorenulls=True).over(w)
    b = F.last(F.when(F.col("side") == "B", F.col("text")), ignorenulls=True).over(w)
    return utterances.withColumn("other_text", F.when(F.col("side") == "A", b).otherwise(a))


def intervening_talk(utterances: DataFrame) -> DataFrame:
    """Adds intervening: whether the other side spoke since this side's previous utterance; null for a side's first."""
    placed = position(utterances)
    own = Window.partitionBy("call_id", "side").orderBy("position")
    return placed.withColumn("intervening", F.col("position") - F.lag("position").over(own) > 1)


def mutual_revelation(utterances: DataFrame, anecdote: Column) -> DataFrame:
    """Adds mutual_revelation: null for a call's first utterance, 0 after the same side, else whether both are anecdotes."""
    w = by_call()
    told = utterances.withColumn("anecdote", anecdote)
    first = F.lag("side").over(w).isNull()
    both = F.col("anecdote") & F.lag("anecdote").over(w)
    return told.withColumn("mutual_revelation", F.when(first, None).when(F.lag("side").over(w) == F.col("side"), 0).otherwise(both.cast("int")))


def text_features(utterances: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """All row-local features of the text, and named columns of one's own: split once, then one projection over the parts."""
    t, seconds = F.col("text"), F.col("end") - F.col("start")
    some = F.when(t.contains("["), F.filter(X.words(t), X.is_bracket)).when(t.isNotNull(), F.array().cast("array<string>"))
    split = utterances.select(*KEY, seconds.alias("seconds_"), X.tokens(t).alias("tokens_"), some.alias("brackets_"), X.content_words(t).alias("content_"), X.is_backchannel(t).alias("backchannel"), *extra)
    own = split.columns[-len(extra) :] if extra else []
    parts = split.select("*", X.joined(F.col("tokens_")).alias("line_"), X.repetitions(F.col("tokens_")).alias("repeated_"), X.bracket_events_of(F.col("brackets_")).alias("events_"))
    line, again, seconds = F.col("line_"), F.col("repeated_"), F.col("seconds_")
    hits, count = X.filler_hits_of(line), F.when(F.col("tokens_").isNotNull(), F.size("tokens_"))
    return parts.select(
        *KEY,
        count.alias("token_count"),
        X.per_second(count, seconds).alias("word_rate"),
        X.per_second(X.syllables_of(line), seconds).alias("syllable_rate"),
        hits.alias("filler_hits"),
        X.per_second(hits, seconds).alias("fillers_per_second"),
        X.per_second(again["types"], seconds).alias("repetitions_per_second"),
        again["pairs"].alias("repetitions_current"),
        *[F.col("events_")[c].alias(c) for c in ("laughter", "laughed_words", "noise", "vocalized_noise", "other")],
        X.question_flag_of(F.col("content_")).alias("question_flag"),
        X.question_flag_after_markers_of(F.col("content_")).alias("question_after_markers"),
        "backchannel",
        *own,
    )


def question_flags(utterances: DataFrame) -> DataFrame:
    """(key, question_flag, echo_flag)."""
    q = X.question_flag(F.col("text"))
    return other_side_before(utterances).select(*KEY, q.alias("question_flag"), X.echo_flag(q, F.col("text"), F.col("other_text")).alias("echo_flag"))


def repetitions_previous(utterances: DataFrame) -> DataFrame:
    """(key, repetitions_previous): token pairs shared with the predecessor; null for a call's first utterance."""
    return predecessor(utterances).select(*KEY, F.when(F.col("prev_text").isNotNull(), X.shared_pairs(F.col("text"), F.col("prev_text"))).alias("repetitions_previous"))


def syllables(utterances: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """(key, syllables): sum over tokens of the pronunciation table's count, or of vowel groups for words it lacks; 0 without tokens.

    pronunciations: (word, syllables), of any size; the greatest count of a word that is in it more than once.
    """
    known = pronunciations.where("syllables IS NOT NULL").groupBy(F.lower("word").alias("t")).agg(F.max("syllables").cast("long").alias("known"))
    t = utterances.select(*KEY, F.explode_outer(X.tokens(F.col("text"))).alias("t"))  # not grouped by token first: that would hold every token of a task
    each = F.coalesce("known", X.vowel_groups(F.col("t")), F.lit(0)).cast("long")
    return t.join(known, "t", "left").groupBy(*KEY).agg(F.sum(each).alias("syllables"))


def syllable_rate(utterances: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """(key, syllable_rate): per second; null without a positive duration."""
    s = utterances.select(*KEY, (F.col("end") - F.col("start")).alias("seconds")).join(syllables(utterances, pronunciations), KEY)
    return s.select(*KEY, X.per_second(F.col("syllables"), F.col("seconds")).alias("syllable_rate"))
