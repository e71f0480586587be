"""Turns, floor transfers, latching and overlap kinds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from callscope.functions import text as X
from callscope.operators import order

KEY = ["call_id", "side", "utt_num"]
LATCH_SECONDS, OBSTRUCTIVE_SECONDS = 0.2, 1.0


def word_bounds(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """Adds w_start, w_end: first start and last end of the utterance's words, or its own bounds without any."""
    tight = words.groupBy(*KEY).agg(F.min("start").alias("ws"), F.max("end").alias("we"))
    return utterances.join(tight, KEY, "left").withColumn("w_start", F.coalesce("ws", "start")).withColumn("w_end", F.coalesce("we", "end")).drop("ws", "we")


def _walk(batches):
    """One pass over rows sorted by call and time; the state of a single call is carried across batches."""
    call = side_now = turn_end = None
    last_end: dict[str, float] = {}
    for batch in batches:
        kinds, refs = [], []
        for c, side, start, end, bc in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            if c != call:
                call, side_now, turn_end, last_end = c, None, None, {}
            if bc and side != side_now:
                kinds.append("bc")
                refs.append(turn_end)
                continue
            if side_now is None:
                kinds.append("first")
                refs.append(None)
                side_now, turn_end = side, end
            elif side == side_now:
                kinds.append("cont")
                refs.append(last_end.get(side, 0.0))
                turn_end = max(turn_end, end)
            elif end <= turn_end:
                kinds.append("interj")
                refs.append(turn_end)
            else:
                kinds.append("transfer")
                refs.append(turn_end)
                side_now, turn_end = side, end
            last_end[side] = max(last_end.get(side, 0.0), end)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(kinds, pa.string()), pa.array(refs, pa.float64())], [*batch.schema.names[:6], "kind", "ref_end"])


def turn_events(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """(key, w_start, w_end, lex_bc, kind, ref_end), kind one of first, cont, bc, interj, transfer.

    The walk depends on order, so a call is walked in one task; rows carry no text and stream through in Arrow
    batches, so a call of any length needs constant memory.
    """
    rows = word_bounds(utterances, words).select(*KEY, "w_start", "w_end", X.is_backchannel(F.col("text")).alias("lex_bc"), "start", "end")
    ordered = rows.repartition("call_id").sortWithinPartitions("call_id", "w_start", "w_end", "utt_num", "start", "end", "side").select(*KEY, "w_start", "w_end", "lex_bc")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(_walk, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", kind string, ref_end double")


def transfer_columns(events: DataFrame) -> DataFrame:
    """Adds fto, onset_gap, turn_initial, backchannel, interjection, latching, cooperative, obstructive."""
    kind, start, ref = F.col("kind"), F.col("w_start"), F.col("ref_end")
    gap = F.round(start - ref, 6)
    fto = F.when(kind == "transfer", gap)
    overlapped = ref.isNotNull() & (start < ref) & kind.isin("bc", "interj", "transfer")
    obstructive = overlapped & (kind == "transfer") & (F.round(ref - start, 6) <= OBSTRUCTIVE_SECONDS)
    return events.select(
        *KEY, "kind", "w_start", "w_end", "ref_end",
        fto.alias("fto"),
        F.when(kind.isin("cont", "interj", "transfer"), gap).alias("onset_gap"),
        kind.isin("first", "transfer").cast("int").alias("turn_initial"),
        F.when(kind == "bc", 1).when(kind == "cont", F.col("lex_bc")).otherwise(0).alias("backchannel"),
        (kind == "interj").cast("int").alias("interjection"),
        latching(fto).alias("latching"),
        (overlapped & ~obstructive).cast("int").alias("cooperative"),
        obstructive.cast("int").alias("obstructive"),
    )


def latching(fto: Column) -> Column:
    """1 iff 0 <= fto <= 0.2; null without one."""
    return F.when(fto.isNotNull(), fto.between(0.0, LATCH_SECONDS).cast("int"))


def attach(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Manifest rows (key, text) with their transfer columns; a row without an event has nulls, and backchannel from its text."""
    out = manifest.join(transfer_columns(events), KEY, "left")
    return out.withColumn("backchannel", F.coalesce("backchannel", X.is_backchannel(F.col("text"))))


def rollup(features: DataFrame) -> DataFrame:
    """Corpus totals of events."""
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("kind") == "transfer").alias("n_transfers"),
        F.count("fto").alias("n_fto"),
        F.sum("turn_initial").alias("n_initial"),
        F.sum("backchannel").alias("n_backchannels"),
        F.sum("interjection").alias("n_interjections"),
        F.round(F.avg("latching"), 6).alias("latch_rate"),
        F.sum("cooperative").alias("n_cooperative"),
        F.sum("obstructive").alias("n_obstructive"),
        F.round(F.try_divide(F.sum("obstructive"), F.sum(F.col("cooperative") + F.col("obstructive"))), 6).alias("obstructive_share"),
        F.count_if(F.col("kind").isNull()).alias("n_unplaceable"),
    )


def transfer_summary(features: DataFrame, *by: str) -> DataFrame:
    """Number, median, mean, share below 0 and within [-1, 2] of floor-transfer offsets, by the given columns."""
    defined = features.where(F.col("fto").isNotNull())
    median = order.percentiles(defined, ["fto"], [0.5], list(by))
    rows = [(*g, q["fto", 0.5]) for g, q in median.items()]
    fields = [StructField(b, defined.schema[b].dataType) for b in by]
    medians = features.sparkSession.createDataFrame(rows, StructType([*fields, StructField("median_fto", DoubleType())]))
    out = defined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("fto"), 6).alias("mean_fto"),
        F.round(F.avg((F.col("fto") < 0).cast("double")), 6).alias("overlap_share"),
        F.round(F.avg(F.col("fto").between(-1, 2).cast("double")), 6).alias("window_share"),
        F.round(F.avg("latching"), 6).alias("latch_rate"),
    )
    joined = order.matched(out, F.broadcast(medians), list(by)) if by else out.crossJoin(F.broadcast(medians))
    return joined.withColumn("median_fto", F.round("median_fto", 6))
