"""Features by name: what each needs and makes, resolved in order, with shared parts worked out once.

Inputs are tables of a kind (utterances, words, frames, tagged tokens, lexicons, people, topics). A part is a table that one or more
features are read from; parts name the inputs and the other parts they need. run_features puts the parts that the wanted features reach in
topological order, makes each once, and merges what they make in one union and grouping by utterance.
"""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.operators import chronology, order, overlap, people, prosody, turns, units
from callscope.sources import tables
from callscope.sources.tables import KEY

#: Inputs that are read by more than the utterance key: kind -> key columns.
KEYS = {"utterances": KEY, "words": KEY, "frames": KEY, "tagged": KEY, "sides": ["call_id", "side", "caller"], "callers": ["caller"], "conversations": ["call_id"], "topics": ["topic_no"], "lexicon": ["term"], "pronunciations": ["word"]}


class Part(NamedTuple):
    """needs: columns of each input; after: the parts it reads and which of their columns; make: the table, from inputs and parts by name."""

    needs: dict[str, tuple[str, ...]]
    make: Callable[[dict[str, DataFrame]], DataFrame]
    after: dict[str, tuple[str, ...]] = {}


class Feature(NamedTuple):
    """needs: columns of the utterances beyond those of its part; makes: output columns, all in the part's table."""

    part: str
    makes: tuple[str, ...]
    needs: tuple[str, ...] = ()


def _text(t: dict[str, DataFrame]) -> DataFrame:
    u = t["utterances"]
    u = u.withColumns({c: F.lit(None).cast("double") for c in ("start", "end") if c not in u.columns})  # rates are null then; features that need them ask for them
    extra = [X.strip_brackets(F.col("text")).alias("stripped_text"), X.may_be_anecdote(F.col("text")).alias("may_be_anecdote")]
    rates = ("word_rate", "syllable_rate", "fillers_per_second", "repetitions_per_second")
    rows = chronology.text_features(u.select(*KEY, "start", "end", "text"), extra)
    return rows.withColumns({c: F.round(c, 6) for c in rates})


def _every_utterance(t: dict[str, DataFrame], part: DataFrame) -> DataFrame:
    """A row for each utterance, nulls where the part has none."""
    return t["utterances"].select(*KEY).join(part, KEY, "left")


def _rising(t: dict[str, DataFrame]) -> DataFrame:
    return prosody.terminal_slope(t["frames"], prosody.speech_end(turns.word_bounds(t["utterances"], t["words"])))


def _marked(t: dict[str, DataFrame]) -> DataFrame:
    made = {"question_flags": t["text"], "rising_terminal": _every_utterance(t, t["rising"]), "token_count": t["text"], "fto": t["turns"], "pitch": _every_utterance(t, t["pitch"]).withColumn("pitch_mean", F.round("pitch_mean", 9))}
    return prosody.marked_question_of(t["utterances"], made)


def _focus(t: dict[str, DataFrame]) -> DataFrame:
    said = t["utterances"].select(*KEY, F.explode(X.tokens(F.col("text"))).alias("token"))
    return units.personal_hits(said, t["lexicon"], KEY)


def _revelation(t: dict[str, DataFrame]) -> DataFrame:
    past = t["tagged"].groupBy(*KEY).agg(F.max((F.col("pos") == "PAST").cast("int")).alias("past_"))
    told = t["utterances"].join(past, KEY, "left")
    return chronology.mutual_revelation(told, X.may_be_anecdote(F.col("text")) & (F.coalesce("past_", F.lit(0)) == 1)).select(*KEY, "mutual_revelation")


def _syllables(t: dict[str, DataFrame]) -> DataFrame:
    return chronology.syllable_rate(t["utterances"], t["pronunciations"]).select(*KEY, F.round("syllable_rate", 6).alias("syllable_rate_by_table"))


PARTS: dict[str, Part] = {
    "text": Part({"utterances": ("text",)}, _text),
    "questions": Part({"utterances": ("start", "end", "text")}, lambda t: chronology.question_flags(t["utterances"]).select(*KEY, "echo_flag")),
    "previous": Part({"utterances": ("start", "end", "text")}, lambda t: chronology.repetitions_previous(t["utterances"])),
    "turns": Part({"utterances": ("start", "end", "text"), "words": ("start", "end")}, lambda t: turns.transfer_columns(turns.turn_events(t["utterances"], t["words"])).withColumnRenamed("backchannel", "turn_backchannel").withColumn("backchannel", F.col("turn_backchannel"))),
    "overlap": Part({"utterances": (), "words": ("start", "end", "i")}, lambda t: overlap.word_overlap(t["utterances"], t["words"])),
    "pauses": Part({"utterances": (), "words": ("start", "end", "token")}, lambda t: overlap.pauses(t["utterances"], t["words"])),
    "pitch": Part({"frames": ("f0",)}, lambda t: prosody.pitch(t["frames"])),
    "loudness": Part({"frames": ("rms",)}, lambda t: prosody.loudness(t["frames"])),
    "rising": Part({"frames": ("t", "f0"), "utterances": ("start", "end"), "words": ("start", "end")}, _rising),
    "marked": Part({"utterances": ()}, _marked, {"text": ("question_flag", "token_count"), "rising": ("rising",), "turns": ("onset_gap", "backchannel"), "pitch": ("pitch_mean",)}),
    "focus": Part({"utterances": ("text",), "lexicon": ("term", "bucket")}, _focus),
    "pronouns": Part({"utterances": ("start", "end"), "tagged": ("pos",)}, lambda t: units.tagged_rate(t["tagged"], t["utterances"], KEY)),
    "revelation": Part({"utterances": ("start", "end", "text"), "tagged": ("pos",)}, _revelation),
    "syllables": Part({"utterances": ("start", "end", "text"), "pronunciations": ("word", "syllables")}, _syllables),
    "people": Part({"utterances": (), "sides": ("caller",), "callers": ("sex", "birth_year", "dialect", "education")}, lambda t: people.with_demographics(t["utterances"].select(*KEY), t["sides"], t["callers"])),
    "topic": Part({"utterances": (), "conversations": ("topic_no",), "topics": ("topic_no", "topic")}, lambda t: people.with_topic(t["utterances"].select(*KEY), t["conversations"], t["topics"])),
}

_SECONDS = ("start", "end")
FEATURES: dict[str, Feature] = {
    "token_count": Feature("text", ("token_count",)),
    "backchannel": Feature("text", ("backchannel",)),
    "word_rate": Feature("text", ("word_rate",), _SECONDS),
    "syllable_rate": Feature("text", ("syllable_rate",), _SECONDS),
    "syllable_rate_by_table": Feature("syllables", ("syllable_rate_by_table",)),
    "filler_words_per_second": Feature("text", ("fillers_per_second",), _SECONDS),
    "repetitions_per_second": Feature("text", ("repetitions_per_second",), _SECONDS),
    "repetitions_in_current": Feature("text", ("repetitions_current",)),
    "repetitions_in_previous": Feature("previous", ("repetitions_previous",)),
    "bracket_events": Feature("text", ("laughter", "laughed_words", "noise", "vocalized_noise", "other")),
    "question_flag": Feature("text", ("question_flag",)),
    "question_after_markers": Feature("text", ("question_after_markers",)),
    "echo_question": Feature("questions", ("echo_flag",)),
    "stripped_text": Feature("text", ("stripped_text",)),
    "anecdote_candidate": Feature("text", ("may_be_anecdote",)),
    "floor_transfer": Feature("turns", ("kind", "fto", "onset_gap", "turn_initial", "turn_backchannel", "interjection")),
    "latching": Feature("turns", ("latching",)),
    "overlap_split": Feature("turns", ("cooperative", "obstructive")),
    "overlap": Feature("overlap", ("overlap_sec", "overlap_count", "overlap_onset")),
    "pauses": Feature("pauses", ("pause_total", "pause_count", "pause_rate", "pause_max")),
    "pitch": Feature("pitch", ("pitch_mean", "pitch_std", "pitch_range")),
    "loudness": Feature("loudness", ("loudness_mean", "loudness_std", "loudness_range")),
    "rising_terminal": Feature("rising", ("slope_hz", "slope_st", "rising")),
    "marked_question": Feature("marked", ("mgq_score", "mgq_flag")),
    "personal_focus": Feature("focus", ("personal", "impersonal", "analyzed", "score")),
    "pronouns_per_second": Feature("pronouns", ("per_second",)),
    "mutual_revelation": Feature("revelation", ("mutual_revelation",)),
    "demographics": Feature("people", ("caller", "gender", "region", "birth_year", "generation", "decade", "education")),
    "topic": Feature("topic", ("topic",)),
}


def _parts_of(names: list[str]) -> list[str]:
    """The parts that the features need, each after those it reads."""
    for name in names:
        if name not in FEATURES:
            raise ValueError(f"no feature {name!r}; there are {', '.join(sorted(FEATURES))}")
    reached, todo = {}, [FEATURES[n].part for n in names]
    while todo:
        part = todo.pop()
        if part not in reached:
            reached[part] = PARTS[part].after
            todo += PARTS[part].after
    return list(TopologicalSorter(reached).static_order())


def _check_inputs(names: list[str], inputs: dict[str, DataFrame]) -> None:
    for name in names:
        wants: dict[str, list[str]] = {}
        for part in _parts_of([name]):
            for kind, columns in PARTS[part].needs.items():
                wants.setdefault(kind, list(KEYS[kind])).extend(columns)
        wants.setdefault("utterances", list(KEY)).extend(FEATURES[name].needs)
        makes = ", ".join(FEATURES[name].makes)
        for kind, columns in wants.items():
            columns = list(dict.fromkeys(columns))
            if kind not in inputs:
                raise ValueError(f"feature {name!r} makes {makes} and needs a table of {kind} with columns {', '.join(columns)}; it is missing")
            lost = [c for c in columns if c not in inputs[kind].columns]
            if lost:
                whose = "" if kind == "utterances" else f" of {kind}"
                raise ValueError(f"feature {name!r} needs columns {', '.join(columns)}{whose} and makes {makes}; missing: {', '.join(lost)}")


def run_features(names: list[str], inputs: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """(key, what the features make) for every utterance; null where a feature has no row.

    An unknown name, an input that isn't given or one without a needed column is an error that states the contract. Utterances
    are dealt out by call once, for all parts that look at a call; a part that several others read is worked out once.
    """
    inputs = inputs if isinstance(inputs, dict) else {"utterances": inputs}
    names = list(dict.fromkeys(names))
    _check_inputs(names, inputs)
    parts = _parts_of(names)
    table = dict(inputs)
    if len(parts) > 1:
        table["utterances"] = order.settled(inputs["utterances"].repartition("call_id"))
    wanted: dict[str, list[str]] = {}
    for n in names:
        wanted.setdefault(FEATURES[n].part, []).extend(FEATURES[n].makes)
    for part in parts:
        made = PARTS[part].make(table)
        reads = [PARTS[p].after[part] for p in parts if part in PARTS[p].after] + [tuple(wanted[p]) for p in wanted if p == part]
        made = made.select(*dict.fromkeys((*KEY, *(c for columns in reads for c in columns))))  # no column is worked out that nothing reads
        table[part] = order.settled(made) if len(reads) > 1 else made
    own = {p: table[p].select(*KEY, *columns) for p, columns in wanted.items()}
    if len(own) == 1 and next(iter(own)) == "text":
        return own["text"]
    return tables.union_rows(table["utterances"].select(*KEY), own)


def run_feature(name: str, inputs: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """run_features for one name."""
    return run_features([name], inputs)


def tag_tokens(tokens: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], column: str = "token") -> DataFrame:
    """Adds tag: what a user-supplied tagger says of each token, a batch at a time; null tokens get a null tag.

    `load` makes the tagger; it runs once in a Python worker, however many batches follow, so it may open a model file.
    """
    ready: list = []

    def tag(col: pa.Array) -> pa.Array:
        if not ready:
            ready.append(load())
        given = col.to_pylist()
        some = [x for x in given if x is not None]
        made = iter(ready[0](some))
        return pa.array([None if x is None else next(made) for x in given], pa.string())

    return tokens.withColumn("tag", F.arrow_udf(tag, "string")(F.col(column)))
