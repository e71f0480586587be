"""Column expressions on gold dialogue-act tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: one decoration at the end of a tag.
_TAIL = r"(\(\^q\)|\^[a-z0-9]+|@|\*)"
#: Tags of gold questions and backchannels.
QUESTION_BASES = ("qy", "qw", "qo", "qr", "qrr", "qh", "^g")


def _split(tag: Column) -> Column:
    return F.filter(F.transform(F.split(tag, ","), lambda p: F.trim(p)), lambda p: p != "")


def _run(part: Column) -> Column:
    """The decorations at a part's end, outermost last."""
    return F.regexp_extract_all(F.regexp_extract(part, f"({_TAIL}+)$", 1), F.lit(_TAIL), 1)


def _stem(part: Column) -> Column:
    return F.regexp_replace(part, f"{_TAIL}+$", "")


def bases(tag: Column) -> Column:
    """Base acts of a compound tag; a part that is decorations only keeps its innermost one as base."""
    return F.transform(_split(tag), lambda p: F.when(_stem(p) != "", _stem(p)).otherwise(F.get(_run(p), F.lit(0))))


def decorations(tag: Column) -> Column:
    """Distinct decorations of a compound tag, sorted."""
    own = F.transform(_split(tag), lambda p: F.when(_stem(p) != "", _run(p)).otherwise(F.slice(_run(p), F.lit(2), F.greatest(F.size(_run(p)) - 1, F.lit(0)))))
    return F.array_sort(F.array_distinct(F.flatten(own)))


def behaviours(b: Column, d: Column) -> dict[str, Column]:
    """Named predicates over bases and decorations."""
    has = lambda x, v: F.array_contains(x, v)
    return {
        "collab_completion": has(b, "^2") | has(d, "^2"),
        "mirror": has(b, "^m") | has(d, "^m"),
        "echo_question": has(b, "bh"),
        "appreciation": has(b, "ba"),
        "quotation": has(b, "^q") | has(d, "^q") | has(d, "(^q)"),
        "backchannel": has(b, "b"),
    }


def is_question(b: Column) -> Column:
    return F.arrays_overlap(b, F.array(*map(F.lit, QUESTION_BASES)))


def question_category(b: Column, d: Column) -> Column:
    return F.when(F.array_contains(d, "^d"), "declarative").when(F.array_contains(b, "^g") | F.array_contains(d, "^g"), "tag").otherwise("syntactic")


def terminal_class(b: Column, d: Column) -> Column:
    """stmt / ynq / declq / other, declarative questions before plain ones."""
    question = F.array_contains(b, "qy")
    return F.when(question & F.array_contains(d, "^d"), "declq").when(question, "ynq").when(F.arrays_overlap(b, F.array(F.lit("sd"), F.lit("sv"))), "stmt").otherwise("other")
