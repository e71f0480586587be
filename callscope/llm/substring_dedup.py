"""Removal of long word passages that repeat across documents, by difference-cover anchors.

Word positions modulo PERIOD that lie in COVER are anchors. COVER is a perfect difference set: for any two
positions there is a shift below PERIOD that takes both to cover positions. So two equal passages of at least
ANCHOR + PERIOD - 1 = 50 words share an aligned anchor of ANCHOR words, although only 6 of 31 positions are hashed.
Anchors that occur in two different texts are extended: every window of `min_words` words around them is hashed
and counts as a repeat if the least document with the same window is smaller.

Defined results: null or empty text has no words; a text shorter than a window is kept; equal windows inside one
document don't count; rows with a null id are kept whole and never make another row lose words; rows that repeat an id
are judged each on its own text and never by each other. Other columns pass through or are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm._frames import kept, sieved, splittable

PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
MIN_WORDS = 50


#: Marks of one id's rows: the low 32 bits are the first word of a repeated window, or WHOLE; the high ones tell which text is meant.
WHOLE = 0xFFFFFFFF


def _tag(sig: np.ndarray) -> np.ndarray:
    return sig.astype(np.int64) & ~np.int64(WHOLE)


def _anchor_rows(size: int):
    """Rows (id, sig, text) -> an (anchor, id, sig, at) for every cover position."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def rows(batch: pa.RecordBatch):
        words = T.Words(batch.column(2))
        start = T.window_starts(words.counts, words.offsets, size)
        start = start[cover[words.position()[start] % PERIOD]]
        doc = pa.array(words.doc()[start])
        yield pa.RecordBatch.from_arrays([T.signed(T.rolling(words.hashes(), size)[start]), batch.column(0).take(doc), batch.column(1).take(doc), pa.array(words.position()[start].astype(np.int32))], ["anchor", "id", "sig", "at"])

    return T.mapped(rows)


def _window_rows(size: int, anchor: int):
    """Rows (id, sig, text, near, marks) -> (h, c, id, mark) for every window around an anchor; a marked copy has none, as all of it goes."""

    def rows(batch: pa.RecordBatch):
        words = T.Words(batch.column(2))
        tag = _tag(batch.column(1).to_numpy())
        row, mark = T.listed(batch.column(4))
        copy = np.zeros(batch.num_rows, bool)
        copy[row[mark == (tag[row] | WHOLE)]] = True
        near = np.zeros(len(words) + 1, np.int64)
        doc, at = T.listed(batch.column(3))
        keep = (at < words.counts[doc]) & ~copy[doc]  # the first: not an anchor of another text with this id
        doc, at = doc[keep], at[keep]
        base = words.offsets[:-1][doc]
        np.add.at(near, base + np.maximum(at - (size - anchor), 0), 1)
        np.add.at(near, base + at + 1, -1)
        start = T.window_starts(words.counts, words.offsets, size)
        start = start[np.cumsum(near)[start] > 0]
        h = words.hashes()
        doc = words.doc()[start]
        check = (T.rolling(T.mix(h ^ T.U(0xA24BAED4963EE407)), size)[start] >> T.U(33)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([T.signed(T.rolling(h, size)[start]), pa.array(check), batch.column(0).take(pa.array(doc)), pa.array(tag[doc] | words.position()[start])], ["h", "c", "id", "mark"])

    return T.mapped(rows)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, marks) for the ids that lose words: see WHOLE. Of the texts, those that a sieve of the ids with common anchors lets through are shuffled."""
    anchor = min_words - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"min_words must be {PERIOD} or more")
    texts = keyed(docs, id_col, text_col)
    sigs = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig"), F.xxhash64(F.lit(7), F.col(text_col)).alias("sig2"))
    least = splittable(sigs.groupBy("sig", "sig2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("sig", "sig2", "least"), "sig")
    copies = kept(sigs.join(least, ["sig", "sig2"]).where("id > least").select("id", F.col("sig").bitwiseOR(F.lit(WHOLE)).alias("mark")).distinct())
    # straight from the scan, twice: rows are summed up before they are grouped, and a join of plain shuffles can be split at a hot passage
    anchors = texts.mapInArrow(_anchor_rows(anchor), "anchor long, id long, sig long, at int")
    common = kept(anchors.groupBy("anchor").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("anchor"), release=True)
    near = kept(anchors.select("anchor", "id", "at").join(common, "anchor").groupBy("id").agg(F.collect_list("at").alias("near")), release=True)
    copied = copies.groupBy("id").agg(F.collect_list("mark").alias("marks"))
    around = sieved(texts, near)[0].join(near.join(copied, "id", "left").hint("shuffle_hash"), "id").select("id", "sig", "text", "near", "marks")
    windows = around.mapInArrow(_window_rows(min_words, anchor), "h long, c int, id long, mark long")
    first = kept(windows.groupBy("h", "c").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "c", "least"), release=True)
    found = windows.join(first, ["h", "c"]).where("id > least").select("id", "mark")
    return kept(found.unionByName(copies).groupBy("id").agg(F.collect_list("mark").alias("marks")), release=True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sig, text) of the rows with an id."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))


def _cut_column(size: int, only_changed: bool):
    """(text, sig, marks) -> (n_words, n_removed, kept_text); with only_changed a text that loses nothing stays as it is."""

    def cut(text: pa.Array, sig: pa.Array, marks: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, sig, marks], ["text", "sig", "marks"])
        parts = [one(part) for part in T.slices(batch)]
        return pa.concat_arrays(parts) if parts else one(batch)

    def one(batch: pa.RecordBatch) -> pa.Array:
        words = T.Words(batch.column(0))
        n = batch.num_rows
        edge = np.zeros(len(words) + 1, np.int64)
        row, mark = T.listed(batch.column(2))
        mine = (mark & ~np.int64(WHOLE)) == _tag(batch.column(1).to_numpy())[row]
        row, at = row[mine], mark[mine] & WHOLE
        width = np.where(at == WHOLE, words.counts[row], size)
        ok = words.counts[row] >= size
        row, at, width = row[ok], np.where(at == WHOLE, 0, at)[ok], width[ok]
        np.add.at(edge, words.offsets[row] + at, 1)
        np.add.at(edge, words.offsets[row] + at + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        removed = lost[words.offsets[1:]] - lost[words.offsets[:-1]]
        out = []
        for i, s in enumerate(batch.column(0).to_pylist()):
            if removed[i]:
                lo, hi = words.offsets[i], words.offsets[i + 1]
                out.append(b" ".join(w for w, g in zip(s.encode().split(), gone[lo:hi]) if not g).decode())
            else:
                out.append(s if only_changed else b" ".join((s or "").encode().split()).decode())
        return pa.StructArray.from_arrays([pa.array(words.counts), pa.array(removed), pa.array(out, pa.string())], ["n_words", "n_removed", "kept_text"])

    return F.arrow_udf(cut, "n_words long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row (id, n_words, n_removed, kept_text) per input row; kept_text is the kept words joined by one space."""
    found = repeats(docs, id_col, text_col, min_words)
    cut = _cut_column(min_words, False)
    row = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    return _met(row, found).select(F.col("id").alias(id_col), cut("text", "sig", "marks").alias("o")).select(id_col, "o.*")


def _met(row: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with their ids' marks; only rows that may have some are shuffled."""
    may, rest = sieved(row, found)
    return may.join(found.hint("shuffle_hash"), "id", "left").unionByName(rest.withColumn("marks", F.lit(None).cast("array<long>")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input rows and columns; a text that loses words becomes its kept words joined by one space, any other stays as it is."""
    found = repeats(docs, id_col, text_col, min_words)
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig"))
    text = F.col(f"row.`{text_col}`")
    met = _met(row, found)
    new = F.when(F.col("marks").isNull(), text).otherwise(_cut_column(min_words, True)(text, F.col("sig"), F.col("marks"))["kept_text"])
    out = met.select("row", new.alias("new"))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
