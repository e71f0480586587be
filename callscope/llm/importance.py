"""Quality selection by importance resampling over hashed n-grams.

Words and word pairs are hashed into BUCKETS. Two bag models are counted: the raw one over all texts, the target one over a
bounded, documented sample of labelled good texts (TARGET rows with quality 1, the lowest hashes of id). A text's log
importance is the sum over its n-grams of log target - log raw probability. Gumbel noise, a function of the id and
SEED, is added, and the KEEP share with the largest sums is selected: a draw without replacement in proportion to importance.
The cut is found exactly, by counting 16 bits of the sort key at a time; no global sort and no single task.

Defined results: null or empty text has importance 0; ties at the cut are all selected; without a target row the importance
is 0 for all; rows that repeat an id share their noise; a null id's noise is that of an own constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm._frames import kept

BUCKETS, TARGET, KEEP, SEED = 10_000, 5000, 0.5, 17


def ngrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbouring words."""
    words = T.Words(col, T.NOT_ALNUM, lower=True)
    h, doc = words.hashes(), words.doc()
    start = T.window_starts(words.counts, words.offsets, 2)
    row = np.concatenate([doc, doc[start]])
    return row, (np.concatenate([h, T.rolling(h, 2)[start]]) % T.U(BUCKETS)).astype(np.int64)


def _count_rows(batches):
    """A task's counts, a row a bucket: (bucket, raw, target)."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in T.slices(batch):
            row, bucket = ngrams(part.column(0))
            good = np.asarray(part.column(1)).astype(bool)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[good[row]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log target - log raw probability of each bucket, add-one smoothed; good: at most TARGET ids."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(good.select(F.col(id_col).alias("id"), F.lit(True).alias("good"))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = marked.mapInArrow(_count_rows, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, BUCKETS))
    at = sums["bucket"].to_numpy()
    counts[0, at], counts[1, at] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    p = (counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP, target: int = TARGET, seed: int = SEED) -> DataFrame:
    """(id, n_ngrams, log_importance, draw, selected) per row."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(target)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, good, id_col, text_col))

    def score(batch: pa.RecordBatch):
        row, bucket = ngrams(batch.column(1))
        total = np.bincount(row, shared.value[bucket], minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows)
        u = (batch.column(2).to_numpy().view(T.U) >> T.U(11)).astype(float) + 0.5
        draw = total - np.log(-np.log(u / 2.0**53))
        bits = draw.view(np.int64)
        key = np.where(bits < 0, ~bits & np.int64(2**63 - 1), bits | np.int64(-(2**63)))  # unsigned order, sign bit moved below
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)), pa.array(total), pa.array(draw), pa.array(key.view(T.U) ^ T.U(1 << 63)).view(pa.int64())], ["k", "n_ngrams", "log_importance", "draw", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("noise"))
    scored = kept(rows.mapInArrow(T.mapped(score), f"k {kind}, n_ngrams long, log_importance double, draw double, key long"))
    cut = largest_cut(scored, "key", int(round(keep * scored.count())))
    return scored.select(F.col("k").alias(id_col), "n_ngrams", "log_importance", "draw", (F.col("key") >= F.lit(cut) if cut is not None else F.lit(False)).alias("selected"))


def largest_cut(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a long column: four passes that count 16 bits each; null if k is 0."""
    if k <= 0:
        return None
    unsigned = F.col(key).bitwiseXOR(F.lit(-(2**63)))
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(0xFFFF))
        some = df if shift == 48 else df.where(F.shiftrightunsigned(unsigned, shift + 16) == F.lit(prefix))
        counts = sorted(((r["d"], r["n"]) for r in some.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 65,536 rows at most
        for d, n in counts:
            if k <= n:
                break
            k -= n
        prefix = prefix << 16 | d
    return (prefix ^ 1 << 63) - (1 << 64) if (prefix ^ 1 << 63) >= 1 << 63 else prefix ^ 1 << 63
