"""Toxicity classifier with a counterfactual penalty on identity terms.

A logistic model over the presence of hashed words and word heads (first 4, 5 and 6 bytes). It is fitted on a bounded,
documented sample of labelled texts (SAMPLE, the lowest hashes of id). For every sampled text with identity terms a copy
is made in which each term is swapped for its partner; the fit adds PENALTY times the squared difference of the two logits,
so that naming a group does not move a score by itself. Features that the sample does not support (z below MIN_Z) get no
weight. Scoring looks at whole texts; its table has a fixed size.

Defined results: null or empty text scores as the bias alone; null labels are not learned from; without a label of either
kind every score is the share of label 1 (0 without labels); rows that repeat an id are scored each by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T

BITS = 18
SAMPLE = 6000
#: Longer labelled texts aren't learned from (a parameter of train); all are scored whole.
SAMPLE_CHARS = 20_000
PENALTY = 1.0
MIN_Z = 3.5
THRESHOLD = 0.3
#: The default pairs of identity terms; any other mapping may be given.
SWAPS = {"women": "men", "woman": "man", "girls": "boys", "girl": "boy", "she": "he", "her": "his", "muslim": "christian", "muslims": "christians", "jewish": "catholic", "jews": "catholics", "black": "white", "african": "european", "asian": "american", "gay": "straight", "lesbian": "heterosexual", "transgender": "cisgender", "immigrant": "native", "immigrants": "natives", "disabled": "abled", "deaf": "hearing", "blind": "sighted", "elderly": "young"}


def partners(swaps: dict[str, str]) -> dict[str, str]:
    """Each term's partner, in both directions."""
    return {**{b: a for a, b in swaps.items()}, **swaps}


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of every text, in order."""
    words = T.Words(col, T.NOT_ALNUM, lower=True)
    size = words.end - words.start
    doc = words.doc()
    rows, keys = [doc], [words.hashes()]
    for k in (4, 5, 6):
        long = size > k
        rows.append(doc[long])
        keys.append(T.mix(T.span_hashes(words.raw, words.start[long], words.start[long] + k) + T.U(k)))
    bucket = np.concatenate(keys) >> T.U(64 - BITS)
    pair = np.unique(np.concatenate(rows).astype(T.U) << T.U(BITS) | bucket)
    return (pair >> T.U(BITS)).astype(np.int64), (pair & T.U((1 << BITS) - 1)).astype(np.int64)


def swapped(text: str | None, partner: dict[str, str]) -> str | None:
    """The text with identity terms swapped; null if it has none."""
    words = (text or "").split()
    new = [partner.get(w.strip(".,;:!?\"'()").lower(), None) for w in words]
    return " ".join(n or w for n, w in zip(new, words)) if any(new) else None


def _sample_rows(partner: dict[str, str]):
    def rows(batch: pa.RecordBatch):
        texts = batch.column(0)
        pairs = [features(texts)]
        other = pa.array([swapped(x, partner) for x in texts.to_pylist()], pa.string())
        pairs.append(features(other))
        lists = []
        for row, bucket in pairs:
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32))))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], ["y", "o", "x", "swap"])

    return rows


#: Texts whose features are unpacked at once.
_STEP = 256


def _unpacked(lists: list):
    """(row, bucket) of every feature, some texts at a time."""
    for lo in range(0, len(lists), _STEP):
        part = lists[lo : lo + _STEP]
        yield np.repeat(np.arange(lo, lo + len(part)), [len(v) for v in part]), np.concatenate([np.asarray(v, np.int64) for v in part])


def _sparse(lists: list, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the bucket) of the features whose bucket has a place."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, bucket in _unpacked(lists):
        col = place[bucket]
        rows.append(row[col >= 0])
        cols.append(col[col >= 0])
    return np.concatenate(rows), np.concatenate(cols)


def fit(y: np.ndarray, x: list, swap: list, penalty: float = PENALTY, min_z: float = MIN_Z, steps: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weight of each bucket). y: labels; x, swap: buckets of each text and of its swapped copy (empty if none)."""
    weights = np.zeros(1 << BITS, np.float32)
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return (-20.0 if share == 0 else 20.0), weights
    seen, bad = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for row, bucket in _unpacked(x):
        seen += np.bincount(bucket, minlength=1 << BITS)
        bad += np.bincount(bucket, y[row], minlength=1 << BITS)
    # expected count given text lengths: long texts hold more of everything
    expect = np.cumsum(np.append(0.0, np.full(int(seen.max()), share)))[seen]
    z = (bad - expect) / np.sqrt(expect * (1 - share) + 1.0)
    known = np.zeros(1 << BITS, bool)
    for v, w in zip(x, swap):
        if len(w):
            known[np.setxor1d(v, w).astype(np.int64)] = True
    chosen = np.flatnonzero(((z >= min_z) & (seen >= 4)) | known)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    row, col = _sparse(x, place)
    has = np.array([i for i, v in enumerate(swap) if len(v)], np.int64)
    srow, scol = _sparse([swap[i] for i in has], place)
    prow, pcol = _sparse([x[i] for i in has], place)
    w, b = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        logit = b + np.bincount(row, w[col], minlength=n)
        g = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
        grad = np.bincount(col, g[row], minlength=len(chosen)) / n + 2e-4 * w
        if len(has):
            gap = np.bincount(prow, w[pcol], minlength=len(has)) - np.bincount(srow, w[scol], minlength=len(has))
            grad += 2 * penalty / n * (np.bincount(pcol, gap[prow], minlength=len(chosen)) - np.bincount(scol, gap[srow], minlength=len(chosen)))
        full = np.append(grad, g.mean())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[chosen] = w
    return float(b), weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, held_out: bool = True, swaps: dict[str, str] = SWAPS, penalty: float = PENALTY, sample_chars: int = SAMPLE_CHARS) -> tuple[float, np.ndarray]:
    """Fits on at most `sample` labelled rows of at most `sample_chars` characters, never on those whose crc32(id) mod 4 is 2 (unless held_out is False)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out:
        known = known.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)
    picked = known.select(F.col(id_col), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.where(F.length(text_col) <= sample_chars).select(id_col, F.col(text_col).alias("text")).join(F.broadcast(picked), id_col).select("text", "y", F.xxhash64(id_col, "text").alias("o"))
    # the limit again, on rows: an id may have any number of texts
    got = rows.mapInArrow(T.mapped(_sample_rows(partners(swaps))), "y double, o long, x array<int>, swap array<int>").orderBy("o", "y").limit(sample).toArrow()
    lists = lambda c: [np.asarray(v.values) for v in got[c].combine_chunks()] if got.num_rows else []
    x, swap = lists("x"), lists("swap")
    return fit(got["y"].to_numpy().astype(float), x, swap, penalty)


def score_column(model: tuple[float, np.ndarray]):
    """A column function: text -> score in [0, 1]."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)  # 1 MB

    def one(col: pa.Array) -> pa.Array:
        bias, weights = shared.value
        row, bucket = features(col)
        logit = bias + np.bincount(row, weights[bucket], minlength=len(col))
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return F.arrow_udf(T.array_mapped(one), "double")


def counterfactual_gap(docs: DataFrame, model: tuple[float, np.ndarray], text_col: str = "text", swaps: dict[str, str] = SWAPS) -> DataFrame:
    """One row (n, mean_gap, max_gap): how far scores move, in absolute value, when the identity terms of a text are swapped; n texts have one."""
    partner = partners(swaps)
    other = F.arrow_udf(lambda col: pa.array([swapped(x, partner) for x in col.to_pylist()], pa.string()), "string")
    both = docs.select(F.col(text_col).alias("a"), other(F.col(text_col)).alias("b")).where(F.col("b").isNotNull())
    score = score_column(model)
    return both.select(F.abs(score(F.col("a")) - score(F.col("b"))).alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, swaps: dict[str, str] = SWAPS, penalty: float = PENALTY, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, held_out, score, predicted, swap_gap) per row; swap_gap is how far the score moves when the text's identity terms are swapped, null without one."""
    model = train(docs, labels, id_col, text_col, swaps=swaps, penalty=penalty, sample_chars=sample_chars)
    score, partner = score_column(model), partners(swaps)
    other = F.arrow_udf(lambda col: pa.array([swapped(x, partner) for x in col.to_pylist()], pa.string()), "string")
    rows = docs.select(id_col, (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2).alias("held_out"), F.col(text_col).alias("text_"), other(F.col(text_col)).alias("other_"))
    both = rows.select(id_col, "held_out", score(F.col("text_")).alias("score"), F.col("other_").isNotNull().alias("swaps_"), score(F.coalesce("other_", F.lit(""))).alias("moved_"))
    gap = F.when(F.col("swaps_"), F.abs(F.col("score") - F.col("moved_")))
    return both.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), gap.alias("swap_gap"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, swaps: dict[str, str] = SWAPS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The input rows that score below `threshold`."""
    model = train(docs, labels, id_col, text_col, swaps=swaps, sample_chars=sample_chars)
    row = docs.select(F.struct("*").alias("row"), score_column(model)(F.col(text_col)).alias("score"))
    return row.where(F.col("score") < threshold).select("row.*")
