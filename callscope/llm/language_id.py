"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Two recurrent layers of HIDDEN units read the lower-cased UTF-8 bytes of a text forwards and backwards; their states give
class probabilities at every byte, and the document's probabilities are the mean over all its bytes. Gates are piecewise
linear sigmoids. Texts are read whole, in segments of SEGMENT bytes that start from a zero state, so that all segments of
a slice are advanced together. Training is backpropagation through time with Adam on a bounded, documented sample: SAMPLE
texts (the lowest hashes of id), PIECES segments of each, at hashed places.

Defined results: null text or one without a letter is 'und' with score 0; without a training row everything is 'und';
rows that repeat an id are predicted each by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T

HIDDEN, SEGMENT = 6, 128
SAMPLE, PIECES, TRAIN_BYTES, EPOCHS, BATCH = 4000, 2, 64, 8, 256
SLICE = 1 << 19
_A = 3 * HIDDEN


class Network:
    """Weights: for each direction E (3h, 256), U (3h, h); output V (k, 2h), c (k, 1)."""

    def __init__(self, classes: int, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.normal(size=s) * scale).astype(np.float32)
        self.w = {"E0": f(_A, 256, scale=0.3), "U0": f(_A, HIDDEN, scale=0.4), "E1": f(_A, 256, scale=0.3), "U1": f(_A, HIDDEN, scale=0.4), "V": f(classes, 2 * HIDDEN, scale=0.3), "c": np.zeros((classes, 1), np.float32)}
        for d in "01":
            self.w["E" + d][: 2 * HIDDEN] += 0.5  # the gates' resting place

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States (steps, h, lanes) of one direction for bytes x (steps, lanes); with what the gradient needs."""
        e, u = self.w["E" + d], self.w["U" + d]
        rows = np.ascontiguousarray(e.T)
        steps, lanes = x.shape
        h = np.zeros((HIDDEN, lanes), np.float32)
        out = np.empty((steps, HIDDEN, lanes), np.float32)
        saved = []
        for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
            a = rows[x[t]].T
            q = u @ h
            pre = a[: 2 * HIDDEN] + q[: 2 * HIDDEN]
            gate = np.clip(pre, 0, 1)
            cand = np.tanh(a[2 * HIDDEN :] + gate[HIDDEN:] * q[2 * HIDDEN :])
            new = cand + gate[:HIDDEN] * (h - cand)
            if keep:
                saved.append((t, h, q, pre, gate, cand))
            h = new
            out[t] = h
        return (out, saved) if keep else out

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for bytes x (steps, lanes), classes y and the bytes that count."""
        w = self.w
        (f, sf), (b, sb) = self.states(x, "0", True), self.states(x, "1", True)
        both = np.concatenate([f, b], 1)
        logit = np.einsum("kh,thn->tkn", w["V"], both) + w["c"]
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        total = mask.sum()
        loss = -(np.log(np.take_along_axis(p, np.broadcast_to(y, (len(x), 1, len(y))).copy(), 1)[:, 0] + 1e-9) * mask).sum() / total
        g = p
        g[:, y, np.arange(len(y))] -= 1
        g *= mask[:, None, :] / total
        grads = {"V": np.einsum("tkn,thn->kh", g, both), "c": g.sum((0, 2))[:, None]}
        back = np.einsum("kh,tkn->thn", w["V"], g)
        for d, saved, part in (("0", sf, back[:, :HIDDEN]), ("1", sb, back[:, HIDDEN:])):
            ge, gu = np.zeros((256, _A), np.float32), np.zeros_like(w["U" + d])
            carry = np.zeros((HIDDEN, len(y)), np.float32)
            for t, h, q, pre, gate, cand in reversed(saved):
                dh = part[t] + carry
                z, r = gate[:HIDDEN], gate[HIDDEN:]
                dc = dh * (1 - z) * (1 - cand**2)
                live = (pre > 0) & (pre < 1)
                da = np.concatenate([dh * (h - cand) * live[:HIDDEN], dc * q[2 * HIDDEN :] * live[HIDDEN:], dc])
                dq = da.copy()
                dq[2 * HIDDEN :] *= r
                np.add.at(ge, x[t], da.T)
                gu += dq @ h.T
                carry = dh * z + w["U" + d].T @ dq
            grads["E" + d], grads["U" + d] = ge.T, gu
        return float(loss), grads


def train_network(pieces: np.ndarray, y: np.ndarray, mask: np.ndarray, classes: int, epochs: int = EPOCHS, batch: int = BATCH) -> Network:
    """pieces (n, steps) bytes, y (n) classes, mask (n, steps)."""
    net = Network(classes)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    r, t = np.random.default_rng(9), 0
    for epoch in range(epochs):
        order = r.permutation(len(pieces))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            _, grads = net.step(np.ascontiguousarray(pieces[at].T), y[at], np.ascontiguousarray(mask[at].T).astype(np.float32))
            t += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g**2
                net.w[k] = (net.w[k] - (0.03 if epoch < epochs - 2 else 0.008) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def document_probabilities(net: Network, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(mean class probabilities (n, k), counts of bytes labelled with each class (n, k))."""
    raw, offsets = T.buffer_of(col)
    raw = T.LOWER[raw]
    size = np.diff(offsets)
    pieces = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), pieces)
    start = T.ranges(np.zeros(len(size), np.int64), pieces) * SEGMENT + offsets[:-1][doc]
    length = np.minimum(SEGMENT, offsets[1:][doc] - start)
    k = len(net.w["c"])
    sums, votes = np.zeros((len(size), k)), np.zeros((len(size), k), np.int64)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), 2048):
        at = order[lo : lo + 2048]
        steps = int(length[at].max())
        place = start[at][None, :] + np.arange(steps)[:, None]
        mask = np.arange(steps)[:, None] < length[at][None, :]
        x = np.where(mask, raw[np.minimum(place, len(raw) - 1)], 0)
        v = net.w["V"]
        logit = np.matmul(v[:, :HIDDEN], net.states(x, "0")) + np.matmul(v[:, HIDDEN:], net.states(x, "1")) + net.w["c"]
        label = logit.argmax(1)
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p *= (mask / p.sum(1))[:, None, :]
        part = p.sum(0)
        for c in range(k):
            sums[:, c] += np.bincount(doc[at], part[c], minlength=len(size))
            votes[:, c] += np.bincount(doc[at], ((label == c) & mask).sum(0), minlength=len(size)).astype(np.int64)
    return sums / np.maximum(size, 1)[:, None], votes


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, held_out: bool = True) -> tuple[list[str], Network | None]:
    """Fits on at most `sample` rows with a language, never on those whose crc32(id) mod 4 is 2 (unless held_out is False)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    if held_out:
        rows = rows.where(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True)))
    cuts = [F.substring(text_col, (F.pmod(F.xxhash64(F.lit(i), id_col), F.greatest(F.length(text_col) - TRAIN_BYTES, F.lit(1))) + 1).cast("int"), F.lit(TRAIN_BYTES)).alias(f"p{i}") for i in range(PIECES)]
    picked = rows.select(F.xxhash64(id_col, text_col).alias("o"), F.col(lang_col).alias("lang"), *cuts).orderBy("o", "p0").limit(sample).toArrow()
    names = sorted(set(picked["lang"].to_pylist()))
    if not names:
        return [], None
    pieces, y = [], []
    for i in range(PIECES):
        for text, lang in zip(picked[f"p{i}"].to_pylist(), picked["lang"].to_pylist()):
            if text:
                pieces.append(text.encode()[:TRAIN_BYTES])
                y.append(names.index(lang))
    x, mask = np.zeros((len(pieces), TRAIN_BYTES), np.uint8), np.zeros((len(pieces), TRAIN_BYTES), bool)
    for i, p in enumerate(pieces):
        x[i, : len(p)] = T.LOWER[np.frombuffer(p, np.uint8)]
        mask[i, : len(p)] = True
    return names, train_network(x, np.array(y), mask, len(names))


def predict_column(names: list[str], net: Network | None):
    """A column function: text -> (lang_pred, score, label_share)."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast((names, net))  # some kB

    def one(col: pa.Array) -> pa.Array:
        known, net = shared.value
        n = len(col)
        letter = np.asarray(pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False)).astype(bool)
        best, score, share = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if net is not None and n:
            p, votes = document_probabilities(net, col)
            best = p.argmax(1)
            score = np.minimum(p.max(1), 1.0)
            share = votes[np.arange(n), best] / np.maximum(votes.sum(1), 1)
        else:
            letter[:] = False
        lang = [known[b] if ok else "und" for b, ok in zip(best, letter)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(np.where(letter, share, 0.0))], ["lang_pred", "score", "label_share"])

    return F.arrow_udf(T.array_mapped(one, SLICE), "lang_pred string, score double, label_share double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, label_share) per row."""
    names, net = train(docs, id_col, text_col, lang_col)
    return docs.select(id_col, (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2).alias("held_out"), predict_column(names, net)(F.col(text_col)).alias("p")).select(id_col, "held_out", "p.*")
