"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are its white-space words, each led by the vocabulary's word mark. A slice's distinct pre-tokens go into
a trie whose nodes hold the forward score of their prefix: the best sum of piece scores over its segmentations, and the
number of pieces in it. A prefix that many pre-tokens share is scored once; a pre-token's counts are read at its terminal node.
A slice's trie is built level by level: all nodes of a depth are scored together, one vector step for each piece length.

The model is a public vocabulary file (its path is a parameter), whose pieces are scored by their rank as a Zipf law says: the
file has no probabilities, and tokenizers are not trained here, which fitting them to the corpus would be.
A character without a piece counts as its UTF-8 bytes, at BYTE_SCORE each. Ties go to the longest last piece.

Defined results: null or empty text has no tokens; rows that repeat an id are counted each by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T

MARK = "▁"
BYTE_SCORE = -16.0
#: Longer pre-tokens share no prefix worth a level of the trie; they are scored one by one, in time linear in their length.
LONG = 128


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unigram_scores(path: str) -> dict[str, float]:
    """Piece -> log probability, in proportion to 1 / (rank + 3)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    w = -np.log(np.arange(len(pieces)) + 3.0)
    return dict(zip(pieces, (w - np.log(np.exp(w).sum())).tolist()))


class Model:
    """Pieces by length in characters, their hashes sorted for look-up."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        chars = sorted({c for p in scores for c in p})
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        self.table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [p for p in scores if len(p) == n]
            if own:
                h = self._hash(np.array([[ord(c) for c in p] for p in own], np.uint32))
                order = np.argsort(h)
                self.table[n] = h[order], np.array([scores[p] for p in own])[order]

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        h = np.zeros(len(points), T.U)
        for i in range(points.shape[1]):
            h = h * T.U(T._P) + T.mix(points[:, i].astype(T.U) + T.U(1))
        return h

    def _long_word(self, w: str) -> tuple[int, float]:
        """(token count, score) of one pre-token."""
        top, used = [0.0], [0]
        for e in range(1, len(w) + 1):
            width = len(w[e - 1].encode("utf-8", "surrogatepass"))
            best, count = top[e - 1] + width * BYTE_SCORE, used[e - 1] + width
            for k in range(1, min(self.longest, e) + 1):
                s = self.scores.get(w[e - k : e])
                if s is not None and top[e - k] + s >= best:
                    best, count = top[e - k] + s, used[e - k] + 1
            top.append(best)
            used.append(count)
        return used[-1], top[-1]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, scores) of pre-tokens, their mark included, over a trie of them."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            counts[short], scores[short] = self.words([words[i] for i in short])
            for i in long:
                counts[i], scores[i] = self._long_word(words[i])
            return counts, scores
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        start = np.cumsum(size) - size
        counts, scores = np.zeros(n, np.int64), np.zeros(n)
        depth = int(size.max()) if n else 0
        # nodes of a depth: the pre-tokens of at least that length, those with an equal prefix as one
        node = np.zeros(n, np.int64)  # each pre-token's node at the present depth
        parents: list[np.ndarray] = []  # per depth: each node's parent
        letters: list[np.ndarray] = []
        best: list[np.ndarray] = [np.zeros(1)]
        pieces: list[np.ndarray] = [np.zeros(1, np.int64)]
        live = np.arange(n)
        for d in range(1, depth + 1):
            live = live[size[live] >= d]
            char = points[start[live] + d - 1]
            edge = node[live] << 21 | char
            distinct, place = np.unique(edge, return_inverse=True)
            node[live] = place
            parents.append(distinct >> 21)
            letters.append((distinct & ((1 << 21) - 1)).astype(np.uint32))
            m = len(distinct)
            width = np.where(letters[-1] < 0x80, 1, np.where(letters[-1] < 0x800, 2, np.where(letters[-1] < 0x10000, 3, 4)))
            top, used = best[d - 1][parents[-1]] + width * BYTE_SCORE, pieces[d - 1][parents[-1]] + width
            up, h, power = np.arange(m), np.zeros(m, T.U), 1
            for k in range(1, min(self.longest, d) + 1):  # pieces that end here, the last k characters
                h = T.mix(letters[d - k][up].astype(T.U) + T.U(1)) * T.U(power) + h
                power = power * T._P % (1 << 64)
                up = parents[d - k][up]
                if k in self.table:
                    keys, values = self.table[k]
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    other = best[d - k][up] + values[at]
                    better = (keys[at] == h) & (other >= top)
                    top = np.where(better, other, top)
                    used = np.where(better, pieces[d - k][up] + 1, used)
            best.append(top)
            pieces.append(used)
            done = live[size[live] == d]
            counts[done], scores[done] = used[node[done]], top[node[done]]
        return counts, scores


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, log_score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(unigram_scores(path or model_path())))  # the vocabulary, some MB

    def count(col: pa.Array) -> pa.Array:
        words = T.Words(col)
        h = words.hashes()
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        pre = [MARK + words.text(i).decode() for i in first]
        tokens, score = np.zeros(len(pre), np.int64), np.zeros(len(pre))
        order = sorted(range(len(pre)), key=lambda i: len(pre[i]))
        tokens[order], score[order] = shared.value.words([pre[i] for i in order])
        doc = words.doc()
        n = len(col)
        return pa.StructArray.from_arrays([pa.array(words.counts), pa.array(np.bincount(doc, tokens[which], minlength=n).astype(np.int64)), pa.array(np.bincount(doc, score[which], minlength=n))], ["n_words", "n_tokens", "log_score"])

    udf = F.arrow_udf(T.array_mapped(count, 8 << 20), "n_words long, n_tokens long, log_score double")
    return docs.select(id_col, udf(F.col(text_col)).alias("c")).select(id_col, "c.*")
