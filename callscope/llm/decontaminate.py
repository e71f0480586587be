"""Benchmark decontamination: word windows of the test items, looked up at every word of the training texts.

A window is `size` consecutive words of an item (an item of fewer words, but not none, is one window). The set of
window hashes is broadcast while it has at most MAX_WINDOWS entries (about 200 bytes each, so about 40 MB); a larger
benchmark is joined by hash instead. Every hit is verified on the words themselves before it counts.

Defined results: null or empty text has no words and no hits; an item without words has no window; rows that repeat an
id are judged each by itself; equal items all count; items with a null id are one item, named by the empty string; an id of any type counts as a string. Other columns pass through or are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T

SIZE = 10
MAX_WINDOWS = 200_000
SIEVE_BITS = 1 << 27


def _window_rows(size: int):
    """(h, n, item_id, words) for every window of the items."""

    def rows(batch: pa.RecordBatch):
        words = T.Words(batch.column(1), T.NOT_ALNUM, lower=True)
        h = words.hashes()
        out = {"h": [], "n": [], "item_id": [], "words": []}
        ids = batch.column(0).to_pylist()
        for n in range(1, size + 1):
            docs = np.flatnonzero(words.counts >= size if n == size else words.counts == n)
            if not len(docs):
                continue
            start = T.ranges(words.offsets[:-1][docs], words.counts[docs] - n + 1)
            doc = words.doc()[start]
            out["h"] += T.rolling(h, n)[start].view(np.int64).tolist()
            out["n"] += [n] * len(start)
            out["item_id"] += [ids[d] for d in doc]
            out["words"] += [b" ".join(words.text(i) for i in range(s, s + n)) for s in start]
        yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["item_id"], pa.string()), pa.array(out["words"], pa.binary())], ["h", "n", "item_id", "words"])

    return T.mapped(rows)


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Every distinct window of the items: (h, n, item_id, words)."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_window_rows(size), "h long, n int, item_id string, words binary").distinct()


class _Table:
    """The windows as sorted arrays; equal hashes lie together."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r.n, r.h))
        self.h = np.array([r.h for r in rows], np.int64)
        self.n = np.array([r.n for r in rows], np.int64)
        self.item = np.array([r.item_id for r in rows], object)
        self.words = [bytes(r.words) for r in rows]
        self.sizes = {int(n): slice(*np.searchsorted(self.n, [n, n + 1])) for n in np.unique(self.n)}
        self.sieve = {n: self._bits(self.h[s]) for n, s in self.sizes.items()}

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[h.view(T.U) >> T.U(44)] = True
        return bits

    def hits(self, words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, row of the table) of each verified hit."""
        h = words.hashes()
        first, length, row = [], [], []
        for n, cut in self.sizes.items():
            start = T.window_starts(words.counts, words.offsets, n)
            if not len(start):
                continue
            own = T.rolling(h, n)[start]
            maybe = self.sieve[n][own >> T.U(44)]
            start, own = start[maybe], own[maybe].view(np.int64)
            lo, hi = np.searchsorted(self.h[cut], own), np.searchsorted(self.h[cut], own, side="right")
            rows = T.ranges(lo, hi - lo) + cut.start
            start = np.repeat(start, hi - lo)
            same = np.array([b" ".join(words.text(i) for i in range(s, s + n)) == self.words[r] for s, r in zip(start, rows)], bool)
            first.append(start[same])
            row.append(rows[same])
            length.append(np.full(int(same.sum()), n))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(first), join(length), join(row)


def _hits(table: _Table, words: T.Words) -> tuple[np.ndarray, ...]:
    """(row, first word in its text, size, item) of all hits, by row."""
    first, length, row = table.hits(words)
    doc = np.searchsorted(words.offsets, first, side="right") - 1
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    return doc, (first[order] - words.offsets[:-1][doc]), length[order], table.item[row][order]


def _hit_words(words: T.Words, doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words are hit, how many in each text)."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, words.offsets[doc] + at, 1)
    np.add.at(edge, words.offsets[doc] + at + length, -1)
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return hit, total[words.offsets[1:]] - total[words.offsets[:-1]]


def _digest(texts: pa.Array, words: T.Words, doc, at, length, item) -> pa.Array:
    _, n_hit = _hit_words(words, doc, at, length)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    items = [sorted(set(item[a:b])) for a, b in zip(cut[:-1], cut[1:])]
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.StructArray.from_arrays([pa.array(words.counts), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string())], ["n_words", "n_hit", "n_items", "items_sha256"])


_DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string"


def _cut(texts: pa.Array, words: T.Words, doc, at, length, item) -> pa.Array:
    """The texts without the bytes of hit words; what stood between two hit words goes with them."""
    hit, n_hit = _hit_words(words, doc, at, length)
    out = texts.to_pylist()
    for i in np.flatnonzero(n_hit):
        lo, hi = words.offsets[i], words.offsets[i + 1]
        raw = np.frombuffer(out[i].encode(), np.uint8)
        base = words.text_start[i]
        keep = np.ones(len(raw), bool)
        gone = lo + np.flatnonzero(hit[lo:hi])
        for run in np.split(gone, np.flatnonzero(np.diff(gone) > 1) + 1):
            keep[words.start[run[0]] - base : words.end[run[-1]] - base] = False
        out[i] = raw[keep].tobytes().decode()
    return pa.StructArray.from_arrays([pa.array(words.counts), pa.array(n_hit), pa.array(out, pa.string())], ["n_words", "n_hit", "kept"])


_CUT = "n_words long, n_hit long, kept string"


def _found(docs: DataFrame, benchmark: DataFrame, text: str, finish, schema: str, size: int, max_windows: int) -> DataFrame:
    """Adds found: what `finish` makes of each text's words and hits, in one pass over the texts (one Python worker a task).

    The function is marked as not deterministic, which keeps Spark from running it again for a filter on what it finds.
    """
    found = windows(benchmark, size=size)
    if found.count() > max_windows:
        return _joined(docs, found, text, finish, schema, size)
    shared = docs.sparkSession.sparkContext.broadcast(_Table(found.collect()))

    def scan(col: pa.Array) -> pa.Array:
        words = T.Words(col, T.NOT_ALNUM, lower=True)
        return finish(col, words, *_hits(shared.value, words))

    return docs.withColumn("found", F.arrow_udf(T.array_mapped(scan), schema).asNondeterministic()(F.col(text)))


def _sieve(found: DataFrame) -> np.ndarray:
    """A bitmap of the windows' hashes: SIEVE_BITS bits (16 MB), however many windows there are."""
    bit = F.shiftrightunsigned("h", 64 - SIEVE_BITS.bit_length() + 1)
    some = found.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - SIEVE_BITS.bit_length() + 1}) & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, T.U)
    out[some["w"].to_numpy()] = some["m"].to_numpy().view(T.U)
    return out


def _joined(docs: DataFrame, found: DataFrame, text: str, finish, schema: str, size: int) -> DataFrame:
    """As _found for a benchmark of any size: windows of both sides meet in a join on their hash and words. Equal texts are scanned once.

    Only windows of sizes that occur are looked at, and only those whose hash a broadcast bitmap has take part in the shuffle.
    """
    sizes = sorted(r["n"] for r in found.select("n").distinct().collect())  # `size` rows at most
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(found))
    shift = T.U(64 - SIEVE_BITS.bit_length() + 1)

    def every(batch: pa.RecordBatch):
        words = T.Words(batch.column(2), T.NOT_ALNUM, lower=True)
        h = words.hashes()
        for n in sizes:
            start = T.window_starts(words.counts, words.offsets, n)
            if len(start):
                own = T.rolling(h, n)[start]
                bit = own >> shift
                may = (shared.value[bit >> T.U(6)] >> (bit & T.U(63)) & T.U(1)).astype(bool)
                start, own = start[may], own[may]
                doc = pa.array(words.doc()[start])
                joined = [b" ".join(words.text(i) for i in range(s, s + n)) for s in start]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), T.signed(own), pa.array(np.full(len(start), n, np.int32)), pa.array(words.position()[start].astype(np.int32)), pa.array(joined, pa.binary())], ["r1", "r2", "h", "n", "at", "words"])

    keyed = docs.withColumns({"r1": F.xxhash64(text), "r2": F.xxhash64(F.lit(7), F.col(text))})
    own = keyed.select("r1", "r2", F.col(text).alias("text")).where("text IS NOT NULL").distinct().mapInArrow(T.mapped(every), "r1 long, r2 long, h long, n int, at int, words binary")
    lists = own.join(found, ["h", "n", "words"]).groupBy("r1", "r2").agg(F.collect_list(F.struct("at", "n", "item_id")).alias("hits"))

    def end(col: pa.Array, hits: pa.Array) -> pa.Array:
        words = T.Words(col, T.NOT_ALNUM, lower=True)
        hits = hits.fill_null([]) if hits.null_count else hits
        doc = np.repeat(np.arange(len(col)), np.diff(hits.offsets.to_numpy()))
        at, n = (hits.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        item = hits.flatten().field(2).to_numpy(zero_copy_only=False)
        return finish(col, words, doc, at, n, item)

    met = keyed.join(lists, ["r1", "r2"], "left")
    return met.withColumn("found", F.arrow_udf(end, schema).asNondeterministic()(F.col(text), F.col("hits"))).drop("r1", "r2", "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) per row."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    found = _found(rows, benchmark, "t", _digest, _DIGEST, size, max_windows)
    return found.select(F.col("k").alias(id_col), "found.*", (F.col("found.n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, drop_share: float = 0.5, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The input without benchmark passages: hit spans are cut out; a document with at least `drop_share` of its words hit goes."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("t"))
    found = _found(rows, benchmark, "t", _cut, _CUT, size, max_windows)
    stay = found.where((F.col("found.n_hit") == 0) | (F.col("found.n_hit") < F.lit(drop_share) * F.col("found.n_words")))
    return stay.select(*[F.col("found.kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
