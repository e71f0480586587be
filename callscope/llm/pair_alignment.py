"""Alignment of two tokenizers' ids over a corpus by inverted pair bitmaps.

Both token sequences of a text spell the same bytes; where a token of each ends at the same byte they are linked, and those places
cut the text into groups. Which ids get linked how often is kept as an inverted index: tasks number their texts by chunk and slot, and
for each pair of ids and each chunk there is a compressed bitmap of the slots that hold the pair (sorted 16-bit slots, or a bitset
where that is shorter), OR-merged from the chunk's slices. How often a text holds its pair stands in further bitmaps, one for each binary digit
of the number beyond one (multiplicity planes). Population counts give a pair's documents (first plane) and links (all planes by their weight),
added up in Spark. Then every posting gets its pair's score, and a chunk's postings return the scores to its texts.

Sizes: a chunk has at most SLOTS texts and about LINKS links, a longer text being a chunk of its own; a hot pair has one row a chunk and plane.
What is broadcast is one row for each id of the second tokenizer, which its vocabulary bounds.

Defined results: null and empty texts, and those whose bytes a tokenizer doesn't give back (a space is put before each text), have no tokens: zeros and
an empty digest; special tokens' strings are plain text; rows that repeat an id are texts of their own; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm._frames import kept, read_when_written, splittable

SLOTS, LINKS, ROWS = 1 << 16, 1 << 20, 1 << 13
#: A pair's number: the first tokenizer's id shifted by so many bits, plus the second one's.
SHIFT = 20
_DEEP = re.compile(r"\s{5000}")
_SCHEMA = "chunk long, slot int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, plane int, dense boolean, bits binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_FIELDS = pa.schema([("chunk", pa.int64()), ("slot", pa.int32()), *((x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("plane", pa.int32()), ("dense", pa.bool_()), ("bits", pa.binary())])


def paths() -> tuple[str, str]:
    """Of the two vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array(list(map(len, tokens)))
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.digits = np.zeros((len(tokens), 1 + len(str(len(tokens)))), np.uint8)
        for i in range(len(tokens)):
            s = str(i).encode()
            self.digits[i, : len(s)] = list(s)
        self.width = (self.digits > 0).sum(1)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[T.ranges(self.at[ids], self.size[ids])]


class Pair:
    """Two tokenizers, as a worker holds them."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(a_path)
        self.plain.encode_special_tokens = True
        own, tokens = byte_characters(), [b""] * self.plain.get_vocab_size()
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        for token, i in self.plain.get_vocab().items():
            tokens[i] = b"" if token in special else bytes(map(own.__getitem__, token))
        ranks = {t: i for i, t in enumerate(tokens) if t}  # ids are in the order of merging, so they are ranks
        self.first = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = p = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.a = Spelling(tokens)
        self.b = Spelling([bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)])

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The first tokenizer's ids come by its ranks, which is faster; very long runs of white space are too deep for that pattern's recursion."""
        a = [self.plain.encode(" " + t, add_special_tokens=False).ids if _DEEP.search(t) else self.first.encode_ordinary(" " + t) for t in texts]
        return [np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in self.second.encode(texts, num_threads=1)]

    def aligned(self, texts: list[str | None]) -> dict[str, np.ndarray | list[str]]:
        """n_a, n_b, n_groups and groups_sha256 of each text; row and pair of each link."""
        n = len(texts)
        out = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64), "groups_sha256": [""] * n, "row": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64)}
        rows = [i for i, t in enumerate(texts) if t]
        a, b = self.ids([texts[i] for i in rows])
        whole = [b" " + texts[i].encode() for i in rows]
        same = [k for k, w in enumerate(whole) if self.a.size[a[k]].sum() == len(w) == self.b.size[b[k]].sum()]
        same = [k for k in same if self.a.joined(a[k]).tobytes() == whole[k] == self.b.joined(b[k]).tobytes()]
        if not same:
            return out
        rows, a, b = np.array(rows)[same], [a[k] for k in same], [b[k] for k in same]
        out["n_a"][rows], out["n_b"][rows] = list(map(len, a)), list(map(len, b))
        a_row, b_row = (np.repeat(rows, list(map(len, x))) for x in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])  # both go on from text to text, at the same byte
        meet = np.searchsorted(b_end, a_end)
        last_a = b_end[meet] == a_end
        link_a, link_b = np.flatnonzero(last_a), meet[last_a]
        out["row"], out["pair"] = a_row[link_a], a[link_a] << SHIFT | b[link_b]
        out["n_groups"] = np.bincount(out["row"], minlength=n)
        # the groups as text: a token's digits and what follows it, the second tokenizer's tokens of a group after the first one's
        group_a, group_b = np.searchsorted(link_a, np.arange(len(a))), np.searchsorted(link_b, np.arange(len(b)))
        at_a, at_b = np.arange(len(a)) + np.append(0, link_b + 1)[group_a], np.arange(len(b)) + (link_a + 1)[group_b]
        wide = max(self.a.digits.shape[1], self.b.digits.shape[1])
        text, width, row = np.zeros((len(a) + len(b), wide), np.uint8), np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        for spelling, ids, at, own, last, mark in ((self.a, a, at_a, a_row, link_a, b"|"), (self.b, b, at_b, b_row, link_b, b";")):
            follows = np.full(len(ids), ord(","), np.uint8)
            follows[last] = ord(mark)
            text[at, : spelling.digits.shape[1]] = spelling.digits[ids]
            width[at], row[at] = spelling.width[ids], own
            text[at, spelling.width[ids]] = follows
        flat = text[np.arange(wide) <= width[:, None]].tobytes()
        ends = np.cumsum(width + 1)[np.append(np.flatnonzero(np.diff(row)), len(row) - 1)]
        begin = 0
        for i, end in zip(rows.tolist(), ends.tolist()):
            out["groups_sha256"][i] = hashlib.sha256(flat[begin : end - 1]).hexdigest()
            begin = end
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizers(a_path: str, b_path: str) -> Pair:
    """A worker's tokenizers."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def bitmaps(pair: np.ndarray, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """OR-merges a chunk's links into planes: (pair, plane, dense, bits).

    Plane 0 has the slots that hold the pair, plane k those whose number of links less one has the binary digit k - 1.
    """
    key, times = np.unique(pair << 16 | slot, return_counts=True)
    yield from _plane(key, 0)
    rest, plane = times - 1, 1
    while rest.any():
        yield from _plane(key[rest & 1 > 0], plane)
        more = rest > 1
        key, rest, plane = key[more], rest[more] >> 1, plane + 1


def _plane(key: np.ndarray, plane: int) -> Iterator[pa.RecordBatch]:
    """A plane's bitmaps: 16-bit slots one after the other, or a bitset up to the last slot where that is shorter."""
    if not len(key):
        return
    own, slots = key >> 16, (key & 0xFFFF).astype("<u2")
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    n = np.diff(np.append(start, len(own)))
    wide = slots[start + n - 1].astype(np.int64) // 8 + 1
    dense = wide < 2 * n
    offsets = np.append(0, np.cumsum(2 * n[~dense])).astype(np.int32)
    sparse = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(slots[np.repeat(~dense, n)])])
    sets = [np.packbits(np.bincount(slots[i : i + m], minlength=8 * w).astype(bool), bitorder="little").tobytes() for i, m, w in zip(start[dense], n[dense], wide[dense])]
    for which, bits in ((~dense, sparse), (dense, pa.array(sets, pa.binary()))):
        m = int(which.sum())
        yield pa.RecordBatch.from_arrays([pa.array(own[start[which]]), pa.array(np.full(m, plane, np.int32)), pa.array(np.full(m, bool(which is dense))), bits], ["pair", "plane", "dense", "bits"])


def _placed(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """A batch of the index: its own columns and the given ones, nulls elsewhere."""
    have = {name: batch.column(name) for name in batch.schema.names} | columns
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in _FIELDS], schema=_FIELDS)


def index(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text (chunk, slot, doc_id, n_a, n_b, n_groups, groups_sha256) and one for each bitmap (chunk, pair, plane, dense, bits)."""
    own = paths()
    a_path, b_path = a_path or own[0], b_path or own[1]

    def closed(chunk: int, links: list) -> Iterator[pa.RecordBatch]:
        for planes in bitmaps(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])) if links else ():
            for at in range(0, planes.num_rows, ROWS):
                part = planes.slice(at, ROWS)
                yield _placed(part, chunk=pa.array(np.full(part.num_rows, chunk)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk, used, links = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for part in (p for at in range(0, batch.num_rows, ROWS) for p in T.slices(batch.slice(at, ROWS))):
                x = both.aligned(part.column("text").to_pylist())
                if used + part.num_rows > SLOTS or sum(len(p) for p, _ in links) + len(x["pair"]) > LINKS:
                    yield from closed(chunk, links)
                    chunk, used, links = chunk + 1, 0, []
                slots = np.arange(used, used + part.num_rows)
                links.append((x["pair"], slots[x["row"]]))
                used += part.num_rows
                yield _placed(part.select(["doc_id"]), chunk=pa.array(np.full(part.num_rows, chunk)), slot=pa.array(slots, pa.int32()), **{k: pa.array(x[k]) for k in ("n_a", "n_b", "n_groups")}, groups_sha256=pa.array(x["groups_sha256"], pa.string()))
        yield from closed(chunk, links)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, b, n_docs, n_links: population counts of every pair's bitmaps over all chunks."""
    bits = F.when(F.col("dense"), F.bitmap_count("bits")).otherwise(F.expr("octet_length(bits) div 2"))
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    out = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, bits)).alias("n_docs"), F.sum(bits * weight).alias("n_links"))
    return out.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))


def scores(counts: DataFrame) -> DataFrame:
    """pair, n_links, best: whether no other pair of the same second id has more links."""
    top = counts.groupBy("b").agg(F.max("n_links").alias("most"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(top), "b").select("pair", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _returned(texts: pa.Table, postings: pa.Table) -> pa.Table:
    """A chunk's texts with the scores that its postings return to them."""
    size = int(np.max(texts["slot"].to_numpy(), initial=-1)) + 1
    links, best, total = (np.zeros(size, np.int64) for _ in range(3))
    for batch in postings.to_batches():
        raw, offsets = T.buffer_of(batch.column("bits"))
        dense, bits = batch.column("dense").to_numpy(zero_copy_only=False), batch.column("bits")
        sets = [np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), bitorder="little")) for i in np.flatnonzero(dense)]
        sparse = raw[np.repeat(~dense, np.diff(offsets))].view("<u2").astype(np.int64)
        weight, n_links, is_best = 1 << np.maximum(batch.column("plane").to_numpy() - 1, 0), batch.column("n_links").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
        row = np.concatenate([np.repeat(np.flatnonzero(~dense), np.diff(offsets)[~dense] // 2), *(np.full(len(x), i) for i, x in zip(np.flatnonzero(dense), sets))])
        slot = np.concatenate([sparse, *sets]).astype(np.int64)
        np.add.at(links, slot, weight[row])
        np.add.at(best, slot, (weight * is_best)[row])
        np.add.at(total, slot, (weight * n_links)[row])
    slot = texts["slot"].to_numpy()
    own = {"n_links": links[slot], "n_best": best[slot], "count_sum": total[slot]}
    names = [f.split()[0] for f in _RESULT.split(", ")]
    return pa.table([pa.array(own[x]) if x in own else texts[x] for x in names], names)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    both = read_when_written(index(docs, a_path, b_path, id_col, text_col), "pair-index")
    texts = both.where(F.col("pair").isNull()).select(F.col("chunk").alias("place"), "slot", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    postings = both.where(F.col("pair").isNotNull()).select("chunk", "pair", "plane", "dense", "bits")
    scored = postings.join(splittable(scores(kept(pair_counts(postings))), "pair"), "pair").select("chunk", "plane", "dense", "bits", "n_links", "best")
    return texts.groupBy("place").cogroup(scored.groupBy("chunk")).applyInArrow(_returned, _RESULT)
