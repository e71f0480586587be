"""Exact merge-type encoding of whole texts by backtracking, and decoding.

The model merges neighbouring symbols by score (ties: leftmost first). A sequence of pieces is the encoding of its text exactly
if each piece encodes to itself and each two neighbours, merged again from their characters, come out as themselves: a merge
across a border would first be seen by those two. So a text is walked from the left: at a position the longest piece found by an
Aho-Corasick automaton is tried, then its shorter prefixes, each checked against the piece before it. A position from which
nothing fits is marked in a bitfield and given up for good, since only one valid sequence can lead to it; the walk then steps back.
No merge queue over the text is needed, and the work grows linearly with its length.

Texts are cut where no piece of the vocabulary can reach over (before a word mark that follows another character; between letters and
other characters, if no piece holds both, which is looked up in the vocabulary), and the ids of at most
KEEP short words are remembered in a worker. Characters without a piece become their UTF-8 bytes.

Defined results: null is empty, an empty text has no ids and decodes to an empty text; a text's own word marks (U+2581) count as
spaces; rows that repeat an id are encoded each by itself; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.token_counts import MARK, model_path

#: Words and pairs of neighbours that a worker remembers, and the characters of the longest word that it does.
KEEP, LONGEST = 400_000, 48
#: Rows of a batch that are handled together are cut at so many characters.
SLICE_CHARS = 1 << 19
#: Letters that stand in words, if the vocabulary has no piece with such a letter beside another character than a word mark before it.
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯͰ-ϿЀ-ӿ"
_NEVER = float("-inf")
_SCHEMA = "doc_id long, ids array<int>, decoded string"


class Codec:
    """Encoder and decoder of one model file of merge type with byte fallback and without normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = p
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        odd = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in odd if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.id = {s: i for i, s in enumerate(self.pieces) if i not in odd}
        self.score = {s: p.get_score(i) for s, i in self.id.items()}
        letters = not any(re.search(f"[{_LETTER}][^{_LETTER}]|[^{_LETTER}{MARK}][{_LETTER}]", s) for s in self.id)
        self.word = re.compile(f"{MARK}*[{_LETTER}]+|{MARK}*[^{MARK}{_LETTER}]+|{MARK}+" if letters else f"{MARK}*[^{MARK}]+|{MARK}+")
        if len(self.byte) != 256 or any(re.search(f"[^{MARK}]{MARK}", s) for s in self.id):
            raise ValueError("a model with byte fallback and leading word marks is needed")
        self.machine, self.shorter, self.size = ahocorasick.Automaton(), [-1] * n, list(map(len, self.pieces))
        whole = {s: i for s, i in self.id.items() if self.merged(s) == [s]}  # others are never the outcome of merging
        for s, i in whole.items():
            self.machine.add_word(s, (len(s) - 1, i))
            self.shorter[i] = next((whole[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in whole), -1)
        self.machine.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The outcome of merging a short text's characters."""
        parts, score = list(text), self.score
        order = [score.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while order and (best := max(order)) > _NEVER:
            k = order.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del order[k]
            if k:
                order[k - 1] = score.get(parts[k - 1] + parts[k], _NEVER)
            if k < len(order):
                order[k] = score.get(parts[k] + parts[k + 1], _NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces stay as they are when their characters are merged again."""
        x, y = self.pieces[a], self.pieces[b]
        if len(self.fits) >= 2 * KEEP:
            self.fits.clear()
        self.fits[a << 32 | b] = found = self.merged(x + y) == [x, y]
        return found

    def _walk(self, text: str) -> list[int]:
        """Ids of a text whose spaces are word marks; -1 - code point for a character without a piece."""
        longest = [-1] * len(text)  # the longest piece that starts at each place: later ends overwrite earlier ones
        for end, (back, i) in self.machine.iter(text):
            longest[end - back] = i
        end, at, last, out, failed = len(text), 0, -1, [], bytearray(len(text) + 1)
        size, shorter, fits = self.size, self.shorter, self.fits
        while at < end:
            i = longest[at]
            if i < 0 and not failed[at + 1]:  # a character without a piece fits anything
                i = last = -1 - ord(text[at])
                out.append(i)
                at += 1
                continue
            while i >= 0:
                if not failed[at + size[i]]:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | i)
                    if fit is None:
                        fit = self.compatible(last, i)
                    if fit:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += size[i]
                last = i
            else:  # only one valid sequence leads here, and it can't go on
                failed[at] = 1
                i = out.pop()
                at -= size[i] if i >= 0 else 1
                last = out[-1] if out else -1
        return out

    def _ids(self, word: str) -> tuple[int, ...]:
        out = self._walk(word)
        if out and min(out) < 0:
            out = list(chain.from_iterable((i,) if i >= 0 else (self.byte[x] for x in chr(-1 - i).encode()) for i in out))
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for word in self.word.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(word)
            if ids is None:
                ids = self._ids(word)
                if len(word) <= LONGEST:
                    if len(known) >= KEEP:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's codec of a model file."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: every whole text's ids and what they decode to."""
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows in _parts(batches):
            ids = [c.encode(x) for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of round_trip's rows, digested where they are made: ids and texts don't leave a task."""
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        digit = list(map(str, range(len(c.pieces))))
        for rows in _parts(batches):
            out = []
            for key, text in rows:
                ids = c.encode(text)
                out.append((key, len(ids), hashlib.sha256(",".join(map(digit.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, text) of some rows at a time, a row at least: Python objects of a bounded number of characters."""
    for batch in batches:
        part, room = [], SLICE_CHARS
        for key, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            part.append((key.as_py(), text))
            room -= len(text or "")
            if room <= 0:
                yield part
                part, room = [], SLICE_CHARS
        if part:
            yield part
