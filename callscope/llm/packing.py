"""Packing of tokenised documents into sequences by bounded-space online best fit.

Each task keeps at most OPEN windows. A document's ids are cut into full windows and one remainder. The remainder goes
to the open window with the least room that takes it (best fit). If none does and a new one can't be opened, the
fullest window is filled up with the remainder's head and emitted, and the rest takes a new window. What stays open at a
task's end is merged: first the task's own windows into full ones, then the last part windows of GROUP tasks each.
A merge's last part is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: null text is empty, and every document ends with id END, so no document is without a piece; rows that
repeat an id are separate documents; special-token strings in a text are taken as the tokenizer takes them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm._frames import kept

LENGTH, OPEN, GROUP, END = 2048, 16, 64, 1
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: what stands between words, what the tokenizer cuts words into, and what it has to see with its surroundings.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[T.SPACE] = _SPACE
_KIND[ord("'")] = _ODD
for _a, _b, _k in ((0x30, 0x3A, _DIGIT), (0x41, 0x5B, _LETTER), (0x61, 0x7B, _LETTER)):
    _KIND[_a:_b] = _k


class _Known:
    """Encoded words: flat arrays of their bytes and ids, looked up by a sorted hash and confirmed on the bytes."""

    def __init__(self, h, raw_n, raw, ids_n, ids, used):
        order = np.argsort(h, kind="stable")
        self.h, self.raw_n, self.ids_n, self.used, self.raw, self.ids = h[order], raw_n[order], ids_n[order], used[order], raw, ids
        self.raw_at, self.ids_at = (np.cumsum(raw_n) - raw_n)[order], (np.cumsum(ids_n) - ids_n)[order]

    def __len__(self) -> int:
        return len(self.h)

    @staticmethod
    def none() -> _Known:
        return _Known(np.zeros(0, T.U), *(np.zeros(0, t) for t in (np.int64, np.uint8, np.int64, "<u4", np.int64)))

    def find(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for an unknown one."""
        out = np.full(len(h), -1)
        if len(self) and len(h):
            at = np.minimum(np.searchsorted(self.h, h), len(self) - 1)
            may = np.flatnonzero((self.h[at] == h) & (self.raw_n[at] == size))
            if len(may):
                n = size[may]
                same = self.raw[T.ranges(self.raw_at[at[may]], n)] == raw[T.ranges(start[may], n)]
                may = may[np.logical_and.reduceat(same, np.cumsum(n) - n)]
                out[may] = at[may]
        return out

    def some(self, keep: np.ndarray) -> tuple:
        """What the constructor takes, of the kept places."""
        return self.h[keep], self.raw_n[keep], self.raw[T.ranges(self.raw_at[keep], self.raw_n[keep])], self.ids_n[keep], self.ids[T.ranges(self.ids_at[keep], self.ids_n[keep])], self.used[keep]

    def joined(self, other: _Known) -> _Known:
        return _Known(*map(np.concatenate, zip(self.some(np.arange(len(self))), other.some(np.arange(len(other))))))


class Encoder:
    """Ids of texts, by way of their distinct words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. It also cuts
    between letters, single digits and runs of other ASCII, and lower-cases; a word of ASCII and Latin-1 letters is cut there, too.
    Words with other bytes, an apostrophe or '<|' stay whole, as they stand. New words are encoded together, a space between them: each is one
    piece, whose last token bears the word-end mark. Whole words have a special token between them, those that hold '<|' are
    encoded alone. At most KEEP known words are kept (about 70 bytes each); when there are more, the half that was met longest ago goes.
    """

    KEEP = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known, self.recent, self.clock = _Known.none(), _Known.none(), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some words encoded at once, how many each has)."""
        ids = self._ids((" " if plain else self.mark).join(words))
        cut = self.ends[ids] if plain else ids == self.mark_id
        last = np.flatnonzero(cut)
        if len(last) != len(words) - (not plain):  # can't be told apart
            parts = [self._ids(w) for w in words]
            return np.concatenate(parts), np.array(list(map(len, parts)))
        if plain:
            return ids, np.diff(last, prepend=-1)
        return ids[~cut], np.diff(np.append(last, len(ids)), prepend=-1) - 1

    def _learn(self, words: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the new words in an order of their own, numbers of ids, ids); whole: which words stay as they stand."""
        plain, marked = np.flatnonzero(~whole).tolist(), np.flatnonzero(whole).tolist()
        alone = [i for i in marked if "<|" in words[i]]
        marked = [i for i in marked if "<|" not in words[i]]
        groups = [(own[a : a + 512], own is plain) for own in (plain, marked) for a in range(0, len(own), 512)] + [([i], True) for i in alone]
        made = [self._together([words[i] for i in own], kind) if len(own) > 1 else ((x := self._ids(words[own[0]])), np.array([len(x)])) for own, kind in groups]
        return np.array(plain + marked + alone), np.concatenate([n for _, n in made]), np.concatenate([x for x, _ in made])

    def _pieces(self, col: pa.Array):
        """(bytes, start, end, whether whole, offsets of the texts) of the words of the texts."""
        words = T.Words(col)
        raw = words.raw
        kind = _KIND[raw]
        pair = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))  # Latin-1 letters; the signs of times and division aren't
        kind[pair] = kind[pair + 1] = _LETTER
        kind[np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))] = _ODD
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        odd = odd[words.end] > odd[words.start]
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[words.start[odd]] = 1
        edge[words.end[odd]] -= 1
        whole = np.cumsum(edge[:-1], dtype=np.int8) > 0
        cut = np.zeros(len(raw), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut &= (kind != _SPACE) & ~whole
        cut[words.start] = True
        start = np.flatnonzero(cut)
        word = np.searchsorted(words.start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), words.end[word])
        first = np.searchsorted(word, np.arange(len(words) + 1))
        return np.where(whole, raw, T.LOWER[raw]), start, end, odd[word], first[words.offsets]

    def texts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        raw, start, end, whole, offsets = self._pieces(col)
        h = T.span_hashes(raw, start, end) ^ np.where(whole, T.U(0x5851F42D4C957F2D), T.U(0))
        own, first, code = np.unique(h, return_index=True, return_inverse=True)
        start, size, whole = start[first], (end - start)[first], whole[first]
        self.clock += 1
        ids_at, ids_n, base, flat = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), 0, []
        unknown = np.ones(len(own), bool)
        for store in (self.known, self.recent):
            at = store.find(own, raw, start, size)
            hit = at >= 0
            ids_at[hit], ids_n[hit] = store.ids_at[at[hit]] + base, store.ids_n[at[hit]]
            store.used[at[hit]] = self.clock
            unknown &= ~hit
            flat.append(store.ids)
            base += len(store.ids)
        new = np.flatnonzero(unknown)
        if len(new):
            data = raw.tobytes()
            order, count, ids = self._learn([data[a : a + n].decode() for a, n in zip(start[new].tolist(), size[new].tolist())], whole[new])
            new = new[order]
            ids_n[new], ids_at[new] = count, base + np.cumsum(count) - count
            flat.append(ids)
            self._remember(_Known(own[new], size[new], raw[T.ranges(start[new], size[new])], count, ids, np.full(len(new), self.clock)))
        counts = ids_n[code]
        out = np.concatenate(flat)[T.ranges(ids_at[code], counts)]
        return out, np.concatenate([[0], np.cumsum(counts)])[offsets]

    def _remember(self, new: _Known) -> None:
        self.recent = self.recent.joined(new)
        if len(self.recent) > self.KEEP // 8:
            self.known, self.recent = self.known.joined(self.recent), _Known.none()
            if len(self.known) > self.KEEP:
                order = np.argsort(self.known.used, kind="stable")
                self.known = _Known(*self.known.some(np.sort(order[len(order) - self.KEEP // 2 :])))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: a Python worker runs many tasks in turn, and its known words serve them all."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Packer:
    """The open windows of one task; a window is a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, room: int, base: int):
        self.length, self.room, self.base, self.next = length, room, base, 0
        self.open: list[list] = []  # [used, pieces]

    def emit(self, pieces: list, part: int = 0) -> list[tuple]:
        at, out, sequence = 0, [], self.base + self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, at, part, None))
            at += len(ids)
        return out

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> list[tuple]:
        out = []
        while len(ids) >= self.length:
            out += self.emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return out
        fit = [w for w in self.open if w[0] + len(ids) <= self.length]
        if fit:
            best = max(fit, key=lambda w: w[0])
        else:
            if len(self.open) >= self.room:
                full = max(self.open, key=lambda w: w[0])
                head = self.length - full[0]
                full[1].append((doc, start, ids[:head], total))
                out += self.emit(full[1])
                self.open = [w for w in self.open if w is not full]
                start, ids = start + head, ids[head:]
            best = [0, []]
            self.open.append(best)
        best[0] += len(ids)
        best[1].append((doc, start, ids, total))
        if best[0] == self.length:
            out += self.emit(best[1])
            self.open = [w for w in self.open if w is not best]
        return out

    def merge(self, pieces: list) -> tuple[list[tuple], list]:
        """Pieces one after another in full windows; and the pieces of the last, part one."""
        out, window, used = [], [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                head = ids[: self.length - used]
                window.append((doc, start, head, total))
                used, start, ids = used + len(head), start + len(head), ids[len(head) :]
                if used == self.length:
                    out += self.emit(window)
                    window, used = [], 0
        return out, window

    def powers(self, pieces: list) -> list[tuple]:
        """A part window as sequences of lengths that are powers of two, the longest first."""
        left = sum(len(p[2]) for p in pieces)
        out, rest = [], list(pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, used = [], 0
            while used < size:
                doc, start, ids, total = rest.pop(0)
                head = ids[: size - used]
                window.append((doc, start, head, total))
                used += len(head)
                if len(head) < len(ids):
                    rest.insert(0, (doc, start + len(head), ids[len(head) :], total))
            out += self.emit(window)
            left -= size
        return out


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], _NAMES)


def _pack_rows(path: str, length: int, room: int, end: int):
    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own_encoder, packer = encoder(path), _Packer(length, room, part << 32)
        for batch in batches:
            for piece in T.slices(batch, limit=1 << 20):
                ids, offsets = own_encoder.texts(piece.column(1))
                rows = []
                for i, doc in enumerate(piece.column(0).to_pylist()):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end)).astype("<u4")
                    rows += packer.add(doc, 0, own, len(own))
                yield _batch(rows)
        windows = sorted(packer.open, key=lambda w: -w[0])
        rows, rest = packer.merge([p for w in windows for p in w[1]])
        rows += [(d, s, len(i), zlib.crc32(i), n, None, None, part, i.tobytes()) for d, s, i, n in rest]
        yield _batch(rows)

    return pack


def _merge_rows(length: int, group: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
        packer = _Packer(length, 1, (1 << 62) + ((rows[0]["part"] // group) << 32))
        out, rest = packer.merge([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows])
        return pa.Table.from_batches([_batch(out + packer.powers(rest))])

    return merge


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, room: int = OPEN, group: int = GROUP, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = kept(rows.mapInArrow(_pack_rows(path or tokenizer_path(), length, room, end), _SCHEMA))  # once: both branches must see the same windows
    last = packed.where("ids is not null").groupBy(F.floor(F.col("part") / F.lit(group)).alias("merge")).applyInArrow(_merge_rows(length, group), _SCHEMA)
    return packed.where("ids is null").unionByName(last).drop("part", "ids")
