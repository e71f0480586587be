"""Frame analysers that users supply, run over the frames of each utterance in order.

Frames are dealt out by utterance and sorted within it, and stream through a task in Arrow batches. An analyser is fed the pieces of its
utterance as they come, so an utterance may be longer than a batch; what an analyser has to remember between two pieces it keeps itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from callscope.sources.tables import KEY

#: The analyser factory of the last job that a worker took part in: loaded once a worker.
_LOADED: dict[str, Callable] = {}


def analyse(frames: DataFrame, load: Callable[[], Callable], makes: str, columns: list[str], sort: list[str] = ("t",), by: list[str] = KEY) -> DataFrame:
    """(by, what the analyser makes): rows of every utterance's analyser.

    `load` runs once in a Python worker and returns a function that begins an utterance; what that returns has feed(piece) and end(), which
    take or give columns by name as arrays (lists of samples one after the other, nulls as not-a-number) and may return None. `makes` states
    the columns that they return.
    """
    kinds = dict(frames.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), makes])
    names = [part.split()[0] for part in makes.split(",")]
    job, by, columns = uuid.uuid4().hex, list(by), list(columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if job not in _LOADED:
            _LOADED.clear()
            _LOADED[job] = load()
        begin, key, current, fields = _LOADED[job], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(b) for b in by]
            out = []
            for start, size in zip(*_runs(batch, by)):
                own = tuple(batch.column(b)[start].as_py() for b in by)
                if own != key:
                    if current is not None:
                        out.append((key, current.end()))
                    key, current = own, begin()
                out.append((key, current.feed({c: _numbers(batch.column(c).slice(start, size)) for c in columns})))
            yield from _rows(out, fields, names)
        if current is not None:
            yield from _rows([(key, current.end())], fields, names)

    return frames.select(*by, *dict.fromkeys([*sort, *columns])).repartition(*by).sortWithinPartitions(*by, *sort).mapInArrow(run, schema)


def whole(function: Callable[[dict[str, np.ndarray]], dict | None]) -> Callable[[], Callable]:
    """The `load` of a plain function of all of an utterance's frames."""

    class Collected:
        def __init__(self):
            self.pieces: list[dict] = []

        def feed(self, piece: dict) -> None:
            self.pieces.append(piece)

        def end(self) -> dict | None:
            return function({c: np.concatenate([p[c] for p in self.pieces]) for c in self.pieces[0]})

    return lambda: Collected


def _runs(batch: pa.RecordBatch, by: list[str]) -> tuple[list[int], list[int]]:
    """Where runs of equal keys start, and their lengths."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for b in by:
        col = batch.column(b)
        a, z = col.slice(1), col.slice(0, n - 1)
        new[1:] |= pc.fill_null(pc.not_equal(a, z), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(z).to_numpy(zero_copy_only=False))
    start = np.flatnonzero(new)
    return start.tolist(), np.diff(np.append(start, n)).tolist()


def _numbers(col: pa.Array) -> np.ndarray:
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        col = col.flatten()
    return pc.cast(col, pa.float64()).to_numpy(zero_copy_only=False)


def _rows(made: list[tuple], fields: list[pa.Field], names: list[str]) -> Iterator[pa.RecordBatch]:
    made = [(key, m, len(m[names[0]])) for key, m in made if m is not None and len(m[names[0]])]
    if made:
        keys = [pa.array([key[i] for key, _, n in made for _ in range(n)], f.type) for i, f in enumerate(fields)]
        values = [pa.array(np.concatenate([np.asarray(m[x]) for _, m, _ in made])) for x in names]
        yield pa.RecordBatch.from_arrays([*keys, *values], [*(f.name for f in fields), *names])


class FrameRms:
    """Root mean square of each Hann-windowed frame; what a frame still lacks is kept for the next piece."""

    BLOCK = 4096

    def __init__(self, size: int, hop: int):
        self.size, self.hop, self.taper = size, hop, np.hanning(size + 1)[:-1]
        self.rest, self.made = np.zeros(0), 0

    def _frames(self, x: np.ndarray) -> dict:
        n = (len(x) - self.size) // self.hop + 1
        cut = np.lib.stride_tricks.sliding_window_view(x, self.size)[:: self.hop][:n]
        power = [((cut[i : i + self.BLOCK] * self.taper) ** 2).mean(1) for i in range(0, n, self.BLOCK)]
        at = (self.made + np.arange(n)) * self.hop
        self.made += n
        return {"t": at.astype(np.int64), "rms": np.sqrt(np.concatenate(power))}

    def feed(self, piece: dict) -> dict | None:
        x = np.concatenate([self.rest, piece["samples"]])
        n = max(0, (len(x) - self.size) // self.hop + 1)
        self.rest = x[n * self.hop :]
        return self._frames(x) if n else None

    def end(self) -> dict | None:
        """An utterance shorter than a frame is padded to one."""
        return None if self.made else self._frames(np.pad(self.rest, (0, self.size - len(self.rest))))
