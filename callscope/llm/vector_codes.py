"""Vector compression: part codebooks trained with exact integer arithmetic, pruned by fixed pivots (LAESA).

A component x becomes floor(SCALE * x), a vector is cut into equal consecutive parts, and each part position has a codebook. The
distances of every part to a few fixed pivots (entries of the first codebook, picked farthest first) are computed once and
stored beside the vectors. In a round, the distances of the pivots to the current entries then bound each part's distance to an entry from
below, by the largest difference of the two; entries are tried in the order of that bound, with exact integer distances, until the
bound passes the best one found. The bound is lowered by more than single precision can err, so no nearest entry is lost.

A round is one pass over the stored vectors: tasks add up their own parts by entry, Spark adds up the tasks' sums, and the driver
gets one row for each component of a codebook, whatever the number of vectors.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; the first codebook is that of the rows that come
first by id (null ids last), equal ids by their vectors; with fewer rows than entries there are fewer entries; an empty table has an empty result;
rows that repeat an id have codes of their own; null labels are one label; other columns, whatever their names, play no part.
Vectors of different lengths, of a length that can't be cut, or with components so large that a squared distance leaves 62 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm._frames import read_when_written

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 8, 16, 6, 4, 4096
#: Share by which a bound is lowered; stored distances are right to 2^-24 of their size.
SLACK = 1e-6


def whole(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows with a vector of finite components only."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & finite)


def _integers(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def farthest_first(entries: np.ndarray, n: int) -> np.ndarray:
    """n of the entries, each as far from those before it as can be; the first one is the first entry."""
    picked, gap = [0], ((entries - entries[0]) ** 2).sum(1)
    while len(picked) < min(n, len(entries)):
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((entries - entries[picked[-1]]) ** 2).sum(1))
    return entries[picked]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x to each row of y, from exact squares."""
    return np.sqrt(np.stack([((x - row) ** 2).sum(1) for row in y], 1).astype(np.float64))


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry of each row, its squared distance, number of exact evaluations); ties go to the lower index."""
    across, own = distances(entries, pivots), to_pivots.astype(np.float64)
    low = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(own[:, p, None] - across[None, :, p]) - SLACK * (own[:, p, None] + across[None, :, p]), out=low)
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, 1) ** 2
    best, code, evaluated = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries)), 0
    live = np.arange(len(x))
    for step in range(len(entries)):
        live = live[low[live, step] <= best[live]]
        if not len(live):
            break
        e = order[live, step]
        d = ((x[live] - entries[e]) ** 2).sum(1)
        evaluated += len(live)
        better = (d < best[live]) | ((d == best[live]) & (e < code[live]))
        best[live[better]], code[live[better]] = d[better], e[better]
    return code, best, evaluated


class Codebooks:
    """Entries and pivots of all part positions: arrays of (part, entry or pivot, component)."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots

    def assign(self, values: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(codes, squared distances, exact evaluations) of vectors' parts, a column for each part."""
        parts, n = len(self.entries), self.pivots.shape[1]
        x = values.reshape(len(values), parts, -1)
        found = [nearest(x[:, p], to_pivots[:, p * n : (p + 1) * n], self.entries[p], self.pivots[p]) for p in range(parts)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), sum(f[2] for f in found)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _packed(rows: DataFrame, first: Codebooks) -> DataFrame:
    """Rows with integer components and the distances of their parts to the pivots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _integers(_matrix(batch.column("v"), np.float64))
                x = values.reshape(len(values), len(first.pivots), -1)
                far = np.concatenate([distances(x[:, p], first.pivots[p]) for p in range(x.shape[1])], 1).astype(np.float32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype))) for a in (values, far)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *lists], ["id", "label", "v", "far"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, v array<long>, far array<float>")


def _sums(packed: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, at, total: sums of the components of the parts that have the entry nearest; at -1: how many they are."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column("v"), np.int64)
                code = books.assign(values, _matrix(batch.column("far"), np.float32))[0]
                x = values.reshape(len(values), parts, width)
                for p in range(parts):
                    np.add.at(total[p, :, :width], code[:, p], x[:, p])
                    total[p, :, width] += np.bincount(code[:, p], minlength=entries)
        p, e, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in ((p, pa.int32()), (e, pa.int32()), (np.where(at == width, -1, at), pa.int32()), (total[p, e, at], pa.int64()))], ["part", "entry", "at", "total"])

    made = packed.select("v", "far").mapInArrow(run, "part int, entry int, at int, total long")
    return made.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _moved(books: Codebooks, sums: list) -> Codebooks:
    """The next round's codebooks: means of the parts, rounded down; unused entries stay."""
    total = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in sums}
    entries = books.entries.copy()
    for (p, e, at), n in total.items():
        if at == -1:
            entries[p, e] = [total.get((p, e, i), 0) // n for i in range(entries.shape[2])]
    return Codebooks(entries, books.pivots)


def train(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[Codebooks | None, DataFrame | None]:
    """(codebooks after all rounds, the stored rows id, label, v, far); (None, None) where no row has a whole vector."""
    rows = whole(vectors, vec_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    size = F.size("v")
    m = rows.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("far")).first()
    if m["most"] is None:
        return None, None
    if m["least"] != m["most"] or m["most"] % parts or not m["most"]:
        raise ValueError(f"vectors have {m['least']} to {m['most']} components; one length is needed that {parts} divides")
    if m["most"] // parts * (2 * (SCALE * m["far"] + 1)) ** 2 >= 2**62:
        raise ValueError(f"a component of size {m['far']} is too large for exact distances")
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    first = _integers(np.array([r["v"] for r in seeds])).reshape(len(seeds), parts, -1).swapaxes(0, 1)
    books = Codebooks(first, np.stack([farthest_first(e, pivots) for e in first]))
    packed = read_when_written(_packed(rows, books), "vector-parts")
    for _ in range(rounds):
        books = _moved(books, _sums(packed, books).collect())
    return books, packed


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, n_evaluated: every whole vector's code (two hex digits a part) and squared
    error, the errors of its label, the codebooks' digest, and the exact distances computed for its batch's rows on average."""
    kind = dict(vectors.dtypes)
    books, packed = train(vectors, id_col, vec_col, label_col, parts, entries, rounds, pivots)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind[id_col]}, code string, error long, label_error long, codebooks_sha256 string, n_evaluated double")
    digit = [f"{e:02x}" for e in range(max(entries, 1))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, error, n = books.assign(_matrix(batch.column("v"), np.int64), _matrix(batch.column("far"), np.float32))
                text = ["".join(map(digit.__getitem__, row)) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.sum(1), pa.int64()), pa.array(np.full(len(code), n / len(code)))], ["id", "label", "code", "error", "n_evaluated"])

    coded = packed.mapInArrow(run, f"id {kind[id_col]}, label {kind[label_col]}, code string, error long, n_evaluated double")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "n_evaluated")
