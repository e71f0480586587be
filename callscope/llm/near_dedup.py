"""Near-duplicate classes of documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of sub-keys, TABLES of ROWS minhashes each, give table keys: key (i, j) joins sub-key i of the first
collection and j of the second, for the WIDTH values of j that follow i round the clock. 2 * TABLES * ROWS minhashes thus do
the work of TABLES * WIDTH * 2 * ROWS. At the threshold of 0.75 a pair is missed with probability 0.0008 (0.0005 as it shares no
sub-key of a collection, the rest as none of the shared ones meet), below 0.0001 from 0.8 on; at 0.23 it is a candidate with
probability 0.003 at most, so that a text's share of common boilerplate makes few candidates.
Only sub-keys that two classes share are combined, and buckets with the same members count as one.

1. Equal shingle sets become one class, named by its smallest id.
2. Each bucket of the tables (i, i) links its members to its smallest member, where the sizes of the sets allow it; these
   candidate links are confirmed on full sets. Most copies become one component here, so that a large group needs few keys.
3. The same with the buckets of all tables, for the sub-keys that several components still share.
4. Members of buckets that still hold several components are compared across components, exactly, in blocks of bounded
   size (counts of common shingles by matrix product). Buckets with the same members are taken once. Where the buckets of a
   connected region overlap so much that comparing bucket by bucket would make more comparisons than the region has pairs,
   the region is compared as one. Pairs inside a component are skipped, and a block pair returns a spanning forest of its links:
   fewer links than it has components.

Defined results: null or empty text or one without words has the empty set and is linked with nothing; a text of fewer than
`size` words has its whole word sequence as its one shingle; a row with a null id is linked with nothing, has no component and
is kept; rows that repeat an id are one document in the links (each text of the id may link it), and a row of the result each.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm._frames import components, grouped, kept, splittable

SIZE, PERCENT = 5, 75
TABLES, ROWS, WIDTH = 22, 4, 9
BLOCK = 256


def shingle_sets(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each text, and the texts' offsets."""
    words = T.Words(col, lower=True)
    h = words.hashes()
    start = T.window_starts(words.counts, words.offsets, size)
    values = [T.rolling(h, size)[start]]
    docs = [words.doc()[start]]
    for n in range(1, size):  # a short text is one shingle
        short = np.flatnonzero(words.counts == n)
        values.append(T.rolling(h, n)[words.offsets[:-1][short]] if len(short) else np.zeros(0, T.U))
        docs.append(short)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(col) + 1))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * T.U(2) + T.U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two order-free 64-bit sums over each set."""
    sums = np.zeros((2, len(value) + 1), T.U)
    np.cumsum(value, out=sums[0, 1:])
    np.cumsum(T.mix(value), out=sums[1, 1:])
    return sums[:, offsets[1:]] - sums[:, offsets[:-1]]


def _sketch_rows(size: int, tables: int, rows: int):
    a, b = _seeds(2 * tables * rows)

    def sketch(batch: pa.RecordBatch):
        value, offsets = shingle_sets(batch.column(1), size)
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        at = offsets[:-1][full]
        low = (value >> T.U(20)).astype(T.U)
        keys = np.zeros((len(full), 2 * tables), T.U)
        sig = _signatures(value, offsets)
        if len(full):
            for k in range(2 * tables * rows):
                least = np.minimum.reduceat((low * a[k] + b[k]) >> T.U(32), at)
                keys[:, k // rows] = T.mix(keys[:, k // rows] + least + T.U(k))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * tables, 0))]).astype(np.int32)), T.signed(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), T.signed(sig[0]), T.signed(sig[1]), lists], ["id", "n", "s1", "s2", "keys"])

    return T.mapped(sketch)


def _set_rows(size: int):
    def sets(batch: pa.RecordBatch):
        value, offsets = shingle_sets(batch.column(1), size)
        raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(value)])
        s1, s2 = _signatures(value, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), T.signed(s1), T.signed(s2), raw], ["id", "s1", "s2", "shingles"])

    return T.mapped(sets)


def _confirm_rows(percent: int):
    """For rows (a, b, x, y) with two sets as bytes: whether they are similar enough."""

    def confirm(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            step = 512
            for lo in range(0, batch.num_rows, step):
                x, ox = T.buffer_of(batch.column(2).slice(lo, step))
                y, oy = T.buffer_of(batch.column(3).slice(lo, step))
                nx, ny = np.diff(ox) // 8, np.diff(oy) // 8
                pair = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                value = np.concatenate([np.frombuffer(x.tobytes(), T.U), np.frombuffer(y.tobytes(), T.U)])
                order = np.lexsort((value, pair))
                pair, value = pair[order], value[order]
                same = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
                both = np.bincount(pair[1:][same], minlength=len(nx))
                keep[lo : lo + len(nx)] = 100 * both >= percent * (nx + ny - both)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return confirm


def _block_links(percent: int):
    """A spanning forest of the links between the left and right rows of one block pair; rows (block, other, side, id, component, shingles)."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        raw, offsets = T.buffer_of(table["shingles"])
        size = np.diff(offsets) // 8
        value = np.frombuffer(raw.tobytes(), T.U)
        row = np.repeat(np.arange(len(ids)), size)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):  # a block with itself
            right = left
        place = np.full((2, len(ids)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        shared = np.unique(value[place[0, row] >= 0])
        shared = shared[np.isin(shared, value[place[1, row] >= 0], assume_unique=False)]
        at = np.searchsorted(shared, value)
        at[at == len(shared)] = 0
        hit = (shared[at] == value) if len(shared) else np.zeros(len(value), bool)
        both = np.zeros((len(left), len(right)), np.float32)
        at, where = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        at, where = at[order], where[order]
        for lo in range(0, len(shared), 4096):
            cut = slice(*np.searchsorted(at, [lo, lo + 4096]))
            m = np.zeros((2, max(len(left), len(right)), 4096), np.float32)
            for k in (0, 1):
                own = place[k, where[cut]]
                m[k, own[own >= 0], (at[cut] - lo)[own >= 0]] = 1
            both += m[0, : len(left)] @ m[1, : len(right)].T
        total = size[left][:, None] + size[right][None, :] - both
        i, j = np.nonzero((100 * both >= percent * total) & (comp[left][:, None] != comp[right][None, :]))
        tree = _forest(comp[left][i], comp[right][j])
        i, j = i[tree], j[tree]
        return pa.table({"a": ids[left][i], "b": ids[right][j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return links


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links that join the same components as all do, one fewer than the components at most."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    first = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_index=True)[1] if len(a) else np.zeros(0, int)
    root, keep = list(range(len(names))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in first.tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            root[x] = y
            keep.append(k)
    return keep


#: What of a packed sub-key tells its set of members; the rest is its place.
_MATES = -64


def _diagonal_rows(tables: int):
    """Rows (id, n, keys) -> (t, id, n, component) for the tables that join sub-key i of both collections; the id as component."""

    def rows(batch: pa.RecordBatch):
        row, v = T.listed(batch.column(2))
        slot, mates = v & ~_MATES, v & _MATES
        p, q = slot < tables, slot >= tables
        _, i, j = np.intersect1d(row[p] * tables + slot[p], row[q] * tables + slot[q] - tables, return_indices=True)
        yield _table_keys(batch.column(0), batch.column(1), batch.column(0), row[p][i], mates[p][i], mates[q][j])

    return T.mapped(rows, "keys")


def _tensor_rows(tables: int, width: int):
    """Rows (id, n, component, keys) -> (t, id, n, component) for the tables of a first sub-key and the `width` second ones from its place on."""

    def rows(batch: pa.RecordBatch):
        row, v = T.listed(batch.column(3))
        slot, mates = v & ~_MATES, v & _MATES
        order = np.argsort(row, kind="stable")
        first, second = order[slot[order] < tables], order[slot[order] >= tables]
        at = np.searchsorted(row[second], np.arange(batch.num_rows + 1))
        count = np.diff(at)[row[first]]
        for lo in range(0, len(first), 1 << 12):  # a sub-key makes a few dozen rows
            own, n = first[lo : lo + (1 << 12)], count[lo : lo + (1 << 12)]
            p, q = np.repeat(own, n), second[T.ranges(at[row[own]], n)]
            near = (slot[q] - slot[p]) % tables < width
            p, q = p[near], q[near]
            yield _table_keys(batch.column(0), batch.column(1), batch.column(2), row[p], mates[p], mates[q])

    return T.mapped(rows, "keys")


def _table_keys(ids: pa.Array, n: pa.Array, component: pa.Array, row: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    t = T.mix(T.mix(p.view(T.U)) + q.view(T.U))
    order = np.lexsort((t, row))
    row, t = row[order], t[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (t[1:] != t[:-1])
    at = pa.array(row[new])
    return pa.RecordBatch.from_arrays([T.signed(t[new]), ids.take(at), n.take(at), component.take(at)], ["t", "id", "n", "component"])


_TABLE_KEYS = "t long, id long, n long, component long"


def _sizes_allow(n: str, m: str, percent: int):
    """Whether two sets of these sizes can be similar enough; 0 stands for an id with several sets."""
    return (F.least(n, m) == 0) | (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))


def _shared_keys(reps: DataFrame) -> DataFrame:
    """(id, n, keys): the sub-keys that another representative has, too; each as what tells its set of members, with its place."""
    sub = reps.select("id", F.posexplode("keys").alias("slot", "key"))  # a key is of one slot
    alike = grouped(sub, "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x")).where("lo <> hi").select("key", F.xxhash64("lo", "hi", "c", "x").alias("mates"))
    own = sub.join(alike, "key").select("id", F.col("mates").bitwiseAND(F.lit(_MATES)).bitwiseOR(F.col("slot").cast("long")).alias("k"))
    sizes = reps.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.min("n")).otherwise(0).alias("n"))
    return own.groupBy("id").agg(F.collect_list("k").alias("keys")).join(sizes, "id").select("id", "n", "keys")


def _mixed_keys(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n, component, keys): the sub-keys that members of several components share."""
    flat = shared.join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), F.explode("keys").alias("k"))
    mixed = grouped(flat, "k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("k")
    return flat.join(mixed, "k").groupBy("id", "n", "component").agg(F.collect_list("k").alias("keys"))


def _members(table_keys: DataFrame) -> DataFrame:
    """The table keys of buckets with several components, with the bucket's smallest member a, its number and what tells its members."""
    buckets = grouped(table_keys, "t").agg(F.min(F.struct("id", "n", "component")).alias("h"), F.max("id").alias("z"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x")).where("lo <> hi")
    named = buckets.select("t", F.col("h.id").alias("a"), F.col("h.n").alias("an"), F.col("h.component").alias("ac"), "c", F.xxhash64("h.id", "z", "c", "x").alias("mates"))
    return table_keys.join(named, "t")


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Candidate links of buckets' members to the smallest one, across components."""
    return members.where("id <> a and component <> ac").where(_sizes_allow("n", "an", percent)).select("a", F.col("id").alias("b")).distinct()


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))


def _sets(texts: DataFrame, reps: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the representatives with these ids."""
    chosen = kept(reps.join(ids.distinct(), "id", "left_semi").select("id", "s1", "s2"))
    raw = texts.join(chosen.select("id").distinct(), "id", "left_semi").mapInArrow(_set_rows(size), "id long, s1 long, s2 long, shingles binary")
    return kept(raw.join(chosen, ["id", "s1", "s2"], "left_semi").dropDuplicates(["id", "s1", "s2"]).select("id", "shingles"), release=True)


def _confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = stars.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return kept(pairs.select("a", "b", "x", "y").mapInArrow(_confirm_rows(percent), "a long, b long"), release=True)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _open_groups(members: DataFrame, found: DataFrame, block: int) -> DataFrame | None:
    """(g, id, component, blocks): what has to be compared across components: a bucket's members, or those of a whole region."""
    some = members.where("c > 2").select("mates", "a", "id").distinct()  # buckets with the same members as one
    inside = kept(some.join(found, "id", "left").select("mates", "a", "id", F.coalesce("component", "id").alias("component")), release=True)
    if inside.isEmpty():
        return None
    region = components(inside.select("a", F.col("id").alias("b"))).withColumnRenamed("component", "region")
    mixed = inside.groupBy("mates", "a").agg(F.count(F.lit(1)).cast("double").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    heads = mixed.join(region.withColumnRenamed("id", "a"), "a").select("mates", "region", "m")
    work = heads.groupBy("region").agg(F.sum(F.col("m") * F.col("m")).alias("by_bucket"))
    size = region.groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("k"))
    plan = kept(heads.join(work, "region").join(size, "region").withColumn("whole", F.col("k") * F.col("k") <= F.col("by_bucket")), release=True)
    blocks = lambda c: F.ceil(F.col(c) / F.lit(float(block))).cast("int").alias("blocks")
    bucketwise = inside.join(splittable(plan.where("not whole").select("mates", blocks("m")), "mates"), "mates").select(F.col("mates").alias("g"), "id", "component", "blocks")
    whole = inside.select("id", "component").distinct().join(region, "id").join(splittable(plan.where("whole").select("region", blocks("k")).distinct(), "region"), "region").select(F.xxhash64(F.lit(1), "region").alias("g"), "id", "component", "blocks")
    return bucketwise.unionByName(whole)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, tables: int = TABLES, rows: int = ROWS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) per document; component_id is the smallest id reachable by links."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = kept(texts.mapInArrow(_sketch_rows(size, tables, rows), "id long, n long, s1 long, s2 long, keys array<long>"))
    some = sketch.where("n > 0 and id is not null")
    classes = kept(some.groupBy("s1", "s2", "n").agg(F.min("id").alias("cls")))
    reps = kept(some.join(classes.select(F.col("cls").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi").dropDuplicates(["id", "s1", "s2"]))

    shared = kept(_shared_keys(reps), release=True)
    stars = kept(_stars(_members(kept(shared.mapInArrow(_diagonal_rows(tables), _TABLE_KEYS))).withColumn("ac", F.col("a")), percent), release=True)
    sets = _sets(texts, reps, _ends(stars), size)
    links = _confirmed(stars, sets, percent)
    twice = kept(some.groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("id"))
    if not twice.isEmpty():  # an id with several texts is one document
        links = links.unionByName(some.join(twice, "id", "left_semi").join(classes, ["s1", "s2", "n"]).where("id <> cls").select(F.col("cls").alias("a"), F.col("id").alias("b")))
    final = kept(components(links), release=True)

    members = kept(_members(kept(_mixed_keys(shared, final).mapInArrow(_tensor_rows(tables, width), _TABLE_KEYS))), release=True)
    if not members.isEmpty():
        stars = kept(_stars(members, percent))
        sets = sets.unionByName(_sets(texts, reps, _ends(stars).unionByName(members.where("c > 2").select("id")).join(sets.select("id").distinct(), "id", "left_anti"), size))
        links = _edges(final).unionByName(_confirmed(stars, sets, percent))
        open_groups = _open_groups(members, final, block)
        if open_groups is not None:
            placed = open_groups.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("id", "component", "g", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
            more = kept(spread.join(sets, "id").groupBy("g", "p", "q").applyInArrow(_block_links(percent), "a long, b long"), release=True)
            links = links.unionByName(more)
        final = kept(components(links), release=True)

    cls = kept(classes.join(final.withColumnRenamed("id", "cls"), "cls", "left").select("s1", "s2", "n", F.coalesce("component", "cls").alias("component")))
    named = sketch.where("id is not null").select("id", "n", "s1", "s2").join(cls, ["s1", "s2", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    lost = sketch.where("id is null").select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    out = named.unionByName(lost)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
