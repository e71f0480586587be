"""Document fingerprints by a randomised edit embedding, with bit-sampled banding and verification.

A walk with shared randomness turns a text of n characters into a string of about 2n symbols: at step j it emits the current
character and moves on iff the shared random bit of (j mod CYCLE, character class) is set. Texts at a small edit distance
soon fall into step again after an edit, so their embeddings differ in few places: edit distance becomes Hamming distance.

Octave b holds the steps [2^b, 2^(b+1)); SAMPLES fixed steps of each octave are read, one byte of a hash of the emitted
character and the step each. So a fingerprint is a sample of the embedding at places that don't depend on the text's length,
denser near its start. The likeness of two fingerprints is the share of equal bytes, each octave weighted with its length.
Bands of BAND_SYMBOLS sampled symbols are the keys of candidate pairs, which an edit-distance check on the embedding confirms.

Defined results: null text is empty, whose fingerprint is the empty string, with likeness 1 to another empty one and 0 to
any other; equal texts have equal fingerprints; rows with a null id come last; rows that repeat an id lie next to each other
in the order of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm._frames import components, kept

CYCLE = 4096
SAMPLES = 16
LANES = 384
BANDS, BAND_SYMBOLS = 16, 4
BLOCK = 128
#: Ranges of ids, at most; bounds what the driver holds and broadcasts, a row of 16 bytes each.
MAX_BLOCKS = 20_000
_R = np.random.default_rng(424242)
_MOVE = _R.integers(0, 2, (CYCLE, 256), dtype=np.uint8)
_SALT = _R.integers(1, 2**63, 256, dtype=np.uint64) | T.U(1)


def _places(octaves: int) -> np.ndarray:
    """The sampled steps of each octave, in order: octave b has min(SAMPLES, 2^b)."""
    out = []
    for b in range(octaves):
        lo = 1 << b
        r = np.random.default_rng(1000 + b)
        out.append(np.arange(lo, 2 * lo) if lo <= SAMPLES else np.sort(lo + r.choice(lo, SAMPLES, replace=False) if lo < 1 << 20 else lo + r.integers(0, lo, SAMPLES)))
    return np.concatenate(out)


def classes(text: str) -> np.ndarray:
    """A byte for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8) if len(points) and points.max() > 255 else points.astype(np.uint8)


def embed(texts: list[np.ndarray]) -> list[bytes]:
    """The sampled symbols of each text's walk, one byte each. The walks of up to LANES texts advance together."""
    out: list[bytes] = [b""] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        size = np.array([len(texts[i]) for i in lanes])
        longest = int(size[0])
        octaves = int(3 * longest).bit_length()
        places = _places(octaves)
        # characters of all lanes end to end; each lane ends in a stop that no walk leaves
        start = np.cumsum(size + 1) - (size + 1)
        flat = np.zeros(int((size + 1).sum()), np.uint8)
        for s, i in zip(start, lanes):
            flat[s : s + len(texts[i])] = texts[i]
        end = start + size
        at = start.copy()
        live = len(lanes)
        symbols = np.zeros((len(lanes), len(places)), np.uint8)
        filled = np.zeros(len(lanes), np.int64)
        nxt = 0
        j = 1  # step 0 isn't sampled
        while nxt < len(places) and live:
            stop = min(int(places[nxt]), j + 256)
            pos, last = at[:live], end[:live]
            while j < stop:
                pos += _MOVE[j % CYCLE][flat[pos]]
                np.minimum(pos, last, out=pos)
                j += 1
            if j == places[nxt]:
                on = pos < last
                c = flat[pos].astype(T.U)
                symbols[:live, nxt] = np.where(on, T.mix((c + T.U(1)) * _SALT[nxt % 256]) >> T.U(56), 0)
                filled[:live] = np.where(on, nxt + 1, filled[:live])
                nxt += 1
            still = np.flatnonzero(pos < last)
            live = int(still[-1]) + 1 if len(still) else 0
        for k, i in enumerate(lanes):
            out[i] = symbols[k, : filled[k]].tobytes()
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Hex of the sampled symbols of each text."""
    return [x.hex() for x in embed([classes(t) for t in texts])]


def _octave_of(octaves: int = 40) -> np.ndarray:
    return np.concatenate([np.full(min(SAMPLES, 1 << b), b) for b in range(octaves)])


_OCTAVE = _octave_of()
_WEIGHT = np.array([(1 << int(b)) / min(SAMPLES, 1 << int(b)) for b in _OCTAVE])


def likeness(a: str, b: str) -> float:
    """Weighted share of equal symbols; symbols that only one has count as different."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    n, m = min(len(x), len(y)), max(len(x), len(y))
    if not m:
        return 1.0
    return float(_WEIGHT[:n][x[:n] == y[:n]].sum() / _WEIGHT[:m].sum())


def _neighbour_rows():
    """Rows (block, id, text, own), sorted by block and descending place -> (id, text, next text) for own rows."""

    def pairs(batches):
        held = None  # (id, text) that waits for the next
        for batch in batches:
            for block, doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None:
                    yield held[0], held[1], text or ""
                held = (doc, text or "") if own else None
        # the last row of a task is never an own one: each block ends with its follower

    def rows(batches):
        some, size = [], 0
        for x in pairs(batches):
            some.append(x)
            size += len(x[1]) + len(x[2])
            if len(some) >= 4096 or size > 6 << 20:
                yield _print_rows(some)
                some, size = [], 0
        if some:
            yield _print_rows(some)

    return rows


def edited(text: str, following: str) -> str:
    """The text whose last floor(n/2) characters are replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _print_rows(rows: list[tuple]) -> pa.RecordBatch:
    new = [edited(t, f) for _, t, f in rows]
    follow = [f for _, _, f in rows]
    distinct = {t: None for t in (*[r[1] for r in rows], *new, *follow)}
    known = dict(zip(distinct, fingerprints(list(distinct))))
    cols = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
        pa.array([known[r[1]] for r in rows]),
        pa.array([known[t] for t in new]),
        pa.array([likeness(known[r[1]], known[t]) for r, t in zip(rows, new)]),
        pa.array([likeness(known[r[1]], known[f]) for r, f in zip(rows, follow)]),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 4000) -> DataFrame:
    """Fingerprints of each text and of its edit with the next text by descending id (after the last: the first).

    Ids are cut into ranges of about `rows_per_block` rows; each range is sorted in a task of its own and gets one more row,
    the first one of the range that follows, so that every text meets its follower with a single shuffle of the texts.
    """
    spark = docs.sparkSession
    text = F.col(text_col).alias("text")
    rows = docs.select(F.when(F.col(id_col).isNull(), F.lit(2**63 - 1)).otherwise(-F.col(id_col).cast("long")).alias("k"), F.col(id_col).cast("long").alias("id"), text)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], _OUT)
    blocks = min(MAX_BLOCKS, -(-total // rows_per_block))
    cuts = sorted(set(rows.select(F.col("k").cast("double")).approxQuantile("k", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    bounds = np.array(cuts)
    block_of = F.arrow_udf(lambda k: pa.array(np.searchsorted(bounds, k.to_numpy(zero_copy_only=False).astype(float)).astype(np.int32)), "int")
    placed = rows.withColumn("block", block_of("k"))
    # the first place of every block (a row a block): it also closes the block before, and the first of all closes the last
    firsts = sorted((r["block"], r["k"]) for r in placed.groupBy("block").agg(F.min("k").alias("k")).collect())
    lead = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "k long, block int")
    own = placed.select("block", F.lit(0).alias("tail"), "k", "id", "text", F.lit(True).alias("own"))
    extra = rows.join(F.broadcast(lead), "k").select("block", F.lit(1).alias("tail"), "k", "id", "text", F.lit(False).alias("own"))
    both = own.unionByName(extra).repartitionByRange(len(firsts), "block").sortWithinPartitions("block", "tail", "k", "text")
    return both.select("block", "id", "text", "own").mapInArrow(_neighbour_rows(), _OUT)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns, a machine integer of any width for each."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return score


def _close(x: str, y: str, similarity: float) -> bool:
    most = (1 - similarity) * max(len(x), len(y))
    return abs(len(x) - len(y)) <= most and edit_distance(x, y) <= most


def _block_links(similarity: float):
    """Links between the rows (region, p, q, side, id, component, keys, text) of one block pair; a block with itself has side 0 only.

    Only pairs with a common key and of different components are judged, and none that the links so far have joined.
    """

    def links(table: pa.Table) -> pa.Table:
        side, ids, comp, keys, texts = (table[c].to_pylist() for c in ("side", "id", "component", "keys", "text"))
        inner = 1 not in side
        by_key: dict[int, tuple[list[int], list[int]]] = {}
        for i, own in enumerate(keys):
            for k in own:
                by_key.setdefault(k, ([], []))[side[i]].append(i)
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        judged, out = set(), []
        for left, right in by_key.values():
            for i in left:
                for j in left if inner else right:
                    if (inner and i >= j) or (i, j) in judged or root(comp[i]) == root(comp[j]):
                        continue
                    judged.add((i, j))
                    if _close(texts[i], texts[j], similarity):
                        out.append((ids[i], ids[j]))
                        parent[root(comp[i])] = root(comp[j])
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(id, component_id): documents linked by a common band and an edit distance of at most (1 - similarity) * length.

    Equal texts are one class. A band is a choice of BAND_SYMBOLS sampled symbols of one octave, with the octave; each band's
    members meet its smallest id, which is confirmed on the texts. Members of bands that still hold several components are then
    compared across components, in pairs of blocks of about `block` texts; a pair is judged once, however many bands it shares.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    same = texts.groupBy(F.sha2("text", 256).alias("sig")).agg(F.min("id").alias("cls"))
    member = texts.select("id", F.sha2("text", 256).alias("sig")).join(same, "sig").select("id", "cls")
    reps = texts.join(same.select(F.col("cls").alias("id")), "id", "left_semi").where("text <> ''")

    def bands(batch: pa.RecordBatch):
        out_id, out_key = [], []
        for doc, symbols in zip(batch.column(0).to_pylist(), embed([classes(t) for t in batch.column(1).to_pylist()])):
            octave = _OCTAVE[: len(symbols)]
            for b in np.unique(octave):
                own = np.frombuffer(symbols, np.uint8)[octave == b]
                r = np.random.default_rng(int(b))
                if len(own) < BAND_SYMBOLS or b < octave[-1] - 4:
                    continue
                for t in range(BANDS):
                    pick = r.choice(SAMPLES, BAND_SYMBOLS, replace=False)
                    if pick.max() < len(own):
                        out_id.append(doc)
                        out_key.append(f"{b}.{t}.{own[pick].tobytes().hex()}")
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_key, pa.string())], ["id", "key"])

    keys = kept(reps.mapInArrow(T.mapped(bands), "id long, key string"))
    centre = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    members = keys.join(centre, "key")
    pairs = kept(members.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    confirm = F.arrow_udf(lambda x, y: pa.array([_close(a, b, similarity) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.bool_()), "boolean")
    left, right = reps.select(F.col("id").alias("a"), F.col("text").alias("x")), reps.select(F.col("id").alias("b"), F.col("text").alias("y"))
    links = kept(pairs.join(left, "a").join(right, "b").where(confirm("x", "y")).select("a", "b"))
    found = kept(components(links))

    # bands that hold several components: their members are compared across components
    named = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_docs = named.join(mixed, "key").groupBy("id", "component").agg(F.collect_set(F.xxhash64("key")).alias("keys"))  # a few bands an octave
    region = components(pairs).select("id", F.col("component").alias("region"))
    inside = kept(open_docs.join(region, "id"))
    count = inside.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("blocks"))
    placed = inside.join(count, "region").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(reps, "id")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("region", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "component", "keys", "text")
    more = spread.groupBy("region", "p", "q").applyInArrow(_block_links(similarity), "a long, b long")
    final = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = member.join(final.select(F.col("id").alias("cls"), "component"), "cls", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("component", "cls").alias("component_id"))
