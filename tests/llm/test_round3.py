"""Operators 11 to 13 against plain brute-force versions, with nulls, empty, long and repeated rows, ties and clashing columns."""

import bisect
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callscope.llm import pair_alignment, piece_codec, toxicity, vector_codes, warc
from callscope.llm.token_counts import model_path

ODD = ["", None, " ", "  two  spaces ", "▁mark ▁", "<s></s><unk><0x41>", "<|endoftext|> x", "é́ 中文 😀\x00\x01", "aaaa" * 50, " " * 300, "\n\n\t x", "Ω≈ç√∫˜µ≤", "tie tie", "tie tie"]


def texts(seed=3, n=40):
    r = random.Random(seed)
    syllables = ["the", "in", "er", "tion", "ße", "ción", "ñ", "ez", "x", "qu", "12", ".", ",", "\n", " ", " ", " ", "é", "!!", "中"]
    return ODD + ["".join(r.choice(syllables) for _ in range(r.randrange(1, 200))) for _ in range(n)] + ["".join(r.choice(syllables) for _ in range(60_000)), "ab" * 100_000, "x" + " \n" * 200_000 + "y"]


def frame(spark, rows):
    """Rows of (id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("chunk", "slot", "pair", "id", "ids", "bits", "decoded", "n_a")}).repartition(3)


# 13


@pytest.fixture(scope="module")
def codec():
    return piece_codec.codec(model_path())


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.one_of(st.text(max_size=60), st.text("abent ▁\n中ß1.=😀", max_size=60)))
def test_ids_are_the_librarys(codec, text):
    assert codec.encode(text) == codec.library.encode(text)


def test_ids_of_pieces_runs_and_long_texts(codec):
    r = random.Random(5)
    for t in texts() + [" " * n + "x" + " " * (n // 2) for n in range(70)] + ["".join(codec.pieces[r.randrange(3, 32000)] for _ in range(r.randrange(1, 9))) for _ in range(3000)]:
        assert codec.encode(t) == (codec.library.encode(t) if t else [])


def test_neighbours_that_merge_differently_are_told(codec):
    """Some longest matches have to be given up, or backtracking is not tested."""
    word = next(w for w in ("▁" + a + b for a in codec.pieces[300:900] for b in codec.pieces[300:400] if "▁" not in a + b) if len(codec.merged(w)) > 1 and len(codec.merged(w)[0]) < max(len(p) for p in codec.id if w.startswith(p)))
    assert [codec.pieces[i] for i in codec._ids(word)] == codec.merged(word)


def test_piece_codec_query(spark, codec):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "same id")]
    got = Counter(map(tuple, piece_codec.digests(frame(spark, rows)).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for k, t in rows:
        ids = codec.library.encode(t or "")
        want[k, len(ids), sha(",".join(map(str, ids))), sha(codec.library.decode(ids) if ids else "")] += 1
    assert got == want
    back = {r["doc_id"]: r for r in piece_codec.round_trip(frame(spark, rows[:-2])).collect()}
    assert all(back[k]["decoded"] == (t or "").replace("▁", " ") and len(back[k]["ids"]) == len(codec.encode(t)) for k, t in rows[:-2])
    assert piece_codec.digests(frame(spark, rows).limit(0)).count() == 0


# 11


def plain_alignment(rows):
    """The contract word by word, with the tokenizers library for the first tokenizer."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    entry = {i: bytes(char[c] for c in s) for s, i in t.get_vocab().items() if s != "<|endoftext|>"}
    p = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    piece = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for key, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.encode(text) if text else []
        if b"".join(map(entry.__getitem__, a)) != b" " * bool(text) + (text or "").encode() or b"".join(map(piece, b)) != b" " * bool(text) + (text or "").encode():
            a = b = []
        ends_a, ends_b, at = [], [], 0
        for i in a:
            ends_a.append(at := at + len(entry[i]))
        at = 0
        for i in b:
            ends_b.append(at := at + len(piece(i)))
        at_a, at_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        cut = sorted(set(ends_a) & set(ends_b))
        links = [(at_a[e], at_b[e]) for e in cut]
        held = {c: ([], []) for c in cut}
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends):
                held[cut[bisect.bisect_left(cut, e)]][side].append(str(i))
        groups = ["|".join(map(",".join, held[c])) for c in cut]
        found.append((key, len(a), len(b), len(cut), links, ";".join(groups)))
        count.update(links)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return [(k, n_a, n_b, n, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha(g)) for k, n_a, n_b, n, ls, g in found]


@pytest.mark.parametrize("limits", [(1 << 16, 1 << 20), (5, 400)])
def test_pair_alignment(spark, monkeypatch, limits):
    """Whole chunks, and tiny ones (the limits are read where the job is made)."""
    rows = list(enumerate(texts())) + [(None, "no id the tion"), (3, "same id")]
    want = Counter(plain_alignment(rows))
    monkeypatch.setattr(pair_alignment, "SLOTS", limits[0])
    monkeypatch.setattr(pair_alignment, "LINKS", limits[1])
    got = pair_alignment.align(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == want
    assert pair_alignment.align(frame(spark, rows).limit(0)).count() == 0
    assert {tuple(r)[1:] for r in pair_alignment.align(frame(spark, [(1, None), (2, "")])).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_bitmaps_hold_every_link(spark):
    """Sparse and dense bitmaps, and as many planes as the largest multiplicity has digits; counts come from the bits alone."""
    r = np.random.default_rng(4)
    pair = np.concatenate([np.full(9000, 7 << 20 | 3), r.integers(0, 50, 3000) << 20 | 5, np.full(1000, 9)])
    slot = np.concatenate([r.integers(0, 6000, 9000), r.integers(0, 60000, 3000), np.full(1000, 65535)])
    batches = list(pair_alignment.bitmaps(pair, slot))
    df = spark.createDataFrame([tuple(x.values()) for b in batches for x in b.to_pylist()], "pair long, plane int, dense boolean, bits binary")
    assert {x["dense"] for x in df.collect()} == {True, False}
    got = {x["pair"]: (x["n_docs"], x["n_links"]) for x in pair_alignment.pair_counts(df).collect()}
    held = Counter(zip(pair.tolist(), slot.tolist()))
    want = {p: (sum(q == p for q, _ in held), int((pair == p).sum())) for p in set(pair.tolist())}
    assert got == want


# 12


def plain_codes(rows, parts=8, size=16, rounds=6):
    keep = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = len(keep[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in keep[:size]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in keep:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(own, books[p])]
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in keep]
    label = Counter()
    for _, f, lab in found:
        label[lab] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label[lab], sha) for i, f, lab in found]


def vectors(n, seed=2, width=16):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(20)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)], r.choice([1, 2, 2, 2, None])) for i in range(n)]
    rows[3:6] = [(3, rows[0][1], 2), (4, rows[0][1], 2), (5, [0.0] * width, None)]  # equal entries, ties, unused ones
    return rows


def vector_frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({x: F.lit("x") for x in ("id", "v", "far", "of", "code", "part")}).repartition(3)


@pytest.mark.parametrize("n", [300, 10, 1])
def test_vector_codes(spark, n):
    rows = vectors(max(n, 6))[:n] + [(-1, None, 1), (-2, [None] * 16, 1), (-3, [math.nan] * 16, 2), (-4, [math.inf] + [0.0] * 15, 2), (10**6, [-0.00001] * 16, 9)]
    got = vector_codes.compress(vector_frame(spark, rows)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(plain_codes(rows))
    if n == 300:
        assert all(8 <= r["n_evaluated"] < 0.6 * 8 * 16 for r in got)  # bounds leave out far entries


def test_vector_codes_at_the_edges(spark):
    empty = vector_codes.compress(vector_frame(spark, vectors(10)).limit(0))
    assert empty.count() == 0 and empty.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    twice = vectors(30) + [(7, [0.5] * 16, 1), (None, [0.25] * 16, None)]
    assert vector_codes.compress(vector_frame(spark, twice)).count() == 32
    with pytest.raises(ValueError):
        vector_codes.compress(vector_frame(spark, [(1, [0.0] * 16, 1), (2, [0.0] * 8, 1)]))
    with pytest.raises(ValueError):
        vector_codes.compress(vector_frame(spark, [(1, [1e9] * 16, 1)]))


def test_pruned_search_is_exact():
    r = np.random.default_rng(8)
    for scale in (3, 4096, 100_000):
        x, entries = r.integers(-scale, scale, (500, 8)), r.integers(-scale, scale, (16, 8))
        entries[5] = entries[2]
        pivots = vector_codes.farthest_first(entries, 4)
        code, best, n = vector_codes.nearest(x, vector_codes.distances(x, pivots).astype(np.float32), entries, pivots)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and n < d.size


# 4, its shared steps


def test_block_links_are_a_forest():
    """256 rows that are all alike, each a component of its own: fewer links than rows, and all of them connected."""
    import pyarrow as pa

    from callscope.llm import near_dedup

    raw = np.arange(100, dtype=np.uint64).tobytes()
    table = pa.table({"side": pa.array([0] * 256, pa.int32()), "id": pa.array(range(256)), "component": pa.array(range(256)), "shingles": pa.array([raw] * 256, pa.binary())})
    got = near_dedup._block_links(75)(table).to_pylist()
    assert len(got) == 255
    near = {i: i for i in range(256)}
    for _ in range(256):
        for r in got:
            near[r["a"]] = near[r["b"]] = min(near[r["a"]], near[r["b"]])
    assert set(near.values()) == {0}


@pytest.mark.parametrize("hub", [0, 10**6])
def test_components_of_a_star(spark, hub):
    """A hub with the least or the largest id; the joins of both steps can be split at it."""
    from callscope.llm._frames import components

    links = spark.createDataFrame([*((i, hub) for i in range(1, 3001)), (5000, 5001), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    least = min(hub, 1)
    assert got == {**{i: least for i in [*range(1, 3001), hub]}, 5000: 5000, 5001: 5000}


# 7: archives of others


def test_foreign_page_ids_and_malformed_records(spark, tmp_path):
    """A page id that is no number is none; malformed records are counted where the files are written."""
    record = lambda field: warc.arc_record("http://x/", 1, "a", 0, b"HTTP/1.1 200 OK\r\n" + field + b"\r\n\r\nbody")
    fields = [b"X-Page-Id: abc", b"X-Page-Id: 12", b"x-page-id: -3 ", b"X-Page-Id: 99999999999999999999999", b"Other: 1", b"X-Page-Id:"]
    content = warc.arc_version_block("a", 1) + b"".join(map(record, fields)) + b"no header line\nrest\n"
    archives = spark.createDataFrame([("a.arc", bytearray(content))], "path string, content binary")
    got = warc.convert(archives).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in got) == [(False, -3), (False, 12), (True, 0), (True, 0), (True, 0), (True, 0)]
    files, lost = warc.write_warc(warc.mark_revisits(warc.parsed(archives)), f"file://{tmp_path}/w")
    assert files == 1 and lost == warc.malformed(archives).count() >= 1
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 6


# 8: what the penalty does where terms occur


def test_penalty_lowers_the_gap_of_swapped_terms(spark):
    """Toxic texts name one group more often; with the penalty, held-out neutral mentions move less and are rejected less often."""
    r = random.Random(7)
    groups, plain, rude = ["women", "men"], [f"word{i}" for i in range(60)], ["vile", "scum", "idiots"]
    rows = []
    for i in range(1200):
        toxic = i % 4 == 0
        who = r.choice(["women"] * 5 + ["men"]) if toxic else r.choice(["men"] * 5 + ["women"])
        rows.append((i, " ".join(r.sample(plain, 12) + [who] + (r.sample(rude, 1) if toxic and r.random() < 0.8 else [])), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(10_000 + i, " ".join(r.sample(plain, 12) + [groups[i % 2]])) for i in range(200)], "doc_id long, text string")
    gap, wrong = {}, {}
    for penalty in (0.0, 5.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        gap[penalty] = toxicity.counterfactual_gap(neutral, model).first()["mean_gap"]
        wrong[penalty] = neutral.select(toxicity.score_column(model)(F.col("text")).alias("s")).where("s >= 0.3").count()
    assert gap[5.0] < 0.5 * gap[0.0] and wrong[5.0] <= wrong[0.0]
    out = toxicity.classify(docs.unionByName(spark.createDataFrame([(-1, "no term"), (-2, None)], "doc_id long, text string")), labels)
    assert {x["doc_id"]: x["swap_gap"] for x in out.where("doc_id < 0").collect()} == {-1: None, -2: None}
    assert out.where("swap_gap is not null").count() == 1200


def test_toxicity_fit_unpacks_a_few_texts_at_a_time():
    """The driver's memory is a small part of what all features of the sample would take as whole numbers."""
    import tracemalloc

    import numpy as np

    from callscope.llm import toxicity

    r = np.random.default_rng(5)
    x = [np.unique(r.integers(0, 1 << toxicity.BITS, 1000)).astype(np.int32) for _ in range(4000)]
    y = (np.arange(4000) % 2).astype(float)
    tracemalloc.start()
    bias, weights = toxicity.fit(y, x, [v[:0] for v in x], steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights.shape == (1 << toxicity.BITS,) and np.isfinite(bias)
    assert peak < sum(map(len, x)) * 8


def test_components_end_at_stars_and_take_few_tasks(spark):
    """The driver keeps a record of every task: a path of five nodes, a hub of 40 and a pair take fewer than 130 of 4 partitions each."""
    from callscope.llm._frames import components

    links = [(1, 2), (2, 3), (3, 4), (4, 5), (101, 100)] + [(200 + k, 240) for k in range(40)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4).persist()
    assert df.count() == len(links)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("few tasks", "few tasks")
    try:
        got = {r["id"]: r["component"] for r in components(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert got == {k: 1 for k in range(1, 6)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 241)}
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few tasks") for s in told.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))
    print("tasks", tasks)
    assert 0 < tasks < 130
