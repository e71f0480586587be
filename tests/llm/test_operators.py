"""Each operator against a plain brute-force version, with nulls, empty and repeated rows, ties and clashing columns."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callscope.llm import _text as T
from callscope.llm import decontaminate, fingerprint, importance, language_id, near_dedup, packing, substring_dedup, token_counts, toxicity, warc
from callscope.llm._frames import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def fixture(seed=1, n=60):
    """Documents with shared passages, exact and near copies, one very long text, nulls and empties."""
    r = random.Random(seed)
    passage = words(r, 70)
    out = []
    for i in range(n):
        own = words(r, r.randrange(1, 160))
        if i % 3 == 0:
            at = r.randrange(len(own) + 1)
            own[at:at] = passage[r.randrange(0, 10) :]
        if i % 7 == 0 and out:
            own = out[-1][1].split() if out[-1][1] else own
        if i % 7 == 3 and out and out[-1][1]:
            own = out[-1][1].split()
            own[len(own) // 2] = "edited"
        out.append((i, " ".join(own)))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "one two"), (n + 4, "One two"), (n + 5, " ".join(words(r, 5000) + passage)), (n + 6, " nbsp x " * 60)]
    r.shuffle(out)
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"id": F.lit("x"), "sig": F.lit(None).cast("string"), "n_words": F.lit(-1), "row": F.lit(3)}) if extra else df


EMPTY = []


def test_words_and_hashes():
    texts = ["a  b\tc", "", None, " x", "é y z ", "a b c"]
    w = T.Words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = [w.text(k).decode() for k in range(w.offsets[i], w.offsets[i + 1])]
        assert own == SPACE.findall(t or "")
    h = w.hashes()
    assert (h[w.offsets[0] : w.offsets[1]] == h[w.offsets[5] : w.offsets[6]]).all()
    low = T.Words(pa.array(["Ab-c9 É, ÉX"]), T.NOT_ALNUM, lower=True)
    assert [low.text(k).decode() for k in range(len(low))] == ALNUM.findall("ab-c9 É, Éx")
    for size in (1, 2, 5, 7, 50):
        x = np.arange(120, dtype=np.uint64) % np.uint64(7)
        r = T.rolling(x, size)
        assert len(r) == 121 - size and r[0] == r[7] and (size == 1 or r[0] != r[1])


def test_slices_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * k for k in range(50)])], ["text"])
    parts = list(T.slices(b, limit=100))
    assert sum(p.num_rows for p in parts) == 50 and len(parts) > 5
    assert pa.concat_arrays([p.column(0) for p in parts]).equals(b.column(0))


def brute_substrings(rows, size=50):
    first = {}
    docs = [(d, SPACE.findall(t or "")) for d, t in rows]
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup(spark, parts):
    rows = fixture() + [(None, "lost id " * 40), (None, None)]
    got = [tuple(r) for r in substring_dedup.dedup_substrings(frame(spark, rows).repartition(parts)).collect()]
    assert sorted(got, key=str) == brute_substrings(rows)
    assert any(r[2] for r in got)


def test_substring_dedup_repeated_ids(spark):
    r = random.Random(5)
    a, b = " ".join(words(r, 80)), " ".join(words(r, 80))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a), (3, b)]
    got = [tuple(x) for x in substring_dedup.dedup_substrings(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_substrings(rows)


def test_remove_repeats_keeps_columns(spark):
    rows = fixture(2, 30) + [(None, "a  b")]
    df = frame(spark, rows)
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    brute = {d: (n, t) for d, _, n, t in brute_substrings(rows)}
    for d, t in ((x["doc_id"], x["text"]) for x in out.collect()):
        assert t == (brute[d][1] if brute[d][0] else dict(rows)[d])
    with pytest.raises(ValueError):
        substring_dedup.repeats(df, min_words=20)


def shingles(text, size=5):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_near(rows):
    docs = sorted({d: shingles(t) for d, t in rows}.items())
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(docs):
        for b, y in docs[i + 1 :]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in docs)


def chain(seed, n, length, step):
    """Texts that each differ a little from the one before, so that far ones aren't linked directly."""
    r = random.Random(seed)
    w = words(r, length, 10_000)
    out = []
    for _ in range(n):
        w = list(w)
        for k in range(step):
            w[r.randrange(length)] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_near_dedup(spark, block):
    rows = fixture(3) + [(200 + i, t) for i, t in enumerate(chain(4, 30, 120, 2))] + [(300 + i, t) for i, t in enumerate(chain(5, 12, 60, 2))]
    rows += [(400, "A b C d e f"), (401, "a B c d E f"), (402, "a b c"), (403, "A B C")]
    out = [tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows + [(None, "x y z"), (None, None)]), block=block).collect()]
    got = sorted(r for r in out if r[0] is not None)
    assert got == brute_near(rows)
    assert sorted(r for r in out if r[0] is None) == [(None, 0, None, True), (None, 1, None, True)]
    assert sum(not r[3] for r in got) > 20


def test_near_dedup_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, EMPTY)).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(frame(spark, [(5, None)])).collect()] == [(5, 0, 5, True)]


def test_near_dedup_repeated_ids(spark):
    r = random.Random(12)
    a, b, c = (" ".join(words(r, 60, 10_000)) for _ in range(3))
    rows = [(1, a), (2, b), (3, a), (3, b), (3, b), (4, b + " more"), (5, c), (5, c), (6, None), (6, a + " end")]
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(frame(spark, rows)).collect())
    component = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}  # 3 joins the copies of both of its texts; a row without words is linked with nothing
    want = [(d, len(shingles(t)), component[d] if t else d, component[d] == d or not t) for d, t in rows]
    assert got == sorted(want)


def test_near_dedup_of_a_template(spark):
    """Texts that share much without being copies: many mixed buckets, compared as one region, and copies among them."""
    r = random.Random(13)
    template = words(r, 100, 10_000)
    rows = [(i, " ".join(template + words(r, 22, 10_000))) for i in range(60)]
    rows += [(100 + i, t.rsplit(" ", 6)[0]) for i, t in rows[::3]]
    assert sorted(tuple(x) for x in near_dedup.near_duplicates(frame(spark, rows), block=16).collect()) == brute_near(rows)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    r = random.Random(3)
    names = r.sample(range(10**6), 3000)
    got = components(spark.createDataFrame(list(zip(names[:-1], names[1:])), "a long, b long"))
    assert {x["component"] for x in got.collect()} == {min(names)} and got.count() == 3000


def brute_hits(rows, items, size=10):
    norm = lambda t: ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in items:
        w = norm(t)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, t in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontamination(spark, most):
    rows = fixture(6, 40)
    long = next(t for _, t in rows if t and len(t.split()) > 60).split()
    items = [(1, " ".join(long[5:40])), (2, "W1, (w2) w3"), (3, None), (4, "..."), (5, " ".join(long[5:40]).upper()), (6, "edited"), (11, " ".join(long[20:30]))]
    rows.append((900, "xx w1-W2;w3 yy"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = [tuple(r) for r in decontaminate.contamination(frame(spark, rows), bench, max_windows=most).collect()]
    assert sorted(got, key=str) == brute_hits(rows, items)


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"q{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(40))
    rows = [(1, f"{clean} {item}, {clean}"), (2, item), (3, clean), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = frame(spark, rows)
    out = decontaminate.decontaminate(df, bench)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{clean} , {clean}", 3: clean, 4: None}
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == 4


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é" + "x" * 200, "<p>é" + "x" * 200, "short", "short", None, "", "a\r\n\r\nb" * 40, "a\r\n\r\nb" * 40, "<p>é" + "x" * 200]
    rows = [(i * 3 % 10, f"http://h/{i} q" if i % 2 else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted(tuple(r)[:5] for r in warc.archive_pages(pages, f"file://{tmp_path}/w").collect())
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = first.get(b, p) < p
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    assert got == sorted(want)
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0
    kinds = [f["WARC-Type"] for p in (tmp_path / "w").glob("*.warc.gz") for f, _ in warc.parse_warc(p.read_bytes())]
    assert sorted(kinds) == sorted(x[3] for x in want)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    body = warc.arc_version_block("f.arc", version) + warc.arc_record("http://a/", version, "f.arc", 9, b"HTTP/1.1 200 OK\r\n\r\nline\n\nfiledesc://no\n") + warc.arc_record("http://b/", version, "f.arc", 99, b"")
    for content in (body, gzip.compress(body)):
        got = list(warc.parse_arc(content))
        assert [(x[0], x[-1]) for x in got] == [("http://a/", b"HTTP/1.1 200 OK\r\n\r\nline\n\nfiledesc://no\n"), ("http://b/", b"")]
    with pytest.raises(ValueError):
        list(warc.parse_arc(body[:-3].replace(b" 0\n", b" 50\n")))
    with pytest.raises(ValueError):
        list(warc.parse_arc(body.replace(f"{version} 0 Inter".encode(), f"{3 - version} 0 Inter".encode())))


def corpus(seed, n, bad=("badword", "nastiness")):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = i % 4 == 0
        w = words(r, 40, 300)
        if y:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(bad) + r.choice(["", "s", "ly"])
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity_held_out_and_edges(spark):
    rows = corpus(1, 1200)
    docs = frame(spark, [(d, t) for d, t, _ in rows] + [(5000, None), (5001, ""), (5002, "badword badwords nastily nastiness")])
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(5000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [(got[d]["predicted"], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.97 and got[5002]["score"] > 0.3
    assert got[5000]["score"] == got[5001]["score"] < 0.3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.classify(docs, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none < 0.01
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 5002").count() == 0 and kept.count() > 850


def test_toxicity_counterfactual_penalty():
    r = random.Random(3)
    partner = toxicity.partners(toxicity.SWAPS)
    texts, y = [], []
    for i in range(800):
        bad = i % 3 == 0
        w = words(r, 20, 100)
        w[0] = "women" if r.random() < (0.9 if bad else 0.1) else "men"
        if bad:
            w[1] = "horrid"
        texts.append(" ".join(w))
        y.append(float(bad))
    def lists(ts):
        row, bucket = toxicity.features(pa.array(ts, pa.string()))
        return np.split(bucket, np.searchsorted(row, np.arange(1, len(ts))))

    gaps = []
    for penalty in (0.0, 3.0):
        bias, w = toxicity.fit(np.array(y), lists(texts), lists([toxicity.swapped(t, partner) for t in texts]), penalty)
        score = lambda t: bias + w[toxicity.features(pa.array([t]))[1]].sum()
        gaps.append(abs(score("the women w1 w2") - score("the men w1 w2")))
        assert score("women horrid w3") > score("women w5 w3")
    assert gaps[1] < 0.3 * gaps[0]
    assert toxicity.swapped("no term", partner) is None and toxicity.swapped("The women, left", partner) == "The men left"


def test_language_id(spark):
    r = random.Random(2)
    sounds = {"aa": ["ka", "ti", "mo", "ra"], "bb": ["sch", "ung", "zei", "ö"], "cc": ["eau", "oix", "é", "ç"]}
    rows = []
    for i in range(900):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang if i % 10 else None))
    extra = [(2000, None, "aa"), (2001, "", None), (2002, "123 !!", "bb"), (2003, "katimo " * 5000, None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = {x["doc_id"]: x for x in language_id.identify(df).collect()}
    ok = [got[i]["lang_pred"] == ("aa", "bb", "cc")[i % 3] for i in range(900) if got[i]["held_out"]]
    assert np.mean(ok) > 0.97 and len(got) == 904
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2000, 2001, 2002)) and got[2003]["lang_pred"] == "aa"
    assert {x["lang_pred"] for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_gradient():
    net = language_id.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x, y, mask = r.integers(97, 105, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones((6, 5))
    _, grads = net.step(x, y, mask)
    for k, at in (("E0", (3, 99)), ("U0", (8, 2)), ("U1", (1, 3)), ("V", (1, 4)), ("E1", (14, 100))):
        keep = net.w[k][at]
        net.w[k][at] = keep + 1e-3
        up = net.step(x, y, mask)[0]
        net.w[k][at] = keep - 1e-3
        down = net.step(x, y, mask)[0]
        net.w[k][at] = keep
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3


def test_packing_is_exact(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["The", "cat,", "unbelievable", "<|endoftext|>", "don't", "x²", "日本語", "ok!!"]) for _ in range(r.choice([0, 3, 40, 900, 5000])))) for i in range(40)] + [(100, None), (101, ""), (102, "a b c İ"), (7, "again")]
    got = packing.pack(frame(spark, rows).repartition(5), length=256).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    truth = {}
    for d, t in rows:
        truth.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = {}
    for p in got:
        pieces.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for d, all_ids in truth.items():
        for ids in all_ids:
            own = sorted(pieces[d, len(ids)], key=lambda p: p["start"])
            at = 0
            for p in own:
                assert p["start"] == at and p["length"] > 0
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
    sequences = {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 256 or at < 256 and at & (at - 1) == 0
    assert packing.pack(frame(spark, EMPTY)).count() == 0


def test_packer_emits_the_fullest():
    p = packing._Packer(10, 2, 0)
    a = lambda n: np.arange(n, dtype="<u4")
    assert not p.add(1, 0, a(7), 7) and not p.add(2, 0, a(6), 6)
    out = p.add(3, 0, a(5), 5)  # fits nowhere: the window of 7 is filled and leaves
    assert [(x[0], x[2]) for x in out] == [(1, 7), (3, 3)] and sorted(w[0] for w in p.open) == [2, 6]
    assert sum(x[2] for x in p.powers([(9, 0, a(7), 7)])) == 7


def test_fingerprints(spark):
    r = random.Random(8)
    rows = [(i, " ".join(words(r, r.randrange(1, 120)))) for i in range(50)] + [(60, None), (61, ""), (62, "x"), (63, "日本語テキスト" * 30), (64, " ".join(words(r, 4000)))]
    got = {x["doc_id"]: x for x in fingerprint.with_edits(frame(spark, rows), rows_per_block=9).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (d, t), (_, f) in zip(order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        half = len(t) // 2
        new = t[: len(t) - half] + f[:half]
        x = got[d]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = fingerprint.fingerprints([t, new, f])
        assert (x["fingerprint"], x["edited_fingerprint"]) == (a, b)
        assert x["near_edited"] == fingerprint.likeness(a, b) and x["near_next"] == fingerprint.likeness(a, c)
    long = [x for x in got.values() if x["n_chars"] > 300]
    assert np.mean([x["near_edited"] for x in long]) > np.mean([x["near_next"] for x in long]) + 0.25
    assert fingerprint.with_edits(frame(spark, EMPTY)).count() == 0
    one = fingerprint.with_edits(frame(spark, [(None, "ab"), (3, "abcd")])).collect()
    assert len(one) == 2


def test_embedding_keeps_step_after_an_edit():
    r = random.Random(1)
    base = "".join(r.choice("abcdefghij ") for _ in range(3000))
    edit = base[:300] + "zz" + base[300:]
    other = "".join(r.choice("abcdefghij ") for _ in range(3000))
    a, b, c = fingerprint.fingerprints([base, edit, other])
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) > 0.6 > 0.3 > fingerprint.likeness(a, c)
    assert fingerprint.fingerprints([base])[0] == a


def test_edit_distance():
    r = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(2))
        assert fingerprint.edit_distance(a, b) == plain(a, b)


def test_fingerprint_near_duplicates(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefghijklm ") for _ in range(800)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:400] + "#" + t[401:]) for i, t in enumerate(base)] + [(20, base[0]), (30, ""), (31, None)]
    got = {x["doc_id"]: x["component_id"] for x in fingerprint.near_duplicates(frame(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if k < 30} == {**{i: i for i in range(5)}, **{10 + i: i for i in range(5)}, 20: 0}
    assert got[30] == 30 == got[31]


def test_fingerprint_bands_with_several_components(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklm ") for _ in range(n))
    template, near = word(300), word(500)
    # the bands that 1 and 2 share lie in the template and are headed by 0, which is like neither: an edit every 14 characters breaks the others
    edits = "".join(near[i : i + 14] + "x" for i in range(0, 500, 14))[:500]
    assert fingerprint.edit_distance(template + near, template + edits) <= 80
    rows = [(0, template + word(500)), (1, template + near), (2, template + edits), (3, template + word(500))]
    for block in (128, 1):
        got = {x["doc_id"]: x["component_id"] for x in fingerprint.near_duplicates(frame(spark, rows), block=block).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def test_importance(spark):
    r = random.Random(11)
    rows = [(i, " ".join(f"{'g' if i % 2 else 'b'}{r.randrange(40)}" for _ in range(30))) for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)] + [(3, 1)], "doc_id long, quality int")
    out = importance.importance(frame(spark, rows), labels, keep=0.25).collect()
    assert len(out) == 402 and sum(x["selected"] for x in out) == round(0.25 * 402)
    cut = sorted((x["draw"] for x in out), reverse=True)[round(0.25 * 402) - 1]
    assert all(x["selected"] == (x["draw"] >= cut) for x in out)
    assert np.mean([x["doc_id"] % 2 for x in out if x["selected"]]) > 0.95
    empty = [x for x in out if x["doc_id"] >= 900]
    assert all(x["log_importance"] == 0 and x["n_ngrams"] == 0 for x in empty)
    # against plain counting
    row, bucket = importance.ngrams(pa.array([t for _, t in rows], pa.string()))
    raw = np.bincount(bucket, minlength=importance.BUCKETS)
    good = np.bincount(bucket[np.isin(row, [i for i in range(200) if i % 2])], minlength=importance.BUCKETS)
    ratio = np.log((good + 1) / (good.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    want = np.bincount(row, ratio[bucket], minlength=len(rows))
    assert np.allclose([x["log_importance"] for x in sorted(out, key=lambda x: x["doc_id"])], want)


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100])
def test_largest_cut(spark, k):
    r = random.Random(k)
    values = [r.choice([-(2**62), -5, 0, 3, 2**40, r.randrange(-(2**63), 2**63)]) for _ in range(100)]
    cut = importance.largest_cut(spark.createDataFrame([(v,) for v in values], "v long"), "v", k)
    assert cut == (sorted(values, reverse=True)[k - 1] if k else None)


def test_token_counts(spark):
    scores = token_counts.unigram_scores(token_counts.model_path())
    longest = max(map(len, scores))

    def viterbi(w):
        best = [(0.0, 0)] + [(-1e300, 0)] * len(w)
        for e in range(1, len(w) + 1):
            n = len(w[e - 1].encode())
            best[e] = (best[e - 1][0] + n * token_counts.BYTE_SCORE, best[e - 1][1] + n)
            for k in range(1, min(longest, e) + 1):
                s = scores.get(w[e - k : e])
                if s is not None and best[e - k][0] + s >= best[e][0]:
                    best[e] = (best[e - k][0] + s, best[e - k][1] + 1)
        return best[-1]

    texts = ["The cat sat", "unbelievably antidisestablishment", "日本語 🎈x", "", None, "a " * 300, "x" * 200, "the then theme the"]
    got = {x["doc_id"]: x for x in token_counts.count_tokens(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        own = [viterbi(token_counts.MARK + w) for w in SPACE.findall(t or "")]
        assert got[i]["n_words"] == len(own) and got[i]["n_tokens"] == sum(n for _, n in own)
        assert abs(got[i]["log_score"] - sum(s for s, _ in own)) < 1e-6
