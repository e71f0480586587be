"""Cases at the edges: empty tables, very long texts and words, ids of every kind, repeats and ties, for each operator and stage."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_hits, brute_near, brute_substrings, corpus, frame, words

import corpus_pipeline
from callscope.llm import _frames, decontaminate, importance, language_id, near_dedup, packing, substring_dedup, token_counts, toxicity, warc

LABELS = "doc_id long, quality int, toxic int"


def test_empty_documents(spark):
    docs = frame(spark, []).withColumn("lang", F.lit("en"))
    labels, bench = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABELS), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (importance.importance(docs, labels), substring_dedup.dedup_substrings(docs), token_counts.count_tokens(docs), decontaminate.contamination(docs, bench), language_id.identify(docs), toxicity.classify(docs, labels)):
        assert out.count() == 0


def test_stages_of_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_very_long_texts(spark):
    r = random.Random(21)
    long = words(r, 120_000, 30_000)
    passage = long[70_000:70_080]
    rows = [(1, " ".join(long)), (2, " ".join(words(r, 50) + passage)), (3, " ".join(long[:119_000])), (4, "z" * 700_000), (5, None)]
    docs = frame(spark, rows)
    assert sorted((tuple(x) for x in substring_dedup.dedup_substrings(docs).collect()), key=str) == brute_substrings(rows)
    assert sorted(tuple(x) for x in near_dedup.near_duplicates(docs).collect()) == brute_near(rows)
    items = [(7, " ".join(passage[:30]))]
    assert sorted((tuple(x) for x in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str) == brute_hits(rows, items)
    got = {x["doc_id"]: x for x in importance.importance(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()}
    assert got[1]["n_ngrams"] == 2 * 120_000 - 1 and got[4]["n_ngrams"] == 1
    scores = {x["doc_id"]: x["score"] for x in toxicity.classify(docs, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, toxic int")).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values())
    counted = {x["doc_id"]: x for x in token_counts.count_tokens(docs).collect()}
    assert counted[1]["n_words"] == 120_000 and counted[4]["n_words"] == 1


def test_a_long_word_takes_linear_time():
    model = token_counts.Model(token_counts.unigram_scores(token_counts.model_path()))
    r = random.Random(1)
    w = "".join(r.choice("abcdefgh") for _ in range(200_000))
    began = time.process_time()
    model.words([w])
    assert time.process_time() - began < 4
    short = w[: token_counts.LONG]
    assert model._long_word(short)[0] == model.words([short])[0][0]
    assert abs(model._long_word(short)[1] - model.words([short])[1][0]) < 1e-9


def test_ties_at_the_cut(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = importance.importance(frame(spark, [(7, "same text")] * 6 + [(8, "other")]), labels, keep=0.5).collect()
    cut = sorted((x["draw"] for x in out), reverse=True)[round(0.5 * 7) - 1]
    assert all(x["selected"] == (x["draw"] >= cut) for x in out)  # equal draws at the cut are all taken or all left


def test_pages_with_odd_ids(spark, tmp_path):
    big, other = "x" * 200, "y" * 150
    rows = [(-5, "http://a/ b?c d", big), (-3, "http://a", big), (0, None, other), (None, "http://n", big), (4, "http://a", other), (4, "http://a", other), (-(2**63), "u", "s"), (0, None, other)]
    got = sorted((tuple(x)[:5] for x in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w").collect()), key=str)
    first = {big: -5, other: 0}
    want = []
    for p, _, h in rows:
        again = p is not None and h in first and p > first[h]
        want.append((p, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)
    fields = [f for p in (tmp_path / "w").glob("*.warc.gz") for f, _ in warc.parse_warc(p.read_bytes())]
    assert len({f["WARC-Record-ID"] for f in fields}) == len(rows)
    assert {f["WARC-Refers-To"] for f in fields if "WARC-Refers-To" in f} <= {f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"}


def test_odd_arc_lines(spark):
    one = warc.arc_version_block("f.arc", 1)
    lines = b"http://a/x y z 1.2.3.4 20200102030405 text/html; charset=utf-8 3\nabc\n"
    body = one + lines + b"http://b/ nothing here 2\nxy\n" + b"http://c/ 1.2.3.4 20200102030405 text/html 1\nq\nbroken line\n" + lines
    bad = []
    assert [(x[0], x[3], x[-1]) for x in warc.parse_arc(body, bad)] == [("http://a/x y z", "text/html; charset=utf-8", b"abc"), ("http://c/", "text/html", b"q")]
    assert [x[2].split(" ")[0] for x in bad] == ["not", "no"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(body))
    two = warc.arc_version_block("f.arc", 2) + b"http://a/x y 1.2.3.4 20200102030405 text/html; charset=utf-8 200 - - 77 f.arc 3\nabc\n"
    assert [(x[0], x[1], x[3], x[-1]) for x in warc.parse_arc(two)] == [("http://a/x y", "1.2.3.4", "text/html; charset=utf-8", b"abc")]
    archives = spark.createDataFrame([("f", bytearray(body))], "path string, content binary")
    assert warc.convert(archives).count() == 2 and [x["reason"].split(" ")[0] for x in warc.malformed(archives).collect()] == ["not", "no"]


@pytest.mark.parametrize("most", [200_000, 1])
def test_items_named_by_strings(spark, most):
    rows = [(1, "a b c d e f g h i j k"), (2, "x y"), (3, None)]
    items = [("q/10", "a b c d e f g h i j"), ("q/9", "b c d e f g h i j k"), ("z", "x"), ("z", "x")]
    got = [tuple(x) for x in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string"), max_windows=most).collect()]
    assert sorted(got, key=str) == brute_hits(rows, items)
    lost = decontaminate.contamination(frame(spark, rows), spark.createDataFrame([(None, "x y")], "item_id long, text string")).where("contaminated").collect()
    assert [(x["doc_id"], x["n_items"], x["items_sha256"]) for x in lost] == [(2, 1, hashlib.sha256(b"").hexdigest())]


def test_identity_terms_as_a_parameter(spark):
    """Terms that go with toxic texts in the sample move scores less where the penalty holds them; measured on held-out texts."""
    r = random.Random(31)
    rows = []
    for i, t, y in corpus(5, 1600):
        w = t.split()
        w[3] = "zorgs" if r.random() < (0.85 if y else 0.15) else "blips"
        rows.append((i, " ".join(w), y))
    docs, labels = frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    swaps = {"zorgs": "blips"}
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    gaps = []
    for penalty in (0.0, 3.0):
        model = toxicity.train(docs, labels, swaps=swaps, penalty=penalty)
        g = toxicity.counterfactual_gap(held, model, swaps=swaps).first()
        assert g["n"] == held.count()
        gaps.append(g["mean_gap"])
    assert gaps[1] < 0.5 * gaps[0]
    got = {x["doc_id"]: x["score"] for x in toxicity.classify(docs, labels, swaps=swaps, penalty=3.0).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in rows]) > 0.95


def test_repeated_ids_do_not_swell_the_sample(spark):
    docs = frame(spark, [(1, f"bad words {i}") for i in range(50)] + [(i, "fine words") for i in range(4, 30)])
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 76 and toxicity.train(docs, labels, sample=5)[1].shape == (1 << toxicity.BITS,)


def test_encoder_forgets_and_stays_exact():
    from tokenizers import Tokenizer

    r = random.Random(41)
    tok = Tokenizer.from_file(packing.tokenizer_path())
    odd = ["Él", "naïve", "×÷", "don't", "İx", "é", "a1b22", "$$$", "<|endoftext|>", "<|EndOfText|>", "x<|", "日本", "ﬁ", "A_b", "\x01q", "a b", "'s", "3's", "ªº", "ÀÉ9,", "</w>"]
    enc = packing.Encoder(packing.tokenizer_path())
    enc.KEEP = 64
    for _ in range(30):
        texts = [r.choice(["", " ", "\n"]) + " ".join(r.choice(odd) + r.choice(["", ".", "Zz", "7", "é"]) + r.choice(["", "word" + str(r.randrange(50))]) for _ in range(r.randrange(12))) for _ in range(8)] + [None]
        ids, offsets = enc.texts(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
        assert len(enc.known) <= 64 + 8 and len(enc.recent) <= 8 + 200


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _frames.shared_dir(Session())



def test_sieved_parts_hold_every_row_once(spark):
    rows = [(k, "x") for k in [*range(-50, 50), 7, 7, 2**62, None, None]]
    df = spark.createDataFrame(rows, "id long, v string")
    for wanted in ([], [7, -50, 2**62]):
        may, rest = _frames.sieved(df, spark.createDataFrame([(k,) for k in wanted], "id long"))
        assert may.columns == rest.columns == ["id", "v"]
        may, rest = [r["id"] for r in may.collect()], [r["id"] for r in rest.collect()]
        assert sorted(map(str, may + rest)) == sorted(str(k) for k, _ in rows)
        assert set(wanted) <= set(may) and not set(wanted) & set(rest) and rest.count(None) == 2
        assert wanted or not may
