"""The pipeline's stages, each against a brute-force version on its own input, and the queries' registration."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_near, brute_substrings, words

from tokenizers import Tokenizer

import corpus_pipeline
from callscope.llm import packing, queries


def _tables(spark, folder):
    r = random.Random(7)
    passage, item = words(r, 60, 5000), words(r, 14, 5000)
    rows = []
    for i in range(200):
        w = words(r, r.randrange(20, 120), 5000)
        if i % 9 == 0:
            w[3:3] = passage
        if i % 11 == 0:
            w[5:5] = item
        if i % 5 == 0:
            w[1::12] = ["vilestword"] * len(w[1::12])
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(300 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(1, 20)] + [(400, None, None, None, None), (401, "", "de", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, " ".join(item)


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    rows, item = _tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {x["doc_id"]: x["text"] for x in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/out{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/out{n}")
        if n < 4:
            assert docs.columns == columns
            after = {x["doc_id"]: x["text"] for x in docs.collect()}
            kept.append(len(after))
        if name == "toxicity":
            assert not any(t and t.count("vilestword") > 2 for t in after.values()) and sum("vilestword" not in (r[1] or "") for r in rows) - len(after) < 5
        if name == "near_dedup":
            assert set(after) == {d for d, _, _, k in brute_near(before.items()) if k}
        if name == "substring_dedup":
            for d, _, n_removed, text in brute_substrings(before.items()):
                assert after[d] == (text if n_removed else before[d])
        if name == "decontamination":
            assert all(item not in (t or "") for t in after.values()) and 400 in after
    pieces = docs.collect()
    assert {p["doc_id"] for p in pieces} == set(after)
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0] < len(rows)


def test_run_matches_stages(spark, tmp_path):
    """run's pieces, row by row, against the tokenizer's ids of what the stages leave, each applied to the one before."""
    folder = f"file://{tmp_path}/in"
    _tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/kept{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/kept{n}")
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {x["doc_id"]: tok.encode(x["text"] or "", add_special_tokens=False).ids + [1] for x in docs.collect()}
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(out.columns)
    pieces, sequences = {}, {}
    for p in out.collect():
        pieces.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert numbers == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_whose_names_they_use(spark, tmp_path, name, stage):
    """Extra columns named as the stages' own: kept with their values (all but the last stage), and no error."""
    words = [f"word{i % 37} other{i}" for i in range(40)]
    docs = [(i, " ".join(words[i : i + 20]), "en", "s", 1) for i in range(12)] + [(12, " ".join(words[:20]), "en", "s", 1), (None, "no id", "en", "s", 1), (13, None, "en", "s", 1), (14, "", "en", "s", 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    own = ["away_id", "sieve_word", "sieve_bit", "sieve_bits", "row", "id", "score", "y", "kept", "component_id", "sig", "n", "hit", "ids", "part", "offset", "other", "sequence_id"]
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in own})
    spark.createDataFrame([(i, int(i == 3)) for i in range(12)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(words[30:38]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, wide, str(tmp_path))
    if name == corpus_pipeline.STAGES[-1][0]:
        assert got.count() == stage(spark, docs, str(tmp_path)).count() >= 16
        return
    rows = got.collect()
    assert set(got.columns) == set(wide.columns) and rows
    for r in rows:
        assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in own)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in stage(spark, docs, str(tmp_path)).collect())
