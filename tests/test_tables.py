"""Readers, contracts, the registry, incremental runs."""

import json

import pytest
from pyspark.sql import functions as F

from callscope.operators import gold, quality, units
from callscope.sources import annotation, tables, transcripts
from callscope.streaming import incremental


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


GOOD = "sw2001A-ms98-a-0001 0.0 1.5   hello   there\n\nsw2001A-ms98-a-0002 1.5 2.5 [noise]\nshort line\n"


def test_transcripts(spark, tmp_path):
    _write(tmp_path / "20/2001/sw2001A-ms98-a-trans.text", GOOD)
    _write(tmp_path / "20/2001/sw2001A-ms98-a-word.text", "sw2001A-ms98-a-0001 0.0 0.5 hello\nsw2001A-ms98-a-0001 0.9 0.5 bad\nsw2001A-ms98-a-0001 nan 0.5 bad\n")
    rows = transcripts.read_utterances(spark, str(tmp_path)).collect()
    assert [(r["utt_num"], r["start"], r["text"]) for r in rows] == [(1, 0.0, "hello   there"), (2, 1.5, "[noise]")]
    assert [r["token"] for r in transcripts.read_words(spark, str(tmp_path)).collect()] == ["hello"]
    for bad in ("sw2002A-ms98-a-0003 0 1 other call\n", "nonsense 0 1 x\n", "sw2001A-ms98-a-0003 x 1 y\n", "sw2001A-ms98-a-0003 inf 1 y\n"):
        _write(tmp_path / "20/2001/sw2001A-ms98-a-trans.text", GOOD + bad)
        assert transcripts.read_utterances(spark, str(tmp_path), "tolerant").count() == 2
        with pytest.raises(Exception, match="bad transcript line"):
            transcripts.read_utterances(spark, str(tmp_path)).collect()


def test_audio_index(spark, tmp_path):
    _write(tmp_path / "a/sw2001A.wav", "x")
    _write(tmp_path / "a/sw2001B.wav", "x")
    index = transcripts.audio_index(spark, str(tmp_path))
    assert index.count() == 2
    again = transcripts.index_from_json(transcripts.index_to_json(index))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    assert json.loads(transcripts.index_to_json(index).first()[0])["call_id"] == 2001
    units_ = spark.createDataFrame([(2001, "A"), (2002, "A")], "call_id int, side string")
    found, lost = transcripts.resolve_audio(units_, index)
    assert found.count() == 1 and lost.first()["call_id"] == 2002
    _write(tmp_path / "b/sw2001A.wav", "x")
    with pytest.raises(Exception, match="two audio files"):
        transcripts.audio_index(spark, str(tmp_path)).collect()


def test_annotation(spark, tmp_path):
    ns = 'xmlns:nite="http://nite.example/"'
    _write(tmp_path / "dialAct/sw2005.A.dialAct.xml", f'<?xml version="1.0"?>\n<nite:root {ns}>\n<da nite:id="da1" niteType="statement" swbdType="sd^e">\n<nite:child href="sw2005.A.terminals.xml#id(w1)"/>\n<nite:child href="sw2005.A.terminals.xml#id(w2)"/>\n</da>\n<da nite:id="da2" niteType="x" swbdType="b"></da>\n</nite:root>')
    _write(tmp_path / "terminals/sw2005.A.terminals.xml", f'<?xml version="1.0"?>\n<nite:root {ns}>\n<word nite:id="w1" orth="hi" pos="UH" nite:start="0.5" nite:end="0.9"/>\n<punc nite:id="p1">.</punc>\n<word nite:id="w2" orth="you" pos="PRP" nite:start="1.0" nite:end="1.5"/>\n<word nite:id="w3" orth="x" pos="NN" nite:start="non-aligned" nite:end="1"/>\n</nite:root>')
    _write(tmp_path / "disfluency/sw2005.A.disfluency.xml", f'<?xml version="1.0"?>\n<nite:root {ns}>\n<disfluency nite:id="d1">\n<reparandum>\n<nite:child href="sw2005.A.terminals.xml#id(w1)"/>\n</reparandum>\n<repair>\n<nite:child href="sw2005.A.terminals.xml#id(w2)"/>\n</repair>\n</disfluency>\n<disfluency nite:id="d2">\n<reparandum>\n<nite:child href="sw2005.A.terminals.xml#id(w2)"/>\n</reparandum>\n</disfluency>\n</nite:root>')
    acts, words = annotation.read_dialacts(spark, str(tmp_path)), annotation.read_terminals(spark, str(tmp_path))
    assert {r["da_id"]: (r["call_id"], r["side"], r["tag"], r["ids"]) for r in acts.collect()} == {"da1": (2005, "A", "sd^e", ["w1", "w2"]), "da2": (2005, "A", "b", [])}
    assert sorted(r["terminal_id"] for r in words.collect()) == ["w1", "w2"]
    dis = {r["disfluency_id"]: (r["reparandum_ids"], r["repair_ids"]) for r in annotation.read_disfluencies(spark, str(tmp_path)).collect()}
    assert dis == {"d1": (["w1"], ["w2"]), "d2": (["w2"], [])}
    spans = {r["da_id"]: (r["start"], r["end"], r["n_terminals"]) for r in gold.resolve_spans(acts, words, ["call_id", "side", "da_id"]).collect()}
    assert spans == {"da1": (0.5, 1.5, 2), "da2": (None, None, None)}


def test_corpus_tables(spark, tmp_path):
    _write(tmp_path / "caller.csv", '1001, 10, 3, "MALE", 1950, "SOUTH MIDLAND", 2, 0\nshort\n"x", 1, 1, "MALE", 1950, "a", 2\n')
    _write(tmp_path / "conv.csv", '2001, 0, 1001, 1002, 304\n2002, 0, 1, 2, "UNK"\n')
    _write(tmp_path / "topic.csv", '"CAMPING", 304, 1\n"BAD", x\n')
    _write(tmp_path / "side.csv", '2001, "A", 1001, 5\n')
    assert [tuple(r) for r in annotation.read_callers(spark, str(tmp_path / "caller.csv")).collect()] == [(1001, "MALE", "1950", "SOUTH MIDLAND", "2")]
    assert [tuple(r) for r in annotation.read_conversations(spark, str(tmp_path / "conv.csv")).collect()] == [(2001, 1001, 1002, "304"), (2002, 1, 2, "UNK")]
    assert [tuple(r) for r in annotation.read_topics(spark, str(tmp_path / "topic.csv")).collect()] == [(304, "CAMPING")]
    assert [tuple(r) for r in annotation.read_sides(spark, str(tmp_path / "side.csv")).collect()] == [(2001, "A", 1001)]


KEYS = "call_id long, side string, utt_num long"


def test_canonical_contracts(spark):
    rows = [(1, "A", 1), (1, "A", 2)]
    m = spark.createDataFrame(rows, KEYS)
    f = m.withColumn("x", F.lit(1))
    assert tables.build_table(m, {"f": f, "g": m.withColumn("y", F.lit(2))}).count() == 2
    for bad, why in ((f.where("utt_num = 1"), "missing"), (f.unionByName(f), "more than once"), (f.unionByName(spark.createDataFrame([(9, "A", 1, 1)], KEYS + ", x int")), "extra"), (f.drop("side"), "no key"), (m, "no value")):
        with pytest.raises(ValueError, match=why):
            tables.build_table(m, {"f": bad})
    with pytest.raises(ValueError, match="already there"):
        tables.build_table(m, {"f": f, "g": f})


def test_manifest(spark, tmp_path):
    u = spark.createDataFrame([(2001, "A", 7, 'say "hi", ok')], KEYS + ", text string")
    m = tables.build_manifest(u)
    assert m.first()[0] == "200/sw2001A-U0007.wav"
    m.coalesce(1).write.option("header", "true").option("escape", '"').csv(f"{tmp_path}/m")
    back = tables.read_manifest(spark, f"{tmp_path}/m")
    assert tuple(back.first()) == tuple(m.first())
    k = tables.parse_key(F.col("`Utterance File Name`"))
    assert tuple(back.select(*k.values()).first()) == (2001, "A", 7, "sw2001A")
    u.select("text").write.option("header", "true").csv(f"{tmp_path}/n")
    with pytest.raises(ValueError, match="not a manifest"):
        tables.read_manifest(spark, f"{tmp_path}/n")


def test_registry(spark, tmp_path):
    doc = "# x\n\n## Trusted columns\n\n| Column | Extractor | Family | Note |\n|---|---|---|---|\n| `a` | e1 | volume | n1 |\n| `b` | e2 | tannen | n2 |\n\n## WIP\n\n| Column | Extractor | Family | Note |\n|---|---|---|---|\n| `c` | e3 | volume | n |\n"
    (tmp_path / "r.md").write_text(doc)
    r = tables.check_registry(tables.read_registry(spark, str(tmp_path / "r.md")))
    assert [(x["column"], x["family"], x["status"]) for x in r.orderBy("position").collect()] == [("a", "volume", "Trusted"), ("b", "tannen", "Trusted"), ("c", "volume", "WIP")]
    assert tables.selected_columns(r, "validated") == ["a", "b"] and tables.selected_columns(r, "all", "volume") == ["a", "c"]
    with pytest.raises(ValueError, match="unknown families"):
        tables.check_registry(r.withColumn("family", F.lit("zzz")))
    with pytest.raises(ValueError, match="twice"):
        tables.check_registry(r.unionByName(r))
    with pytest.raises(ValueError, match="no columns"):
        tables.check_registry(r.limit(0))
    with pytest.raises(ValueError):
        tables.selected_columns(r, "none")


def test_fresh(spark, tmp_path):
    import os

    for n, age in (("old", 1000), ("new", 2000)):
        (tmp_path / n).write_text("x")
        os.utime(tmp_path / n, (age, age))
    tables.assert_fresh(spark, str(tmp_path / "new"), [str(tmp_path / "old")])
    with pytest.raises(ValueError, match="older"):
        tables.assert_fresh(spark, str(tmp_path / "old"), [str(tmp_path / "new")])


def test_incremental_manifest(spark, tmp_path):
    root, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    _write(root / "sw2001A-ms98-a-trans.text", GOOD)
    for expected in (2, 2):
        incremental.grow_manifest(incremental.utterance_stream(spark, str(root)), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == expected
    _write(root / "sw2001B-ms98-a-trans.text", GOOD.replace("2001A", "2001B"))
    incremental.grow_manifest(incremental.utterance_stream(spark, str(root)), out, check).awaitTermination()
    assert spark.read.parquet(out).select("`Utterance File Name`").distinct().count() == 4


def test_feature_cache(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    cached = spark.createDataFrame([(1, 10, "v2"), (2, 20, "v1"), (3, None, "v2"), (9, 90, "v2")], "k long, x int, version string")
    missing = incremental.rows_to_compute(rows, cached, ["k"], "v2", "x")
    assert sorted(r["k"] for r in missing.collect()) == [2, 3, 4]
    full = incremental.with_cache(rows, cached, lambda r: r.withColumn("x", F.lit(-1)), ["k"], "v2", "x")
    assert {r["k"]: r["x"] for r in full.collect()} == {1: 10, 2: -1, 3: -1, 4: -1}


def test_units(spark):
    rows = [("u", 0, 1.0, 0.5), ("u", 0, 3.0, 5.0), ("u", 1, 99.0, 0.1), ("v", 0, float("inf"), None)]
    df = spark.createDataFrame(rows, "unit string, backchannel int, x double, fto double")
    r = units.unit_table(df, "unit", ["x", "fto"], min_utterances=2).first()
    assert (r["x"], r["fto"], r["n_sub"], r["n_fto"], round(r["bc_rate"], 6)) == (2.0, 0.5, 2, 1, 0.333333)
    kept, n = units.utterance_level(df, ["x", "fto"])
    assert kept.count() == 2 and tuple(n.first()) == (2, 1)
    assert units.complete(df, ["x"]).count() == 3
    rules = quality.audit(df, {"big": "x > 50", "null_is_no_breach": "fto > 4"})
    assert {x["rule"]: x["n_violations"] for x in rules.collect()} == {"big": 2, "null_is_no_breach": 1}


def test_keys_of_large_calls(spark):
    u = spark.createDataFrame([(9999, "A", 7, "a", 0.0, 1.0), (10_000, "B", 12_345, "b", 0.0, 1.0), (1_234_567, "A", 1, "c", 0.0, 1.0)], KEYS + ", text string, start double, end double")
    m = tables.build_manifest(u)
    k = tables.parse_key(F.col("`Utterance File Name`"))
    assert [tuple(r) for r in m.select(*k.values()).orderBy("call_id").collect()] == [(9999, "A", 7, "sw9999A"), (10_000, "B", 12_345, "sw10000B"), (1_234_567, "A", 1, "sw1234567A")]
    assert tables.pending_units(u.select("call_id", "side"), m).count() == 0
    audio = m.select(F.col("`Utterance File Name`").alias("file"), F.lit(1.0).alias("seconds"))
    assert tables.verify_durations(m, audio, u, 10, 1).where("reason is not null").count() == 0


def test_units_without_transcript(spark):
    wanted = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A")], "call_id int, side string")
    had = spark.createDataFrame([(1, "A", "yes"), (1, "A", "no"), (3, "A", "x")], "call_id int, side string, text string")
    got = sorted(tuple(r) for r in transcripts.without_transcript(wanted, had).collect())
    assert got == [(1, "B", "transcript missing"), (2, "A", "transcript missing")]
