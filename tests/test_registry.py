"""Features by name and taggers that users supply."""

import pytest
from pyspark.sql import functions as F

from callscope.operators import registry
from callscope.sources import tables

ROWS = [(1, "A", 2, 0.0, 2.0, "well i went [noise] home"), (1, "B", 3, 1.0, 1.0, "uh-huh"), (1, "A", 4, 3.0, 4.0, None)]


def test_run_feature(spark):
    u = spark.createDataFrame(ROWS, "call_id int, side string, utt_num int, start double, end double, text string")
    got = {name: {r[2]: r[3] for r in registry.run_feature(name, u).collect()} for name in ("token_count", "backchannel", "word_rate", "stripped_text", "anecdote_candidate")}
    assert got["token_count"] == {2: 4, 3: 1, 4: None} and got["word_rate"] == {2: 2.0, 3: None, 4: None}
    assert got["backchannel"][3] == 1 and got["anecdote_candidate"][2] is False and got["stripped_text"][2] == "well i went home"
    with pytest.raises(ValueError, match="there are .*token_count"):
        registry.run_feature("loudest_word", u)
    with pytest.raises(ValueError, match="needs columns call_id, side, utt_num, text, start, end and makes word_rate; missing: end"):
        registry.run_feature("word_rate", u.drop("end"))


def test_tagger_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda tokens: [t.upper() for t in tokens]

    words = spark.createDataFrame([("a",), (None,), ("b",)] * 2000, "token string").repartition(1)
    out = registry.tag_tokens(words, load).groupBy("token", "tag").count().collect()
    assert {(r[0], r[1], r[2]) for r in out} == {("a", "A", 2000), ("b", "B", 2000), (None, None, 2000)}
    assert len(open(log).read()) == 1


def test_first_person_words_are_whole_words(spark):
    from callscope.functions import text as X

    texts = ["en ouré et la vie ici", "we go on and on", "a I_b c d e", "it's mine, all of it", "i", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(X.may_be_anecdote(F.col("t")), F.lit(False))).collect()]
    assert got == [False, True, False, True, False, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 2, 0.5)], "call_id int, side string, utt_num int, score double")
    tables.write_scores(df, f"file://{tmp_path}/scores")
    tables.write_scores(df, f"file://{tmp_path}/scores")  # again: replaced
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/scores").collect()] == [(1, "A", 2, 0.5)]


def calls(spark):
    """Small tables of every kind of input."""
    u = [(c, s, n, float(n), n + 0.9, t) for c in (1, 2) for n, (s, t) in enumerate([("A", "well i went [noise] home and saw the family"), ("B", "uh-huh"), ("B", "do you like it there"), ("A", "i did i did say so yesterday"), ("A", "[laughter] the the the")])]
    words = [(c, s, n, i, a + i * 0.1, a + i * 0.1 + 0.05, w) for c, s, n, a, _, t in u for i, w in enumerate(t.split())]
    frames = [(c, s, n, f / 20, 100.0 + 4 * f * (n == 2), 0.1 * f) for c, s, n, *_ in u for f in range(12)]
    return {
        "utterances": spark.createDataFrame(u, "call_id long, side string, utt_num long, start double, end double, text string"),
        "words": spark.createDataFrame(words, "call_id long, side string, utt_num long, i int, start double, end double, token string"),
        "frames": spark.createDataFrame(frames, "call_id long, side string, utt_num long, t double, f0 double, rms double"),
        "tagged": spark.createDataFrame([(c, s, n, w, "PAST" if w in ("went", "did") else "PRON" if w in ("i", "you") else "X") for c, s, n, _, _, _, w in words], "call_id long, side string, utt_num long, token string, pos string"),
        "lexicon": spark.createDataFrame([("family", "personal"), ("home", "personal"), ("the", "impersonal")], "term string, bucket string"),
        "pronunciations": spark.createDataFrame([("family", 3)], "word string, syllables int"),
        "sides": spark.createDataFrame([(1, "A", 7), (1, "B", 8), (2, "A", 8)], "call_id long, side string, caller long"),
        "callers": spark.createDataFrame([(7, "MALE", "1950", "NEW ENGLAND", "2"), (8, "FEMALE", "1920", "UNK", "1")], "caller long, sex string, birth_year string, dialect string, education string"),
        "conversations": spark.createDataFrame([(1, "3")], "call_id long, topic_no string"),
        "topics": spark.createDataFrame([(3, "PETS")], "topic_no int, topic string"),
    }


def test_all_features_in_one_run(spark):
    """Every name, and each by itself gives the same columns."""
    inputs = calls(spark)
    both = registry.run_features(list(registry.FEATURES), inputs)
    rows = {(r["call_id"], r["utt_num"]): r for r in both.collect()}
    assert len(rows) == 10 and set(both.columns) == {*tables.KEY, *(c for f in registry.FEATURES.values() for c in f.makes)}
    a = rows[1, 0]
    assert (a["token_count"], a["gender"], a["topic"], a["personal"], a["impersonal"], a["kind"], a["pitch_mean"]) == (8, "male", "PETS", 2, 1, "first", 100.0)
    assert rows[1, 2]["rising"] == 1 and rows[1, 2]["mgq_score"] == 1 and rows[2, 1]["gender"] is None and rows[2, 1]["topic"] == "UNK"
    assert rows[1, 3]["mutual_revelation"] == 0 and rows[1, 3]["repetitions_current"] == 2
    for name in ("pauses", "pitch", "overlap", "marked_question", "repetitions_in_previous", "pronouns_per_second", "syllable_rate_by_table"):
        own = registry.run_feature(name, inputs)
        for r in own.collect():
            assert all(r[c] == rows[r["call_id"], r["utt_num"]][c] for c in registry.FEATURES[name].makes)


def test_shared_parts_are_made_once(spark, monkeypatch):
    """The walk is one part, whoever reads it; it comes after what it needs."""
    made = []
    for name, part in registry.PARTS.items():
        monkeypatch.setitem(registry.PARTS, name, part._replace(make=lambda t, name=name, part=part: made.append(name) or part.make(t)))
    registry.run_features(["marked_question", "latching", "overlap_split", "token_count", "pitch"], calls(spark))
    assert sorted(made) == ["marked", "pitch", "rising", "text", "turns"] and made[-1] == "marked"


def test_missing_inputs_are_errors(spark):
    inputs = calls(spark)
    for name, lost in (("pitch", "frames"), ("marked_question", "words"), ("personal_focus", "lexicon"), ("demographics", "callers"), ("topic", "topics"), ("mutual_revelation", "tagged")):
        with pytest.raises(ValueError, match=f"{name}.*{lost}"):
            registry.run_feature(name, {k: v for k, v in inputs.items() if k != lost})
    with pytest.raises(ValueError, match="'pitch' needs columns call_id, side, utt_num, f0 of frames and makes pitch_mean.*missing: f0"):
        registry.run_feature("pitch", inputs | {"frames": inputs["frames"].drop("f0")})


def test_analyser_sees_an_utterance_over_many_batches(spark, tmp_path):
    """Frames in order, whatever the batches; the model is loaded once a worker."""
    from callscope.operators import analysis, prosody

    log = str(tmp_path / "loads")
    rows = [(1, "A", n, float(t), float(t % 7) if t % 5 else None) for n, size in ((1, 9000), (2, 1), (3, 50), (4, 4000)) for t in range(size)]
    df = spark.createDataFrame(rows, "call_id int, side string, utt_num int, t double, v double").repartition(5)

    def load():
        import numpy as np

        with open(log, "a") as f:
            f.write("x")
        return analysis.whole(lambda c: {"n": [len(c["v"])], "sorted": [bool((np.diff(c["t"]) > 0).all())], "total": [float(np.nansum(c["v"]))]})()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["utt_num"]: (r["n"], r["sorted"], r["total"]) for r in analysis.analyse(df, load, "n long, sorted boolean, total double", ["t", "v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {n: (size, True, float(sum(t % 7 for t in range(size) if t % 5))) for n, size in ((1, 9000), (2, 1), (3, 50), (4, 4000))}
    assert len(open(log).read()) == 1
    import numpy as np

    x = np.random.default_rng(1).normal(size=5000)
    parts = spark.createDataFrame([(1, "A", 1, b, x[b * 90 : (b + 1) * 90].tolist()) for b in range(56)] + [(1, "A", 2, 0, [1.0, 2.0])], "call_id int, side string, utt_num int, b int, samples array<double>")
    one = spark.createDataFrame([(1, "A", 1, x.tolist()), (1, "A", 2, [1.0, 2.0])], "call_id int, side string, utt_num int, samples array<double>")
    a, b = ({(r["utt_num"], r["t"]): r["rms"] for r in d.collect()} for d in (prosody.frame_rms(parts, block="b"), prosody.frame_rms(one)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a) and len(a) == 1 + (5000 - 512) // 128 + 1
    assert a[1, 128] == pytest.approx(float(np.sqrt((np.abs(np.fft.fft(x[128:640] * np.hanning(513)[:-1])) ** 2).sum() / 512**2)))


def test_parts_make_only_what_is_read(spark, monkeypatch):
    """A settled part has its wanted columns and those that another part reads; tables are dealt out before they are grouped, tokens meet a small lexicon unshuffled."""
    from callscope.operators import order, registry
    from callscope.plans import rollups
    from callscope.sources import tables

    kept, settled = [], order.settled
    monkeypatch.setattr(order, "settled", lambda df: kept.append(set(df.columns)) or settled(df))
    rollups.udf_run_features(spark, "/root/testdata/sf0.001")
    assert {*registry.KEY, "token_count", "word_rate", "question_flag"} in kept and not any("stripped_text" in columns for columns in kept)
    a = spark.range(5).select("id", F.lit("x").alias("a"))
    plan = tables.union_rows(a.select("id"), {"a": a}, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("Exchange") and "Aggregate" not in plan[plan.index("Exchange") :]
    assert "BroadcastHashJoin" in rollups._hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_tables_columns_are_grouped_as_one(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 5)], "id int, s string, v int")
    out = tables.union_rows(spark.range(1, 4).select(F.col("id").cast("int")), {"a": a}, ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, "x", None), (2, None, 5), (3, None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("first(") == 1
