"""Turns, overlap, pauses, text and chronology on small hand-made calls."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.functions import tags as G
from callscope.functions import text as X
from callscope.operators import chronology as C
from callscope.operators import gold, people, prosody
from callscope.operators import overlap as O
from callscope.operators import turns as T

UTT = "call_id long, side string, utt_num long, start double, end double, text string"
WORD = "call_id long, side string, utt_num long, i long, start double, end double, token string"
SCENE = [
    ("A", 2, 0.0, 4.0, "we moved here in march"),
    ("B", 3, 1.0, 1.3, "uh-huh"),
    ("B", 4, 2.0, 3.0, "no way really"),
    ("A", 5, 4.5, 4.7, "right"),
    ("B", 6, 4.6, 6.0, "so how was it"),
    ("A", 7, 6.1, 7.0, "it was fine"),
    ("B", 8, 9.0, 9.4, "okay"),
    ("A", 9, 9.5, 10.0, "anyway"),
]
EXPECTED = {
    2: ("first", None, None, None, 1, 0, 0, None, 0, 0),
    3: ("bc", 4.0, None, None, 0, 1, 0, None, 1, 0),
    4: ("interj", 4.0, None, -2.0, 0, 0, 1, None, 1, 0),
    5: ("cont", 4.0, None, 0.5, 0, 1, 0, None, 0, 0),
    6: ("transfer", 4.7, -0.1, -0.1, 1, 0, 0, 0, 0, 1),
    7: ("transfer", 6.0, 0.1, 0.1, 1, 0, 0, 1, 0, 0),
    8: ("bc", 7.0, None, None, 0, 1, 0, None, 0, 0),
    9: ("cont", 7.0, None, 2.5, 0, 0, 0, None, 0, 0),
}


def calls(spark, n=1):
    return spark.createDataFrame([(c, *r) for c in range(n) for r in SCENE], UTT), spark.createDataFrame([], WORD)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_turn_walk_scene(spark, parts):
    u, w = calls(spark, 5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = T.transfer_columns(T.turn_events(u.orderBy(F.rand(parts)), w)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == 40
    for r in rows:
        assert (r["kind"], r["ref_end"], r["fto"], r["onset_gap"], r["turn_initial"], r["backchannel"], r["interjection"], r["latching"], r["cooperative"], r["obstructive"]) == EXPECTED[r["utt_num"]]


def test_backchannel_before_any_turn_and_word_bounds(spark):
    u = spark.createDataFrame([(1, "A", 2, 0.0, 1.0, "um-hum"), (1, "B", 3, 0.5, 2.0, "hello there")], UTT)
    w = spark.createDataFrame([(1, "B", 3, 0, 0.6, 1.9, "hello"), (1, "B", 3, 1, 0.7, 1.5, "there")], WORD)
    got = {r["utt_num"]: (r["kind"], r["ref_end"], r["w_start"], r["w_end"]) for r in T.turn_events(u, w).collect()}
    assert got == {2: ("bc", None, 0.0, 1.0), 3: ("first", None, 0.6, 1.9)}


def test_missing_event_falls_back_to_text(spark):
    u, w = calls(spark)
    manifest = u.select("call_id", "side", "utt_num", "text").unionByName(spark.createDataFrame([(0, "A", 99, "mm-hm")], "call_id long, side string, utt_num long, text string"))
    r = T.attach(manifest, T.turn_events(u, w)).where("utt_num = 99").first()
    assert r["kind"] is None and r["fto"] is None and r["turn_initial"] is None and r["backchannel"] == 1


TEXTS = ["", "[noise]", "[laughter] yeah", "Yeah, right.", "um you know i mean so", "i guess like like well", "what, is it", "[noise] so was he", "i[t]- is", "the the the cat Cat", "you know you know", "[laughter-yes] [vocalized-noise] [x]", "so well but"]


def test_text_functions(spark):
    t = F.col("text")
    cols = {"n": X.token_count(t), "bc": X.is_backchannel(t), "fill": X.filler_hits(t), "rep": X.repeated_types(t), "pairs": X.repeated_pairs(t), "q": X.question_flag(t), "qa": X.question_flag_after_markers(t), "b": X.bracket_events(t)}
    got = [r.asDict() for r in spark.createDataFrame([(x,) for x in TEXTS], "text string").select(*[c.alias(k) for k, c in cols.items()]).collect()]
    assert [g["n"] for g in got] == [0, 0, 1, 2, 6, 5, 3, 3, 2, 5, 4, 0, 3]
    assert [g["bc"] for g in got] == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [g["fill"] for g in got] == [0, 0, 0, 0, 4, 4, 0, 1, 0, 0, 2, 0, 2]
    assert [g["rep"] for g in got] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 2, 2, 0, 0]
    assert got[9]["pairs"] == 4
    assert [g["q"] for g in got] == [None, None, 0, 0, 0, 0, 1, 0, 0, 0, 0, None, 0]
    assert [g["qa"] for g in got] == [None, None, 0, 0, 0, 0, 1, 1, 0, 0, 0, None, 0]
    assert tuple(got[11]["b"]) == (0, 1, 0, 1, 1)
    null = spark.sql("SELECT CAST(NULL AS STRING) AS text").select(X.token_count(t).alias("n"), X.question_flag(t).alias("q")).first()
    assert null["n"] is None and null["q"] is None


def test_echo_flag(spark):
    rows = [(1, "is he home", "he is home"), (1, "is he home", None), (0, "he is", "he is"), (None, "[noise]", "x"), (1, "what a b c d e f", "what a b c d e f")]
    df = spark.createDataFrame(rows, "q int, text string, earlier string")
    assert [r[0] for r in df.select(X.echo_flag(F.col("q"), F.col("text"), F.col("earlier"))).collect()] == [1, 0, 0, None, 0]


def test_chronology(spark):
    u, _ = calls(spark)
    got = {r["utt_num"]: r for r in C.other_side_before(C.predecessor(u)).collect()}
    assert got[2]["prev_text"] is None and got[4]["prev_text"] == "uh-huh" and got[4]["other_text"] == "we moved here in march" and abs(got[5]["turn_gap"] - 1.5) < 1e-9
    told = {r["utt_num"]: r["mutual_revelation"] for r in C.mutual_revelation(u, F.col("utt_num") > 3).collect()}
    assert told[2] is None and told[3] == 0 and told[4] == 0 and told[5] == 1
    between = {r["utt_num"]: r["intervening"] for r in C.intervening_talk(u).collect()}
    assert between[2] is None and between[4] is False and between[5] is True


def brute_overlap(words, key):
    own = sorted((w[4], w[5]) for w in words if w[:3] == key)
    if not own:
        return None, None, None
    merged = []
    for s, e in own:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    cuts, count = [], 0
    for w in words:
        if w[0] == key[0] and w[1] != key[1]:
            c = [(max(s, w[4]), min(e, w[5])) for s, e in merged if max(s, w[4]) < min(e, w[5])]
            count += bool(c)
            cuts += c
    total, last = 0.0, -1e9
    for s, e in sorted(cuts):
        total += max(0, e - max(s, last))
        last = max(last, e)
    onset = any(w[4] <= own[0][0] < w[5] for w in words if w[0] == key[0] and w[1] != key[1])
    return round(total, 6), count, int(onset)


def test_word_overlap_against_brute_force(spark):
    r = random.Random(3)
    words, utts = [], []
    for c in range(4):
        for k in range(60):
            side, at = r.choice("AB"), r.randrange(0, 9000) / 100
            utts.append((c, side, k, at, at + 1, "x"))
            for i in range(r.randrange(0, 6)):
                s = round(at + r.randrange(0, 200) / 100, 2)
                words.append((c, side, k, i, s, round(s + r.randrange(1, 1500) / 100, 2), "w"))
    got = O.word_overlap(spark.createDataFrame(utts, UTT), spark.createDataFrame(words, WORD)).collect()
    assert len(got) == len(utts)
    for x in got:
        d, n, o = brute_overlap(words, (x["call_id"], x["side"], x["utt_num"]))
        assert (x["overlap_count"], x["overlap_onset"]) == (n, o)
        assert d is None and x["overlap_sec"] is None or abs(x["overlap_sec"] - d) < 1e-5


def test_pauses(spark):
    u = spark.createDataFrame([(1, "A", k, 0.0, 9.0, "x") for k in (1, 2, 3)], UTT)
    w = spark.createDataFrame([(1, "A", 1, 0, 0.0, 1.0, "a"), (1, "A", 1, 1, 1.25, 2.0, "b"), (1, "A", 1, 2, 2.1, 3.0, "c"), (1, "A", 1, 3, 2.9, 4.0, "d"), (1, "A", 2, 0, 5.0, 5.0, "a")], WORD)
    got = {r["utt_num"]: tuple(r)[3:] for r in O.pauses(u, w).collect()}
    assert got == {1: (0.35, 1, 0.0875, 0.25), 2: (0.0, 0, 0.0, 0.0), 3: (None, None, None, None)}


def test_tag_grammar(spark):
    tags = {"qy^d^t": (["qy"], ["^d", "^t"]), "sd(^q)": (["sd"], ["(^q)"]), "ba,fe": (["ba", "fe"], []), "^2": (["^2"], []), "sd(^q)*": (["sd"], ["(^q)", "*"]), "^2^g@": (["^2"], ["@", "^g"]), "%": (["%"], [])}
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = {r["tag"]: (r["b"], r["d"]) for r in df.select("tag", G.bases(F.col("tag")).alias("b"), G.decorations(F.col("tag")).alias("d")).collect()}
    assert got == {k: (b, sorted(d)) for k, (b, d) in tags.items()}


def test_alignment_ties_go_to_the_later(spark):
    u = spark.createDataFrame([(1, "A", 1, 0.0, 2.0, ""), (1, "A", 2, 2.0, 4.0, ""), (1, "A", 3, 100.0, 250.0, "")], UTT)
    acts = spark.createDataFrame([(1, "A", 1, "b", 1.0, 3.0), (1, "A", 2, "b", 3.9, 6.0), (1, "A", 3, "b", 110.0, 240.0), (1, "A", 4, "b", None, None)], "call_id long, side string, act_id long, tag string, start double, end double")
    assert {r["act_id"]: r["utt_num"] for r in gold.align(acts, u).collect()} == {1: 2, 2: None, 3: 3, 4: None}


def test_terminal_slope_and_marked_question(spark):
    up = [(1, "A", 1, t / 10, 100 * 2 ** (t / 10 * 6 / 12), 0.1) for t in range(11)] + [(1, "A", 2, 0.0, None, 0.0), (1, "A", 2, 0.1, 100.0, 0.0)]
    f = spark.createDataFrame(up, "call_id long, side string, utt_num long, t double, f0 double, rms double")
    none = spark.createDataFrame([], "call_id long, side string, utt_num long, anchor double")
    got = prosody.terminal_slope(f, none).collect()
    assert len(got) == 1 and abs(got[0]["slope_st"] - 6) < 1e-6 and got[0]["rising"] == 1
    p = {r["utt_num"]: r["pitch_mean"] for r in prosody.pitch(f).collect()}
    assert p[2] == 100.0
    rows = [(1, "A", i, *x) for i, x in enumerate([(1, 1, 1, 1, 0.1, 9.0, 5.0), (0, 0, None, 1, 0.1, 9.0, 5.0), (0, 0, 0, 1, 0.1, 9.0, 5.0), (0, 1, None, 4, 0.5, 5.0, 5.0), (0, 0, 1, 9, None, None, None)])]
    m = spark.createDataFrame(rows, "call_id long, side string, utt_num long, backchannel int, question_flag int, rising int, token_count int, onset_gap double, pitch_mean double, high_pitch double")
    assert {r["utt_num"]: r["mgq_score"] for r in prosody.marked_question(m).collect()} == {0: None, 1: None, 2: 0, 3: 4, 4: 1}


def test_frame_rms(spark):
    audio = spark.createDataFrame([(1, "A", 1, [0.5] * 2048), (1, "A", 2, [0.0] * 10)], "call_id long, side string, utt_num long, samples array<double>")
    rows = prosody.frame_rms(audio).collect()
    one = [r["rms"] for r in rows if r["utt_num"] == 1]
    assert len(one) == 13 and all(abs(x - 0.5 * (3 / 8) ** 0.5) < 1e-3 for x in one)
    assert [r["rms"] for r in rows if r["utt_num"] == 2] == [0.0]


def test_speakers(spark):
    c = spark.createDataFrame([(1, " male", "1926", "NEW YORK CITY", "2"), (2, "FEMALE", "x", "", "1"), (3, "FEMALE", "1965", "", "1")], "caller long, sex string, birth_year string, dialect string, education string")
    got = {r["caller"]: tuple(r)[1:6] for r in people.normalised_callers(c).collect()}
    assert got == {1: ("male", "new_york_city", 1926, "GI", "1920s"), 3: ("female", "unk", 1965, "Generation_X", "1960s")}
    with pytest.raises(Exception, match="unrecognized sex"):
        people.normalised_callers(c.withColumn("sex", F.lit("?"))).collect()
    u, _ = calls(spark)
    sides = spark.createDataFrame([(0, "A", 1)], "call_id long, side string, caller long")
    with pytest.raises(Exception, match="no speaker"):
        people.with_demographics(u, sides, c, strict=True).collect()
    assert people.unmapped_count(u, sides).first()[0] == 4 and people.mapped_rows(u, sides).count() == 4
    assert people.roles_to_sides(spark.createDataFrame([(5, 7, 8)], "call_id long, caller_from long, caller_to long")).count() == 2


def test_repetitions_grow_with_the_utterance(spark):
    """Against counts; a hundred thousand tokens take one fold, not a look at all pairs."""
    import random
    import time
    from collections import Counter

    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["a", "b", "[noise]", "C", "c", "i[t]-", ""]) for _ in range(r.randrange(12))), " ".join(r.choice("abcx") for _ in range(r.randrange(9)))) for i in range(200)]
    rows += [(200, None, "a"), (201, "a", None), (202, "", ""), (203, "a A", "a")]
    df = spark.createDataFrame(rows, "id int, t string, o string")
    got = {x["id"]: (x["n"], x["p"], x["s"]) for x in df.select("id", X.repeated_types(F.col("t")).alias("n"), X.repeated_pairs(F.col("t")).alias("p"), X.shared_pairs(F.col("t"), F.col("o")).alias("s")).collect()}
    count = lambda t: None if t is None else Counter(w for w in t.lower().split() if not (w[0] == "[" and w[-1] == "]"))
    for i, t, o in rows:
        a, b = count(t), count(o)
        assert got[i][:2] == ((None, None) if a is None else (sum(n > 1 for n in a.values()), sum(n * (n - 1) // 2 for n in a.values())))
        assert got[i][2] == (None if a is None or b is None else sum(n * b[w] for w, n in a.items()))
    long = spark.createDataFrame([(" ".join(f"w{i % 40_000}" for i in range(100_000)),), ("ha " * 100_000,)], "t string")
    began = time.time()
    assert {x[0] for x in long.select(X.repeated_pairs(F.col("t"))).collect()} == {80_000, 100_000 * 99_999 // 2}
    assert time.time() - began < 20


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_utterances_read_their_pieces_once(spark):
    from callscope.plans import corpus, core, rollups

    d = "/root/testdata/sf0.001"
    assert "Union" not in _plan(corpus.utterances(spark, d))
    assert _plan(rollups.set_union_sides(spark, d)).count("Scan parquet") == 2 and _plan(core.src_feature_per_manifest_row(spark, d)).count("Scan parquet") <= 4


def test_midpoints_are_dealt_by_the_rows_that_are_sorted(spark):
    from callscope.plans import annotated

    plan = annotated.jn_midpoint_asof(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_syllables_are_not_grouped_by_token(spark):
    from callscope.operators import chronology

    u = spark.createDataFrame([(1, "A", 2, "the the banana"), (1, "B", 4, ""), (2, "A", 2, None)], "call_id long, side string, utt_num long, text string")
    out = chronology.syllables(u, spark.createDataFrame([("the", 7)], "word string, syllables int"))
    assert {(r["call_id"], r["side"]): r["syllables"] for r in out.collect()} == {(1, "A"): 17, (1, "B"): 0, (2, "A"): 0}
    assert "count(t" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_pauses_are_dealt_over_all_partitions(spark):
    w = spark.createDataFrame([(1, "A", n, i, i + 0.0, i + 0.5, "a") for n in range(40) for i in range(3)], "call_id long, side string, utt_num long, i int, start double, end double, token string")
    out = O.pauses(w.select(*O.KEY).distinct(), w)
    assert {tuple(r)[3:] for r in out.collect()} == {(1.0, 2, 0.4, 0.5)}
    assert "REPARTITION_BY_NUM" in _plan(out)
