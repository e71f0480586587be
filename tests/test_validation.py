"""Repairs, composites, sensitivity grids and score validation against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import chronology as C
from callscope.operators import gold, groups, multivariate, prosody, quality

U = "call_id long, side string, utt_num long, start double, end double, text string"
W = "call_id long, side string, utt_num long, token string, repair boolean"


@pytest.fixture(scope="module")
def talk(spark):
    r = random.Random(3)
    utt, words = [], []
    for call in (1, 2):
        for n in range(40):
            key = (call, r.choice("AB"), n)
            said = [(r.choice(["a", "B", "b", "c", "[noise]"]), r.choice([True, False, None])) for _ in range(r.choice([0, 1, 4, 9]))]
            utt.append((*key, float(r.randrange(15)), 20.0, " ".join(t for t, _ in said)))
            words += [(*key, t, x) for t, x in said]
    return utt, words, spark.createDataFrame(utt, U), spark.createDataFrame(words, W)


def counted(words, clean):
    out = {}
    for call, side, n, t, repair in words:
        if t != "[noise]":
            out.setdefault((call, side, n), Counter())[t.lower()] += not (clean and repair)
    return out


def test_repair_shares(talk):
    utt, words, u, w = talk
    both = counted(words, False), counted(words, True)
    now = [sum(n * (n - 1) // 2 for c in k.values() for n in c.values()) for k in both]
    order = sorted(utt, key=lambda x: (x[0], x[3], x[1], x[2]))
    steps = [(a[:3], b[:3]) for a, b in zip(order, order[1:]) if a[0] == b[0]]
    before = [sum(k.get(b, {}).get(t, 0) * n for a, b in steps for t, n in k.get(a, {}).items()) for k in both]
    for got, want in ((gold.repair_share_current(w), now), (gold.repair_share_previous(w, u), before)):
        x = got.first()
        assert [x["pairs"], x["pairs_without_repair"]] == want and x["repair_share"] == round(1 - want[1] / want[0], 6)
    assert {(x[:3], tuple(x[3:])) for x in map(tuple, gold.predecessors(u).where("prev_num IS NOT NULL").select("call_id", "side", "utt_num", "call_id", "prev_side", "prev_num").collect())} == {(b, a) for a, b in steps}


def test_repair_shares_without_words(spark, talk):
    none = spark.createDataFrame([], W)
    for x in (gold.repair_share_current(none).first(), gold.repair_share_previous(none, talk[2]).first()):
        assert tuple(x) == (0, 0, None)


def test_repetition_against_mirror(spark, talk):
    _, words, _, w = talk
    acts = spark.createDataFrame([(1, "A", "sd^m"), (1, "A", "b"), (2, "B", "b^m,sd^m")], "call_id long, side string, tag string")
    x = {r["measure"]: r for r in gold.repetition_against_mirror(w, acts).collect()}
    pairs = lambda k: sum(n * (n - 1) // 2 for n in k.values())
    raw = counted(words, False)
    sides = sorted({k[:2] for k in raw})
    n = [sum(k[:2] == s for k in raw) for s in sides]
    mirror = [100 * {(1, "A"): 1, (2, "B"): 1}.get(s, 0) / m for s, m in zip(sides, n)]
    want = [sum(pairs(c) for k, c in raw.items() if k[:2] == s) / m for s, m in zip(sides, n)]
    assert x["raw"]["n_sides"] == len(sides) and abs(x["raw"]["r"] - np.corrcoef(want, mirror)[0, 1]) < 1e-5
    assert {r["r"] for r in gold.repetition_against_mirror(w, acts.where("tag = 'b'")).collect()} == {None}


def test_syllables_by_table(spark):
    u = spark.createDataFrame([(1, "A", 1, 0.0, 2.0, "Every [noise] idea every xyz"), (1, "A", 2, 0.0, 0.0, "idea"), (1, "B", 3, 0.0, 1.0, None), (1, "B", 4, 0.0, 1.0, "[noise]"), (1, "B", 5, 0.0, 1.0, "12 shh")], U)
    p = spark.createDataFrame([("IDEA", 3), ("every", 2), ("every", 3), ("shh", None)], "word string, syllables int")
    assert {r["utt_num"]: r["syllables"] for r in C.syllables(u, p).collect()} == {1: 3 + 3 + 3 + 1, 2: 3, 3: 0, 4: 0, 5: 1}
    assert {r["utt_num"]: r["syllable_rate"] for r in C.syllable_rate(u, p).collect()} == {1: 5.0, 2: None, 3: 0.0, 4: 0.0, 5: 1.0}


def inputs(spark, n=2):
    key = "call_id long, side string, utt_num long, "
    k = [(1, "A", i) for i in range(n)]
    of = lambda schema, *v: spark.createDataFrame([(*x, *v) for x in k], key + schema)
    return {"question_flags": of("question_flag int", 1), "rising_terminal": of("rising int", None), "token_count": of("token_count int", 3), "fto": of("onset_gap double, backchannel int", 0.1, 0), "pitch": of("pitch_mean double", 100.0)}


def test_composite_inputs(spark):
    u = spark.createDataFrame([(1, "A", i, 0.0, 1.0, "x") for i in range(2)], U)
    t = inputs(spark)
    assert [tuple(r)[3:] for r in prosody.marked_question_of(u, t).collect()] == [(3, 0)] * 2
    with pytest.raises(prosody.MissingInput, match="missing input pitch"):
        prosody.marked_question_of(u, {k: v for k, v in t.items() if k != "pitch"})
    with pytest.raises(prosody.MissingInput, match="fto has no column onset_gap"):
        prosody.marked_question_of(u, t | {"fto": t["fto"].drop("onset_gap")})
    with pytest.raises(Exception, match="token_count has not one row for utterance 1/A/1"):
        prosody.marked_question_of(u, t | {"token_count": inputs(spark, 1)["token_count"]}).collect()
    with pytest.raises(Exception, match="rising_terminal has not one row"):
        prosody.marked_question_of(u, t | {"rising_terminal": t["rising_terminal"].unionByName(t["rising_terminal"])}).collect()


def test_defined_rates(spark):
    r = random.Random(5)
    rows = [(g, r.choice([0, 1, None]), r.choice([None, r.random()])) for g in range(12) for _ in range(4 + g)]
    x = quality.defined_rates(spark.createDataFrame(rows, "g int, flag int, v double"), "flag", "v", ["g"], 6).first()
    mean = lambda v: np.mean([a for a in v if a is not None])
    g = [[b for b in rows if b[0] == k] for k in range(2, 12)]
    d, s, o = ([np.mean([b[1] is not None for b in y]) for y in g], [mean([b[1] for b in y]) for y in g], [mean([b[2] for b in y]) for y in g])
    want = [len(g), *np.quantile(d, [0.05, 0.5, 0.95]), np.corrcoef(d, o)[0, 1], np.corrcoef(d, s)[0, 1], np.corrcoef(s, o)[0, 1]]
    assert np.allclose(list(x), want, atol=2e-6)


def test_anova_grid(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(r.normal(5.0 * (g == 0)))) for g in (0, 1, 2, 3) for _ in range(30)] + [(None, 9.0)] * 30
    x = {(c["unknown"], c["test"]): c for c in groups.anova_grid(spark.createDataFrame(rows, "g int, v double"), "g", "v", [0]).collect()}
    assert len(x) == 4 and x["in", "fisher"]["k"] == 4 and all(x["in", t]["p"] < 1e-6 and x["out", t]["k"] == 3 and x["out", t]["p"] > 0.001 for t in ("fisher", "welch"))


def test_anova_without_spread(spark):
    still = spark.createDataFrame([(g, float(g)) for g in (1, 2) for _ in range(6)], "g int, v double")
    mixed = still.unionByName(spark.createDataFrame([(3, float(i)) for i in range(6)], "g int, v double"))
    for df, k, f in ((still, 2, None), (still.where("g = 1"), 1, None), (still.where("g > 2"), 0, None), (mixed, 3, 6 * ((1 - 5.5 / 3) ** 2 + (2 - 5.5 / 3) ** 2 + (2.5 - 5.5 / 3) ** 2) / 2 / (17.5 / 15))):
        x = groups.anova(df, "g", "v").first()
        assert x["k"] == k and (x["f"] is None if f is None else abs(x["f"] - f) < 1e-6) and x["welch_f"] is None and x["welch_p"] is None


def test_scores(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 5)) @ r.normal(size=(5, 5))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double, out double")
    names, load, target = ["a", "b", "c", "d"], np.linalg.qr(r.normal(size=(4, 2)))[0], np.array([1.0, -1.0, 0.0, 1.0])
    z = (x - x.mean(0)) / x.std(0)
    z, out = z[:, :4], z[:, 4]
    score = z @ load @ (load.T @ target)
    cor = lambda p, q: np.corrcoef(p, q)[0, 1]
    c = multivariate.theory_contributions(df, load.tolist(), target.tolist(), names, "a").toPandas()
    sign = np.sign(cor(score, z[:, 0]))
    assert np.allclose(c["score"], sign * score) and set(c["flipped"]) == {sign < 0}
    assert np.allclose(c.filter(like="component_").sum(axis=1), c["score"]) and np.allclose(c.filter(like="feature_").sum(axis=1), c["score"])
    v = {(y["validation"], y["name"]): y["value"] for y in multivariate.validate_scores(df, names, load.tolist(), target.tolist(), {"other": [0, 0, 1, 0]}, ["out"]).collect()}
    full = load @ (load.T @ target)
    two = np.linalg.lstsq(np.stack([score, z @ load[:, 0]], 1), out, rcond=None)[0]
    fit = np.stack([score, z @ load[:, 0]], 1) @ two
    want = {("direction", "b"): cor(score, z[:, 1]), ("agrees", "b"): float(cor(score, z[:, 1]) < 0), ("without", "c"): cor(score, score - full[2] * z[:, 2]), ("variant", "other"): cor(score, z @ load @ load[2]), ("contrast", "all"): cor(score, z @ target), ("outside", "out"): cor(score, out), ("gain", "out"): cor(fit, out) ** 2 - cor(z @ load[:, 0], out) ** 2}
    assert all(abs(v[k] - w) < 1e-9 for k, w in want.items()) and ("direction", "c") not in v


def test_block_shares(spark):
    load = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.25), (1, "c", 0.25), (2, "a", 0.0)], "component int, feature string, loading double")
    x = multivariate.block_shares(load, spark.createDataFrame([("a", "x"), ("b", "x")], "feature string, block string"))
    assert {(r["component"], r["block"]): r["share"] for r in x.collect()} == {(1, "x"): 0.75, (1, "none"): 0.25, (2, "x"): None}
    assert x.where(F.col("share") > 1).count() == 0
