"""Statistics on planted structure and planted nulls, seeded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import classify, clusterability, curves, groups, modality, multivariate


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in np.atleast_2d(x)], ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def axes():
    r = np.random.default_rng(1)
    return {"one": r.normal(size=600), "two": np.concatenate([r.normal(-3, 1, 300), r.normal(3, 1, 300)]), "flat": r.uniform(size=600), "skew": r.gamma(2.0, size=600)}


@pytest.fixture(scope="module")
def columns(spark, axes):
    return frame(spark, np.stack(list(axes.values()), 1), axes).cache()


def test_distribution_functions():
    assert abs(groups.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-6
    p = lambda t, n: groups.incomplete_beta(n / 2, 0.5, n / (n + t * t))
    assert abs(p(2.0, 10) - 0.0733880) < 1e-6 and abs(p(2.228139, 10) - 0.05) < 1e-6


def test_anova_detects_a_shift(spark):
    r = np.random.default_rng(2)
    rows = [(g, float(r.normal(g == "c", 1 + (g == "b")))) for g in "abc" for _ in range(80)]
    a = groups.anova(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    assert a["p"] < 1e-3 and a["welch_p"] < 1e-3 and a["k"] == 3
    null = groups.anova(spark.createDataFrame([(g, float(r.normal())) for g in "abc" for _ in range(80)], "g string, v double"), "g", "v").first()
    assert null["p"] > 0.01


def test_pca(spark):
    r = np.random.default_rng(3)
    f = r.normal(size=(500, 1))
    x = np.concatenate([f + 0.5 * r.normal(size=(500, 3)), r.normal(size=(500, 2))], 1)
    df = frame(spark, x, "abcde")
    m = multivariate.pca(df, list("abcde"))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(m["values"], np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1])
    s = multivariate.project(df, m, 2).toPandas()
    assert np.allclose(s["PC1"].to_numpy(), z @ m["weights"][:, 0])
    k, _ = multivariate.parallel_analysis(spark, m["values"], 500, 60)
    assert k == 1
    chosen, mean_r = multivariate.indicators(df, m, 1, 3)
    assert {c for c, _ in chosen} == set("abc") and mean_r > 0.6


def test_factors(spark):
    r = np.random.default_rng(4)
    load = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.9], [0, 0.8], [0, 0.7]])
    x = r.normal(size=(4000, 2)) @ load.T + r.normal(size=(4000, 6)) * np.sqrt(1 - (load**2).sum(1))
    m = multivariate.factors(frame(spark, x, "abcdef"), list("abcdef"), 2)
    got = m["loadings"][:, np.argsort(-m["loadings"][0])]
    assert np.abs(got - load).max() < 0.08
    assert multivariate.identify_factor(m, ["a", "b"])[1] and not multivariate.identify_factor(m, ["a", "d"])[1]


def test_modes_and_bandwidth(columns):
    for name, n in (("one", 1), ("two", 2)):
        x, c = modality.histogram(columns, name)
        assert c.sum() == 600
        assert modality.strict_modes(modality.smooth(x, c, 0.35)) == n == modality.prominent_modes(modality.smooth(x, c, 0.35))
    x, c = modality.histogram(columns, "two")
    h = modality.critical_bandwidth(x, c)
    assert modality.strict_modes(modality.smooth(x, c, h)) == 1 < modality.strict_modes(modality.smooth(x, c, 0.9 * h))
    assert modality.strict_modes(np.array([0, 1, 1, 0, 2, 0.0])) == 2
    with pytest.raises(ValueError):
        modality.histogram(columns.select(F.lit(1.0).alias("k")), "k")


def test_dip():
    x = np.arange(4.0)
    assert abs(modality.dip(x, np.ones(4)) - 0.125) < 1e-9  # 1 / (2 n) for an even sample
    two = np.array([10, 10, 0, 0, 0, 10, 10.0])
    assert modality.dip(np.arange(7.0), two) > 0.12 > modality.dip(np.arange(7.0), np.array([1, 3, 6, 9, 6, 3, 1.0]))


def test_unimodality_tests(columns):
    assert modality.dip_test(columns, "two", 39)[1] <= 0.05 < modality.dip_test(columns, "one", 39)[1]
    assert modality.silverman(columns, "two", 1, 39)[1] <= 0.05 < modality.silverman(columns, "one", 1, 39)[1]
    assert modality.likelihood_ratio(columns, "two", replicates=39)[1] <= 0.05
    assert modality.likelihood_ratio(columns, "one", replicates=39)[1] > 0.02


def test_families(columns):
    assert modality.verdict(modality.family_table(columns, "two")) == "mixture"
    assert modality.verdict(modality.family_table(columns, "one")) == "single"
    skew = {r["family"]: r["bic"] for r in modality.family_table(columns, "skew").collect()}
    assert min(skew["log_normal"], skew["skew_normal"], skew["skew_t"]) < skew["normal"]


def test_mixture_curve(columns):
    bic = {r["k"]: r["bic"] for r in multivariate.mixture_curve(columns, "two", range(1, 4)).collect()}
    assert bic[2] < bic[1] and bic[2] < bic[3] + 20
    labels = multivariate.mixture_labels(columns, "two", 2).groupBy("label").agg(F.avg("two").alias("m")).orderBy("label").collect()
    assert labels[0]["m"] < -2 and labels[1]["m"] > 2


def test_clusters(spark):
    r = np.random.default_rng(5)
    three = frame(spark, np.concatenate([r.normal(c, 0.3, (100, 2)) for c in ((0, 0), (5, 0), (0, 5))]), "xy").cache()
    k, _ = modality.gap_statistic(three, ["x", "y"], range(1, 6), 6)
    assert k == 3 and clusterability.hopkins(three, ["x", "y"]) > 0.8
    assert 0.35 < clusterability.hopkins(frame(spark, r.uniform(size=(400, 2)), "xy"), ["x", "y"]) < 0.65
    best = max(multivariate.silhouettes(three, ["x", "y"], range(2, 5)).collect(), key=lambda q: q["silhouette"])
    assert best["k"] == 3
    x, c = modality.pairwise_distances(three, ["x", "y"])
    assert c.sum() == 300 * 299 / 2
    with pytest.raises(ValueError):
        modality.pairwise_distances(three, ["x", "y"], max_rows=10)


def test_curves(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 4)) + (np.arange(300)[:, None] < 120) * 2.5
    df = frame(spark, np.concatenate([np.arange(300)[:, None], x], 1), ["unit", *"abcd"])
    m = {q["cut"]: q["value"] for q in curves.mambac(df, "unit", list("abcd")).collect()}
    order, want = {}, []
    for i in range(4):
        o = np.argsort(x[:, i], kind="stable")
        want += [x[o[100:], j].mean() - x[o[:100], j].mean() for j in range(4) if j != i]
    assert abs(m[100] - np.mean(want)) < 1e-9 and len(m) == 251
    e = [q["value"] for q in curves.maxeig(df, "unit", list("abcd"), 12).orderBy("window").collect()]
    assert max(e[3:11]) > 1.3 * max(e[0], e[-1])
    d = np.array([q["density"] for q in curves.lmode(df, list("abcd")).orderBy("x").collect()])
    assert modality.prominent_modes(d) == 2 and abs(d.sum() * 0.05 - 1) < 0.02


def test_bootstrap_and_theory(spark):
    r = np.random.default_rng(7)
    f = r.normal(size=(400, 1))
    df = frame(spark, np.concatenate([f + 0.4 * r.normal(size=(400, 2)), r.normal(size=(400, 1))], 1), "abc")
    b = multivariate.bootstrap_scores(df, list("abc"), [1.0, 1.0, 0.0], 30).toPandas()
    assert len(b) == 30 and b["agreement"].min() > 0.95 and b["captured"].min() > 0.9


def test_classifier_queries(spark):
    """Both run on a table, give each utterance a score, and agree with the labels that they learn from."""
    from callscope.plans import statistics

    d = "/root/testdata/sf0.001"
    rows = statistics.ml_classifier(spark, d).collect()
    assert len(rows) == len({(r["call_id"], r["side"], r["utt_num"]) for r in rows}) > 100
    assert {r["label"] for r in rows} == {0.0, 1.0} and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    a = statistics.ml_out_of_fold(spark, d).first()
    assert a["tp"] + a["fn"] == sum(r["label"] == 1 for r in rows) and a["admitted"]


def test_classifier(spark):
    rows = [(i, i % 12, "yeah right" if i % 3 == 0 else f"we went to town {i % 7} times", float(i % 5) if i % 4 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "k long, call long, text string, x double")
    d = classify.prepare(df, "text", ["x"], F.col("k") % 3 == 0)
    out = classify.out_of_fold(d, ["x"], "call", ["k"], folds=3)
    a = classify.admission(out, 0.9).first()
    assert out.count() == 240 and a["f1"] == 1.0 and a["admitted"]
    assert classify.top_features(classify.fit(d, ["x"]), 3)[0][0] in {"yeah", "right", "<s> yeah", "yeah right", "we", "<s> we", "went", "we went", "to", "town", "times", "to town", "went to"}


def _utterances(spark):
    rows = [(i, i % 12, "yeah right" if i % 3 == 0 else f"we went to town {i % 7} times" + " late" * (i % 12 == 5), float(i % 5) if i % 4 else None) for i in range(240)]
    return classify.prepare(spark.createDataFrame(rows, "k long, call long, text string, x double"), "text", ["x"], F.col("k") % 3 == 0)


def test_classifier_is_fitted_without_the_names_of_its_features(spark, monkeypatch):
    """Names would go along with each task of each step: at a vocabulary's size that took longer than the fit."""
    from pyspark.ml.classification import LogisticRegression

    seen, own = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: (seen.append(df), own(self, df))[1])
    d = _utterances(spark)
    model = classify.fit(d, ["x"])
    assert len(seen) == 1 and all(f.metadata == {} for f in seen[0].schema) and "ExistingRDD" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    two = {r["k"]: r["score"] for r in classify.predict(model, d, ["k"]).collect()}
    one = {r["k"]: r["score"] for r in classify.in_sample(d, ["x"], ["k"]).collect()}
    assert len(one) == 240 and max(abs(one[k] - two[k]) for k in two) < 1e-9


def test_out_of_fold_counts_terms_once_and_keeps_folds_apart(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    d = _utterances(spark)
    fold = F.pmod(F.xxhash64(F.lit(3), "call"), 3)
    want = {}
    for k in range(3):
        model = classify.fit(d.where(fold != k), ["x"])
        want |= {r["k"]: r["score"] for r in classify.predict(model, d.where(fold == k), ["k"]).collect()}
    fits, own = [], CountVectorizer.fit
    monkeypatch.setattr(CountVectorizer, "fit", lambda self, df: (fits.append(1), own(self, df))[1])
    got = {r["k"]: r["score"] for r in classify.out_of_fold(d, ["x"], "call", ["k"], folds=3).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert len(fits) == 2


def test_vocabularies_of_folds_are_the_most_frequent_terms(spark, monkeypatch):
    monkeypatch.setattr(classify, "VOCABULARY", 2)
    d = spark.createDataFrame([(0, ["a", "a", "b"]), (0, ["b", "c"]), (1, ["a", "c", "d"]), (1, ["c", "d", "d"]), (2, ["a", "c"])], "fold int, marked array<string>")
    known = {r["term"]: (r["in0"], r["in1"], r["in2"]) for r in classify._vocabularies(d, "marked", 2, [None, 0, 1]).to_pylist()}
    assert known == {"a": (True, False, True), "c": (True, True, False), "b": (False, False, True), "d": (False, True, False)}


def test_pairwise_distances_of_all_rows(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(300, 2)), np.tile([[0.5, -0.5]], (40, 1))])
    at, c = modality.pairwise_distances(frame(spark, x, "xy"), ["x", "y"], block=64)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))[np.triu_indices(340, 1)]
    edges = np.append(at - (at[1] - at[0]) / 2, at[-1] + (at[1] - at[0]) / 2)
    assert c.sum() == 340 * 339 / 2 and np.abs(np.cumsum(c) - np.cumsum(np.histogram(d, edges)[0])).max() <= 2
    many = spark.range(20_500).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 41).cast("double").alias("y"))
    assert modality.pairwise_distances(many, ["x", "y"])[1].sum() == 20_500 * 20_499 / 2


def test_distance_dip_takes_every_unit(spark):
    from callscope.plans import statistics

    sf = "/root/testdata/sf0.1"
    n = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
    assert statistics.ml_distance_dip(spark, sf).first()["n_pairs"] == n * (n - 1) // 2


def test_null_distributions_have_the_tables_size(spark):
    # errors of the reference dispersions fall with the rows: 16 times the rows, about a quarter of the spread
    small, large = (np.log(modality.reference_dispersions(spark, [1.0, 2.0], n, [1, 2], 40, slice_rows=5000)) for n in (2000, 32_000))
    assert 0.12 < large[:, 0].std() / small[:, 0].std() < 0.45
    assert np.allclose(np.exp(large[:, 0]).mean() / 32_000, 5 / 12, rtol=0.01) and np.allclose(np.exp(large[:, 1]).mean() / 32_000, 2 / 12, rtol=0.03)
    uniform = spark.range(20_000).select((F.rand(3) * 1.0).alias("x"), (F.rand(4) * 1.0).alias("y")).cache()
    assert modality.gap_statistic(uniform, ["x", "y"], [1, 2], 20)[1].where("k = 1").first()["error"] < 0.006  # 0.014 at 2,000 rows
    # Horn: the threshold above 1 falls with the square root of the rows, and equals that of drawn rows
    _, cut = multivariate.parallel_analysis(spark, np.ones(4), 400, 4000)
    r = np.random.default_rng(9)
    rows = np.array([np.sort(np.linalg.eigvalsh(np.corrcoef(r.normal(size=(400, 4)), rowvar=False)))[::-1] for _ in range(4000)]) * 400 / 399
    assert np.abs(cut - np.quantile(rows, 0.95, axis=0)).max() < 0.01
    assert multivariate.parallel_analysis(spark, np.ones(4), 4_000_000, 50)[1][0] < 1.003


def test_parallel_analysis_query_uses_every_unit(spark):
    from callscope.plans import statistics

    top = [r["threshold"] for r in statistics.ml_parallel_analysis(spark, "/root/testdata/sf0.1").orderBy("component").collect()]
    assert top[0] < 1.03  # about 1.05 for 2,000 rows of noise


def test_grid_takes_the_most_modes_of_three_bandwidths(spark):
    from statistics import NormalDist

    from callscope.operators import grid

    half = [NormalDist(0, 0.75).inv_cdf((i + 0.5) / 1000) for i in range(1000)]
    x = np.array([v - 1 for v in half] + [v + 1 for v in half])
    rows = [("r", "t", "u", str(i), 5, float(v), None if i == 0 else float(v + i % 7)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rule string, transform string, unit string, id string, n_sub long, a double, b double")
    got = {q["feature_set"]: q for q in grid.specifications(df, [3], {"one": ["a"], "both": ["a", "b"]}, replicates=19).collect()}
    assert got["one"]["modes"] == 2 and got["one"]["unimodal"] is False and got["one"]["n_units"] == 2000
    assert got["both"]["n_units"] == 1999 and abs(got["one"]["skewness"]) < 1e-6
    at, c = modality.histogram(df, "a", 512)
    assert modality.prominent_modes(modality.smooth(at, c, 0.4)) == 1  # the single bandwidth of before
    assert got["one"]["dip_p"] * 20 == pytest.approx(round(got["one"]["dip_p"] * 20))
    assert grid.specifications(df.limit(4), [3], {"one": ["a"]}).first()["dip"] is None


def test_ranking_works_out_the_grid_once(spark):
    from callscope.operators import grid

    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    names = "rule string, transform string, unit string, min_utt int, feature_set string, dip_p double"
    specs = spark.createDataFrame([("r", "t", "u", m, "f", p) for m, p in ((1, 0.5), (2, None), (3, 0.1))], names).mapInArrow(count, names)
    assert [q["min_utt"] for q in grid.ranked(specs).collect()] == [3, 1, 2]
    assert seen.value == 3
