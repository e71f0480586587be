"""Queries on components, mixtures, modes, curves, grids and classifiers, with SQL where it can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.operators import chronology as C
from callscope.operators import clusterability
from callscope.operators import classify, curves, grid, modality, multivariate, order
from callscope.operators import overlap as O
from callscope.operators import turns as T
from callscope.operators import units as U
from callscope.plans import annotated, corpus, rollups

QUERIES: dict = {}
SQL: dict[str, str] = {}
query_with_calls = rollups.query


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in LINES])


def _customers(spark, sf_dir):
    """A unit table: a row a customer, with order statistics."""
    o = corpus.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("price"), F.max(F.col("o_totalprice").cast("double")).alias("top"), F.avg((F.col("o_orderkey") % 97).cast("double")).alias("noise")).withColumnRenamed("o_custkey", "unit")


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}' for c in LINES)} FROM lineitem")
def ml_standardise(spark, sf_dir):
    return multivariate.standardise(_lines(spark, sf_dir), LINES).withColumns({c: F.round(c, 6) for c in LINES})


@query(None)
def ml_pca(spark, sf_dir):
    m = multivariate.pca(_lines(spark, sf_dir), LINES)
    return multivariate.loadings_table(spark, m).withColumn("share", F.element_at(F.array(*[F.lit(float(s)) for s in m["shares"]]), F.col("component")))


_PAIRS = [(a, b) for i, a in enumerate(LINES) for b in LINES[i:]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM lineitem" for a, b in _PAIRS))
def ml_pca_correlations(spark, sf_dir):
    """Correlations put together again from all components: loadings and eigenvalues have to be right together."""
    m = multivariate.pca(_lines(spark, sf_dir), LINES)
    r = m["loadings"] @ m["loadings"].T * (m["n"] - 1) / m["n"]
    return spark.createDataFrame([(a, b, float(r[LINES.index(a), LINES.index(b)])) for a, b in _PAIRS], "a string, b string, r double").withColumn("r", F.round("r", 6))


@query("SELECT 0.0::DOUBLE AS mean, round(sum(v), 6) AS total, 0.0::DOUBLE AS covariance FROM (" + " UNION ALL ".join(f"SELECT var_samp({c}::DOUBLE) / var_pop({c}::DOUBLE) AS v FROM lineitem" for c in LINES) + ")")
def ml_component_score_moments(spark, sf_dir):
    """Scores on all components: mean 0, no covariance, and the columns' whole variance."""
    d = _lines(spark, sf_dir)
    scored = multivariate.project(d, multivariate.pca(d, LINES), len(LINES))
    pcs = [f"PC{j + 1}" for j in range(len(LINES))]
    total = lambda xs: sum(xs[1:], xs[0])
    zero = lambda x: F.abs(F.round(x, 6))
    return scored.agg(zero(total([F.avg(c) for c in pcs])).alias("mean"), F.round(total([F.var_samp(c) for c in pcs]), 6).alias("total"), zero(total([F.abs(F.covar_samp(a, b)) for i, a in enumerate(pcs) for b in pcs[i + 1 :]])).alias("covariance"))


@query(None)
def ml_component_scores(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return multivariate.project(d, multivariate.pca(d, LINES), 2).select("l_orderkey", "l_linenumber", "PC1", "PC2")


@query(f"""WITH q AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, {p}) AS {c}_{n}' for c in LINES[:2] for n, p in (('lo', 0.25), ('mid', 0.5), ('hi', 0.75)))} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c}::DOUBLE - {c}_mid) / ({c}_hi - {c}_lo), 6) AS {c}' for c in LINES[:2])} FROM lineitem, q""")
def ml_robust_scale(spark, sf_dir):
    scaled = multivariate.robust_scale(_lines(spark, sf_dir), LINES[:2])
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(F.get("scaled", F.lit(i)), 6).alias(c) for i, c in enumerate(LINES[:2])])


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, round(list_sum(v) / n, 6) AS total, round(v[1] / n, 6) AS first, round(v[len(v)] / n, 6) AS last FROM e")
def scl_l2_normalise(spark, sf_dir):
    e = multivariate.l2_normalise(corpus.table(spark, sf_dir, "embeddings"), "embedding")
    return e.select("vec_id", F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("unit", F.lit(0)), 6).alias("first"), F.round(F.element_at("unit", -1), 6).alias("last"))


@query(None)
def ml_parallel_analysis(spark, sf_dir):
    m = multivariate.pca(_customers(spark, sf_dir), ["n", "price", "top", "noise"])
    k, cut = multivariate.parallel_analysis(spark, m["values"], m["n"], 100)
    return spark.createDataFrame([(i + 1, float(v), float(c), i < k) for i, (v, c) in enumerate(zip(m["values"], cut))], "component int, eigenvalue double, threshold double, kept boolean")


@query(None)
def ml_factors(spark, sf_dir):
    d = _customers(spark, sf_dir)
    return multivariate.loadings_table(spark, multivariate.factors(d, ["n", "price", "top", "noise"], 2))


@query(None)
def ml_indicators(spark, sf_dir):
    d = _customers(spark, sf_dir)
    chosen, r = multivariate.indicators(d, multivariate.pca(d, ["n", "price", "top", "noise"]), 1, 3)
    return spark.createDataFrame([(c, s, r) for c, s in chosen], "feature string, sign int, mean_r double")


@query(None)
def ml_mixture_curve(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "events").select("value")
    return multivariate.mixture_curve(o, "value", range(1, 4))


@query(None)
def ml_silhouettes(spark, sf_dir):
    d = multivariate.standardise(_customers(spark, sf_dir), ["price", "top"])
    return multivariate.silhouettes(d, ["price", "top"], range(2, 5))


@query(f"""WITH z AS (SELECT l_orderkey, l_linenumber, {', '.join(f'(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())::DOUBLE AS {c}' for c in LINES)} FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity * 0.36 + l_extendedprice * 0.54, 5) AS score, round((l_quantity - l_discount) / sqrt(2), 5) AS contrast, 0.18::DOUBLE AS captured FROM z""")
def ml_theory_scores(spark, sf_dir):
    d = multivariate.theory_scores(_lines(spark, sf_dir), [[0.6, 0.6], [0.9, 0.0], [0.0, 0.6], [0.0, 0.8]], [1.0, 0.0, -1.0, 0.0], LINES)
    return d.select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in ("score", "contrast", "captured")])


@query(None)
def ml_bootstrap_scores(spark, sf_dir):
    return multivariate.bootstrap_scores(_customers(spark, sf_dir), ["n", "price", "top", "noise"], [1.0, 0.0, 1.0, 0.0], 50)


@query(None)
def ml_battery(spark, sf_dir):
    return modality.battery(_customers(spark, sf_dir), ["price"], "customer", 39)


@query(None)
def ml_family_table(spark, sf_dir):
    return modality.family_table(_customers(spark, sf_dir), "price")


@query(None)
def ml_mode_counts(spark, sf_dir):
    x, counts = modality.histogram(corpus.table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("v")), "v")
    rows = [(h, modality.strict_modes(modality.smooth(x, counts, h)), modality.prominent_modes(modality.smooth(x, counts, h))) for h in (0.25, 0.4, 0.6)]
    return spark.createDataFrame(rows, "bandwidth double, strict int, prominent int")


@query(None)
def ml_tail_diagnosis(spark, sf_dir):
    d = modality.tail_diagnosis(corpus.table(spark, sf_dir, "events").select("value"), "value")
    return spark.createDataFrame([tuple(d.values())], "raw_modes int, winsorised_modes int, far_share double")


@query(None)
def ml_distance_dip(spark, sf_dir):
    d = multivariate.standardise(_customers(spark, sf_dir), ["price", "top"])
    return spark.createDataFrame([modality.distance_dip(d, ["price", "top"])], "n_pairs long, dip double, error double")


@query(None)
def ml_clusterability(spark, sf_dir):
    d = multivariate.standardise(_customers(spark, sf_dir), ["price", "top"])
    k, gaps = modality.gap_statistic(d, ["price", "top"], range(1, 4), 5)
    return gaps.withColumn("chosen", F.col("k") == k).withColumn("hopkins", F.lit(clusterability.hopkins(d, ["price", "top"])))


@query(None)
def ml_hopkins_nulls(spark, sf_dir):
    """Hopkins' statistic of the unit table against tables of its size with its covariance, and with its correlation and quantiles."""
    d = multivariate.standardise(_customers(spark, sf_dir), ["price", "top", "noise"])
    rows = [(null, *clusterability.hopkins_test(d, ["price", "top", "noise"], null, replicates=200)) for null in ("gaussian", "copula")]
    return spark.createDataFrame(rows, "null_table string, statistic double, p double, null_mean double")


_UNIT_SQL = "WITH c AS (SELECT o_custkey AS unit, count(*)::DOUBLE AS n, avg(o_totalprice::DOUBLE) AS price, max(o_totalprice::DOUBLE) AS top, avg((o_orderkey % 97)::DOUBLE) AS noise FROM orders GROUP BY 1)"


@query(f"""{_UNIT_SQL}, l AS (SELECT unit, 'price' AS name, price AS v FROM c UNION ALL SELECT unit, 'top', top FROM c UNION ALL SELECT unit, 'noise', noise FROM c),
r AS (SELECT name AS i, unit, row_number() OVER (PARTITION BY name ORDER BY v, unit) AS cut FROM l), p AS (SELECT i, name AS o, cut, v FROM r JOIN l USING (unit) WHERE i <> name),
s AS (SELECT i, o, cut, sum(v) OVER (PARTITION BY i, o ORDER BY cut) AS b, sum(v) OVER (PARTITION BY i, o) AS t, count(*) OVER (PARTITION BY i, o) AS n FROM p)
SELECT cut::INT AS cut, round(avg((t - b) / (n - cut) - b / cut), 4) AS value FROM s WHERE cut BETWEEN 25 AND n - 25 GROUP BY cut""")
def win_mambac(spark, sf_dir):
    return curves.mambac(_customers(spark, sf_dir), "unit", ["price", "top", "noise"]).withColumn("value", F.round("value", 4))


@query(None)
def win_maxeig(spark, sf_dir):
    d = multivariate.standardise(_customers(spark, sf_dir), ["n", "price", "top", "noise"])
    return curves.maxeig(d, "unit", ["n", "price", "top", "noise"], 20)


@query(f"""{_UNIT_SQL}, l AS (SELECT unit, 'price' AS name, price AS v, top AS a, noise AS b FROM c UNION ALL SELECT unit, 'top', top, price, noise FROM c UNION ALL SELECT unit, 'noise', noise, price, top FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v, unit) - 1 AS r FROM l), s AS (SELECT count(*) AS n, floor(count(*) / (1 + 19 * (1 - 0.9::DOUBLE)))::BIGINT AS size FROM c),
w AS (SELECT t AS "window", round_even(t * ((n - size) / 19.0::DOUBLE), 0)::BIGINT AS lo, size FROM s, (SELECT unnest(range(0, 20)) AS t)),
e AS (SELECT name, "window", abs(covar_samp(a, b)) AS v FROM r JOIN w ON r >= lo AND r < lo + size GROUP BY ALL)
SELECT "window"::INT AS "window", round(avg(v), 2) AS value FROM e GROUP BY 1""")
def win_maxeig_three(spark, sf_dir):
    """With three indicators the eigenvalue is the size of the other two's covariance."""
    return curves.maxeig(_customers(spark, sf_dir), "unit", ["price", "top", "noise"], 20).withColumn("value", F.round("value", 2))


@query(None)
def ml_lmode(spark, sf_dir):
    return curves.lmode(_customers(spark, sf_dir), ["n", "price", "top", "noise"])


@query("""WITH o AS (SELECT l_linenumber AS at, avg(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1), d AS (SELECT l_linenumber AS at, avg(m) AS m FROM (SELECT l_linenumber, l_suppkey % 5 AS r, avg(l_quantity)::DOUBLE AS m FROM lineitem GROUP BY ALL) GROUP BY 1),
t AS (SELECT l_linenumber AS at, avg(m) AS m FROM (SELECT l_linenumber, l_partkey % 5 AS r, avg(l_tax * 500)::DOUBLE AS m FROM lineitem GROUP BY ALL) GROUP BY 1), s AS (SELECT sqrt(avg((v - d.m) ** 2)) AS rd, sqrt(avg((v - t.m) ** 2)) AS rt FROM o JOIN d USING (at) JOIN t USING (at))
SELECT round(rd / (rd + rt), 6) AS index, CASE WHEN rd / (rd + rt) < 0.45 THEN 'dimensional' WHEN rd / (rd + rt) > 0.55 THEN 'taxonic' ELSE 'ambiguous' END AS verdict FROM s""".replace("AS index", 'AS "index"').replace(" AS at,", ' AS "at",').replace("USING (at)", 'USING ("at")'))
def ml_curve_fit_index(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "at")
    observed = t.groupBy("at").agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))
    stack = lambda k, c: t.groupBy("at", (F.col(k) % 5).alias("replicate")).agg(F.avg(c.cast("double")).alias("value"))
    return curves.curve_fit_index(observed, stack("l_suppkey", F.col("l_quantity")), stack("l_partkey", F.col("l_tax") * 500))


def _specs(spark, sf_dir):
    features = ["token_count", "word_rate", "pause_total"]
    t = order.settled(rollups._table(spark, sf_dir).select("call_id", "side", "caller", "backchannel", *features))  # quantiles and both transforms read it
    rules = {"listed": F.col("backchannel"), "short": (F.col("token_count") <= 2).cast("int"), "none": F.lit(0)}
    units = {"caller": F.col("caller"), "side": F.concat(F.col("call_id").cast("string"), "side")}
    tables = grid.unit_tables(t, rules, {"none": None, "winsor": grid.winsorised}, units, features)
    return grid.specifications(tables, [3, 10], {"volume": ["token_count", "word_rate"], "all": ["token_count", "word_rate", "pause_total"]})


@query(None)
def ml_specification_grid(spark, sf_dir):
    return _specs(spark, sf_dir)


@query(None)
def srt_specification_ranking(spark, sf_dir):
    return grid.ranked(_specs(spark, sf_dir)).select("rule", "transform", "unit", "min_utt", "feature_set", "dip_p", "unimodal")


@query(None)
def srt_specification_enrichment(spark, sf_dir):
    return grid.enrichment(_specs(spark, sf_dir), ~F.coalesce("unimodal", F.lit(True)), "unit")


_UNITS = ["n", "price", "top", "noise"]
_N = range(len(_UNITS))
_STEP = ", ".join(f"{' + '.join(f'c{min(i, j)}_{max(i, j)} * v{j}' for j in _N)} AS w{i}" for i in _N)


@query(f"""{_UNIT_SQL.replace('WITH c AS', 'WITH RECURSIVE un AS')}, c AS (SELECT {', '.join(f'corr({_UNITS[i]}, {_UNITS[j]}) AS c{i}_{j}' for i in _N for j in _N if i <= j)} FROM un),
it AS (SELECT 0 AS i, {', '.join(f'{1.0 / (i + 1)}::DOUBLE AS v{i}' for i in _N)} UNION ALL SELECT i + 1, {', '.join(f'w{i} / sqrt({" + ".join(f"w{j} * w{j}" for j in _N)})' for i in _N)} FROM (SELECT i, {_STEP} FROM it, c WHERE i < 500)),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(v{i}) AS v FROM it WHERE i = 500" for i, c in enumerate(_UNITS))})
SELECT 1 AS component, feature, round(v, 5) AS weight, row_number() OVER (ORDER BY v DESC)::INT AS place FROM l""")
def srt_loading_order(spark, sf_dir):
    """Features by the size of their loading on the first component, with that component's weights; the SQL finds it by repeated multiplication."""
    m = multivariate.pca(_customers(spark, sf_dir), _UNITS)
    scale = F.lit(float(m["values"][0]) ** 0.5)
    first = multivariate.loadings_table(spark, m).where("component = 1")
    return first.select("component", "feature", F.round(F.abs(F.col("loading")) / scale, 5).alias("weight"), "place")


def _labelled(spark, sf_dir):
    """Utterances ready for the classifier, with just the numbers that it takes."""
    p = order.settled(corpus.pieces(spark, sf_dir))
    u, w = corpus.utterances(spark, sf_dir, p), corpus.words(spark, sf_dir, p)
    fto = T.transfer_columns(T.turn_events(u, w)).select(*C.KEY, U.in_window(F.col("fto")).alias("fto"))
    seconds = F.col("end") - F.col("start")
    count = X.token_count(F.col("text"))
    t = O.spread(u, *C.KEY).join(O.spread(fto, *C.KEY), C.KEY).select(*C.KEY, "text", count.alias("token_count"), F.round(X.per_second(count, seconds), 6).alias("word_rate"), "fto")
    return classify.prepare(t, "text", ["token_count", "word_rate", "fto"], X.is_backchannel(F.col("text"))).drop("text")


@query(None)
def ml_classifier(spark, sf_dir):
    return classify.in_sample(_labelled(spark, sf_dir), ["token_count", "word_rate", "fto"], [*C.KEY, "label"])


@query(None)
def ml_out_of_fold(spark, sf_dir):
    return classify.admission(classify.out_of_fold(_labelled(spark, sf_dir), ["token_count", "word_rate", "fto"], "call_id", C.KEY), 0.6)
