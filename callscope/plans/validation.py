"""Queries on repairs in gold tokens, composites, sensitivity grids and the validation of scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import chronology as C
from callscope.operators import gold, multivariate, prosody, quality
from callscope.operators import groups as S
from callscope.plans import annotated, corpus, rollups, statistics
from callscope.plans.annotated import PITCH_SQL, SLOPE_SQL, TAG_SQL
from callscope.plans.core import _TOK
from callscope.plans.statistics import LINES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {corpus.SQL.strip()}, {sql.strip()}"
        return f

    return add


# --- repairs in gold tokens -------------------------------------------------------------------------------------


def _gold_words(spark, sf_dir):
    return corpus.words(spark, sf_dir).select(*C.KEY, "token", (F.col("i") % 6).isin(2, 3).alias("repair"))


TOKENS_SQL = """
tc AS (SELECT call_id, side, utt_num, lower(token) AS t, count(*) AS n, count_if(i % 6 NOT IN (2, 3)) AS k FROM w WHERE NOT (starts_with(token, '[') AND ends_with(token, ']')) GROUP BY ALL),
pr AS (SELECT call_id, side, utt_num, lag(side) OVER o AS prev_side, lag(utt_num) OVER o AS prev_num FROM u WINDOW o AS (PARTITION BY call_id ORDER BY start, side, utt_num))
"""


@query(f"{TOKENS_SQL} SELECT * FROM pr")
def win_gold_predecessor(spark, sf_dir):
    return gold.predecessors(corpus.utterances(spark, sf_dir))


@query(f"""{TOKENS_SQL} SELECT coalesce(sum(c.n * p.n), 0)::BIGINT AS pairs, coalesce(sum(c.k * p.k), 0)::BIGINT AS pairs_without_repair, round(1 - sum(c.k * p.k) / sum(c.n * p.n), 6) AS repair_share
FROM tc c JOIN pr USING (call_id, side, utt_num) JOIN tc p ON p.call_id = c.call_id AND p.side = pr.prev_side AND p.utt_num = pr.prev_num AND p.t = c.t""")
def agg_repair_share_previous(spark, sf_dir):
    return gold.repair_share_previous(_gold_words(spark, sf_dir), corpus.utterances(spark, sf_dir))


@query(f"""{TOKENS_SQL}, {TAG_SQL},
cp AS (SELECT call_id, side, utt_num, sum(n * (n - 1) // 2) AS n, sum(k * (k - 1) // 2) AS k FROM tc GROUP BY ALL),
sd AS (SELECT call_id, side, count(*) AS u, sum(n) AS n, sum(k) AS k FROM cp GROUP BY ALL),
mi AS (SELECT call_id, side, count_if(list_contains(decorations, '^d')) AS m FROM tg GROUP BY ALL),
x AS (SELECT (n / u)::DOUBLE AS raw, (k / u)::DOUBLE AS clean, ((n - k) / u)::DOUBLE AS by_repair, (100 * coalesce(m, 0) / u)::DOUBLE AS mirror FROM sd LEFT JOIN mi USING (call_id, side))
SELECT 'raw' AS measure, count(*) AS n_sides, round(corr(raw, mirror), 6) AS r FROM x UNION ALL SELECT 'clean', count(*), round(corr(clean, mirror), 6) FROM x UNION ALL SELECT 'by_repair', count(*), round(corr(by_repair, mirror), 6) FROM x""")
def agg_repetition_mirror_correlation(spark, sf_dir):
    """The given acts have no '^m'; '^d' takes its place."""
    return gold.repetition_against_mirror(_gold_words(spark, sf_dir), corpus.acts(spark, sf_dir), "^d")


# --- text -------------------------------------------------------------------------------------------------------


@query(f"""
tk AS (SELECT call_id, side, utt_num, unnest({_TOK}) AS t FROM u), dict AS (SELECT DISTINCT t, len(t) // 3 + 1 AS known FROM tk WHERE len(t) % 3 = 0),
sy AS (SELECT call_id, side, utt_num, sum(coalesce(known, CASE WHEN regexp_matches(t, '[a-z]') THEN greatest(1, len(regexp_extract_all(t, '[aeiouy]+'))) ELSE 0 END)) AS s FROM tk LEFT JOIN dict USING (t) GROUP BY ALL)
SELECT u.call_id, u.side, u.utt_num, round(coalesce(s, 0) / round("end" - start, 6), 6) AS syllable_rate FROM u LEFT JOIN sy USING (call_id, side, utt_num)""")
def scl_syllables_by_table(spark, sf_dir):
    """The pronunciation table is derived from the tokens: those of a length divisible by three are in it."""
    from callscope.functions import text as X

    u = corpus.utterances(spark, sf_dir).withColumn("end", F.round(F.col("end") - F.col("start"), 6)).withColumn("start", F.lit(0.0))
    words = u.select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct().where(F.length("word") % 3 == 0)
    rate = C.syllable_rate(u, words.select("word", (F.floor(F.length("word") / 3) + 1).alias("syllables")))
    return rate.withColumn("syllable_rate", F.round("syllable_rate", 6))


_PAIRS = f"coalesce(list_sum(list_transform(map_values(list_aggregate({_TOK}, 'histogram')), lambda n: n * (n - 1) // 2)), 0)"
_LAUGHS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w = '[laughter]'))"


def _later(sql):
    return sql.replace("text", "later")


@query(f"""
rc AS (SELECT text, text || CASE WHEN utt_num % 10 = 0 THEN ' [laughter]' WHEN utt_num % 14 = 0 THEN ' the the' WHEN utt_num % 22 = 0 THEN ' zq' ELSE '' END AS later FROM u)
SELECT 'laughter' AS feature, count_if({_LAUGHS} <> {_later(_LAUGHS)})::BIGINT AS n_mismatches FROM rc UNION ALL SELECT 'token_count', count_if(len({_TOK}) <> len({_later(_TOK)}))::BIGINT FROM rc UNION ALL SELECT 'repetitions_current', count_if({_PAIRS} <> {_later(_PAIRS)})::BIGINT FROM rc""")
def agg_reconciliation(spark, sf_dir):
    """Features of the text as it was against those recomputed from a transcript in which some utterances were changed later."""
    from callscope.functions import text as X

    u, n = corpus.utterances(spark, sf_dir), F.col("utt_num")
    later = F.concat("text", F.when(n % 10 == 0, " [laughter]").when(n % 14 == 0, " the the").when(n % 22 == 0, " zq").otherwise(""))
    stored = C.text_features(u).select(*C.KEY, "laughter", "token_count", "repetitions_current").join(u.select(*C.KEY, later.alias("later")), C.KEY)
    t = F.col("later")
    return quality.reconcile(stored, {"laughter": X.bracket_events(t)["laughter"], "token_count": X.token_count(t), "repetitions_current": X.repeated_pairs(t)})


@query(f"""{SLOPE_SQL}, {PITCH_SQL},
df AS (SELECT call_id, side, count(*) AS n, avg((rising IS NOT NULL)::INT) AS defined, avg(rising) AS share, avg(pitch_mean) AS other FROM u LEFT JOIN sl USING (call_id, side, utt_num) LEFT JOIN pm USING (call_id, side, utt_num) GROUP BY ALL HAVING count(*) >= 5)
SELECT count(*) AS n_units, round(quantile_cont(defined, 0.05), 6) AS q05, round(quantile_cont(defined, 0.5), 6) AS median, round(quantile_cont(defined, 0.95), 6) AS q95, round(corr(defined, other), 6) AS r_defined_other, round(corr(defined, share), 6) AS r_defined_share, round(corr(share, other), 6) AS r_share_other FROM df""")
def agg_defined_rates(spark, sf_dir):
    pitch = prosody.pitch(corpus.frames(spark, sf_dir)).select(*C.KEY, "pitch_mean")
    u = corpus.utterances(spark, sf_dir).select(*C.KEY).join(annotated._slopes(spark, sf_dir), C.KEY, "left").join(pitch, C.KEY, "left")
    return quality.defined_rates(u, "rising", "pitch_mean", ["call_id", "side"], 5)


# --- group comparisons and scores --------------------------------------------------------------------------------


def _grid(spark, sf_dir):
    return S.anova_grid(rollups._customers(spark, sf_dir).withColumn("level", F.col("c_nationkey") % 4), "level", "c_acctbal", [0])


@query(None)
def agg_anova_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query("""
c AS (SELECT 'in' AS cell, c_nationkey % 4 AS lv, c_acctbal FROM customer UNION ALL SELECT 'out', c_nationkey % 4, c_acctbal FROM customer WHERE c_nationkey % 4 <> 0),
g AS (SELECT cell, lv, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM c GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT cell, count(*) AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS wi, sum(n / v) AS w, sum(n / v * m) AS wm, sum(n / v * m * m) AS wmm FROM g GROUP BY cell),
l AS (SELECT cell, sum((1 - g.n / v / w) ** 2 / (g.n - 1)) AS lam FROM g JOIN s USING (cell) GROUP BY cell)
SELECT cell AS unknown, 'fisher' AS test, k, round((nmm - nm * nm / n) / (k - 1) / (wi / (n - k)), 6) AS f, (n - k)::DOUBLE AS dof FROM s
UNION ALL SELECT cell, 'welch', k, round((wmm - wm * wm / w) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam), 6), round((k * k - 1) / (3 * lam), 6) FROM s JOIN l USING (cell)""")
def agg_anova_grid_statistic(spark, sf_dir):
    return _grid(spark, sf_dir).drop("p")


#: A map of four columns to two components, and what it is held against.
LOADINGS = [[0.6, 0.6], [0.9, 0.0], [0.0, 0.6], [0.0, 0.8]]
Z_SQL = f"z AS (SELECT *, {', '.join(f'(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())::DOUBLE AS z{i}' for i, c in enumerate(LINES))} FROM lineitem)"


@query(f"""{Z_SQL}, c AS (SELECT l_orderkey, l_linenumber, z0, z1, z2, z3, CASE WHEN (SELECT corr(-0.84 * z0 - 0.54 * z1 - 0.48 * z2 - 0.64 * z3, z0) FROM z) < 0 THEN -1 ELSE 1 END AS g FROM z)
SELECT l_orderkey, l_linenumber, round(g * -(0.84 * z0 + 0.54 * z1 + 0.48 * z2 + 0.64 * z3), 5) AS score, round(g * -0.6 * (0.6 * z0 + 0.9 * z1), 5) AS component_1, round(g * -0.8 * (0.6 * z0 + 0.6 * z2 + 0.8 * z3), 5) AS component_2,
round(g * -0.84 * z0, 5) AS feature_l_quantity, round(g * -0.54 * z1, 5) AS feature_l_extendedprice, round(g * -0.48 * z2, 5) AS feature_l_discount, round(g * -0.64 * z3, 5) AS feature_l_tax, g < 0 AS flipped FROM c""")
def ml_theory_contributions(spark, sf_dir):
    d = multivariate.theory_contributions(statistics._lines(spark, sf_dir), LOADINGS, [-1.0, 0.0, 1.0, -1.0], LINES, "l_quantity")
    parts = ["score", "component_1", "component_2", *[f"feature_{c}" for c in LINES]]
    return d.select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in parts], "flipped")


@query(f"""{Z_SQL}, s AS (SELECT *, 0.36 * z0 + 0.54 * z1 AS sc, 0.6 * z0 + 0.6 * z2 + 0.8 * z3 AS c2 FROM z),
r AS (SELECT corr(sc, z0) AS d0, corr(sc, z2) AS d2, corr(sc, z1) AS w0, corr(sc, z0) AS w1, corr(sc, 0.84 * z0 + 0.54 * z1 + 0.48 * z2 + 0.64 * z3) AS v0, corr(sc, 0.54 * z0 + 0.81 * z1) AS v1, corr(sc, z0 - z2) AS ct,
  corr(sc, l_linenumber) AS o0, corr(sc, l_suppkey) AS o1, corr(c2, l_linenumber) AS b0, corr(c2, l_suppkey) AS b1, corr(sc, c2) AS ab FROM s)
SELECT validation, name, round(value, 5) AS value FROM (SELECT unnest([
  {{'validation': 'direction', 'name': 'l_quantity', 'value': d0}}, {{'validation': 'agrees', 'name': 'l_quantity', 'value': (sign(d0) = 1)::INT::DOUBLE}},
  {{'validation': 'direction', 'name': 'l_discount', 'value': d2}}, {{'validation': 'agrees', 'name': 'l_discount', 'value': (sign(d2) = -1)::INT::DOUBLE}},
  {{'validation': 'without', 'name': 'l_quantity', 'value': w0}}, {{'validation': 'without', 'name': 'l_extendedprice', 'value': w1}}, {{'validation': 'without', 'name': 'l_discount', 'value': 1.0::DOUBLE}}, {{'validation': 'without', 'name': 'l_tax', 'value': 1.0::DOUBLE}},
  {{'validation': 'variant', 'name': 'with_tax', 'value': v0}}, {{'validation': 'variant', 'name': 'price', 'value': v1}}, {{'validation': 'contrast', 'name': 'all', 'value': ct}},
  {{'validation': 'outside', 'name': 'l_linenumber', 'value': o0}}, {{'validation': 'gain', 'name': 'l_linenumber', 'value': (o0 - b0 * ab) ** 2 / (1 - ab ** 2)}},
  {{'validation': 'outside', 'name': 'l_suppkey', 'value': o1}}, {{'validation': 'gain', 'name': 'l_suppkey', 'value': (o1 - b1 * ab) ** 2 / (1 - ab ** 2)}}], recursive := true) FROM r)""")
def ml_score_validation(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in (*LINES, "l_linenumber", "l_suppkey")])
    v = multivariate.validate_scores(d, LINES, LOADINGS, [1.0, 0.0, -1.0, 0.0], {"with_tax": [1, 0, -1, 1], "price": [0, 1, 0, 0]}, ["l_linenumber", "l_suppkey"], 2)
    return v.withColumn("value", F.round("value", 5))


_WITH = [("l_quantity", "size"), ("l_extendedprice", "size"), ("l_discount", "rate"), ("l_tax", "none")]


@query(f"""
x AS (SELECT *, (l_extendedprice * (1 - l_discount))::DOUBLE AS revenue, (l_quantity * l_tax)::DOUBLE AS duty FROM lineitem),
ld AS ({' UNION ALL '.join(f"SELECT '{v}' AS component, '{b}' AS block, abs(round(corr({c}, {v}), 6)) AS a FROM x" for v in ('revenue', 'duty') for c, b in _WITH)})
SELECT component, block, round(sum(a) / (SELECT sum(a) FROM ld y WHERE y.component = ld.component), 6) AS share FROM ld GROUP BY component, block""")
def agg_block_shares(spark, sf_dir):
    """Loadings are the columns' correlations with two composite measures; l_tax is of no block."""
    d = statistics._lines(spark, sf_dir).select(*LINES, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), (F.col("l_quantity") * F.col("l_tax")).alias("duty"))
    loadings = S.correlations(d, LINES, ["revenue", "duty"]).select(F.col("b").alias("component"), F.col("a").alias("feature"), F.col("r").alias("loading"))
    return multivariate.block_shares(loadings, spark.createDataFrame(_WITH[:3], "feature string, block string"))
