"""Group comparisons, correlations, ranks and multiple-testing corrections over unit tables.

Moments are Spark aggregates; the p-values of a handful of result rows come from a vectorised incomplete beta function.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from callscope.operators import order


def correlation(a: str, b: str) -> Column:
    """Pearson's r over the rows that have both, as an aggregate; null where a column is constant, on which Spark's own stops."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def group_table(df: DataFrame, by: str, value: str, min_n: int = 5) -> DataFrame:
    """(by, n, mean, sd) of each group with at least `min_n` values; sample spread."""
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where(F.col("n") >= min_n)


def welch_t(df: DataFrame, group: Column, value: str) -> DataFrame:
    """One row: t, degrees of freedom and Cohen's d between rows where `group` holds and the others; p beside them."""
    v = F.col(value)
    m = df.where(v.isNotNull() & group.isNotNull()).agg(*[x for i, g in ((1, group), (2, ~group)) for x in (F.count(F.when(g, v)).alias(f"n{i}"), F.avg(F.when(g, v)).alias(f"m{i}"), F.var_samp(F.when(g, v)).alias(f"v{i}"))])
    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    out = m.select("n1", "n2", F.round((F.col("m1") - F.col("m2")) / F.sqrt(se1 + se2), 6).alias("t"), F.round((se1 + se2) ** 2 / (se1**2 / (F.col("n1") - 1) + se2**2 / (F.col("n2") - 1)), 6).alias("dof"), F.round((F.col("m1") - F.col("m2")) / F.sqrt((F.col("v1") + F.col("v2")) / 2), 6).alias("cohen_d"))
    return out.withColumn("p", F.round(t_p_value(F.col("t"), F.col("dof")), 9))


def anova(df: DataFrame, by: str, value: str, min_n: int = 5) -> DataFrame:
    """One row: Fisher's and Welch's F with their degrees of freedom and p-values. Rows without a group are left out.

    Null where undefined: both with fewer than two groups or without spread, Welch's with a group that has none.
    """
    g = group_table(df.where(F.col(by).isNotNull()), by, value, min_n)
    var = F.col("sd") ** 2
    w = F.try_divide(F.col("n"), var)
    s = g.agg(F.count(F.lit(1)).alias("k"), F.count(w).alias("spread"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("nm"), F.sum(F.col("n") * F.col("mean") ** 2).alias("nmm"), F.sum((F.col("n") - 1) * var).alias("within"), F.sum(w).alias("w"), F.sum(w * F.col("mean")).alias("wm"), F.sum(w * F.col("mean") ** 2).alias("wmm"))
    lam = g.crossJoin(F.broadcast(s.select(F.col("w").alias("all_w")))).agg(F.sum((1 - w / F.col("all_w")) ** 2 / (F.col("n") - 1)).alias("lam"))
    s = s.crossJoin(F.broadcast(lam))
    k = F.col("k")
    fisher = F.try_divide(F.try_divide(F.col("nmm") - F.col("nm") ** 2 / F.col("n"), k - 1), F.try_divide(F.col("within"), F.col("n") - k))
    whole = lambda c: F.when((F.col("spread") == k) & (k > 1), c)
    welch = whole(F.try_divide(F.try_divide(F.col("wmm") - F.col("wm") ** 2 / F.col("w"), k - 1), 1 + F.try_divide(2 * (k - 2), k**2 - 1) * F.col("lam")))
    out = s.select(k.cast("long").alias("k"), F.round(fisher, 6).alias("f"), (F.col("n") - k).cast("double").alias("dof"), F.round(welch, 6).alias("welch_f"), F.round(whole(F.try_divide(k**2 - 1, 3 * F.col("lam"))), 6).alias("welch_dof"))
    one = (k - 1).cast("double")
    return out.withColumn("p", F.round(f_p_value(F.col("f"), one, F.col("dof")), 9)).withColumn("welch_p", F.round(f_p_value(F.col("welch_f"), one, F.col("welch_dof")), 9))


def anova_grid(df: DataFrame, by: str, value: str, unknown: list, min_n: int = 5) -> DataFrame:
    """(unknown, test, k, f, dof, p): Fisher's and Welch's analysis of variance with the unknown groups in and out."""
    known = df.where(~F.col(by).isin(*unknown))
    cells = anova(df, by, value, min_n).select(F.lit("in").alias("unknown"), "*").unionByName(anova(known, by, value, min_n).select(F.lit("out").alias("unknown"), "*"))
    both = F.array(F.struct(F.lit("fisher").alias("test"), F.col("k"), F.col("f"), F.col("dof"), F.col("p")), F.struct(F.lit("welch").alias("test"), F.col("k"), F.col("welch_f").alias("f"), F.col("welch_dof").alias("dof"), F.col("welch_p").alias("p")))
    return cells.select("unknown", F.explode(both).alias("x")).select("unknown", "x.*")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided."""
    return pd.Series([None if pd.isna(x) or pd.isna(n) else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(b) else incomplete_beta(b / 2, a / 2, b / (b + a * x)) for x, a, b in zip(f, one, two)], dtype="float64")


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, skewness, kurtosis): population skewness and excess kurtosis of each column."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return each.groupBy("name").agg(F.count("v").alias("n"), F.round(F.skewness("v"), 6).alias("skewness"), F.round(F.kurtosis("v"), 6).alias("kurtosis"))


def correlations(df: DataFrame, columns: list[str], others: list[str] | None = None) -> DataFrame:
    """(a, b, r) for all pairs of columns, or of columns with others; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in (others if others is not None else columns[i + 1 :])]
    row = df.agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation with mid-ranks, in each group or over all rows."""
    by = list(by)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    for c, name in ((a, "ra"), (b, "rb")):
        rows = order.with_rank(rows, c, by).withColumn(name, order.mid_rank()).drop("rank_", "times_", "of_")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(correlation("ra", "rb"), 6).alias("rho")).select(*by, "n", "rho")


def auc(df: DataFrame, positive: Column, score: str, *by: str) -> DataFrame:
    """(n1, n0, auc) of the Mann-Whitney statistic. Rows are first counted by distinct score, so that the ordered pass is over those."""
    c = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    u = order.running(c, [score], ["q"], list(by)).withColumn("u", F.col("p") * (F.col("q_run") - F.col("q") / 2.0))
    return u.groupBy(*by).agg(F.sum("p").alias("n1"), F.sum("q").alias("n0"), F.round(F.try_divide(F.sum("u"), F.sum("p").cast("double") * F.sum("q")), 6).alias("auc"))


def adjusted_p(df: DataFrame, p: str, *by: str) -> DataFrame:
    """Adds p_adjusted, by Benjamini and Hochberg, within each family of tests."""
    values = order.ranked_values(df, p, list(by)).withColumn("q", F.col(p) * F.col("of") / (F.col("below") + F.col("times")))
    least = order.running(values.select(*by, p, "q"), [F.desc(p)], ["q"], list(by), least=True)
    adjusted = least.select(*by, p, F.round(F.least("q_run", F.lit(1.0)), 9).alias("p_adjusted"))
    return order.matched(df.where(F.col(p).isNotNull()), adjusted, [*by, p])


def percentile_rank(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Rows with a value, with percentile: rank / (n + 1)."""
    return order.with_rank(df, value, list(by)).withColumn("percentile", F.round(F.col("rank_") / (F.col("of_") + 1), 9)).drop("rank_", "times_", "of_")


def top_groups(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group; ties by value."""
    n = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).where(F.col("place") <= k)


def largest(df: DataFrame, value: str, k: int, *keep: str) -> DataFrame:
    """The k rows with the largest value; ties by the kept columns."""
    return df.where(F.col(value).isNotNull()).select(value, *keep).orderBy(F.desc(value), *keep).limit(k)


def representatives(df: DataFrame, score: str, unit: str, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """The unit at each score percentile, by nearest rank."""
    rows = df.where(F.col(score).isNotNull()).select(unit, score, F.lit(1).cast("long").alias("r"))
    places = order.running(rows, [score, unit], ["r"])
    n = rows.count()
    want = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(max(1, math.ceil(a * n))).alias("place")) for a in at])
    return places.select(unit, score, F.explode(F.filter(want, lambda x: x["place"] == F.col("r_run"))).alias("x")).select("x.at", unit, score)
