"""Audits of a feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators import order
from callscope.operators.groups import correlation

#: Rules every feature row keeps: name -> the condition of a violation.
RULES: dict[str, str] = {
    "fto_without_turn_start": "fto IS NOT NULL AND turn_initial = 0",
    "latch_outside_window": "latching = 1 AND (fto < 0 OR fto > 0.2)",
    "pause_total_below_max": "pause_total < pause_max",
    "pause_count_and_max_disagree": "(pause_count >= 1) <> (pause_max >= 0.25)",
    "pause_rate_above_one": "pause_rate > 1",
}


def audit(df: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(rule, n_violations), a row a rule; one pass."""
    one = df.agg(*[F.count_if(F.coalesce(F.expr(r), F.lit(False))).alias(k) for k, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_violations")) for k in rules])).alias("x")).select("x.*")


def null_structure(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Nulls of each column, by the given columns."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def reconcile(df: DataFrame, recomputed: dict[str, Column]) -> DataFrame:
    """(feature, n_mismatches): stored columns against columns recomputed from the text."""
    one = df.agg(*[F.count_if(~F.col(k).eqNullSafe(c)).alias(k) for k, c in recomputed.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("n_mismatches")) for k in recomputed])).alias("x")).select("x.*")


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens <= 2, "1-2").when(tokens <= 5, "3-5").when(tokens <= 10, "6-10").otherwise("11+")


def missing_by(df: DataFrame, value: str, bucket: Column, name: str) -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(value).isNull().cast("double")), 6).alias("null_share"))


def drift(before: DataFrame, after: DataFrame, managed: list[str]) -> DataFrame:
    """One row: row counts before and after a merge and the nulls in the managed columns, to warn on."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in managed])
    return b.crossJoin(F.broadcast(a))


def defined_rates(df: DataFrame, flag: str, other: str, by: list[str], min_n: int = 20) -> DataFrame:
    """One row over groups of at least `min_n` rows: quantiles of the share of rows with the flag, and correlations.

    n_units, q05, median, q95 of that share; r_defined_other, r_defined_share, r_share_other with the mean of `other` and the mean
    flag where it is defined. Groups with a null on either side of a pair don't count there; null where nothing is left.
    """
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).isNotNull().cast("double")).alias("defined"), F.avg(flag).alias("share"), F.avg(other).alias("other")).where(F.col("n") >= min_n)
    r = lambda a, b: F.round(correlation(a, b), 6)
    g = order.settled(g)
    found = order.percentiles(g, ["defined"], [0.05, 0.5, 0.95])[()]
    q = lambda p: F.round(F.lit(found["defined", p]).cast("double"), 6)
    return g.agg(F.count(F.lit(1)).alias("n_units"), q(0.05).alias("q05"), q(0.5).alias("median"), q(0.95).alias("q95"), r("defined", "other").alias("r_defined_other"), r("defined", "share").alias("r_defined_share"), r("share", "other").alias("r_share_other"))
