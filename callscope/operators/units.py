"""Unit tables: utterance features rolled up to sides or callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators import order

WINDOW = (-2.0, 2.0)
POOLED_FLOOR = 30


def in_window(fto: Column, low: float = WINDOW[0], high: float = WINDOW[1]) -> Column:
    """Offsets outside the response window are unmeasured."""
    return F.when(fto.between(low, high), fto)


def finite(x: Column) -> Column:
    """Infinite and not-a-number values are unmeasured."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns}).dropna(subset=columns)


def winsor_bounds(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """One row with <column>_lo, _hi, _min of each column; exact quantiles unless an accuracy for approximate ones is given."""
    if accuracy is not None:
        return df.agg(*[x for c in columns for x in (F.percentile_approx(c, low, accuracy).alias(f"{c}_lo"), F.percentile_approx(c, high, accuracy).alias(f"{c}_hi"), F.min(c).alias(f"{c}_min"))])
    q = order.percentiles(df, columns, [low, high, 0])[()]
    names = [(c, p, f"{c}_{end}") for c in columns for p, end in ((low, "lo"), (high, "hi"), (0, "min"))]
    return df.sparkSession.createDataFrame([tuple(q[c, p] for c, p, _ in names)], ", ".join(f"`{name}` double" for *_, name in names))


def winsor_log(df: DataFrame, columns: list[str], skip: tuple[str, ...] = ("fto",), **bounds) -> DataFrame:
    """Each column cut to its 1 % and 99 % quantiles and log1p taken; left alone if skipped or if it has a negative value."""
    b = winsor_bounds(df, columns, **bounds)  # one row
    out = df.crossJoin(F.broadcast(b))
    new = {c: F.when(F.col(f"{c}_min") < 0, F.col(c)).otherwise(F.log1p(F.least(F.greatest(F.col(c), F.col(f"{c}_lo")), F.col(f"{c}_hi")))) for c in columns if c not in skip}
    return out.withColumns(new).select(*df.columns)


def exact_mean(value: Column, places: int = 6) -> Column:
    """An aggregate: the mean of values of so many decimal places, rounded half up to as many.

    Values are added up as whole numbers, so that neither the order of the rows nor binary fractions decide a tie.
    """
    whole = F.round(value * 10**places).cast("long")
    n, twice = F.count(value), 2 * F.sum(whole) + F.count(value)
    quotient = F.try_divide((twice - F.pmod(twice, F.nullif(2 * n, F.lit(0)))).cast("decimal(38,0)"), (2 * n).cast("decimal(38,0)"))
    return quotient.cast("double") / 10**places


def unit_table(df: DataFrame, unit: str | list[str], features: list[str], backchannel: str = "backchannel", min_utterances: int = 20, demographics: list[str] = (), places: int | None = None) -> DataFrame:
    """Means of features over substantive rows, n_sub, n_fto, bc_rate over all rows, first known demographics; small units go.

    One grouping with conditional aggregates, combined before its only shuffle. With `places` values count to so many decimal places, and
    means are exact to as many.
    """
    mean = F.avg if places is None else (lambda x: exact_mean(x, places))
    units = [unit] if isinstance(unit, str) else list(unit)
    substantive = F.col(backchannel) == 0
    fto = in_window(F.col("fto"))
    value = {c: fto if c == "fto" else F.col(c) for c in features}
    return df.groupBy(*units).agg(
        *[mean(F.when(substantive, value[c])).alias(c) for c in features],
        F.count_if(substantive).alias("n_sub"),
        F.count(F.when(substantive, fto)).alias("n_fto"),
        mean(F.col(backchannel).cast("double")).alias("bc_rate"),
        *[F.min(c).alias(c) for c in demographics],
    ).where(F.col("n_sub") >= min_utterances)


def utterance_level(df: DataFrame, features: list[str], backchannel: str = "backchannel") -> tuple[DataFrame, DataFrame]:
    """(substantive complete rows, one row with the numbers kept and dropped)."""
    rows = df.where(F.col(backchannel) == 0)
    whole = F.forall(F.array(*[finite(F.col(c).cast("double")).isNotNull() for c in features]), lambda x: x)
    return complete(rows, features), rows.agg(F.count_if(whole).alias("n_kept"), F.count_if(~whole).alias("n_dropped"))


def panel(df: DataFrame, unit: str | list[str], floor: int = POOLED_FLOOR) -> DataFrame:
    """Ratios of pooled sums: focus_ratio (with a floor on hits), rising_share, laughs_per100, obstructive_share, coverage."""
    units = [unit] if isinstance(unit, str) else list(unit)
    sub = F.col("backchannel") == 0
    hits = F.sum(F.when(sub, F.col("personal") + F.col("impersonal")))
    g = df.groupBy(*units).agg(
        hits.alias("hits"),
        F.sum(F.when(sub, F.col("personal"))).alias("personal"),
        F.avg(F.when(sub, F.col("rising"))).alias("rising_share"),
        F.avg(F.when(sub, F.col("rising").isNotNull().cast("double"))).alias("rising_defined"),
        F.sum(F.when(sub, F.coalesce("rising", F.lit(0)))).alias("rises"),
        F.count_if(sub).alias("n_sub"),
        F.sum("laughter").alias("laughs"),
        F.count(F.lit(1)).alias("n"),
        F.sum("obstructive").alias("obstructive"),
        F.sum(F.col("obstructive") + F.col("cooperative")).alias("overlaps"),
    )
    return g.select(*units, "hits", F.round(F.when(F.col("hits") >= floor, F.col("personal") / F.col("hits")), 6).alias("focus_ratio"), F.round("rising_share", 6).alias("rising_share"), F.round("rising_defined", 6).alias("rising_defined"), F.round(F.try_divide("rises", "n_sub"), 6).alias("rising_lower_bound"), F.round(100 * F.col("laughs") / F.col("n"), 6).alias("laughs_per100"), F.round(F.try_divide("obstructive", "overlaps"), 6).alias("obstructive_share"))


def coverage(panel_table: DataFrame, floors: tuple[int, ...] = (10, 30, 100)) -> DataFrame:
    """Share of units with at least so many pooled hits."""
    return panel_table.agg(F.count(F.lit(1)).alias("n_units"), *[F.round(F.avg((F.coalesce("hits", F.lit(0)) >= k).cast("double")), 6).alias(f"share_{k}") for k in floors])


def personal_hits(words: DataFrame, lexicon: DataFrame, key: list[str], min_hits: int = 3) -> DataFrame:
    """(key, personal, impersonal, analyzed, score) from words and a lexicon (term, bucket); the score needs `min_hits` hits."""
    met = words.join(lexicon, words["token"] == lexicon["term"], "left")
    g = met.groupBy(*key).agg(F.count_if(F.col("bucket") == "personal").alias("personal"), F.count_if(F.col("bucket") == "impersonal").alias("impersonal"), F.count(F.lit(1)).alias("analyzed"))
    total = F.col("personal") + F.col("impersonal")
    return g.withColumn("score", F.round(F.when(total >= min_hits, F.col("personal") / total), 6))


def tagged_rate(tagged: DataFrame, utterances: DataFrame, key: list[str], tag: str = "PRON") -> DataFrame:
    """(key, per_second): tokens with the given part of speech per second of utterance."""
    n = tagged.groupBy(*key).agg(F.count_if(F.col("pos") == tag).alias("n"))
    seconds = F.col("end") - F.col("start")
    return utterances.join(n, key, "left").select(*key, F.round(F.when(seconds > 0, F.coalesce("n", F.lit(0)) / seconds), 6).alias("per_second"))
