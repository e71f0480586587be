"""Taxometric curves over indicator tables, and how they fit comparison curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import order


def long_table(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """(unit, name, value)."""
    return df.select(F.col(unit).alias("unit"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("unit", "x.*")


def mambac(df: DataFrame, unit: str, columns: list[str], buffer: int = 25) -> DataFrame:
    """(cut, value): mean above less mean below each cut, averaged over all ordered pairs of indicators.

    The rows of each input indicator are put in its order once, with the totals of all others running along.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    names = {c: f"y{i}" for i, c in enumerate(columns)}
    rows = df.select(F.col(unit).alias("unit"), *[F.col(c).cast("double").alias(y) for c, y in names.items()], F.lit(1).cast("long").alias("cut"), each).select("*", "x.*").drop("x")
    run = order.running(rows, ["value", "unit"], ["cut", *names.values()], ["input"])
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"{y}_all") for c, y in names.items()])
    cut, n = F.col("cut_run"), F.col("n")
    cuts = run.crossJoin(F.broadcast(totals)).where((cut >= buffer) & (cut <= n - buffer))  # one row
    value = F.array(*[F.when(F.col("input") != c, (F.col(f"{y}_all") - F.col(f"{y}_run")) / (n - cut) - F.col(f"{y}_run") / cut) for c, y in names.items()])
    return cuts.select(cut.cast("int").alias("cut"), F.explode(value).alias("value")).groupBy("cut").agg(F.avg("value").alias("value"))


def maxeig(df: DataFrame, unit: str, columns: list[str], windows: int = 50, overlap: float = 0.9) -> DataFrame:
    """(window, value): the largest eigenvalue of the other indicators' covariance, its diagonal zeroed, in overlapping rank windows, averaged over inputs."""
    k = len(columns)
    if k < 3:
        raise ValueError("maxeig needs three indicators or more")
    rows = long_table(df, unit, columns)
    n = df.count()
    size = int(n / (1 + (windows - 1) * (1 - overlap)))
    if size < k:
        raise ValueError(f"windows of {size} rows for {k} indicators")
    step = (n - size) / (windows - 1) if windows > 1 else 0.0
    places = order.running(rows.withColumn("r", F.lit(1).cast("long")), ["value", "unit"], ["r"], ["name"])
    ranked = places.select("unit", F.col("name").alias("input"), (F.col("r_run") - 1).alias("r"))
    lows = np.array([round(t * step) for t in range(windows)])
    inside = F.filter(F.array(*[F.struct(F.lit(t).alias("window"), F.lit(int(lo)).alias("lo")) for t, lo in enumerate(lows)]), lambda x: (F.col("r") >= x["lo"]) & (F.col("r") < x["lo"] + size))
    met = ranked.select("unit", "input", F.explode(inside).alias("x")).select("unit", "input", "x.window").join(df.select(F.col(unit).alias("unit"), *columns), "unit")
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    sums = met.groupBy("input", "window").agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])

    def largest(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                c = np.zeros((k, k))
                for i, j in pairs:
                    c[i, j] = c[j, i] = r[f"c{i}_{j}"]
                rest = [i for i in range(k) if columns[i] != r["input"]]
                out.append((r["input"], int(r["window"]), float(np.linalg.eigvalsh(c[np.ix_(rest, rest)])[-1])))
            yield pd.DataFrame(out, columns=["input", "window", "value"])

    return sums.mapInPandas(largest, "input string, window int, value double").groupBy("window").agg(F.avg("value").alias("value"))


def lmode(df: DataFrame, columns: list[str], low: float = -4.0, high: float = 4.0, points: int = 161) -> DataFrame:
    """(x, density) of one-factor scores, standardised, on a fixed grid; bandwidth by Scott's rule."""
    from callscope.operators import modality, multivariate

    model = multivariate.factors(df, columns, 1)
    scored = multivariate.project(df.dropna(subset=columns), model, 1, "F")
    x, counts = modality.histogram(scored, "F1")
    h = float(counts.sum()) ** -0.2
    grid = np.linspace(low, high, points)
    density = np.array([(counts * np.exp(-0.5 * ((g - x) / h) ** 2)).sum() for g in grid]) / (counts.sum() * h * np.sqrt(2 * np.pi))
    return df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(grid, density)], "x double, density double")


def curve_fit_index(observed: DataFrame, dimensional: DataFrame, taxonic: DataFrame) -> DataFrame:
    """One row (index, verdict) from curves (at, value) and two stacks of comparison curves (at, value, replicate)."""
    mean = lambda d, n: d.groupBy("at").agg(F.avg("value").alias(n))
    j = observed.join(mean(dimensional, "d"), "at").join(mean(taxonic, "t"), "at")
    rms = lambda c: F.sqrt(F.avg((F.col("value") - F.col(c)) ** 2))
    s = j.agg(rms("d").alias("rd"), rms("t").alias("rt")).select(F.coalesce(F.try_divide("rd", F.col("rd") + F.col("rt")), F.lit(0.5)).alias("index"))
    return s.select(F.round("index", 6).alias("index"), F.when(F.col("index") < 0.45, "dimensional").when(F.col("index") > 0.55, "taxonic").otherwise("ambiguous").alias("verdict"))
