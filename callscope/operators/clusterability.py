"""Hopkins' statistic of a table, and its distribution over tables of the same size without clusters.

A null table has the same covariance (Gaussian), or the same correlation and the columns' own quantiles (Gaussian copula). Its rows are made
in slices by Spark tasks, twice over: for the box that the probes are drawn from, and for the probes' nearest rows. The driver holds the
moments, a grid of quantiles and one minimum for each probe of each replicate, whatever the number of rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import multivariate, order

GRID, SLICE = 257, 1 << 16


def _near(probes: np.ndarray, x: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(each probe's least distance to rows of x, how many rows equal it); equal rows are left out of the distance if `own`."""
    best, same = np.full(len(probes), np.inf), np.zeros(len(probes), np.int64)
    columns = [np.ascontiguousarray(c) for c in x.T]  # a row at a time would cost several times as much
    for i, p in enumerate(probes):
        d = np.zeros(len(x))
        for c, v in zip(columns, p):
            gap = c - v
            gap *= gap
            d += gap
        if own:
            equal = np.flatnonzero(~(d > 0))
            equal = equal[(x[equal] == p).all(1)]
            same[i] = len(equal)
            d[equal] = np.inf
        if len(x) > same[i]:
            best[i] = np.sqrt(d.min())
    return best, same


def statistic(free: np.ndarray, own: np.ndarray, same: np.ndarray) -> float | None:
    """Probes' distances over theirs and the sampled rows'; a row that occurs again has a neighbour at 0."""
    own = np.where(same > 1, 0.0, own)
    total = free.sum() + own.sum()
    return float(free.sum() / total) if np.isfinite(total) and total > 0 else None


def hopkins(df: DataFrame, columns: list[str], probes: int = 50, seed: int = 0) -> float | None:
    """Sum of uniform probes' nearest distances over that plus sampled rows' nearest other distances; 0.5 for uniform rows.

    Probes are uniform in the box of the table's principal axes. Only the sampled row itself is no neighbour: a copy of it is one, at
    distance 0. Rows with a null or a not-a-number are left out; null with fewer than two rows, or all alike.
    """
    rows = _whole(df, columns)
    n, mean, cov = multivariate.moments(rows, columns)
    if n < 2:
        return None
    axes = np.linalg.eigh(cov)[1]
    at = [sum(((F.col(c) - F.lit(float(m))) * F.lit(float(a)) for c, m, a in zip(columns, mean, axes[:, j])), F.lit(0.0)) for j in range(len(columns))]
    box = rows.agg(*[x for j, z in enumerate(at) for x in (F.min(z).alias(f"lo{j}"), F.max(z).alias(f"hi{j}"))]).first()
    r = np.random.default_rng(seed)
    free = np.stack([r.uniform(box[f"lo{j}"], box[f"hi{j}"], probes) for j in range(len(columns))], 1) @ axes.T + mean
    own = np.array([list(x) for x in rows.orderBy(F.xxhash64(F.lit(seed), *columns)).limit(probes).collect()])

    def nearest(batches):
        best, same = [np.full(len(p), np.inf) for p in (free, own)], np.zeros(len(own), np.int64)
        for pdf in batches:
            x = pdf.to_numpy(float)
            best[0] = np.minimum(best[0], _near(free, x, False)[0])
            d, again = _near(own, x, True)
            best[1], same = np.minimum(best[1], d), same + again
        yield pd.DataFrame({"kind": np.repeat([0, 1], [len(free), len(own)]), "probe": np.concatenate([np.arange(len(free)), np.arange(len(own))]), "d": np.concatenate(best), "same": np.concatenate([np.zeros(len(free), np.int64), same])})

    found = rows.mapInPandas(nearest, "kind int, probe int, d double, same long").groupBy("kind", "probe").agg(F.min("d").alias("d"), F.sum("same").alias("same")).collect()
    d, same = {(x["kind"], x["probe"]): x["d"] for x in found}, {x["probe"]: x["same"] for x in found if x["kind"]}
    return statistic(np.array([d[0, i] for i in range(len(free))]), np.array([d[1, i] for i in range(len(own))]), np.array([same[i] for i in range(len(own))]))


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]).dropna()


def _factor(matrix: np.ndarray) -> np.ndarray:
    """A with A @ A.T equal to a covariance, which may be singular."""
    values, vectors = np.linalg.eigh(matrix)
    return vectors * np.sqrt(np.clip(values, 0, None))


def gaussian(n: int, cov: np.ndarray):
    """Makes rows of the same covariance from standard normal ones."""
    factor = _factor(cov * n / max(n - 1, 1))
    return lambda z: z @ factor.T


def copula(df: DataFrame, columns: list[str], cov: np.ndarray):
    """Makes rows with the same correlation between normal scores and each column's own quantiles, read off a grid of exact ones."""
    sd = np.sqrt(np.diag(cov))
    factor = _factor(np.where(np.outer(sd, sd) > 0, cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1), np.eye(len(sd))))
    ps = [i / (GRID - 1) for i in range(GRID)]
    q = order.percentiles(df, columns, ps)[()]
    values = np.array([[q[c, p] for p in ps] for c in columns])
    score = np.array([NormalDist().inv_cdf(min(max(p, 0.25 / GRID), 1 - 0.25 / GRID)) for p in ps])
    return lambda z: np.stack([np.interp(w, score, v) for w, v in zip((z @ factor.T).T, values)], 1)


def null_statistics(spark: SparkSession, make, n: int, axes: np.ndarray, probes: int, replicates: int, seed: int = 0) -> np.ndarray:
    """The statistic of `replicates` tables of n rows each, made by `make` from standard normal rows."""
    p, m = len(axes), min(probes, n)
    slices = 1 + max(0, -(-(n - m) // SLICE))  # the first has the sampled rows

    def rows_of(r: int, s: int) -> np.ndarray:
        size = m if s == 0 else min(SLICE, n - m - (s - 1) * SLICE)
        return make(np.random.default_rng([seed, r, s]).standard_normal((size, p)))

    jobs = spark.range(0, replicates * slices, 1, max(1, min(replicates * slices, 4 * spark.sparkContext.defaultParallelism + replicates * slices // 64)))

    def box(batches):
        for pdf in batches:
            out = [(r, *z.min(0).tolist(), *z.max(0).tolist()) for r, s in (divmod(int(i), slices) for i in pdf["id"]) for z in [rows_of(r, s) @ axes]]
            yield pd.DataFrame(out, columns=["r", *(f"lo{j}" for j in range(p)), *(f"hi{j}" for j in range(p))])

    ends = ", ".join(f"{e}{j} double" for e in ("lo", "hi") for j in range(p))
    boxes = {x["r"]: x for x in jobs.mapInPandas(box, f"r int, {ends}").groupBy("r").agg(*[F.min(f"lo{j}").alias(f"lo{j}") for j in range(p)], *[F.max(f"hi{j}").alias(f"hi{j}") for j in range(p)]).collect()}
    limits = {r: (np.array([x[f"lo{j}"] for j in range(p)]), np.array([x[f"hi{j}"] for j in range(p)])) for r, x in boxes.items()}

    def nearest(batches):
        for pdf in batches:
            out = []
            for r, s in (divmod(int(i), slices) for i in pdf["id"]):
                x, own = rows_of(r, s), rows_of(r, 0)
                free = np.random.default_rng([seed, r, -1 & 0xFFFFFFFF]).uniform(*limits[r], (probes, p)) @ axes.T
                d, same = _near(own, x, True)
                out.append(pd.DataFrame({"r": r, "kind": np.repeat([0, 1], [probes, m]), "probe": np.concatenate([np.arange(probes), np.arange(m)]), "d": np.concatenate([_near(free, x, False)[0], d]), "same": np.concatenate([np.zeros(probes, np.int64), same])}))
            yield pd.concat(out)

    found = jobs.mapInPandas(nearest, "r int, kind int, probe int, d double, same long").groupBy("r", "kind", "probe").agg(F.min("d").alias("d"), F.sum("same").alias("same"))
    each = found.groupBy("r").agg(F.sum(F.when(F.col("kind") == 0, F.col("d"))).alias("free"), F.sum(F.when((F.col("kind") == 1) & (F.col("same") <= 1), F.col("d")).when(F.col("kind") == 1, 0.0)).alias("own")).collect()
    return np.array([x["free"] / (x["free"] + x["own"]) for x in sorted(each, key=lambda x: x["r"]) if x["free"] + x["own"] > 0])


def hopkins_test(df: DataFrame, columns: list[str], null: str = "gaussian", probes: int = 50, replicates: int = 500, seed: int = 0) -> tuple[float | None, float | None, float | None]:
    """(statistic, share of null tables with at least as large a one, their mean); nulls where the statistic is null."""
    if null not in ("gaussian", "copula"):
        raise ValueError("null must be gaussian or copula")
    rows = order.settled(_whole(df, columns))
    seen = hopkins(rows, columns, probes, seed)
    if seen is None:
        return None, None, None
    n, _, cov = multivariate.moments(rows, columns)
    make = gaussian(n, cov) if null == "gaussian" else copula(rows, columns, cov)
    values = null_statistics(df.sparkSession, make, n, np.linalg.eigh(cov)[1], probes, replicates, seed)
    return seen, float((values >= seen).mean()), float(values.mean())
