"""Components, factors, mixtures and clusters over numeric columns. The rows stay in Spark; k x k matrices reach numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import order
from callscope.operators.groups import correlation


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance) of complete rows: one aggregation of k (k + 1) / 2 merged cross moments."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.dropna(subset=columns).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else np.nan
    return row["n"], np.array([row[f"m{i}"] for i in range(k)], float), cov


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by population spread; 0 for a constant one."""
    m = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    out = df.crossJoin(F.broadcast(m))  # one row
    return out.withColumns({c: F.when(F.col(f"{c}_s") == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")) for c in columns}).select(*df.columns)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds scaled: the columns less their median, by interquartile range (0 where that is 0)."""
    q = order.percentiles(df, columns, [0.25, 0.5, 0.75])[()]
    scaled = [F.lit(0.0) if not (wide := (q[c, 0.75] or 0.0) - (q[c, 0.25] or 0.0)) else (F.col(c) - F.lit(q[c, 0.5])) / F.lit(wide) for c in columns]
    return df.withColumn("scaled", F.array(*scaled))


def l2_normalise(df: DataFrame, array_col: str, out: str = "unit") -> DataFrame:
    v = df.withColumn("v_", array_to_vector(F.col(array_col).cast("array<double>")))
    return Normalizer(inputCol="v_", outputCol="n_", p=2.0).transform(v).withColumn(out, vector_to_array("n_")).drop("v_", "n_")


def pca(df: DataFrame, columns: list[str]) -> dict:
    """Full-rank components of standardised columns: eigenvalues (n - 1), shares, loadings (k x k), scoring weights, means, spreads.

    Each component's largest loading is positive.
    """
    n, mean, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values)
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(columns))] < 0, -1, 1)
    values = values * n / max(n - 1, 1)
    return {"n": n, "mean": mean, "sd": sd, "values": values, "shares": values / values.sum(), "weights": vectors, "loadings": vectors * np.sqrt(values), "columns": columns}


def project(df: DataFrame, model: dict, k: int, prefix: str = "PC") -> DataFrame:
    """Adds PC1..PCk: weighted sums of standardised columns, as plain expressions."""
    z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(model["columns"], model["mean"], model["sd"])]
    return df.withColumns({f"{prefix}{j + 1}": sum((z[i] * float(model["weights"][i, j]) for i in range(1, len(z))), z[0] * float(model["weights"][0, j])) for j in range(k)})


def loadings_table(spark: SparkSession, model: dict) -> DataFrame:
    """(component, feature, loading, place): by size within each component."""
    rows = []
    for j in range(model["loadings"].shape[1]):
        order = sorted(range(len(model["columns"])), key=lambda i: (-abs(model["loadings"][i, j]), model["columns"][i]))
        rows += [(j + 1, model["columns"][i], float(model["loadings"][i, j]), place + 1) for place, i in enumerate(order)]
    return spark.createDataFrame(rows, "component int, feature string, loading double, place int")


def parallel_analysis(spark: SparkSession, values: np.ndarray, n: int, replicates: int = 500, quantile: float = 0.95, seed: int = 0) -> tuple[int, np.ndarray]:
    """(K, thresholds): leading eigenvalues above the quantile of those of normal noise of the same size; replicates are spread over tasks.

    The noise's cross products are drawn as a Wishart matrix of n - 1 degrees (Bartlett's triangle), so a draw costs the same for any n > p.
    """
    p = len(values)
    below = np.tril_indices(p, -1)

    def draw(batches):
        for pdf in batches:
            out = []
            for r in pdf["id"]:
                g = np.random.default_rng([seed, int(r)])
                if n > p:
                    half = np.diag(np.sqrt(g.chisquare(n - 1 - np.arange(p))))
                    half[below] = g.normal(size=len(below[0]))
                    cross = half @ half.T
                    corr = cross / np.sqrt(np.outer(np.diag(cross), np.diag(cross)))
                else:
                    corr = np.corrcoef(g.normal(size=(n, p)), rowvar=False)
                out.append(np.sort(np.linalg.eigvalsh(corr))[::-1] * n / (n - 1))
            yield pd.DataFrame([(j, v) for e in out for j, v in enumerate(e)], columns=["place", "value"])

    noise = spark.range(0, replicates, 1, max(1, min(replicates, spark.sparkContext.defaultParallelism * 2))).mapInPandas(draw, "place long, value double")
    cut = {r["place"]: r["t"] for r in noise.groupBy("place").agg(F.percentile("value", F.lit(quantile)).alias("t")).collect()}
    thresholds = np.array([cut[i] for i in range(p)])
    above = values > thresholds
    return int(p if above.all() else np.argmin(above)), thresholds


def factors(df: DataFrame, columns: list[str], k: int, steps: int = 2000) -> dict:
    """Maximum-likelihood factors of the correlation matrix by EM, varimax rotation, regression scoring weights.

    Each factor's largest loading is positive. Only the moments come from the rows.
    """
    n, mean, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, -k:][:, ::-1] * np.sqrt(np.clip(values[-k:][::-1], 1e-6, None)) * 0.9
    psi = np.clip(1 - (load**2).sum(1), 0.05, None)
    for _ in range(steps):
        beta = np.linalg.solve(load @ load.T + np.diag(psi), load).T
        ezz = np.eye(k) - beta @ load + beta @ r @ beta.T
        new = r @ beta.T @ np.linalg.inv(ezz)
        new_psi = np.clip(np.diag(r - new @ beta @ r), 1e-4, None)
        moved = max(np.abs(new - load).max(), np.abs(new_psi - psi).max())
        load, psi = new, new_psi
        if moved < 1e-8:
            break
    load = load @ varimax(load)
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(k)] < 0, -1, 1)
    weights = np.linalg.solve(load @ load.T + np.diag(psi), load)
    return {"n": n, "mean": mean, "sd": sd, "loadings": load, "noise": psi, "weights": weights, "shares": (load**2).sum(0) / len(columns), "columns": columns}


def varimax(load: np.ndarray, steps: int = 200) -> np.ndarray:
    """The rotation that makes squared loadings vary most."""
    p, k = load.shape
    turn, last = np.eye(k), 0.0
    for _ in range(steps):
        x = load @ turn
        u, s, v = np.linalg.svd(load.T @ (x**3 - x * (x**2).sum(0) / p))
        turn = u @ v
        if s.sum() <= last * (1 + 1e-10):
            break
        last = s.sum()
    return turn


def identify_factor(model: dict, signature: list[str], bar: float = 0.4) -> tuple[int, bool]:
    """(factor, whether it meets the bar): the factor whose least loading on the signature columns is largest."""
    rows = [model["columns"].index(c) for c in signature]
    least = model["loadings"][rows].min(0)
    return int(least.argmax()) + 1, bool(least.max() >= bar)


def indicators(df: DataFrame, model: dict, component: int, k: int, max_r: float = 0.85) -> tuple[list[tuple[str, int]], float]:
    """The k columns that load most on a component, none correlated above max_r with a stronger one, with their signs; and their mean correlation."""
    _, _, cov = moments(df, model["columns"])
    sd = np.sqrt(np.diag(cov))
    r, load = cov / np.outer(sd, sd), model["loadings"][:, component - 1]
    chosen: list[int] = []
    for i in np.argsort(-np.abs(load)):
        if len(chosen) < k and all(abs(r[i, j]) <= max_r for j in chosen):
            chosen.append(int(i))
    signs = [1 if load[i] >= 0 else -1 for i in chosen]
    pair = [r[i, j] * a * b for x, (i, a) in enumerate(zip(chosen, signs)) for j, b in list(zip(chosen, signs))[x + 1 :]]
    return [(model["columns"][i], s) for i, s in zip(chosen, signs)], float(np.mean(pair)) if pair else 0.0


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns))


def mixture_curve(df: DataFrame, column: str, ks=range(1, 5)) -> DataFrame:
    """(k, log_likelihood, bic, weights, means, sds) of one-dimensional Gaussian mixtures, p = 3 k - 1 parameters.

    Fitted by EM, from quantiles, on the column's histogram: one aggregation for all k, however many rows.
    """
    from callscope.operators import modality

    x, counts = modality.histogram(df, column)
    m, s = df.agg(F.avg(column), F.stddev_pop(column)).first()
    n, rows = counts.sum(), []
    for k in ks:
        ll, w, mean, sd = modality.em(x, counts, k)
        ll -= n * np.log(s)
        order = np.argsort(mean)
        rows.append((k, float(ll), float((3 * k - 1) * np.log(n) - 2 * ll), [float(v) for v in w[order]], [float(m + s * v) for v in mean[order]], [float(s * v) for v in sd[order]]))
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, weights array<double>, means array<double>, sds array<double>")


def mixture_labels(df: DataFrame, column: str, k: int) -> DataFrame:
    """Adds label: the most probable part, by rising mean; null stays null."""
    fit = mixture_curve(df, column, [k]).first()
    parts = [F.struct((F.lit(float(np.log(w / s))) - 0.5 * ((F.col(column) - F.lit(m)) / F.lit(s)) ** 2).alias("v"), F.lit(i).alias("i")) for i, (w, m, s) in enumerate(zip(fit["weights"], fit["means"], fit["sds"]))]
    return df.withColumn("label", F.when(F.col(column).isNotNull(), F.array_max(F.array(*parts))["i"]))


def silhouettes(df: DataFrame, columns: list[str], ks=range(2, 11), seed: int = 0) -> DataFrame:
    """(k, silhouette) of k-means clusterings."""
    v = _vector(df, columns).select("features").cache()
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(v).transform(v)))) for k in ks]
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def theory_scores(df: DataFrame, loadings: list[list[float]], target: list[float], columns: list[str]) -> DataFrame:
    """Adds score = z (L L' t), contrast = z . t / |t| for standardised columns z, and captured = |L' t|^2 / |t|^2."""
    l, t = np.asarray(loadings), np.asarray(target)  # noqa: E741
    w, norm = l @ (l.T @ t), float(np.linalg.norm(t))
    z = standardise(df, columns)
    dot = lambda v: sum((F.col(c) * float(x) for c, x in list(zip(columns, v))[1:]), F.col(columns[0]) * float(v[0]))
    return z.withColumns({"score": dot(w), "contrast": dot(t / norm), "captured": F.lit(float(np.linalg.norm(l.T @ t) ** 2 / norm**2))})


def bootstrap_scores(df: DataFrame, columns: list[str], target: list[float], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(replicate, captured, agreement): the first components refitted on Poisson-weighted rows, one weighted moment pass over all replicates.

    captured: share of the target in the first two components; agreement: |cosine| of the first component with that of all rows.
    """
    base, k = pca(df, columns), len(columns)
    z = standardise(df.dropna(subset=columns), columns).select(*columns)
    u = F.pmod(F.xxhash64(F.lit(seed), "r", *columns), F.lit(1 << 30)) / float(1 << 30)
    weight = F.lit(0)
    at, p = 0.0, float(np.exp(-1))
    for i in range(1, 7):
        at += p
        weight = F.when(u >= at, i).otherwise(weight)
        p /= i
    rows = z.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("w", weight).where("w > 0")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy("r").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)], *[F.sum(F.col("w") * F.col(columns[i]) * F.col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs])
    t, first = np.asarray(target) / np.linalg.norm(target), base["weights"][:, 0]

    def refit(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.array([row[f"m{i}"] for i in range(k)]) / row["n"]
                c = np.zeros((k, k))
                for i, j in pairs:
                    c[i, j] = c[j, i] = row[f"c{i}_{j}"] / row["n"] - m[i] * m[j]
                s = np.sqrt(np.diag(c))
                v = np.linalg.eigh(c / np.outer(s, s))[1][:, ::-1]
                out.append((int(row["r"]), float(((v[:, :2].T @ t) ** 2).sum()), float(abs(v[:, 0] @ first))))
            yield pd.DataFrame(out, columns=["replicate", "captured", "agreement"])

    return sums.mapInPandas(refit, "replicate int, captured double, agreement double")


def theory_contributions(df: DataFrame, loadings: list[list[float]], target: list[float], columns: list[str], anchor: str) -> DataFrame:
    """Adds score, component_1.. and feature_<column>: both kinds of parts sum to the score. flipped: whether all were negated.

    The score is negated if it correlates negatively with the anchor column, so that more of the anchor means a higher score.
    """
    l, t = np.asarray(loadings), np.asarray(target)  # noqa: E741
    w = l.T @ t
    full = l @ w
    z = standardise(df, columns)
    dot = lambda v: sum((F.col(c) * float(x) for c, x in list(zip(columns, v))[1:]), F.col(columns[0]) * float(v[0]))
    parts = {"score": dot(full)} | {f"component_{k + 1}": dot(l[:, k] * w[k]) for k in range(l.shape[1])} | {f"feature_{c}": F.col(c) * float(x) for c, x in zip(columns, full)}
    scored = z.withColumns(parts)
    sign = scored.agg(F.when(correlation("score", anchor) < 0, -1.0).otherwise(1.0).alias("sign_"))
    return scored.crossJoin(F.broadcast(sign)).withColumns({c: F.col(c) * F.col("sign_") for c in parts}).withColumn("flipped", F.col("sign_") < 0).drop("sign_")  # one row


def validate_scores(df: DataFrame, columns: list[str], loadings: list[list[float]], target: list[float], variants: dict[str, list[float]], outside: list[str], first: int = 1) -> DataFrame:
    """(validation, name, value) of the score z (L L' t), all from one pass of cross moments over complete rows.

    direction: correlation of the score with each column of the target, 1 in agrees if its sign is the target's; without: correlation
    with the score that leaves one column's part out; variant: with scores of other targets; contrast: with z . t; outside: with other
    columns; gain: what the score adds to the first component's share of an outside column's variance.
    """
    k, names = len(columns), [*columns, *outside]
    _, _, cov = moments(df, names)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = np.inf  # a constant column has no part in a score
    r = cov / np.outer(sd, sd)
    l, t = np.asarray(loadings), np.asarray(target, float)  # noqa: E741
    wide = lambda v: np.concatenate([v, np.zeros(len(outside))])
    score = wide(l @ (l.T @ t))
    one = lambda i: np.eye(len(names))[i]

    def between(a, b):
        s = (a @ r @ a) * (b @ r @ b)
        return float(a @ r @ b / np.sqrt(s)) if s > 0 else None

    rows = []
    for i, c in enumerate(columns):
        if t[i]:
            x = between(score, one(i))
            rows += [("direction", c, x), ("agrees", c, None if x is None else float(np.sign(x) == np.sign(t[i])))]
        rows.append(("without", c, between(score, score * (1 - one(i)))))
    rows += [("variant", v, between(score, wide(l @ (l.T @ np.asarray(x, float))))) for v, x in variants.items()]
    rows.append(("contrast", "all", between(score, wide(t))))
    component = wide(l[:, first - 1])
    for i, c in enumerate(outside, k):
        a, b, ab = between(score, one(i)), between(component, one(i)), between(score, component)
        rows.append(("outside", c, a))
        known = None not in (a, b, ab) and abs(ab) < 1 - 1e-9
        rows.append(("gain", c, (a - b * ab) ** 2 / (1 - ab**2) if known else None))
    return df.sparkSession.createDataFrame(rows, "validation string, name string, value double")


def block_shares(loadings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(component, block, share) of absolute loadings; loadings (component, feature, loading), blocks (feature, block). Features of no block count as 'none'."""
    s = loadings.join(blocks, "feature", "left").groupBy("component", F.coalesce("block", F.lit("none")).alias("block")).agg(F.sum(F.abs("loading")).alias("s"))
    whole = loadings.groupBy("component").agg(F.sum(F.abs("loading")).alias("all_"))
    return s.join(whole, "component").select("component", "block", F.round(F.try_divide("s", "all_"), 6).alias("share"))
