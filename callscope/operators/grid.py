"""A grid of analysis choices in one pass: backchannel rule x transform x unit x minimum x feature set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators import modality, order, units


def unit_tables(df: DataFrame, rules: dict[str, Column], transforms: dict, unit_keys: dict[str, Column], features: list[str]) -> DataFrame:
    """(rule, transform, unit, id, n_sub, <features>) for all choices: each row is emitted once for each rule it is substantive under, then grouped once.

    transforms: name -> a function of the table and the features that returns the transformed table (None: as it is).
    """
    rule = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("bc")) for k, c in rules.items()]), lambda x: x["bc"] == 0)).alias("r")
    unit = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("unit"), c.cast("string").alias("id")) for k, c in unit_keys.items()]), lambda x: x["id"].isNotNull())).alias("v")
    out = None
    for name, change in transforms.items():
        table = change(df, features) if change else df
        own = table.select("*", rule).select("*", unit).select("r.rule", F.lit(name).alias("transform"), "v.unit", "v.id", *features)
        out = own if out is None else out.unionByName(own)
    return out.groupBy("rule", "transform", "unit", "id").agg(F.count(F.lit(1)).alias("n_sub"), *[F.avg(c).alias(c) for c in features])


BANDWIDTHS = (0.25, 0.4, 0.6)
BINS = 512


def specifications(tables: DataFrame, minimums: list[int], feature_sets: dict[str, list[str]], replicates: int = 199) -> DataFrame:
    """(rule, transform, unit, min_utt, feature_set, n_units, dip, dip_p, modes, delta_bic, skewness, unimodal): the first component of each choice.

    modes is the largest count over BANDWIDTHS. Moments and bins of the component are grouped in Spark: the driver holds a row
    of moments a choice, and a task sees one choice's BINS counts.
    """
    names = ["rule", "transform", "unit", "min_utt", "feature_set"]
    features = list(dict.fromkeys(c for cols in feature_sets.values() for c in cols))
    f = [f"f{i}" for i in range(len(features))]
    tables = order.settled(tables)  # moments, ranges and bins are three passes
    rows = None
    for name, cols in feature_sets.items():
        full = F.lit(True)
        for c in cols:
            full = full & F.col(c).isNotNull() & ~F.isnan(c)
        own = tables.select("rule", "transform", "unit", "n_sub", F.lit(name).alias("feature_set"), *[F.when(full, F.col(c).cast("double") if c in cols else F.lit(0.0)).alias(x) for c, x in zip(features, f)])
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.select("*", F.explode(F.array(*map(F.lit, minimums))).alias("min_utt")).where("n_sub >= min_utt")

    pairs = [(i, j) for i in range(len(f)) for j in range(i, len(f))]
    found = rows.groupBy(*names).agg(F.count("f0").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(f)], *[F.covar_pop(f[i], f[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    empty, models = [], []
    for q in found:
        at = [features.index(c) for c in feature_sets[q["feature_set"]]]
        cov = np.array([[q[f"c{min(i, j)}_{max(i, j)}"] for j in at] for i in at], float)
        if q["n"] < 10 or not (np.diag(cov) > 0).all():
            empty.append((*[q[k] for k in names], q["n"]))
            continue
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.outer(sd, sd)
        w = np.linalg.eigh(corr)[1][:, -1] if len(at) > 1 else np.ones(1)
        w = w / np.sqrt(w @ corr @ w) / sd  # the score has spread 1
        whole = np.zeros(len(f))
        whole[at] = w
        models.append((*[q[k] for k in names], [float(v) for v in whole], float(sum(v * q[f"m{i}"] for v, i in zip(w, at)))))
    spark = tables.sparkSession
    kinds = "rule string, transform string, unit string, min_utt int, feature_set string"
    schema = f"{kinds}, n_units long, dip double, dip_p double, modes int, delta_bic double, skewness double, unimodal boolean"
    rest = spark.createDataFrame([(*e, *[None] * 6) for e in empty], schema)
    columns = rest.columns
    if not models:
        return rest
    scored = rows.where("f0 is not null").join(F.broadcast(spark.createDataFrame(models, f"{kinds}, w array<double>, c double")), names)  # a row a choice
    scored = scored.select(*names, (sum((F.get("w", F.lit(i)) * F.col(x) for i, x in enumerate(f)), F.lit(0.0)) - F.col("c")).alias("v"))
    range_ = scored.groupBy(*names).agg(F.min("v").alias("low"), (F.max("v") + 1e-9).alias("high"), F.skewness("v").alias("skewness"))
    bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int")
    bins = scored.join(range_, names).groupBy(*names, "low", "high", "skewness", bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BINS)
        counts[pdf["b"].to_numpy()] = pdf["n"].to_numpy()
        edges = np.linspace(pdf["low"].iat[0], pdf["high"].iat[0], BINS + 1)
        at = (edges[:-1] + edges[1:]) / 2
        stat, n = modality.dip(at, counts), int(counts.sum())
        r = np.random.default_rng(0)
        p = (1 + sum(modality.dip(at, r.multinomial(n, np.full(BINS, 1 / BINS)).astype(float)) >= stat for _ in range(replicates))) / (replicates + 1)
        modes = max(modality.prominent_modes(modality.smooth(at, counts, h)) for h in BANDWIDTHS)
        bic = lambda k: (3 * k - 1) * np.log(n) - 2 * modality.em(at, counts, k)[0]
        return pd.DataFrame([(*key, n, stat, p, modes, bic(2) - bic(1), float(pdf["skewness"].iat[0]), bool(p > 0.05 and modes == 1))], columns=columns)

    return bins.repartition(4 * len(models), *names).groupBy(*names).applyInPandas(one, schema).unionByName(rest)


def ranked(specs: DataFrame) -> DataFrame:
    """Specifications by rising dip p."""
    specs = order.settled(specs)  # a sort samples its input first, which would draw all replicates twice
    return specs.orderBy(F.asc_nulls_last("dip_p"), "rule", "transform", "unit", "min_utt", "feature_set")


def enrichment(specs: DataFrame, condition: Column, parameter: str) -> DataFrame:
    """(value, share among rows that meet the condition, share among all, ratio) of a parameter's values."""
    total = specs.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("k"))
    g = specs.groupBy(F.col(parameter).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("a"), F.count_if(condition).alias("b")).crossJoin(F.broadcast(total))
    share, base = F.try_divide("b", "k"), F.col("a") / F.col("n")
    return g.select("value", F.round(share, 6).alias("share"), F.round(base, 6).alias("base_share"), F.round(share / base, 6).alias("ratio"))


def winsorised(df: DataFrame, features: list[str]) -> DataFrame:
    return units.winsor_log(df, features)
