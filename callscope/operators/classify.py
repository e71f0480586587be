"""Utterance classifier on marked word n-grams and numeric columns, with grouped out-of-fold prediction."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Imputer, NGram, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.operators import gold, order

VOCABULARY = 1 << 18
#: Folds fitted at a time: their jobs are short, and the driver works between them.
FITS = 3
#: Rows of a task of a fit; a task returns a gradient of the vocabulary's length at each step, so there are no more than these and the cores ask for.
ROWS = 500_000


def prepare(df: DataFrame, text: str, numeric: list[str], label: Column | None = None) -> DataFrame:
    """Adds marked tokens, missing indicators and, with a label, balancing weights; labelled rows are worked out once."""
    out = df.withColumn("marked", F.concat(F.array(F.lit("<s>")), X.tokens(F.coalesce(F.col(text), F.lit("")))))
    out = out.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric}).withColumns({c: F.col(c).cast("double") for c in numeric})
    if label is None:
        return out
    out = order.settled(out.withColumn("label", label.cast("double")))
    share = out.agg(F.avg("label")).first()[0]
    return out.withColumn("weight", F.lit(1.0) if share in (None, 0.0, 1.0) else F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def _vocabularies(rows: DataFrame, column: str, min_df: int, held_out: list[int | None]) -> pa.Table:
    """(term, in0, in1...): for each fold to hold out (None: none) the terms in at least min_df of the other rows, the most frequent ones up to VOCABULARY; one counting for all."""
    own = F.sort_array(column)
    each = F.transform(own, lambda w, i: F.struct(w.alias("term"), (~F.get(own, i - 1).eqNullSafe(w)).alias("new")))
    seen = rows.select("fold", F.explode(each).alias("t")).select("fold", "t.*")
    inside, folds = [F.lit(True) if k is None else F.col("fold") != k for k in held_out], range(len(held_out))
    counts = seen.groupBy("term").agg(*[F.count_if(x & F.col("new")).alias(f"df{j}") for j, x in enumerate(inside)], *[F.count_if(x).alias(f"n{j}") for j, x in enumerate(inside)])
    known = [F.col(f"df{j}") >= min_df for j in folds]
    counts = order.settled(counts.where(reduce(Column.__or__, known)))
    for j, n in enumerate(counts.agg(*[F.count_if(x) for x in known]).first()):
        if n > VOCABULARY:
            last = counts.where(known[j]).orderBy(F.desc(f"n{j}"), "term").offset(VOCABULARY - 1).limit(1).select(f"n{j}", "term").first()
            known[j] &= (F.col(f"n{j}") > last[0]) | ((F.col(f"n{j}") == last[0]) & (F.col("term") <= last[1]))
    return counts.where(reduce(Column.__or__, known)).select("term", *[x.alias(f"in{j}") for j, x in enumerate(known)]).toArrow()


def _vectors(rows: DataFrame, numeric: list[str], min_df: int, held_out: list[int | None]) -> tuple[list[Model], DataFrame, list[np.ndarray]]:
    """(stages up to the features, the rows with these, worked out once, for each fold to hold out 1.0 where a feature belongs to it).

    Features are the terms of any fold's vocabulary, the numbers filled with each fold's medians, and what is missing. Names of vector
    elements are dropped as they come: the driver would hold them many times over, and each task of a fit would be sent them.
    """
    stages, masks = [NGram(n=2, inputCol="marked", outputCol="pairs")], [[] for _ in held_out]
    shown = stages[0].transform(rows)
    for name, column in (("one", "marked"), ("two", "pairs")):
        known = _vocabularies(shown, column, min_df, held_out)
        listed = rows.sparkSession.createDataFrame(known.select(["term"])).select(F.array("term").alias(column))
        stages.append(CountVectorizer(inputCol=column, outputCol=name, binary=True, vocabSize=max(1, len(known))).fit(listed))  # of the chosen terms alone
        at = pc.index_in(pa.array(stages[-1].vocabulary, pa.string()), value_set=known["term"].combine_chunks()).to_numpy(zero_copy_only=False)
        for j, mask in enumerate(masks):
            mask.append(known[f"in{j}"].to_numpy()[at].astype(float))
        shown = stages[-1].transform(shown).withMetadata(name, {})
    inputs = ["one", "two"]
    for j, k in enumerate(held_out if numeric else []):
        filled = [f"{c}_filled{j}" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=filled).fit(rows if k is None else rows.where(F.col("fold") != k)))
        inputs += filled
        for i, mask in enumerate(masks):
            mask.append(np.full(len(numeric), float(i == j)))
    for mask in masks:
        mask.append(np.ones(len(numeric)))
    stages.append(VectorAssembler(inputCols=[*inputs, *[f"{c}_missing" for c in numeric]], outputCol="features"))
    for stage in stages[3:]:
        shown = stage.transform(shown)
    shown = shown.select(*[c for c in rows.columns if c != "marked"], "features").withMetadata("features", {})
    return stages, order.settled(shown), [np.concatenate(m) for m in masks]


def _dealt(shown: DataFrame) -> DataFrame:
    """The rows in few partitions, as a fit goes over them a hundred times."""
    cores = shown.sparkSession.sparkContext.defaultParallelism
    return shown.coalesce(max(cores, -(-shown.count() // ROWS)))


def _logistic(reg: float, features: str = "features") -> LogisticRegression:
    """Features are scaled by the fit itself."""
    return LogisticRegression(featuresCol=features, weightCol="weight", regParam=reg, maxIter=50, threshold=0.5, maxBlockSizeInMB=16)


def _fitted(train: DataFrame, numeric: list[str], min_df: int, reg: float) -> tuple[list[Model], DataFrame]:
    stages, shown, _ = _vectors(train.withColumn("fold", F.lit(0)), numeric, min_df, [None])
    return [*stages, _logistic(reg).fit(_dealt(shown))], shown


def fit(train: DataFrame, numeric: list[str], min_df: int = 5, reg: float = 1e-3) -> PipelineModel:
    """Binary uni- and bigrams (in at least min_df utterances), median-imputed scaled numbers, balanced logistic regression."""
    return PipelineModel(_fitted(train, numeric, min_df, reg)[0])


def predict(model: Model, df: DataFrame, keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("score"))


def in_sample(df: DataFrame, numeric: list[str], keep: list[str], min_df: int = 5, reg: float = 1e-3) -> DataFrame:
    """predict on the very rows of the fit, whose vectors are not worked out again."""
    stages, shown = _fitted(df, numeric, min_df, reg)
    return predict(stages[-1], shown, keep)


def out_of_fold(df: DataFrame, numeric: list[str], group: str, keep: list[str], folds: int = 5, min_df: int = 5) -> DataFrame:
    """Each row predicted by a model that saw no row of its group: vocabulary, medians and scales are fitted inside the fold.

    Terms are counted and looked up once for all folds; a fold's fit sees those of its own vocabulary only, as the others are 0 for it.
    """
    rows = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), group), folds))
    _, shown, masks = _vectors(rows, numeric, min_df, list(range(folds)))
    shown = _dealt(shown)

    def part(k: int) -> DataFrame:
        own = ElementwiseProduct(scalingVec=Vectors.dense(masks[k]), inputCol="features", outputCol="own")
        model = _logistic(1e-3, "own").fit(own.transform(shown.where(F.col("fold") != k)))
        return predict(PipelineModel([own, model]), shown.where(F.col("fold") == k), [*keep, "label"])

    with ThreadPool(min(FITS, folds)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(part), range(folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def admission(predicted: DataFrame, bar: float) -> DataFrame:
    """Pooled precision, recall and F1, and whether F1 meets the bar."""
    c = gold.confusion(predicted, F.col("predicted") == 1, F.col("label") == 1)
    return c.withColumn("admitted", F.coalesce(F.col("f1") >= bar, F.lit(False)))


def top_features(model: PipelineModel, k: int = 20) -> list[tuple[str, float]]:
    """The n-grams with the largest weights, of either sign."""
    names = [*model.stages[1].vocabulary, *model.stages[2].vocabulary]
    weights = model.stages[-1].coefficients.toArray()[: len(names)]
    return sorted(zip(names, map(float, weights)), key=lambda x: -abs(x[1]))[:k]
