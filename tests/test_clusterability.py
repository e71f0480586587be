"""Hopkins' statistic and its null tables on planted structure."""

import numpy as np
import pytest

from callscope.operators import clusterability as H


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{c} double" for c in "xyz"[: x.shape[1]])).repartition(3)


def test_planted_classes_exceed_both_nulls(spark):
    r = np.random.default_rng(1)
    three = np.concatenate([r.normal(0, 0.3, (300, 2)), r.normal(4, 0.3, (300, 2)), r.normal((0, 4), 0.3, (300, 2))])
    seen, p, mean = H.hopkins_test(frame(spark, three), ["x", "y"], "gaussian", replicates=60)
    assert seen > mean + 0.05 and p < 0.05
    nine = np.concatenate([r.uniform(-0.5, 0.5, (100, 2)) * 0.6 + (i, i * 4 % 9) for i in range(9)])  # no column shows the classes
    seen, p, mean = H.hopkins_test(frame(spark, nine), ["x", "y"], "copula", replicates=60)
    assert seen > mean + 0.05 and p < 0.05


def test_skewed_columns_exceed_the_gaussian_null_only(spark):
    """A copula sample with heavy tails: a dense core, no clusters."""
    r = np.random.default_rng(2)
    z = r.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 900)
    x = np.exp(1.2 * z)
    seen, p, mean = H.hopkins_test(frame(spark, x), ["x", "y"], "gaussian", replicates=60)
    assert p < 0.05 and seen > mean
    assert H.hopkins_test(frame(spark, x), ["x", "y"], "copula", replicates=60)[1] > 0.05


def test_gaussian_rows_are_like_their_null(spark):
    x = np.random.default_rng(3).multivariate_normal([0, 0, 0], [[1, 0.6, 0], [0.6, 1, 0], [0, 0, 2]], 600)
    assert H.hopkins_test(frame(spark, x), ["x", "y", "z"], "gaussian", replicates=60)[1] > 0.02


def test_against_all_pairs(spark):
    """Every row a sampled one: the statistic from plain distances."""
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 2))
    x[7] = x[8]
    own = np.array([min(np.sqrt(((x[i] - x[j]) ** 2).sum()) for j in range(40) if j != i) for i in range(40)])
    assert own[7] == 0
    best, same = H._near(x, x, True)
    assert same.tolist() == [2 if i in (7, 8) else 1 for i in range(40)]
    free = r.uniform(size=(40, 2))
    assert H.statistic(H._near(free, x, False)[0], best, same) == pytest.approx(H._near(free, x, False)[0].sum() / (H._near(free, x, False)[0].sum() + own.sum()))


def test_slices_make_one_table(spark, monkeypatch):
    """Rows are the same in both passes, whatever the number of slices, and as many as asked for."""
    monkeypatch.setattr(H, "SLICE", 70)
    values = H.null_statistics(spark, lambda z: z, 300, np.eye(2), 20, 5)
    assert len(values) == 5 and ((0 < values) & (values < 1)).all()
    monkeypatch.setattr(H, "SLICE", 1000)
    assert len(H.null_statistics(spark, lambda z: z, 10, np.eye(2), 20, 3)) == 3


def test_edges(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert H.hopkins(empty, ["x", "y"]) is None and H.hopkins_test(empty, ["x", "y"]) == (None, None, None)
    assert H.hopkins(frame(spark, np.ones((1, 2))), ["x", "y"]) is None
    assert H.hopkins(frame(spark, np.ones((30, 2))), ["x", "y"]) is None
    pairs = np.repeat(np.random.default_rng(5).normal(size=(100, 2)), 2, axis=0)
    assert H.hopkins(frame(spark, pairs), ["x", "y"]) == 1.0  # each row has a copy
    odd = spark.createDataFrame([(1.0, None), (float("nan"), 1.0), (0.0, 0.0), (1.0, 1.0), (2.0, 5.0)], "x double, y double")
    assert 0 < H.hopkins(odd, ["x", "y"]) < 1
    with pytest.raises(ValueError):
        H.hopkins_test(odd, ["x", "y"], "uniform")


def test_distances_of_some_blocks_are_within_their_bound(spark):
    """An incomplete sum over few block pairs against all pairs, with copies; its work grows as the rows."""
    from callscope.operators import modality

    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 1, (2500, 2)), r.normal(5, 1, (1500, 2)), np.repeat(r.normal(2, 1, (50, 2)), 8, axis=0)])
    df = frame(spark, x)
    n, whole, none = modality.distance_dip(df, ["x", "y"], exact=True, block=128)
    m, some, error = modality.distance_dip(df, ["x", "y"], exact=False, block=128, offsets=2)
    assert n == m == 4400 * 4399 // 2 and none == 0.0 and 0 < error < 0.07 and abs(some - whole) <= error
    at, all_counts = modality.pairwise_distances(df, ["x", "y"], block=128)
    _, few = modality.pairwise_distances(df, ["x", "y"], block=128, offsets=2)
    assert few.sum() == pytest.approx(all_counts.sum())
    assert np.abs(np.cumsum(few) - np.cumsum(all_counts)).max() / n <= error
    assert modality.distance_dip(frame(spark, x[:10]), ["x", "y"])[2] == 0.0 and modality.distance_dip(spark.createDataFrame([], "x double, y double"), ["x", "y"])[1] == 0.0


def test_nearest_rows_are_found_by_columns():
    """Copies of a probe are counted and left out; a table of copies alone has no nearest row; each column is read as a whole."""
    import inspect

    import numpy as np

    from callscope.operators import clusterability

    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(500, 3)), np.zeros((2, 3))])
    probes = np.concatenate([x[:4], np.zeros((1, 3)), r.normal(size=(5, 3))])
    each = np.sqrt(((x[None] - probes[:, None]) ** 2).sum(2))
    d, same = clusterability._near(probes, x, True)
    assert same.tolist() == [1] * 4 + [2] + [0] * 5
    assert np.allclose(d, np.where((x[None] == probes[:, None]).all(2), np.inf, each).min(1), rtol=1e-12)
    assert np.allclose(clusterability._near(probes, x, False)[0], each.min(1), rtol=1e-12)
    assert np.isinf(clusterability._near(np.zeros((1, 3)), np.zeros((2, 3)), True)[0]).all()
    assert "sum(1)" not in inspect.getsource(clusterability._near)
