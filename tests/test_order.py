"""Percentiles, running totals and ranks against numpy and plain loops, with ties over partition borders, nulls and odd values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import groups, order, units


def numbers(n=4000, seed=3):
    r = random.Random(seed)
    kinds = [lambda: r.gauss(0, 1), lambda: float(r.randrange(5)), lambda: r.choice([-1, 1]) * 2.0 ** r.randrange(-900, 900), lambda: 0.0, lambda: -r.random() * 1e-9]
    return [r.choice(kinds)() for _ in range(n)]


def test_percentiles_are_exact(spark):
    x = numbers()
    rows = [(i, v, float(i % 7), None) for i, v in enumerate(x)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "a long, b double, c double, d double").repartition(5)
    ps = [0, 0.01, 0.25, 0.5, 0.9, 0.99, 1]
    got = order.percentiles(df, ["a", "b", "c", "d"], ps)[()]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, map(float, ps)))).alias(c) for c in "abc"]).first()
    for c in "abc":
        assert [got[c, p] for p in ps] == pytest.approx(list(want[c]), rel=1e-12, abs=1e-320)
    assert all(got["d", p] is None for p in ps)


def test_percentiles_of_groups_ties_and_odd_values(spark):
    rows = [("x", float(v)) for v in range(10)] + [("y", 7.0)] * 500 + [(None, math.inf), (None, -math.inf), (None, 1.0), ("z", None), ("w", math.nan), ("w", 1.0)]
    got = order.percentiles(spark.createDataFrame(rows, "g string, v double"), ["v"], [0.5], ["g"])
    assert got[("x",)]["v", 0.5] == 4.5 and got[("y",)]["v", 0.5] == 7.0 and got[(None,)]["v", 0.5] == 1.0
    assert math.isnan(got[("w",)]["v", 0.5]) and ("z",) not in got
    assert order.percentiles(spark.createDataFrame([], "v double"), ["v"], [0.5]) == {(): {("v", 0.5): None}}
    assert order.percentiles(spark.createDataFrame([(2.5,)], "v double"), ["v"], [0.01, 1])[()] == {("v", 0.01): 2.5, ("v", 1): 2.5}


def test_a_pass_returns_few_counts_whatever_the_values(spark, monkeypatch):
    """Distinct values don't reach the driver or a task's buffer: no pass returns more than a few thousand rows."""
    seen = []
    plain = order._counted
    monkeypatch.setattr(order, "_counted", lambda *a: (lambda out: (seen.append(max(map(len, out.values()))), out)[1])(plain(*a)))
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003 / 7.0).alias("v"))
    got = order.percentiles(df, ["v"], [0.01, 0.5, 0.99])[()]
    assert got["v", 0.5] == pytest.approx(float(np.percentile([i * 7919 % 200_003 / 7 for i in range(200_000)], 50)), abs=1e-9)
    assert 1 <= len(seen) <= 6 and max(seen) <= order.SLICES


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_running_totals(spark, by):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None, "c"]), r.choice([1, None, 2]), i, r.randrange(-5, 9), r.choice([None, r.random()])) for i in range(3000)] + [("huge", 1, i, 1, 1.0) for i in range(3000, 7000)]
    df = spark.createDataFrame(rows, "g string, h int, at long, n int, x double").repartition(7)
    for least in (False, True):
        got = {q["at"]: (q["n_run"], q["x_run"]) for q in order.running(df, [F.col("at").desc()], ["n", "x"], by, least).collect()}
        state, want = {}, {}
        for g, h, at, n, x in sorted(rows, key=lambda q: -q[2]):
            key = tuple({"g": g, "h": h}[b] for b in by)
            a, b = state.get(key, (math.inf, math.inf) if least else (0, 0.0))
            state[key] = a, b = (min(a, n), min(b, math.inf if x is None else x)) if least else (a + n, b + (x or 0.0))
            want[at] = a, b
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want) and len(got) == len(want)
    assert order.running(df.limit(0), ["at"], ["n"], by).count() == 0


def test_ranks_with_ties_over_borders(spark):
    rows = [(i, "s" if i % 3 else "t", [1.0, 2.0, 2.0, 2.0, 3.0, None][i % 6]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(9)
    for by in ([], ["g"]):
        got = {r["id"]: (r["rank_"], r["times_"], r["of_"]) for r in order.with_rank(df, "v", by).collect()}
        for i, g, v in rows:
            if v is not None:
                own = [w for _, h, w in rows if w is not None and (not by or h == g)]
                assert got[i] == (1 + sum(w < v for w in own), own.count(v), len(own))
        assert len(got) == 1000


def test_group_statistics_without_groups(spark):
    """Against plain versions, ungrouped, with ties."""
    r = random.Random(9)
    rows = [(i, r.randrange(30) / 3, r.randrange(20) * 1.0, i % 3 == 0) for i in range(400)] + [(400, None, 1.0, True), (401, 2.0, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, p boolean").repartition(6)
    both = [(a, b) for _, a, b, _ in rows if a is not None and b is not None]
    mid = lambda xs: [sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for x in xs]
    rho = np.corrcoef(mid([a for a, _ in both]), mid([b for _, b in both]))[0, 1]
    assert groups.spearman(df, "a", "b").first()["n"] == len(both)
    assert groups.spearman(df, "a", "b").first()["rho"] == pytest.approx(rho, abs=1e-6)
    pos, neg = [[a for _, a, _, p in rows if a is not None and p is q] for q in (True, False)]
    u = sum((x > y) + (x == y) / 2 for x in pos for y in neg) / len(pos) / len(neg)
    assert groups.auc(df, F.col("p"), "a").first()["auc"] == pytest.approx(u, abs=1e-6)
    at = {x["id"]: x["percentile"] for x in groups.percentile_rank(df, "a").collect()}
    known = [a for _, a, _, _ in rows if a is not None]
    assert all(at[i] == pytest.approx((1 + sum(y < a for y in known)) / (len(known) + 1), abs=1e-9) for i, a, _, _ in rows if a is not None)
    ps = [(i, (i % 50 + 1) / 60) for i in range(200)]
    adj = {x["id"]: x["p_adjusted"] for x in groups.adjusted_p(spark.createDataFrame(ps, "id long, p double"), "p").collect()}
    srt = sorted(p for _, p in ps)
    assert all(adj[i] == pytest.approx(min(1, min(q * 200 / (k + 1) for k, q in enumerate(srt) if q >= p)), abs=1e-9) for i, p in ps)
    best = {x["at"]: x["id"] for x in groups.representatives(df, "a", "id").collect()}
    line = sorted((a, i) for i, a, _, _ in rows if a is not None)
    assert best == {q: line[max(1, math.ceil(q * len(line))) - 1][1] for q in (0.05, 0.25, 0.5, 0.75, 0.95)}


def test_winsor_bounds_come_from_counts(spark):
    df = spark.createDataFrame([(float(v), None) for v in range(101)], "v double, w double")
    b = units.winsor_bounds(df, ["v", "w"]).first()
    assert (b["v_lo"], b["v_hi"], b["v_min"], b["w_lo"]) == (1.0, 99.0, 0.0, None)
