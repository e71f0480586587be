"""Modes, dips, mixtures and clusterability of one axis. Rows become a histogram in Spark; replicates are spread over tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import order

BINS = 4096


def histogram(df: DataFrame, column: str, bins: int = BINS, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(bin centres in units of standard deviation from the mean, counts); at most `bins` rows reach the driver."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    s = v.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not s["s"]:
        raise ValueError(f"{column} does not vary")
    lo, hi = (s["lo"] - s["m"]) / s["s"] - margin, (s["hi"] - s["m"]) / s["s"] + margin
    width = (hi - lo) / bins
    z = (F.col("v") - F.lit(s["m"])) / F.lit(s["s"])
    b = F.least(F.lit(bins - 1), F.floor((z - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = np.zeros(bins)
    for r in v.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["b"]] = r["n"]
    return lo + (np.arange(bins) + 0.5) * width, counts


def smooth(x: np.ndarray, counts: np.ndarray, h: float) -> np.ndarray:
    """Gaussian density of binned counts at bandwidth h, on a grid padded by 3 h, by the Fourier transform."""
    width = x[1] - x[0]
    pad = int(math.ceil(3 * h / width))
    full = np.pad(counts, pad)
    size = 1 << int(math.ceil(math.log2(len(full) + 8 * h / width + 1)))
    f = np.fft.rfftfreq(size, width)
    d = np.fft.irfft(np.fft.rfft(full, size) * np.exp(-2 * (np.pi * f * h) ** 2), size)[: len(full)]
    return np.where(d > 1e-9 * d.max(), d, 0.0)


def strict_modes(density: np.ndarray, floor: float = 1e-6) -> int:
    """Local maxima above floor * maximum; a plateau is one."""
    d = np.concatenate([[-1.0], density[np.concatenate([[True], density[1:] != density[:-1]])], [-1.0]])
    return int(((d[1:-1] > d[:-2]) & (d[1:-1] > d[2:]) & (d[1:-1] > floor * density.max())).sum())


def prominent_modes(density: np.ndarray, share: float = 0.05) -> int:
    """Maxima that stand out by at least `share` of the highest: one pass that tracks the last valley."""
    need, count, low, high, rising = share * density.max(), 0, 0.0, 0.0, True
    for v in density:
        if rising:
            high = max(high, v)
            if high - low >= need and high - v >= need:
                count, rising, low = count + 1, False, v
        else:
            low = min(low, v)
            if v - low >= need:
                rising, high = True, v
    return count + (1 if rising and high - low >= need else 0)


def count_modes(df: DataFrame, column: str, h: float) -> int:
    return strict_modes(smooth(*histogram(df, column), h))


def critical_bandwidth(x: np.ndarray, counts: np.ndarray, k: int = 1, steps: int = 30) -> float:
    """The least bandwidth at which the density has at most k modes, by bisection."""
    lo, hi = 1e-3, 2 * (x[-1] - x[0])
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if strict_modes(smooth(x, counts, mid)) <= k else (mid, hi)
    return hi


def replicate(spark: SparkSession, n: int, one, seed: int = 0) -> DataFrame:
    """(replicate, value): one(generator) for each of n replicates, spread over tasks."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"replicate": pdf["id"], "value": [float(one(np.random.default_rng([seed, int(r)]))) for r in pdf["id"]]})

    return spark.range(0, n, 1, max(1, min(n, 2 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "replicate long, value double")


def silverman(df: DataFrame, column: str, k: int = 1, replicates: int = 99, seed: int = 0) -> tuple[float, float]:
    """(critical bandwidth, p) of at most k modes: smoothed bootstrap of the binned sample, rescaled to its variance."""
    x, counts = histogram(df, column)
    h, n = critical_bandwidth(x, counts, k), int(counts.sum())
    mean = (x * counts).sum() / n
    scale = math.sqrt(1 + h * h / ((x**2 * counts).sum() / n - mean**2))
    width = x[1] - x[0]
    grid = np.concatenate([x[0] + width * np.arange(-int(4 * h / width) - 1, 0), x, x[-1] + width * np.arange(1, int(4 * h / width) + 2)])
    density = smooth(grid, np.concatenate([np.zeros(int(4 * h / width) + 1), counts, np.zeros(int(4 * h / width) + 1)]), h)
    off = (len(density) - len(grid)) // 2
    density = density[off : off + len(grid)]
    shrunk = mean + (grid - mean) / scale

    def one(r):
        drawn = r.multinomial(n, density / density.sum())
        return strict_modes(smooth(shrunk, drawn.astype(float), h)) > k

    return h, float(replicate(df.sparkSession, replicates, one, seed).agg(F.avg("value")).first()[0])


def em(x: np.ndarray, counts: np.ndarray, k: int, steps: int = 300) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, weights, means, spreads) of a k-part Gaussian mixture of binned counts, started at quantiles."""
    n = counts.sum()
    cum = np.cumsum(counts) / n
    mean = np.array([x[min(np.searchsorted(cum, (i + 0.5) / k), len(x) - 1)] for i in range(k)])
    total_sd = math.sqrt((counts * x**2).sum() / n - ((counts * x).sum() / n) ** 2)
    sd, w, last = np.full(k, total_sd / k), np.full(k, 1 / k), -np.inf
    use = counts > 0
    x, counts = x[use], counts[use]
    for _ in range(steps):
        logp = np.log(w) - np.log(sd) - 0.5 * math.log(2 * math.pi) - 0.5 * ((x[:, None] - mean) / sd) ** 2
        top = logp.max(1, keepdims=True)
        mix = top[:, 0] + np.log(np.exp(logp - top).sum(1))
        ll = float((counts * mix).sum())
        r = np.exp(logp - mix[:, None]) * counts[:, None]
        nk = r.sum(0) + 1e-12
        w, mean = nk / n, (r * x[:, None]).sum(0) / nk
        sd = np.maximum(np.sqrt((r * (x[:, None] - mean) ** 2).sum(0) / nk), 0.05 * total_sd)
        if abs(ll - last) < 1e-7 * abs(ll):
            break
        last = ll
    return ll, w, mean, sd


def likelihood_ratio(df: DataFrame, column: str, k0: int = 1, k1: int = 2, replicates: int = 99, seed: int = 0) -> tuple[float, float]:
    """(statistic, p) of k0 against k1 mixture parts by parametric bootstrap; p = (1 + exceeding) / (replicates + 1)."""
    x, counts = histogram(df, column, 1024, margin=2.0)
    ll0, w, mean, sd = em(x, counts, k0)
    stat = 2 * (em(x, counts, k1)[0] - ll0)
    n = int(counts.sum())
    null = sum(a * np.exp(-0.5 * ((x - m) / s) ** 2) / s for a, m, s in zip(w, mean, sd))

    def one(r):
        drawn = r.multinomial(n, null / null.sum()).astype(float)
        return 2 * (em(x, drawn, k1)[0] - em(x, drawn, k0)[0])

    above = replicate(df.sparkSession, replicates, one, seed).agg(F.count_if(F.col("value") >= stat)).first()[0]
    return stat, (1 + above) / (replicates + 1)


def family_table(df: DataFrame, column: str) -> DataFrame:
    """(family, log_likelihood, bic): normal, skew-normal, shifted log-normal, skew-t, and two mixtures, on the binned axis.

    Families without a closed form are searched on a grid that is refined three times; a family that can't be fitted has an infinite bic.
    """
    x, counts = histogram(df, column, 1024)
    n = counts.sum()
    use = counts > 0
    x0, c0 = x[use], counts[use]
    erf = np.vectorize(math.erf)
    phi = lambda z: np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = lambda z: 0.5 * (1 + erf(z / math.sqrt(2)))

    def skew_normal(a, m, s):
        z = (x0 - m) / s
        return np.log(2 * phi(z) / s * np.clip(cdf(a * z), 1e-300, None) + 1e-300)

    def log_normal(shift, m, s):
        y = x0 - (x0[0] - shift)
        return np.log(phi((np.log(y) - m) / s) / (s * y) + 1e-300) if (y > 0).all() else np.full(len(x0), -np.inf)

    def skew_t(a, m, s, v):
        z = (x0 - m) / s
        t = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + z * z / v) ** (-(v + 1) / 2)
        return np.log(2 * t / s * np.clip(cdf(a * z * np.sqrt((v + 1) / (v + z * z))), 1e-300, None) + 1e-300)

    def search(f, box):
        best, at = -np.inf, [(lo + hi) / 2 for lo, hi in box]
        for _ in range(4):
            axes = [np.linspace(lo, hi, 7) for lo, hi in box]
            for point in np.stack(np.meshgrid(*axes), -1).reshape(-1, len(box)):
                value = float((c0 * f(*point)).sum())
                if np.isfinite(value) and value > best:
                    best, at = value, list(point)
            box = [(max(p - (hi - lo) / 5, lo0), p + (hi - lo) / 5) for p, (lo, hi), lo0 in zip(at, box, [b[0] for b in box])]
        return best

    g1, g2 = em(x, counts, 1)[0], em(x, counts, 2)[0]
    width = x0[-1] - x0[0]
    found = [("normal", g1, 2), ("skew_normal", search(skew_normal, [(-8, 8), (-2, 2), (0.3, 2.5)]), 3), ("log_normal", search(log_normal, [(0.01, width), (-3, 3), (0.05, 2)]), 3), ("skew_t", search(skew_t, [(-6, 6), (-2, 2), (0.2, 2), (2, 60)]), 4), ("mixture_1", g1, 2), ("mixture_2", g2, 5)]
    rows = [(name, float(ll), float(p * math.log(n) - 2 * ll) if np.isfinite(ll) else float("inf")) for name, ll, p in found]
    return df.sparkSession.createDataFrame(rows, "family string, log_likelihood double, bic double")


def verdict(families: DataFrame) -> str:
    """single or mixture, by the least bic."""
    best = families.orderBy("bic", "family").first()["family"]
    return "mixture" if best == "mixture_2" else "single"


def dip(x: np.ndarray, counts: np.ndarray) -> float:
    """The dip: half the least distance of the distribution function to a unimodal one.

    A unimodal function is convex up to some mode and concave after it. For each candidate mode the least distance is half
    the largest gap between the step function's upper end and the greatest convex minorant of its lower end (before), and
    likewise with the least concave majorant (after); the best mode is found by bisection, as one gap grows with it and the other falls.
    """
    use = counts > 0
    x, c = x[use].astype(float), counts[use].astype(float)
    n = c.sum()
    hi = np.cumsum(c) / n
    lo = hi - c / n

    def convex_gap(m: int) -> float:  # points 0..m: convex below the steps' lower ends, gap to their upper ends
        px, py = x[: m + 1], lo[: m + 1]
        hull: list[int] = []
        for i in range(m + 1):
            while len(hull) > 1 and (py[hull[-1]] - py[hull[-2]]) * (px[i] - px[hull[-1]]) >= (py[i] - py[hull[-1]]) * (px[hull[-1]] - px[hull[-2]]):
                hull.pop()
            hull.append(i)
        return float((hi[: m + 1] - np.interp(px, px[hull], py[hull]))[: max(m, 1)].max())

    def concave_gap(m: int) -> float:
        px, py = -x[m:][::-1], 1 - hi[m:][::-1]
        top = 1 - lo[m:][::-1]
        hull: list[int] = []
        for i in range(len(px)):
            while len(hull) > 1 and (py[hull[-1]] - py[hull[-2]]) * (px[i] - px[hull[-1]]) >= (py[i] - py[hull[-1]]) * (px[hull[-1]] - px[hull[-2]]):
                hull.pop()
            hull.append(i)
        return float((top - np.interp(px, px[hull], py[hull]))[: max(len(px) - 1, 1)].max())

    a, b = 0, len(x) - 1
    while b - a > 1:
        m = (a + b) // 2
        if convex_gap(m) < concave_gap(m):
            a = m
        else:
            b = m
    return min(max(convex_gap(m), concave_gap(m)) for m in {a, b}) / 2


def dip_test(df: DataFrame, column: str, replicates: int = 99, seed: int = 0) -> tuple[float, float]:
    """(dip, p) against uniform samples of the same size, binned alike."""
    x, counts = histogram(df, column, 1024)
    n, stat = int(counts.sum()), dip(x, counts)
    above = replicate(df.sparkSession, replicates, lambda r: dip(x, r.multinomial(n, np.full(len(x), 1 / len(x))).astype(float)), seed).agg(F.count_if(F.col("value") >= stat)).first()[0]
    return stat, (1 + above) / (replicates + 1)


def battery(df: DataFrame, axes: list[str], level: str, replicates: int = 99, seed: int = 0) -> DataFrame:
    """Ledger rows (axis, level, n, test, stat, p, replicates, verdict) of the dip, Silverman, likelihood-ratio and family tests."""
    rows = []
    for axis in axes:
        n = df.where(F.col(axis).isNotNull()).count()
        d, pd_ = dip_test(df, axis, replicates, seed)
        h, ps = silverman(df, axis, 1, replicates, seed)
        s, pl = likelihood_ratio(df, axis, 1, 2, replicates, seed)
        one = lambda p: "one mode" if p > 0.05 else "several modes"
        d, h, s = float(d), float(h), float(s)
        rows += [(axis, level, n, "dip", d, pd_, replicates, one(pd_)), (axis, level, n, "silverman", h, ps, replicates, one(ps)), (axis, level, n, "likelihood_ratio", s, pl, replicates, "single" if pl > 0.05 else "mixture"), (axis, level, n, "family", None, None, None, verdict(family_table(df, axis)))]
    return df.sparkSession.createDataFrame(rows, "axis string, level string, n long, test string, stat double, p double, replicates int, verdict string")


def tail_diagnosis(df: DataFrame, column: str, h: float = 0.25, cut: float = 0.001) -> dict:
    """Mode counts of the raw and the winsorised axis, and the share of rows beyond 5 standard deviations."""
    q = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
    ends = order.percentiles(df, [column], [cut, 1 - cut])[()]
    clipped = df.select(F.least(F.greatest(F.col(column), F.lit(ends[column, cut])), F.lit(ends[column, 1 - cut])).alias(column))
    far = df.agg(F.avg((F.abs(F.col(column) - F.lit(q["m"])) > 5 * F.lit(q["s"])).cast("double"))).first()[0]
    return {"raw_modes": count_modes(df, column, h), "winsorised_modes": count_modes(clipped, column, h), "far_share": far}


#: Rows up to which distance_dip takes all pairs by itself; offsets of blocks and chance of error beyond.
EXACT_ROWS, OFFSETS, RISK = 50_000, 8, 0.01


def distance_dip(df: DataFrame, columns: list[str], exact: bool | None = None, bins: int = 512, block: int = 2048, offsets: int = OFFSETS, risk: float = RISK) -> tuple[int, float, float]:
    """(number of pairs, dip of the distances of all pairs, bound of its error).

    All pairs up to EXACT_ROWS rows, or with `exact`: error 0. Beyond, an incomplete U-statistic: points are dealt at random over
    blocks, and block i meets i + 1, ..., i + `offsets` only, so that all blocks and points count alike and work grows as the rows.
    The share of distances below any bin edge is then off by at most sqrt(log(2 * bins / risk) / n) but for a chance of `risk`
    (a mean over matchings of n / 2 pairs each), and the dip by no more. n is the effective number of rows, where equal rows have weights.
    """
    rows = df.dropna(subset=columns)
    n = rows.count()
    if exact is None:
        exact = n <= EXACT_ROWS
    x, counts = pairwise_distances(rows, columns, bins, block=block, offsets=None if exact else offsets)
    if not counts.any():
        return n * (n - 1) // 2, 0.0, 0.0
    weights = rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    return n * (n - 1) // 2, float(dip(x, counts)), 0.0 if exact else math.sqrt(math.log(2 * bins / risk) * weights / n**2)


def pairwise_distances(df: DataFrame, columns: list[str], bins: int = 512, max_rows: int | None = None, block: int = 2048, offsets: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centres, counts) of the distances of all pairs of complete rows; work grows with the square of the rows.

    Equal points become one with a weight. Points are dealt by hash over blocks of about `block`, each meets every block once,
    and a task sees two blocks; only `bins` sums reach the driver. A caller that can't afford the square may state max_rows, or
    `offsets`, how many blocks after its own each block meets: counts are then scaled up to all pairs, those of equal rows being exact.
    """
    points = df.dropna(subset=columns).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    x = [f"x{i}" for i in range(len(columns))]
    sized = points.groupBy(*x).agg(F.count(F.lit(1)).alias("w"))
    s = sized.agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("distinct"), *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in x]).first()
    if max_rows is not None and (s["n"] or 0) > max_rows:
        raise ValueError(f"{s['n']} rows; at most {max_rows} were allowed")
    if not s["n"]:
        return np.zeros(bins), np.zeros(bins)
    middle = [s[c] for c in x]
    top = 2 * math.sqrt(sized.agg(F.max(sum(((F.col(c) - F.lit(m)) ** 2 for c, m in zip(x, middle)), F.lit(0.0)))).first()[0]) + 1e-9
    blocks = -(-s["distinct"] // block)
    own = sized.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(x, middle)], "w", F.pmod(F.xxhash64(*x), F.lit(blocks)).cast("int").alias("own"))
    if offsets is not None and 2 * offsets + 1 < blocks:  # a block, and those that have it among the blocks after them
        other = F.explode(F.array(*[F.pmod(F.col("own") + F.lit(d), F.lit(blocks)).cast("int") for d in range(-offsets, offsets + 1) if d])).alias("other")
    else:
        offsets, other = None, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    met = own.select("*", other).select(*x, "w", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        at, w, inside = pdf[x].to_numpy(float), pdf["w"].to_numpy(float), (pdf["own"] == pdf["p"]).to_numpy()
        same = pdf["p"].iat[0] == pdf["q"].iat[0]
        a, wa = at[inside], w[inside]
        b, wb = (a, wa) if same else (at[~inside], w[~inside])
        total = np.zeros(bins)
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            d = np.sqrt(np.clip((part**2).sum(1)[:, None] + (b**2).sum(1) - 2 * part @ b.T, 0, None))
            weight = wa[lo : lo + 256, None] * wb
            if same:  # each pair once
                weight = np.triu(weight, lo + 1)
            total += np.bincount(np.minimum((d / top * bins).astype(int), bins - 1).ravel(), weight.ravel(), bins)
        if same:
            total[0] += (wa * (wa - 1) / 2).sum()
        seen = np.flatnonzero(total)
        return pd.DataFrame({"b": seen.astype("int32"), "n": np.rint(total[seen]).astype("int64")})

    met = met.repartition(min(blocks * (blocks + 1) // 2 if offsets is None else blocks * offsets, 10_000), "p", "q")  # few bytes, much work: not to be coalesced
    rows = met.groupBy("p", "q").applyInPandas(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(bins)
    for r in rows:
        counts[r["b"]] = r["n"]
    if offsets is not None:
        equal = sized.agg(F.sum(F.col("w") * (F.col("w") - 1) / 2)).first()[0]
        counts *= (s["n"] * (s["n"] - 1) / 2 - equal) / counts.sum()
        counts[0] += equal
    return (np.arange(bins) + 0.5) * top / bins, counts


def reference_dispersions(spark: SparkSession, widths: list[float], n: int, ks: list[int], replicates: int, seed: int = 0, steps: int = 30, slice_rows: int = 1 << 16) -> np.ndarray:
    """Within-cluster dispersions (replicate x k) of `replicates` uniform boxes of n rows, by k-means from k of the rows.

    Rows are made again in each step, slice by slice over tasks; the driver holds replicates * sum(ks) centres only.
    """
    p, slices = len(widths), -(-n // slice_rows)
    which = np.repeat(np.arange(len(ks)), ks)  # the k of each centre
    first = np.concatenate([[0], np.cumsum(ks)])

    def rows_of(r: int, s: int) -> np.ndarray:
        return (np.random.default_rng([seed, r, s]).random((min(slice_rows, n - s * slice_rows), p)) - 0.5) * np.array(widths)

    def sums(centres: dict):
        def run(batches):
            for pdf in batches:
                out = []
                for i in pdf["id"]:
                    r, s = divmod(int(i), slices)
                    x = rows_of(r, s)
                    square = (x**2).sum(1)
                    for j, own in enumerate(centres[r]):
                        near = ((own**2).sum(1) - 2 * x @ own.T).argmin(1)
                        size = np.bincount(near, minlength=len(own))
                        total = np.stack([np.bincount(near, x[:, c], len(own)) for c in range(p)], 1)
                        ss = np.bincount(near, square, len(own))
                        out += [(r, int(first[j]) + m, int(size[m]), float(ss[m]), total[m].tolist()) for m in range(len(own))]
                yield pd.DataFrame(out, columns=["r", "m", "n", "ss", "total"])

        tasks = spark.range(0, replicates * slices, 1, max(1, min(replicates * slices, max(2 * spark.sparkContext.defaultParallelism, replicates * slices // 16))))
        parts = tasks.mapInPandas(run, "r int, m int, n long, ss double, total array<double>")
        return parts.groupBy("r", "m").agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), *[F.sum(F.get("total", F.lit(c))).alias(f"t{c}") for c in range(p)]).collect()

    start = {r: rows_of(r, 0)[: max(ks)] for r in range(replicates)}
    centres = {r: [x[:k] for k in ks] for r, x in start.items()}
    out = np.zeros((replicates, len(ks)))
    for _ in range(steps):
        out[:] = 0
        new = {r: [c.copy() for c in own] for r, own in centres.items()}
        for q in sums(centres):
            j = which[q["m"]]
            if q["n"]:
                total = np.array([q[f"t{c}"] for c in range(p)])
                new[q["r"]][j][q["m"] - first[j]] = total / q["n"]
                out[q["r"], j] += q["ss"] - (total**2).sum() / q["n"]
        moved = any(not np.allclose(a, b, rtol=0, atol=1e-9) for r in new for a, b in zip(new[r], centres[r]))
        centres = new
        if not moved:
            break
    return out


def gap_statistic(df: DataFrame, columns: list[str], ks=range(1, 7), replicates: int = 10, seed: int = 0) -> tuple[int, DataFrame]:
    """(chosen k, table of k, log_dispersion, gap, error): within-cluster dispersion against uniform boxes of as many rows.

    k is the least with gap(k) >= gap(k + 1) - error(k + 1).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    spark, ks = df.sparkSession, list(ks)
    v = VectorAssembler(inputCols=columns, outputCol="features").transform(df).select("features").cache()
    n = v.count()
    whole = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    cost = lambda k: KMeans(k=k, seed=seed).fit(v).summary.trainingCost if k > 1 else n * sum(whole)
    seen = [math.log(cost(k) + 1e-12) for k in ks]
    v.unpersist()
    box = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in columns]).first()
    e = np.log(reference_dispersions(spark, list(box), n, ks, replicates, seed) + 1e-12)
    rows = [(int(k), seen[i], float(e[:, i].mean()) - seen[i], float(e[:, i].std()) * math.sqrt(1 + 1 / replicates)) for i, k in enumerate(ks)]
    chosen = next((a[0] for a, b in zip(rows, rows[1:]) if a[2] >= b[2] - b[3]), rows[-1][0])
    return chosen, spark.createDataFrame(rows, "k int, log_dispersion double, gap double, error double")
