"""Binning: kernels against plain versions, the binner's contract, odd columns."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import bins as B
from scoreloom.operators import binning
from scoreloom.operators import binning_kernels as K
from scoreloom.operators.binning import METHODS, Binner, fit_splits


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        x = round(rng.random(), 3)
        y = int(rng.random() < 1 / (1 + math.exp(-6 * (x - 0.5))))
        rows.append((i, x, float(i % 9) if i % 10 else None, 5.0, None, float("inf") if i == 3 else x * 2, f"c{i % 3}", y))
    return spark.createDataFrame(rows, "id int, x double, few double, flat double, none double, odd double, text string, y int")


def plain_chimerge(x, n, b, bins, alpha, least):
    groups = [[v, r, h] for v, r, h in zip(x, n, b)]

    def chi(i):
        return K.pair_chi2(groups[i][1], groups[i][2], groups[i + 1][1], groups[i + 1][2])

    def merge(i):
        groups[i][1] += groups[i + 1][1]
        groups[i][2] += groups[i + 1][2]
        del groups[i + 1]

    while len(groups) > max(bins, 1):
        merge(min(range(len(groups) - 1), key=lambda i: (chi(i), i)))
    while len(groups) > 1 and min(chi(i) for i in range(len(groups) - 1)) < K.chi2_threshold(alpha):
        merge(min(range(len(groups) - 1), key=lambda i: (chi(i), i)))
    while least and len(groups) > 1 and min(g[1] for g in groups) < least:
        edges = [i for i in range(len(groups) - 1) if groups[i][1] < least or groups[i + 1][1] < least]
        merge(min(edges, key=lambda i: (chi(i), i)))
    return sorted({(a[0] + z[0]) / 2 for a, z in zip(groups, groups[1:])})


def counts(seed, m=40):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 30, m).astype(float)
    return np.arange(m, dtype=float), n, np.floor(n * rng.random(m) * np.linspace(0.3, 1, m))


@pytest.mark.parametrize("seed", range(6))
def test_chimerge_against_plain(seed):
    x, n, b = counts(seed)
    for bins, alpha, least in ((5, 0.05, None), (8, 0.5, 40), (3, 0.01, 100), (1, 0.05, None)):
        assert K.chimerge_splits(x, n, b, bins, alpha, least) == plain_chimerge(x, n, b, bins, alpha, least)


def test_chi_threshold():
    assert abs(K.chi2_threshold(0.05) - 3.841458820694124) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_kmeans_against_all_partitions(seed):
    rng = np.random.default_rng(seed)
    x, n = np.sort(rng.random(10)), rng.integers(1, 5, 10).astype(float)

    def cost(cuts):
        total = 0.0
        for a, z in zip([0, *cuts], [*cuts, 10]):
            mean = np.average(x[a:z], weights=n[a:z])
            total += (n[a:z] * (x[a:z] - mean) ** 2).sum()
        return total

    best = min(itertools.combinations(range(1, 10), 3), key=cost)
    centres = [np.average(x[a:z], weights=n[a:z]) for a, z in zip([0, *best], [*best, 10])]
    assert np.allclose(K.kmeans_splits(x, n, 4), [(a + z) / 2 for a, z in zip(centres, centres[1:])])
    assert K.kmeans_splits(x, n, 11) == []


def plain_kmeans(x, n, k):
    """The quadratic program in whole numbers, without rounding."""
    x, n, m = [int(v) for v in x], [int(v) for v in n], len(x)
    w, wx, wxx = ([0, *itertools.accumulate(v)] for v in (n, [a * b for a, b in zip(n, x)], [a * b * b for a, b in zip(n, x)]))
    w, wx, wxx = (np.array(v, float) for v in (w, wx, wxx))
    best, cuts = np.r_[0.0, wxx[1:] - wx[1:] ** 2 / w[1:]], []
    for c in range(1, k):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(c + 1, m + 1):
            i = np.arange(c, j)
            total = best[i] + wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / (w[j] - w[i])
            cut[j], new[j] = i[total.argmin()], total.min()
        cuts.append(cut)
        best = new
    ends = [m]
    for cut in reversed(cuts):
        ends.append(cut[ends[-1]])
    ends = [0, *reversed(ends)]
    centres = [(wx[b] - wx[a]) / (w[b] - w[a]) for a, b in zip(ends, ends[1:])]
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


@pytest.mark.parametrize("kind", ("plain", "outliers", "hot"))
def test_kmeans_many_values(kind, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.unique(rng.integers(0, 50_000, 4_500)).astype(float)
    n = rng.integers(1, 4, len(x)).astype(float)
    if kind == "outliers":
        x[-3:] = 1_000_000, 1_000_001, 2_000_000
    if kind == "hot":
        n[len(n) // 3] = 9 * n.sum()
    assert len(x) > 3_000
    wanted = plain_kmeans(x, n, 5)
    assert np.allclose(K.kmeans_splits(x, n, 5), wanted, rtol=1e-12, atol=0)
    monkeypatch.setattr(K, "BLOCK", 100)
    assert np.allclose(K.kmeans_splits(x, n, 5), wanted, rtol=1e-12, atol=0)


def test_kmeans_far_values():
    x = np.r_[-1e9, np.arange(5000.0), np.arange(5000.0) + 20_000, 1e9]
    got = K.kmeans_splits(x, np.ones(len(x)), 4)
    assert np.allclose(got, [(-1e9 + 2499.5) / 2, 12_499.5, (1e9 + 22_499.5) / 2])
    assert K.kmeans_splits(np.r_[-np.inf, 1.0, 2.0, np.inf], np.ones(4), 2) == [1.5]


def test_optimal_against_all_partitions():
    x, n, b = counts(5, 9)

    def worth(cuts, sign):
        rates, total = [], 0.0
        for a, z in zip([0, *cuts], [*cuts, 9]):
            r, h = n[a:z].sum(), b[a:z].sum()
            if r < 20:
                return -1
            bads, goods = max(h, 0.5) / b.sum(), max(r - h, 0.5) / (n - b).sum()
            total += (goods - bads) * math.log(goods / bads)
            rates.append(h / r)
        return total if all(sign * (q - p) > 0 for p, q in zip(rates, rates[1:])) else -1

    options = [c for k in range(4) for c in itertools.combinations(range(1, 9), k)]
    value, best = max(((worth(c, s), c) for c in options for s in (1, -1)), key=lambda t: t[0])
    assert value > 0 and K.optimal_splits(x, n, b, 4, 20, True) == [float((x[c - 1] + x[c]) / 2) for c in best]


def test_monotone_and_repair():
    splits, n, bad = K.monotone([1, 2, 3], [10, 10, 10, 10], [1, 5, 3, 8], True)
    rates = np.array(bad) / n
    assert (np.diff(rates) >= 0).all() and len(splits) == 2
    assert K.monotone([1, 2], [10, 10, 10], [9, 5, 1], "ascending")[0] == [1, 2]  # a direction that holds is left
    assert K.repaired([1, 2, 3], [50, 3, 40, 2], [5, 1, 4, 1], None, 5) == [1]
    assert K.repaired([1, 2, 3], [50, 0, 40, 20], [5, 0, 4, 1], True, None) == [1, 2, 3]


def test_least_rows():
    assert K.least_rows(None, 10) is None and K.least_rows(3, 10) == 3 and K.least_rows(0.25, 10) == 3 and K.least_rows(0.001, 10) == 1
    for bad, kind in ((True, TypeError), (0, ValueError), (11, ValueError), (1.5, ValueError)):
        with pytest.raises(kind):
            K.least_rows(bad, 10)


def test_codes_and_labels(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 1.0, 1.5, 2.0, 9.0)], "x double")
    codes = df.select(B.bin_code(F.col("x"), [1.0, 2.0]).alias("r"), B.bin_code(F.col("x"), [1.0, 2.0], "left").alias("l")).collect()
    assert [c.r for c in codes] == [-1, 0, 0, 1, 1, 2] and [c.l for c in codes] == [-1, 0, 1, 1, 2, 2]
    assert B.labels([1.23456789, 25.0]) == ["(-inf, 1.235]", "(1.235, 25.0]", "(25.0, inf]"]
    assert len(set(B.labels([0.00012346, 0.00012349]))) == 3


@pytest.mark.parametrize("method", METHODS)
def test_methods_and_least_rows(frame, method):
    splits = fit_splits(frame, ["x", "few", "flat", "none"], "y", method, 5, min_samples=0.1)
    assert "none" not in splits
    for f in ("x", "few"):
        got = frame.where(F.col(f).isNotNull()).groupBy(B.bin_code(F.col(f), splits[f]).alias("c")).count().collect()
        assert min(r["count"] for r in got) >= 0.1 * sum(r["count"] for r in got) or not splits[f]
    mono = fit_splits(frame, ["x"], "y", method, 6, monotonic=True)["x"]
    rates = [r[1] for r in sorted(frame.groupBy(B.bin_code(F.col("x"), mono).alias("c")).agg(F.avg("y")).collect())]
    assert rates == sorted(rates) or rates == sorted(rates, reverse=True)


@pytest.mark.parametrize("method", ("kmean", "dt", "chi", "opt"))
def test_every_distinct_value_counts(spark, method, monkeypatch):
    monkeypatch.setattr(binning, "MAX_VALUES", 500, raising=False)  # no bound by size may come between
    monkeypatch.setattr(binning, "CELLS", 20, raising=False)
    rng = np.random.default_rng(11)
    x = np.r_[rng.random(3000) * 100, np.full(2000, 50.0)]
    y = (rng.random(5000) < np.where((x > 31.4) & (x < 62.7), 0.7, 0.2)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    v, at = np.unique(x, return_inverse=True)
    n, bad = np.bincount(at).astype(float), np.bincount(at, y)
    wanted = {
        "kmean": lambda: K.kmeans_splits(v, n, 4),
        "dt": lambda: K.tree_splits(v, n, bad, 4, 250),
        "chi": lambda: K.chimerge_splits(v, n, bad, 4, 0.05, 250),
        "opt": lambda: K.optimal_splits(v, n, bad, 4, 250, None),
    }[method]()
    assert fit_splits(df, ["x"], "y", method, 4)["x"] == pytest.approx(wanted, rel=1e-12) and len(wanted) > 0


def test_pre_bins_follow_rows(spark):
    values = spark.createDataFrame([("x", float(i), 9000 if i == 300 else 1, i % 2) for i in range(1000)] + [("few", float(i), 5, 1) for i in range(3)], "feature string, x double, n long, bad long")
    got = binning.pre_binned(values, 100).toPandas()
    few, x = got[got.feature == "few"], got[got.feature == "x"].sort_values("x")
    assert sorted(few.x) == [0.0, 1.0, 2.0] and few.n.tolist() == [5, 5, 5]
    assert len(x) <= 100 and x.n.sum() == 9999 and x.bad.sum() == 500
    assert sorted(x.n)[-2] <= 101 and 9000 in x.n.tolist()


def test_binner_contract(frame):
    b = Binner()
    with pytest.raises(ValueError, match="not fitted"):
        b.transform(frame)
    b.fit(frame, "y", ["x", "few"], "quantile", 4)
    stats = b.stats().toPandas()
    for f in ("x", "few"):
        own = stats[stats.feature == f]
        assert own.total.sum() == 400 and np.isclose(own.iv.sum(), b.iv_[f]) and own.cum_total.max() == 400
    assert (stats[stats.feature == "few"].sort_values("cum_total").bin.iloc[-1]) == "Missing"
    again = Binner().load(b.export())
    assert again.rules_ == b.rules_ and again.woe_transform(frame).agg(F.sum("x")).first()[0] == pytest.approx(b.woe_transform(frame).agg(F.sum("x")).first()[0])
    b.set_splits("x", [0.5, 0.2, 0.5])
    assert b["x"].splits == [0.2, 0.5] and set(b["x"].woe_map) <= {"(-inf, 0.2]", "(0.2, 0.5]", "(0.5, inf]"}
    with pytest.raises(KeyError):
        b["nothing"]
    for held in ({"x": {"woe_map": {}}}, {"x": {"woe": {}}}):
        with pytest.raises(ValueError):
            Binner().load(held)
    with pytest.raises(ValueError):
        Binner().load({"x": {"splits": [1.0]}}).woe_transform(frame)
    with pytest.raises(ValueError, match="unknown binning method"):
        fit_splits(frame, ["x"], "y", "nope")
    with pytest.raises(ValueError):
        fit_splits(frame, ["x"], None, "chi")
    with pytest.raises(ValueError, match="labels"):
        fit_splits(frame.withColumn("y", F.col("id") % 3), ["x"], "y", "chi")
    assert Binner().fit(frame.where("1=0"), "y", ["x"], "quantile").rules_ == {}
