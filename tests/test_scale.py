"""Ways that only large inputs take, forced on small ones, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import bins
from scoreloom.functions import quantiles as Q
from scoreloom.functions import running
from scoreloom.functions.quantiles import long_form, quantile_rows
from scoreloom.operators import correlation, metrics, woe


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=6000), 2)
    return pd.DataFrame({"g": rng.choice(["a", "b", None], 6000, p=[0.7, 0.2, 0.1]), "x": x, "z": np.round(x * 0.3 + rng.normal(size=6000), 1), "y": rng.integers(0, 2, 6000), "w": rng.integers(0, 4, 6000)})


@pytest.mark.parametrize("most", [40, 300, 10**6])
def test_running_sums(spark, frame, most):
    own = frame.groupby(["g", "x"], dropna=False, as_index=False).agg(n=("y", "size"), b=("y", "sum"))
    got = running.running_sums(spark.createDataFrame(own), ["g"], "x", ["n", "b"], most).toPandas().sort_values(["g", "x"])
    own = own.sort_values(["g", "x"])
    for c in ("n", "b"):
        groups = own.groupby("g", dropna=False)[c]
        assert list(got[f"before_{c}"]) == list(groups.cumsum() - own[c]) and list(got[f"all_{c}"]) == list(groups.transform("sum"))
    alone = running.running_sums(spark.createDataFrame(own[own.g == "a"][["x", "n"]]), [], "x", ["n"], most).toPandas().sort_values("x")
    assert list(alone.before_n) == list(own[own.g == "a"].n.cumsum() - own[own.g == "a"].n)


@pytest.mark.parametrize("most", [50, 10**6])
def test_quantiles_in_stretches(spark, frame, most, monkeypatch):
    monkeypatch.setattr(running, "MOST", most)
    places = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(frame)
    rows = quantile_rows(long_form(df, ["x", "z"]), places).toPandas()
    for c in ("x", "z"):
        assert np.allclose(rows[rows.feature == c].sort_values("place").value, frame[c].quantile(places))
    rows = quantile_rows(df.select(F.lit("x").alias("feature"), "x", "w"), places, times="w").toPandas().sort_values("place")
    assert np.allclose(rows.value, np.quantile(np.repeat(frame.x, frame.w), places))
    held = Q.quantiles(df, ["x", "z"], places)
    monkeypatch.setattr(Q, "HELD", 0)
    assert all(np.allclose(held[c], v) for c, v in Q.quantiles(df, ["x", "z"], places).items())
    out = metrics.binary_metrics(df, "y", "x", ["g"]).toPandas()
    assert len(out) == 3 and out["AUC"].between(0.4, 0.6).all()


def tau(x, y):
    a, b = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


@pytest.mark.parametrize("most", [100, 1000, 10**6])
def test_kendall(spark, frame, most, monkeypatch):
    monkeypatch.setattr(correlation, "MOST", most)
    own = frame.head(2500).assign(k=1)
    rows = correlation.correlations(spark.createDataFrame(own), ["x", "z", "w", "k"], "kendall").toPandas().set_index(["var1", "var2"]).correlation
    for a, b in (("x", "z"), ("x", "w"), ("z", "w")):
        assert np.isclose(rows[a, b], tau(own[a].to_numpy(), own[b].to_numpy()))
    assert rows.isna().sum() == 3  # of the constant


def test_discordant_pairs():
    rng = np.random.default_rng(22)
    for _ in range(20):
        x, y, n = rng.integers(0, 6, 40), rng.integers(0, 9, 40), rng.integers(1, 4, 40)
        want = sum(n[i] * n[j] for i in range(40) for j in range(40) if x[i] < x[j] and y[i] > y[j])
        assert correlation.discordant(x, y, n) == want


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_many_pairs(spark, frame, method, monkeypatch):
    own = frame[["x", "z", "y", "w"]].astype(float).assign(k=3.0)
    own.loc[::7, "x"], own.loc[::5, "z"] = np.nan, np.nan
    few = correlation.correlations(spark.createDataFrame(own), list(own.columns), method).toPandas().correlation
    monkeypatch.setattr(correlation, "PAIRS", 0)
    many = correlation.correlations(spark.createDataFrame(own), list(own.columns), method).toPandas().correlation
    assert np.allclose(few, many, equal_nan=True) and many.isna().sum() == 4


def test_weights_of_many_values(spark, frame, monkeypatch):
    df = spark.createDataFrame(frame.assign(t=frame.x.astype(str)))
    want = woe.WOETransformer(["t", "g"]).fit(df, "y")
    monkeypatch.setattr(woe, "IN_PLAN", 5)
    got = woe.WOETransformer(["t", "g"]).fit(df, "y")
    assert got.encoders["t"].table is None and got.encoders["g"].table == want.encoders["g"].table
    assert dict(got.iv_table()) == pytest.approx(dict(want.iv_table()))
    a, b = (w.transform(df).groupBy("t", "g").count().toPandas().sort_values(["t", "g"]) for w in (want, got))
    assert np.allclose(a.t, b.t) and list(a["count"]) == list(b["count"])
    assert got.export() == want.export()


def test_edges_in_plan_and_joined(spark, frame, monkeypatch):
    long = long_form(spark.createDataFrame(frame.assign(x=frame.x.where(frame.index % 9 > 0))), ["x", "z", "w"])
    edges = {"x": [-0.5, 0.2], "z": [], "w": None}
    few = bins.coded_by_feature(long, edges, "b").groupBy("feature", "b").count().toPandas().sort_values(["feature", "b"], ignore_index=True)
    monkeypatch.setattr(bins, "IN_PLAN", 0)
    many = bins.coded_by_feature(long, edges, "b").groupBy("feature", "b").count().toPandas().sort_values(["feature", "b"], ignore_index=True)
    assert few.equals(many) and list(few[few.feature == "x"].b) == [-1, 0, 1, 2] and list(few[few.feature == "w"].b) == [0]


@pytest.mark.parametrize("n", [2, 3, 7, 10, 11, 12, 101, 1000])
def test_positions_of_batch_iv(spark, n):
    """Every position of every run of equal values, few and many of them."""
    rng = np.random.default_rng(n)
    for values in (np.arange(n), np.sort(rng.integers(0, max(2, n // 3), n)), np.r_[np.zeros(n - 1), 1.0]):
        x, total = np.unique(values.astype(float), return_counts=True)
        rows = spark.createDataFrame([("f", float(a), int(b)) for a, b in zip(x, total)], "feature string, x double, total long")
        k = min(10, len(x))
        want = sorted({float(values[round((n - 1) * i / k)]) for i in range(k + 1)})[1:-1]
        assert woe._positions(rows, 10, n) == ({"f": want} if len(x) > 1 else {})
