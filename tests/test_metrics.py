"""Metrics, stability, tables: hand values, weights as repetition, odd groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import columns as C
from scoreloom.functions.quantiles import quantiles
from scoreloom.operators import correlation, metrics, psi, tables, woe


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        s = None if i % 50 == 0 else float(np.round(rng.normal(), 1))
        y = -1 if i % 40 == 0 else None if i % 77 == 0 else int(rng.random() < 1 / (1 + math.exp(-(s or 0))))
        rows.append((i, y, s, int(rng.integers(0, 4)), ["train", "test", "OOT", " ", None][i % 5], f"2024{i % 3 + 1:02d}", float(rng.integers(1, 100)), float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "id int, y int, s double, w int, tag string, m string, loan double, prin double")


def plain_auc(rows):
    good, bad = [s for y, s, w in rows for _ in range(w) if y == 0], [s for y, s, w in rows for _ in range(w) if y == 1]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))


def test_auc_ks_weighted(scored):
    rows = [(r.y, r.s, r.w) for r in scored.collect() if r.y in (0, 1) and r.s is not None]
    assert metrics.auc(scored, "y", "s").first()[0] == pytest.approx(plain_auc([(y, s, 1) for y, s, _ in rows]))
    assert metrics.auc(scored, "y", "s", "w").first()[0] == pytest.approx(plain_auc(rows))
    repeated = scored.where("w > 0").withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    assert metrics.ks(scored, "y", "s", "w").first()[0] == pytest.approx(metrics.ks(repeated, "y", "s").first()[0])
    assert metrics.gini(scored, "y", "s").first()[0] == pytest.approx(2 * metrics.auc(scored, "y", "s").first()[0] - 1)
    turned = metrics.binary_metrics(scored, "y", "s", reverse_auc=True).first()
    assert turned["AUC"] == pytest.approx(1 - metrics.auc(scored, "y", "s").first()[0])


def test_counts_and_single_class(spark, scored):
    r = metrics.binary_metrics(scored, "y", "s").first()
    rows = scored.collect()
    assert (r["总"], r["好"], r["坏"]) == (600, sum(x.y == 0 for x in rows), sum(x.y == 1 for x in rows))
    one = metrics.binary_metrics(scored.where("y = 1"), "y", "s").first()
    assert one["KS"] is None and one["AUC"] is None and one["10%lift"] is None
    none = metrics.binary_metrics(scored.where("1=0"), "y", "s").first()
    assert none["总"] == 0 and none["坏占比"] is None
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert metrics.ks(perfect, "y", "s").first()[0] == 1
    with pytest.raises(ValueError):
        metrics.binary_metrics(perfect, "y", "s", mode="nope")


def test_lift_hand_values(spark):
    df = spark.createDataFrame([(i, int(y), p / 10) for i, (y, p) in enumerate(zip("1111110000", [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]))], "i int, y int, p double")
    assert metrics.lift_at_k(df, "y", "p", 0.1, ["i"]) == pytest.approx(1 / 0.6)
    assert metrics.lift_at_k(df, "y", "p", 1.0) == pytest.approx(1.0)
    with pytest.warns(UserWarning):
        assert math.isnan(metrics.lift_at_k(df, "y", "p", 0.0))
    assert metrics.lift_at_k(df.withColumn("y", F.lit(0)), "y", "p", 0.1, ["i"]) == 0.0
    assert metrics.lift_table(df, "y", "p", 5).count() == 5


def test_binned_few_scores(spark):
    df = spark.createDataFrame([(i % 2, float(i % 3)) for i in range(60)] + [(1, 5.0)], "y int, s double")
    exact, binned = metrics.binary_metrics(df, "y", "s").first(), metrics.binary_metrics(df, "y", "s", mode="binned").first()
    assert exact["坏"] == binned["坏"] and 0 <= binned["AUC"] <= 1
    by = metrics.binary_metrics(df.withColumn("g", F.col("s") > 100), "y", "s", ["g"], mode="binned").first()
    assert by["AUC"] == pytest.approx(binned["AUC"])


def test_psi_properties(scored):
    assert psi.psi(scored, scored, "s") == pytest.approx(0, abs=1e-12)
    assert psi.psi(scored, scored.where("s > 0"), "s") > 0.5
    assert psi.psi(scored, scored.where("1=0"), "s") is None
    assert psi.psi(scored.where("s is null"), scored, "s") is not None
    for bad in ({"buckets": 0}, {"nan_strategy": "nope"}):
        with pytest.raises(ValueError):
            psi.psi(scored, scored, "s", **bad)


def test_grouped_psi(scored):
    out = {r.m: r for r in psi.grouped_psi(scored, ["m"], "s", include_stats=True).collect()}
    assert out["202403"].psi == pytest.approx(0, abs=1e-12) and out["202403"].is_reference and not out["202401"].is_reference
    assert out["202401"].sample_count == 200
    blank = scored.withColumn("m", F.when(F.col("m") != "202401", F.col("m")))
    latest = {r.m: r.psi for r in psi.grouped_psi(blank, ["m"], "s").collect()}
    assert latest[None] == pytest.approx(0, abs=1e-12)  # a blank month is the latest
    with pytest.raises(ValueError):
        psi.grouped_psi(scored, ["m"], "s", "value")
    with pytest.raises(KeyError):
        psi.grouped_psi(scored, ["nothing"], "s")
    by_tag = psi.latest_month_psi(scored, "tag", "m", "s")
    assert by_tag.count() == scored.select("tag", "m").distinct().count()


def test_iv_hand_values(spark):
    df = spark.createDataFrame([("a", 0)] * 6 + [("a", 1)] * 2 + [("b", 0)] * 2 + [("b", 1)] * 5 + [(None, 0)], "c string, y int")
    rows = {r.bin: r for r in woe.categorical_iv(df, ["c"], "y").collect()}
    assert set(rows) == {"a", "b", "Missing"}
    assert rows["a"].woe == pytest.approx(math.log((6 / 9) / (2 / 7))) and rows["Missing"].dist_bad == pytest.approx(1 / 7)
    assert woe.batch_iv(df.where("y = 0"), ["c"], "y").first().iv == 0
    e = woe.WOETransformer(["c"]).fit(df, "y")
    assert e.transform(spark.createDataFrame([("z",)], "c string")).first().c == 0.0
    assert woe.WOETransformer().load(e.export()).export() == e.export()
    with pytest.raises(ValueError):
        woe.WOEEncoder("c").transform(df)
    flat = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, y int")
    assert woe.batch_iv(flat, ["x"], "y").first().iv == 0


def test_tables(scored):
    t = tables.label_distribution(scored, "y", "tag", "m").toPandas()
    assert t["灰"].sum() == 15 and list(t["样本集"].dropna().str.strip())[0] == "train"
    perf = tables.bin_performance(scored, "y", "s", [-0.5, 0.5]).collect()
    assert perf[-1].bin == "Missing" and perf[-1].cum_bads_prop == pytest.approx(1)
    whole = tables.bin_metrics(scored, "y", "s", 4, principal="prin", loan="loan").toPandas()
    assert whole["放款金额占比"].sum() == pytest.approx(1) and whole["total"].sum() == scored.where("y in (0, 1)").count()
    for bad in ({"bins": [1.0]}, {"bins": [2.0, 1.0]}, {"q": 1}, {"principal": "prin"}):
        with pytest.raises(ValueError):
            tables.bin_metrics(scored, "y", "s", **bad)
    a, b = tables.split_metrics(scored, ["y"], "s", "tag", "m", principal="prin", loan="loan")
    assert a.count() == 5 and b.count() == 3 and "金额AUC" in a.columns
    assert tables.model_comparison(scored.withColumn("s2", F.col("s") + 1), "y", ["s", "s2"], ["tag"], tag="tag").count() == 10
    ups = tables.score_direction(scored.withColumn("my_score", -F.col("s")), "y", ["s", "my_score"], "tag").collect()
    assert [r["AUC反向"] for r in ups] == [False, True]


def test_keys(spark):
    df = spark.createDataFrame([("2024-01-15 10:00",), ("20240309",), ("202405xx",), ("n/a",), (None,), (" ",)], "m string")
    assert [r[0] for r in df.select(C.month_text(df, "m")).collect()] == ["202401", "202403", "202405", "n/a", "", ""]
    tags = spark.createDataFrame([("oot",), ("Train",), (None,), ("zz",), ("test",)], "t string")
    assert [r.t for r in C.report_order(tags, tag="t").collect()] == ["Train", "test", "oot", None, "zz"]
    bad = spark.createDataFrame([("x",), ("1.5",), (None,)], "v string")
    assert [r[0] for r in bad.select(C.numeric(bad, "v")).collect()] == [None, 1.5, None]


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=30_000), np.full(20_000, 0.25), rng.normal(size=5) * 1e6]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    p = [0, 0.001, 0.1, 0.5, 0.77, 0.9999, 1]
    assert np.allclose(quantiles(df, ["x"], p)["x"], np.quantile(x, p))
    assert quantiles(df.where("1=0"), ["x"], p)["x"] == []


def test_correlations(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 6, 80).astype(float)
    b = a + rng.integers(0, 4, 80)
    df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, b)] + [(None, 1.0, 1.0)], "a double, b double, k double")
    conc = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(80) for j in range(i))
    ta, tb = (sum(x[i] != x[j] for i in range(80) for j in range(i)) for x in (a, b))
    assert correlation.correlation_matrix(df, ["a", "b"], "kendall").loc["a", "b"] == pytest.approx(conc / math.sqrt(ta * tb))
    assert correlation.correlation_matrix(df, ["a", "b"]).loc["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert np.isnan(correlation.correlation_matrix(df, ["a", "k"]).loc["a", "k"])
    v = dict(correlation.vif(df, ["a", "b"]))
    assert v["a"] == pytest.approx(1 / (1 - np.corrcoef(a, b)[0, 1] ** 2)) and correlation.vif(df, ["a"]) == [("a", 1.0)]
    assert dict(correlation.vif(df, ["a", "k"])) == {"a": pytest.approx(1), "k": 1.0}
    assert math.isinf(dict(correlation.vif(df.withColumn("c", 2 * F.col("a")), ["a", "c"]))["a"])
    with pytest.raises(ValueError):
        correlation.correlations(df, ["a", "b"], "nope")
