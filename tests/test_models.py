"""Regression, scorecards, selection, pipeline, report, sources, configuration, streams."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.config import Config, load_conf
from scoreloom.operators.binning import Binner
from scoreloom.operators.logistic import LogisticModel, fit_many
from scoreloom.operators.scorecard import Scorecard
from scoreloom.operators.selection import FeatureSelector, PostFilter, StepwiseSelector, eda_summary
from scoreloom.plans import Report, ScorecardPipeline
from scoreloom.sources import normalise_dictionary, read_spaced, write_workbook
from scoreloom.streaming import psi_counts, scored


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(900, 4))
    p = 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.8 * x[:, 1])))
    y = (rng.random(900) < p).astype(int)
    rows = [(i, *map(float, v), None if i % 30 == 0 else float(v[0] + v[1]), int(t), ["train", "test", "oot"][i % 3], f"2024-0{i % 3 + 1}-05", f"d{i % 2}", float(abs(v[2]) * 100 + 1), float(abs(v[3]) * 10)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, y int, tag string, day string, dim string, loan double, prin double").cache()


def newton(x, y, w=None):
    x, w = np.c_[np.ones(len(x)), x], np.ones(len(x)) if w is None else w
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logistic_against_newton(data, tmp_path):
    pdf = data.toPandas()
    m = LogisticModel().fit(data, ["a", "b", "c"], "y")
    beta, se = newton(pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy())
    assert np.allclose([t["coefficient"] for t in m.table_], beta, atol=1e-7) and np.allclose([t["std_error"] for t in m.table_], se, atol=1e-6)
    w, _ = newton(pdf[["a"]].to_numpy(), pdf.y.to_numpy(), pdf.loan.to_numpy())
    assert np.allclose([t["coefficient"] for t in LogisticModel().fit(data, ["a"], "y", "loan").table_], w, atol=1e-6)
    m.dump(tmp_path / "m.json")
    again = LogisticModel.load(tmp_path / "m.json")
    assert again.coefficients_ == m.coefficients_ and again.stats_ == m.stats_
    p = again.predict(again.predict_proba(data)).where("prediction != cast(probability >= 0.5 as int)").count()
    assert p == 0 and "a" in m.significant()
    small = LogisticModel("l1", 1e6).fit(data, ["a", "b"], "y").coefficients_
    assert small["a"] == small["b"] == 0
    assert fit_many(data.withColumn("a2", 2 * F.col("a")), [["a"], ["a", "a2"]], "y")[1] is None
    with pytest.raises(ValueError):
        LogisticModel().fit(data.where("y = 1"), ["a"], "y")
    with pytest.raises(ValueError, match="not fitted"):
        LogisticModel().predict(data)


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
@pytest.mark.parametrize("criterion", ["aic", "bic", "pvalue"])
def test_stepwise(data, direction, criterion):
    s = StepwiseSelector(direction, criterion).fit(data, ["a", "b", "c", "d"], "y")
    assert {"a", "b"} <= set(s.selected_) and (criterion != "bic" or set(s.selected_) == {"a", "b"})
    assert [h["iteration"] for h in s.history_] == list(range(1, len(s.history_) + 1))
    forced = StepwiseSelector("forward", criterion, exclude=["d"]).fit(data, ["a", "d"], "y")
    assert "d" in forced.selected_


def test_stepwise_errors():
    for bad in ({"direction": "x"}, {"criterion": "p-value"}):
        with pytest.raises(ValueError):
            StepwiseSelector(**bad)


def test_selector_and_postfilter(data):
    wide = data.withColumn("a2", F.col("a") * 2).withColumn("none", F.lit(None).cast("double"))
    s = FeatureSelector(iv_threshold=0.001, corr_threshold=0.95).fit(wide, "y", ["a", "a2", "b", "none", "dim"])
    assert s.removed_["none"].startswith("missing_rate") and s.removed_["a2"].startswith("high_corr: a(") and "a" in s.selected_
    assert {r["feature"] for r in s.report()} == {"a", "a2", "b", "none", "dim"}
    p = PostFilter(vif_threshold=10).fit(wide.where("tag = 'train'"), wide.where("tag = 'test'"), ["a", "a2", "b", "gone"])
    assert p.selected_ == ["a2", "b"] and p.removed_["a"].startswith("vif")
    shifted = data.withColumn("a", F.col("a") + 5)
    assert "a" in PostFilter().fit(data, shifted, ["a", "b"]).removed_
    with pytest.raises(ValueError):
        eda_summary(data, ["a"], ["nope"])
    e = {r.feature: r for r in eda_summary(data, ["e", "dim"]).collect()}
    assert e["e"]["count"] == 870 and e["dim"].unique_count == 2 and e["dim"]["mean"] is None


def test_scorecard(spark, data, tmp_path):
    b = Binner().fit(data, "y", ["a", "e"], "quantile", 4)
    w = b.woe_transform(data)
    m = LogisticModel().fit(w, ["a", "e"], "y")
    for decimals in (None, 0, 2):
        card = Scorecard.build(b, m, points_decimals=decimals)
        data.createOrReplaceTempView("card_rows")
        both = card.score(spark.sql(card.to_sql("card_rows", "by_sql", breakdown=True)), "by_expression", breakdown=True)
        assert both.where("abs(by_sql - by_expression) > 1e-9").count() == 0
        assert both.where("by_sql is null").count() == 0
        card.dump(tmp_path / "card.json")
        assert Scorecard.load(tmp_path / "card.json") == card
    card = Scorecard.build(b, m)
    # a score is linear in the log odds of the model
    linear = m.predict_proba(w).select("id", "probability").join(card.score(data).select("id", "score"), "id")
    gap = linear.select(F.abs(F.col("score") - (card.offset - card.factor * F.ln(F.col("probability") / (1 - F.col("probability"))))).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-8 and card.rows()[0] == ("Intercept", "-", 0.0, card.intercept_points)
    half = Scorecard(intercept=0, splits={"x": []}, woe={"x": [0.0, -1.5 / (20 / math.log(2))]}, coefficients={"x": 1.0}, points_decimals=0)
    assert half.points("x") == [0, 2]
    with pytest.raises(ValueError):
        Scorecard(points_decimals=-1)
    with pytest.raises(ValueError):
        Scorecard.build(b, {"coefficients": {"const": 0.0, "zz": 1.0}})
    with pytest.raises(ValueError):
        Scorecard().score(data)
    assert scored(data, card).columns[-1] == "score"


def test_pipeline_and_report(data, tmp_path):
    p = ScorecardPipeline(data.where("tag = 'train'"), "y", data.where("tag = 'test'"), ["a", "b", "c", "e"])
    with pytest.raises(ValueError, match="comes after"):
        p.woe_transform()
    with pytest.raises(ValueError):
        p.score(data)
    p.prefilter(iv_threshold=0.01, corr_threshold=0.95).bin(method="quantile").woe_transform().postfilter(psi_threshold=1.0).build_model().generate_scorecard()
    out = p.predict_proba(p.score(data))
    assert out.where("score is null or probability is null").count() == 0
    assert out.corr("score", "probability") < -0.9
    r = Report(out, ["y"], "probability", "tag", "day", ["a"], ["dim"], ["loan"], ["c"], "prin", "loan", p.card)
    assert r.available()[-4:] == ["dimensional_comparison", "model_comparison", "amount_metrics", "portrait"]
    sheets = r.build(["portrait", 5, "model_comparison"])
    assert [s.name for s in sheets] == ["评分卡计算明细", "附1 新老模型对比", "附2 画像变量"]
    r.write(tmp_path / "r.xlsx", ["scorecard_details", "portrait"])
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert "附1 画像变量" in z.read("xl/workbook.xml").decode() and z.testzip() is None
    for bad in (["nope"], []):
        with pytest.raises(ValueError):
            r.build(bad)
    with pytest.raises(ValueError):
        Report(out, ["y"], "probability", "tag", "day", principal="prin")


def test_sources_and_config(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 2  3\n\n  4\t5\n")
    assert [tuple(r) for r in read_spaced(spark, str(tmp_path / "t.txt"), ["a", "b", "c"]).collect()] == [("1", "2", "3"), ("4", "5", None)]
    d = spark.createDataFrame([("x", " ", "t1"), ("y", "why", None)], "`变量名` string, `含义` string, `表名` string")
    rows = [tuple(r) for r in normalise_dictionary(d).collect()]
    assert rows == [("x", None, "t1", None), ("y", "why", None, None)]
    write_workbook(tmp_path / "w.xlsx", {"s": [("t", ["n", "坏占比"], [[1, float("nan")], ["<&>", 0.5]])]})
    (tmp_path / "c.json").write_text(json.dumps({"binning": {"n_bins": 7}}))
    (tmp_path / "c.toml").write_text("[points]\npdo = 50.0\n")
    (tmp_path / "c.yaml").write_text("filtering:\n  iv_threshold: 0.1\n")
    assert load_conf(tmp_path / "c.json").binning.n_bins == 7 and load_conf(tmp_path / "c.toml").points.pdo == 50 and load_conf(tmp_path / "c.yaml").filtering.iv_threshold == 0.1
    assert Config().binning.n_bins == 5
    for text in ('{"nope": {}}', '{"binning": {"nope": 1}}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            load_conf(tmp_path / "bad.json")


def test_stream_counts(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 10:00:00", None if i % 10 == 0 else float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, x double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = psi_counts(stream, "x", [2.0, 4.0], "t").writeStream.outputMode("complete").format("memory").queryName("psi_counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {(r.start, r.bucket): r.n for r in spark.table("psi_counts").collect()}
    assert got == {(r.start, r.bucket): r.n for r in psi_counts(df, "x", [2.0, 4.0], "t").collect()} and sum(got.values()) == 60
