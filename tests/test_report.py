"""Feature tables, importance, the report's sheets and charts, interactive tables, text features and own methods."""

import math
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom import interactive
from scoreloom.functions.columns import date_range
from scoreloom.operators import features
from scoreloom.operators.binning import BaseBinner
from scoreloom.operators.importance import ModelView
from scoreloom.operators.logistic import LogisticModel
from scoreloom.operators.scorecard import Scorecard
from scoreloom.plans import Report, ScorecardPipeline
from scoreloom.sources import Chart, write_workbook


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(31)
    n = 1600
    a, b = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    p = 1 / (1 + np.exp(-(a - 0.4 * b + 0.3)))
    y = (rng.random(n) < p).astype(int)
    y[::40] = -1
    a = np.where(np.arange(n) % 17 == 0, np.nan, a)
    return pd.DataFrame({
        "tag": np.resize(["train", "train", "oot", "test"], n), "day": np.resize(["2024-01-31", "2024-02-28", "2024/03/30", "bad"], n + 1)[:n], "y": y, "probability": p, "score_old": 1000 - 1000 * p,
        "a": a, "b": b, "t": np.where(b > 2, "hi", np.where(b > 0, "mid", None)), "dim": np.resize(["x", "y", None], n), "principal": y.clip(0) * 10.0, "loan": 100.0,
    })


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def edges_of(x, bins=10):
    return sorted(set(x.dropna().quantile([i / bins for i in range(bins + 1)])))[1:-1]


def test_monthly_metrics_against_plain(df, frame):
    train = frame[frame.tag == "train"]
    out = features.monthly_metrics(df, df.where("tag = 'train'"), ["a", "b"], "y", "tag", {"b": [1.5, 3.0]}).toPandas().set_index(["feature", "month"])
    for f, cuts in (("a", edges_of(train.a)), ("b", [1.5, 3.0])):
        def code(x):
            return np.where(x.isna(), -1, np.searchsorted(cuts, x, side="left"))

        own = train[train.y >= 0]
        rate = pd.Series(own.y.to_numpy()).groupby(code(own[f])).mean()
        for tag in ("train", "oot", "test"):
            part = frame[(frame.tag == tag) & (frame.y >= 0)]
            score, y = pd.Series(code(part[f])).map(rate).to_numpy(), part.y.to_numpy()
            above = (score[y == 1][:, None] > score[y == 0][None]).mean() + (score[y == 1][:, None] == score[y == 0][None]).mean() / 2
            row = out.loc[f, tag]
            assert math.isclose(row["AUC"], above) and (row["总"], row["坏"]) == (len(part), y.sum())
            side = "left" if f == "b" else "right"
            inner = cuts if f == "b" else edges_of(own[f])
            counts = [np.bincount(np.where(x.isna(), 0, 1 + np.searchsorted(inner, x, side=side)), minlength=len(inner) + 2) for x in (own[f], part[f])]
            e, c = (np.maximum(v / v.sum(), 1e-8) for v in counts)
            assert math.isclose(row["PSI"], ((c - e) * np.log(c / e)).sum(), abs_tol=1e-9)


def test_variable_table_dictionary_and_empty_set(spark, df):
    names = spark.createDataFrame([("a", "alpha", "s1", "t1"), ("a", "alpha2", "s1", "t2"), ("zz", "other", "s2", None)], "`英文名` string, `中文名` string, `来源` string, `指标表英文名` string")
    train, none = df.where("tag = 'train'"), df.where("1 = 0")
    out = features.variable_table(train, none, ["b", "a"], "y", None, [{"feature": "a", "gain": 2.0, "gain_per": 1.0, "weight": 1.0, "weight_per": 1.0}], names).toPandas()
    assert list(out["vars"]) == ["a", "b"] and list(out["序号"]) == [1, 2] and list(out.columns) == list(features.VARIABLES)
    assert list(out["变量解释含义"]) == ["alpha", ""] and list(out["指标表英文名"]) == ["t1", "b"]
    assert out["iv_oot"].isna().all() and out["psi"].isna().all() and out["iv_train"].notna().all()
    types = features.type_distribution(spark, ["a", "b"], names).toPandas().set_index("变量类型")
    assert types.loc["s1", "变量数量"] == 1 and math.isclose(types["重要性占比"].sum(), 1)
    assert features.selection_summary(spark, 40).first()["剩余变量数量"] == 30


class Booster:
    params = {"num_iterations": 7, "lambda_l2": 1.5}

    def feature_importance(self, importance_type):
        return [3.0, 1.0, 3.0] if importance_type == "gain" else [1, 9, 2]

    def feature_name(self):
        return ["p", "q", "r"]


class Wrapped:
    booster_ = Booster()


class Xgb:
    feature_names = ["p", "q"]

    def get_score(self, importance_type):
        return {"p": 1.0, "x": 4.0} if importance_type == "gain" else {"p": 2.0}


class Forest:
    feature_importances_ = [0.2, 0.8]


def test_importance_of_models():
    assert [(r["feature"], r["gain"], r["weight"]) for r in ModelView(Wrapped()).importance()] == [("r", 3.0, 2.0), ("p", 3.0, 1.0), ("q", 1.0, 9.0)]
    assert dict((n, v) for n, v, _ in ModelView(Wrapped()).parameters())["n_estimators"] == "7"
    rows = ModelView(Xgb()).importance()
    assert [(r["feature"], r["gain_per"], r["weight_per"]) for r in rows] == [("x", 0.8, 0.0), ("p", 0.2, 1.0), ("q", 0.0, 0.0)]
    assert [r["feature"] for r in ModelView(Forest()).importance()] == ["feature_1", "feature_0"] and ModelView(Forest()).summary() == []
    card = Scorecard(splits={"x": [1.0], "z": []}, woe={"x": [0.0, 1.0, -1.0], "z": [0.0, 0.0]}, coefficients={"x": -2.0, "z": 0.0})
    assert [r["gain_per"] for r in ModelView(card).importance()] == [1.0, 0.0]
    stats = [{"feature": "z", "coefficient": 0.5}, {"feature": "z", "coefficient": 9.0}]
    assert [r["coefficient"] for r in ModelView(card, stats).summary()] == [None, 0.5]
    flat = Scorecard(splits={"x": [1.0]}, woe={"x": [0.0, 1.0, -1.0]}, coefficients={"x": 0.0})
    assert ModelView(flat).importance()[0]["gain"] == 0.0


def test_report_with_model_and_charts(df, tmp_path):
    p = ScorecardPipeline(df.where("tag = 'train'"), "y", None, ["a", "b"]).bin(method="quantile").woe_transform().build_model().generate_scorecard()
    r = Report(df, ["y"], "probability", "tag", "day", ["a", "b"], ["dim"], ["score_old"], ["a"], "principal", "loan", p.card, model=ModelView(p.card, p.model))
    r.write(tmp_path / "r.xlsx")
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        names = z.namelist()
        for n in names:
            ET.fromstring(z.read(n))
        charts = [n for n in names if "charts/" in n]
        assert len(charts) == 4 and all(f"/{n}" in z.read("[Content_Types].xml").decode() for n in charts)
        text = "".join(z.read(n).decode() for n in names if "worksheets/sheet" in n)
    for title in ("一、目标与设计方案", "一、变量筛选", "二、变量分析", "三、模型统计摘要", "1.a 按月效果", "2.b OOT分箱表", "std_error", "20240131-20240228"):
        assert title in text or title.replace("1.a", "1.b") in text or title.replace("2.b", "2.a") in text
    assert "gain_per" not in text  # of trees only


def test_workbook_without_rows(tmp_path):
    write_workbook(tmp_path / "w.xlsx", {"a'b": [("t", ["bin", "x", "y"], [], Chart("bin", "x", "y", "c")), ("u", ["bin", "x", "y"], [["k", 0.5, 0.1]], Chart("bin", "x", "y", "c & d"))]})
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert [n for n in z.namelist() if "charts/" in n] == ["xl/charts/chart1.xml"]
        assert "'a''b'!$A$" in z.read("xl/charts/chart1.xml").decode()


def test_interactive_tables(df):
    by_tag, by_month = interactive.calculate_split_metrics(df, "tag", "day", ["y"], "probability", "m", "probability", "principal", "loan")
    rows = {r["样本集"]: r for r in by_tag.collect()}
    assert rows["train"]["观察点月"] == "20240131-20240228" and rows["train"]["10%金额lift"] is not None
    assert {r["观察点月"] for r in by_month.collect()} == {"202401", "202402", "202403", "bad"}
    turned = {r["样本集"]: r["AUC"] for r in interactive.calculate_split_metrics(df, "tag", "day", ["y"], "score_old", "m", "score")[0].collect()}
    assert all(math.isclose(turned[k], rows[k]["AUC"], abs_tol=1e-9) for k in turned)
    both = interactive.calculate_dimensional_comparison(df, ["dim"], ["y"], [("new", "probability"), ("old", "score_old")])
    assert both.count() == 6
    assert interactive.calculate_model_comparison(df, "tag", "day", "y", [("new", "probability"), ("old", "score_old")], "month").count() == 8
    assert interactive.calculate_bin_metrics(df, "y", "probability", 5, None, "principal", "loan").count() == 5
    for bad in ({"score_type": "x"}, {"prin_bal_amount_col": "principal"}, {"score_col": "nope"}):
        with pytest.raises(ValueError):
            interactive.calculate_split_metrics(**({"data": df, "tag_col": "tag", "date_col": "day", "label_list": ["y"], "score_col": "probability", "model_name": "m"} | bad))
    with pytest.raises(ValueError):
        interactive.calculate_model_comparison(df, "tag", "day", "y", [("new", "probability")], "nope")


def test_date_ranges(spark):
    rows = spark.createDataFrame([("a", "2024-03-05 10:00"), ("a", "2023/12/31"), ("a", None), ("b", "nothing"), ("c", "20240229")], "g string, d string")
    assert {r.g: r.x for r in rows.groupBy("g").agg(date_range(F.col("d")).alias("x")).collect()} == {"a": "20231231-20240305", "b": "", "c": "20240229-20240229"}


def test_text_features_in_a_pipeline(df, frame):
    p = ScorecardPipeline(df.where("tag = 'train'"), "y", df.where("tag = 'oot'"), ["a", "t"]).bin(method="quantile").woe_transform().postfilter(psi_threshold=10.0).build_model()
    assert p.features == ["a", "t"]
    out = p.predict_proba(df.withColumn("t", F.when(F.col("dim") == "x", "never seen").otherwise(F.col("t"))))
    assert out.columns == [*df.columns, "probability"] or "probability" in out.columns
    assert out.where("probability is null").count() == 0
    with pytest.raises(ValueError, match="no binning rule"):
        p.generate_scorecard()


def test_own_binning_method(df, frame):
    class Thirds(BaseBinner):
        @staticmethod
        def splits_of(x, n, bad, n_bins):
            share = n.cumsum() / n.sum()
            return [float(x[int((share >= i / n_bins).argmax())]) for i in range(1, n_bins)]

    b = Thirds(3).fit(df, ["a", "b"])
    want = frame.a.dropna().sort_values(ignore_index=True)
    assert b.splits_["a"] == [want[math.ceil(len(want) * k / 3) - 1] for k in (1, 2)]
    assert b.transform(df).groupBy("a").count().count() == 4
    assert len(Thirds(3, monotonic=True).fit(df, ["a"], "y").splits_["a"]) == 2
    with pytest.raises(ValueError):
        Thirds(3, monotonic=True).fit(df, ["a"])


def test_logistic_view(df):
    m = LogisticModel().fit(df, ["a", "b"], "y")
    view = ModelView(m)
    assert {r["feature"] for r in view.summary()} == {"a", "b"} and dict(view.model_summary())["AIC"] == m.stats_["aic"]
    assert view.importance()[0]["gain"] == max(abs(m.coefficients_[c]) for c in ("a", "b"))
