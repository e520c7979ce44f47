"""Importance of features and summaries of models, from whatever a model offers: small tables on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from .logistic import CONST, LogisticModel
from .scorecard import Scorecard

IMPORTANCE = ("feature", "gain", "gain_per", "weight", "weight_per")
SUMMARY = ("feature", "coefficient", "std_error", "z_value", "p_value", "ci_lower", "ci_upper", "odds_ratio")
# Names and keys of a model's statistics.
STATISTICS = (("AIC", "aic"), ("BIC", "bic"), ("Log Likelihood", "log_likelihood"), ("Pseudo R²", "pseudo_r2"), ("Nobs", "nobs"))
# Parameters of boosted trees, the names that are read as each, and their meaning.
BOOSTER = (
    ("n_estimators", ("n_estimators", "num_iterations"), "训练轮次"),
    ("learning_rate", ("learning_rate",), "学习率"),
    ("objective", ("objective",), "函数类型"),
    ("subsample", ("subsample", "bagging_fraction"), "训练样本采样比例"),
    ("colsample_bytree", ("colsample_bytree", "feature_fraction"), "特征采样率"),
    ("reg_alpha", ("reg_alpha", "lambda_l1"), "L1正则化系数"),
    ("reg_lambda", ("reg_lambda", "lambda_l2"), "L2正则化系数"),
    ("num_leaves", ("num_leaves",), "叶子节点数"),
    ("max_depth", ("max_depth",), "最大深度"),
)
# Parameters of a scorecard and their meaning.
CARD = (("base_score", "基准分"), ("pdo", "翻倍赔率分值（PDO）"), ("base_odds", "基准赔率"), ("factor", "缩放因子"), ("offset", "缩放偏移"), ("intercept_points", "截距分值"))


@dataclass
class ModelView:
    """One face of scorecards, logistic models, boosted trees and fitted tree models of Spark ML.

    statistics: the logistic model behind a scorecard, or rows with the columns of SUMMARY.
    features: names in the model's order, where the model doesn't know them.
    """

    model: object
    statistics: LogisticModel | Sequence[Mapping] | None = None
    features: Sequence[str] = ()

    @property
    def family(self) -> str:
        if isinstance(self.model, Scorecard):
            return "scorecard"
        if isinstance(self.model, LogisticModel):
            return "logistic"
        booster = self._booster()
        if hasattr(booster, "get_score"):
            return "xgboost"
        return "lightgbm" if hasattr(booster, "feature_importance") else "spark" if hasattr(self.model, "featureImportances") else "other"

    def _booster(self):
        if callable(getter := getattr(self.model, "get_booster", None)):
            return getter()
        return getattr(self.model, "booster_", self.model)

    def names(self) -> list[str]:
        if self.features:
            return list(self.features)
        if self.family == "scorecard":
            return list(self.model.coefficients)
        if self.family == "logistic":
            return list(self.model.columns_)
        booster = self._booster()
        if callable(getter := getattr(booster, "feature_name", None)):
            return list(getter())
        return list(getattr(booster, "feature_names", None) or getattr(self.model, "feature_names_in_", None) or [])

    def importance(self) -> list[dict]:
        """Rows of IMPORTANCE, by falling gain and weight; equal ones stay in the model's order."""
        names = self.names()
        if self.family == "scorecard":
            held = {r["feature"]: r["coefficient"] for r in self.summary()}
            gain = [_finite(abs(v) if (v := held.get(f)) is not None else None) for f in names]
            if not any(gain):
                gain = [_finite(sum(map(abs, p)) / len(p)) if (p := self.model.points(f)) else 0.0 for f in names]
            weight = list(gain)
        elif self.family == "logistic":
            gain = weight = [abs(self.model.coefficients_[f]) for f in names]
        elif self.family == "xgboost":
            gains, weights = (self._booster().get_score(importance_type=k) for k in ("gain", "weight"))
            names = sorted({*gains, *weights, *names})
            gain, weight = [float(gains.get(f, 0.0)) for f in names], [float(weights.get(f, 0.0)) for f in names]
        elif self.family == "lightgbm":
            gain, weight = ([float(v) for v in self._booster().feature_importance(importance_type=k)] for k in ("gain", "split"))
        else:
            raw = self.model.featureImportances.toArray() if self.family == "spark" else getattr(self.model, "feature_importances_", [0.0] * len(names))
            gain = weight = [float(v) for v in raw]
            names = names or [f"feature_{i}" for i in range(len(gain))]
        all_gain, all_weight = sum(gain), sum(weight)
        rows = [{"feature": f, "gain": g, "gain_per": g / all_gain if all_gain else 0.0, "weight": w, "weight_per": w / all_weight if all_weight else 0.0} for f, g, w in zip(names, gain, weight, strict=True)]
        return sorted(rows, key=lambda r: (-r["gain"], -r["weight"]))

    def summary(self) -> list[dict]:
        """Rows of SUMMARY for each feature of a scorecard or logistic model: its first row of the statistics, nulls without one. Other models have none."""
        if self.family not in ("scorecard", "logistic"):
            return []
        source = self.statistics if self.statistics is not None else self.model if self.family == "logistic" else ()
        rows = source.table_ if isinstance(source, LogisticModel) else source
        first: dict[str, Mapping] = {}
        for r in rows:
            first.setdefault(str(r["feature"]), r)
        if not first and self.family == "scorecard":
            first = {f: {"coefficient": b} for f, b in self.model.coefficients.items()}
        return [{"feature": f} | {c: first.get(f, {}).get(c) for c in SUMMARY[1:]} for f in self.names() if f != CONST]

    def model_summary(self) -> list[tuple[str, float | None]]:
        source = self.statistics if isinstance(self.statistics, LogisticModel) else self.model
        held = getattr(source, "stats_", None)
        return [(name, held.get(key)) for name, key in STATISTICS] if held else []

    def parameters(self) -> list[tuple[str, str, str]]:
        """(参数名称, 数值, 参数解释)."""
        if self.family == "scorecard":
            return [(name, str(getattr(self.model, name)), why) for name, why in CARD]
        if self.family == "logistic":
            return [(name, str(getattr(self.model, name)), why) for name, why in (("penalty", "LR正则化方式"), ("alpha", "LR正则化强度"), ("max_iter", "LR最大迭代次数"))]
        held = dict(getattr(self._booster(), "params", None) or {})
        if callable(getter := getattr(self.model, "get_params", None)):
            held |= {k: v for k, v in getter().items() if v is not None}
        return [(name, str(next((held[a] for a in aliases if a in held), "")), why) for name, aliases, why in BOOSTER]


def _finite(x: float | None) -> float:
    return float(x) if x is not None and math.isfinite(x) else 0.0


__all__ = ["IMPORTANCE", "STATISTICS", "SUMMARY", "ModelView"]
