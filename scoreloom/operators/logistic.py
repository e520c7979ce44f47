"""Logistic regression with inference. Each Newton step is one pass over the rows, whatever the number of models fitted together."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import label, numeric

CONST = "const"
#: Numbers of a prepared table that the driver may hold: below, steps are sums there instead of passes of Spark.
HELD = 4_000_000


@dataclass
class Fit:
    """Estimates of one set of columns; coefficient 0 is the constant's."""

    columns: tuple[str, ...]
    coefficients: np.ndarray
    covariance: np.ndarray
    information: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    rows: float
    converged: bool
    robust: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.coefficients)

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.k * math.log(self.rows) - 2 * self.log_likelihood

    @property
    def p_values(self) -> np.ndarray:
        se = np.sqrt(np.diag(self.covariance))
        z = np.divide(self.coefficients, se, out=np.full(self.k, np.nan), where=se > 0)
        return np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else float("nan") for v in z])


def _sums(data: np.ndarray, at: np.ndarray, beta: np.ndarray, squared: bool) -> np.ndarray:
    """Of rows (label, weight, columns...): log likelihood, gradient, information and with squared the sum of squared scores, flat."""
    y, w = data[:, 0], data[:, 1]
    part = np.concatenate([np.ones((len(data), 1)), data[:, at[1:] + 1]], 1)
    p = 1 / (1 + np.exp(-np.clip(part @ beta, -500, 500)))
    q = np.clip(p, 1e-15, 1 - 1e-15)
    held = [[(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()], part.T @ (w * (y - p)), (part.T @ (part * (w * p * (1 - p))[:, None])).ravel()]
    if squared:
        held.append((part.T @ (part * (w * (y - p) ** 2)[:, None])).ravel())
    return np.concatenate(held)


def _pass(own: DataFrame | np.ndarray, models: Sequence[tuple[np.ndarray, np.ndarray]], squared: bool = False) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """For each model (places of its columns, coefficients): log likelihood, gradient, information, and with squared the sum of squared scores."""
    if isinstance(own, np.ndarray):
        with ThreadPoolExecutor(8) as pool:
            flat = list(pool.map(lambda m: _sums(own, *m, squared), models))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [0.0] * len(models)
            for batch in batches:
                data = batch.to_numpy(float)
                sums = [held + _sums(data, *m, squared) for held, m in zip(sums, models, strict=True)]
            for i, held in enumerate(sums):
                if isinstance(held, np.ndarray):
                    yield pd.DataFrame({"model": i, "place": np.arange(len(held)), "value": held})

        flat = [np.zeros(1 + len(b) + (2 if squared else 1) * len(b) ** 2) for _, b in models]
        for r in own.mapInPandas(run, "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).collect():
            flat[r["model"]][r["place"]] = r["value"]
    out = []
    for held, (_, beta) in zip(flat, models, strict=True):
        k = len(beta)
        out.append((float(held[0]), held[1 : 1 + k], held[1 + k : 1 + k + k * k].reshape(k, k), held[1 + k + k * k :].reshape(k, k) if squared else np.zeros((0, 0))))
    return out


def at_hand(own: DataFrame) -> DataFrame | np.ndarray:
    """A prepared table, on the driver if it has at most HELD numbers."""
    return own.toPandas().to_numpy(float) if own.count() * len(own.columns) <= HELD else own


def prepared(df: DataFrame, columns: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """(label, weight, columns...) as doubles of the rows where all are present."""
    lab = label(df, y)
    return df.select(lab.cast("double").alias("__y"), (numeric(df, weight) if weight else F.lit(1.0)).alias("__w"), *[numeric(df, c).alias(f"__{i}") for i, c in enumerate(columns)]).dropna()


def fit_many(df: DataFrame, sets: Sequence[Sequence[str]], y: str, weight: str | None = None, max_iter: int = 100, tol: float = 1e-10, robust: bool = False, own: DataFrame | np.ndarray | None = None, columns: Sequence[str] | None = None, start: dict[str, float] | None = None) -> list[Fit | None]:
    """A model with a constant for each set of columns, all by the same passes; None where columns are linearly dependent. Rows lacking any of the columns are left out of all. start: coefficients to begin with, 0 for others."""
    columns = list(columns) if columns is not None else list(dict.fromkeys(c for s in sets for c in s))
    own = own if own is not None else prepared(df, columns, y, weight)
    place = {c: i + 1 for i, c in enumerate(columns)}
    at = [np.array([0, *[place[c] for c in s]]) for s in sets]
    start = start or {}
    beta = [np.array([start.get(c, 0.0) for c in (CONST, *s)]) for s in sets]
    last, done, out = [None] * len(sets), [False] * len(sets), [None] * len(sets)
    if isinstance(own, np.ndarray):
        n, b = float(own[:, 1].sum()), float((own[:, 0] * own[:, 1]).sum())
    else:
        totals = own.agg(F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col("__y")).alias("b")).first()
        n, b = totals["n"] or 0.0, totals["b"] or 0.0
    if not n or b in (0.0, n):
        return out
    rate = b / n
    null = b * math.log(rate) + (n - b) * math.log(1 - rate)
    for step in range(max_iter + 1):
        live = [i for i in range(len(sets)) if not done[i]]
        if not live:
            break
        for i, (ll, gradient, info, _) in zip(live, _pass(own, [(at[i], beta[i]) for i in live]), strict=True):
            scale = np.abs(np.diag(info)).max() if info.size else 0
            spread = np.sqrt(np.maximum(np.diag(info), 1e-300))
            if scale == 0 or np.linalg.cond(info / np.outer(spread, spread)) > 1e12:
                done[i], out[i] = True, None
                continue
            inverse = np.linalg.inv(info)
            out[i] = Fit(tuple(sets[i]), beta[i].copy(), inverse, info, ll, null, n, False)
            if last[i] is not None and abs(ll - last[i]) < tol * max(1.0, abs(ll)):
                done[i], out[i].converged = True, True
                continue
            last[i] = ll
            if step < max_iter:
                beta[i] = beta[i] + inverse @ gradient
    if robust:
        fitted = [i for i in range(len(sets)) if out[i] is not None]
        for i, (_, _, _, meat) in zip(fitted, _pass(own, [(at[i], out[i].coefficients) for i in fitted], squared=True), strict=True):
            out[i].robust = out[i].covariance @ meat @ out[i].covariance
    return out


@dataclass
class LogisticModel:
    """A fitted logistic regression: coefficients, inference, prediction, JSON.

    penalty None or "l2" fits without a penalty, "l2" with robust (HC0) standard errors;
    "l1" shrinks all but the constant by alpha.
    """

    penalty: str | None = None
    alpha: float = 0.0
    max_iter: int = 100
    columns_: list[str] = field(default_factory=list)
    coefficients_: dict[str, float] = field(default_factory=dict)
    table_: list[dict] = field(default_factory=list)
    stats_: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str], y: str, weight: str | None = None) -> LogisticModel:
        columns = list(columns)
        if self.penalty == "l1":
            found = self._lasso(df, columns, y, weight)
        else:
            found = fit_many(df, [columns], y, weight, self.max_iter, robust=self.penalty == "l2")[0]
        if found is None:
            raise ValueError("the model can't be fitted: linearly dependent columns or one class only")
        cov = found.robust if found.robust is not None else found.covariance
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        self.columns_ = columns
        self.coefficients_ = dict(zip([CONST, *columns], map(float, found.coefficients), strict=True))
        self.table_ = []
        for name, b, s in zip([CONST, *columns], found.coefficients, se, strict=True):
            z = b / s if s > 0 else float("nan")
            self.table_.append({"feature": name, "coefficient": float(b), "std_error": float(s), "z_value": float(z), "p_value": math.erfc(abs(z) / math.sqrt(2)) if z == z else float("nan"), "ci_lower": float(b - 1.959963984540054 * s), "ci_upper": float(b + 1.959963984540054 * s), "odds_ratio": math.exp(min(b, 700))})
        self.stats_ = {"aic": found.aic, "bic": found.bic, "log_likelihood": found.log_likelihood, "pseudo_r2": 1 - found.log_likelihood / found.null_log_likelihood, "nobs": found.rows}
        return self

    def _lasso(self, df: DataFrame, columns: list[str], y: str, weight: str | None) -> Fit | None:
        """Proximal Newton: coordinate descent on the quadratic model of each pass."""
        own = prepared(df, columns, y, weight)
        at, beta, last = np.arange(len(columns) + 1), np.zeros(len(columns) + 1), None
        base = fit_many(df, [[]], y, weight, own=own, columns=columns)[0]
        if base is None:
            return None
        beta[0] = base.coefficients[0]
        for _ in range(self.max_iter):
            ((ll, gradient, info, _),) = _pass(own, [(at, beta)])
            value = -ll + self.alpha * np.abs(beta[1:]).sum()
            if last is not None and abs(value - last) < 1e-9 * max(1.0, abs(value)):
                break
            last, new = value, beta.copy()
            for _ in range(500):
                old = new.copy()
                for j in range(len(new)):
                    slope = gradient[j] - info[j] @ (new - beta) + info[j, j] * new[j]
                    new[j] = slope / info[j, j] if j == 0 else math.copysign(max(abs(slope) - self.alpha, 0.0), slope) / max(info[j, j], 1e-12)
                if np.abs(new - old).max() < 1e-10:
                    break
            beta = new
        ((ll, _, info, _),) = _pass(own, [(at, beta)])
        return Fit(tuple(columns), beta, np.linalg.pinv(info), info, ll, base.null_log_likelihood, base.rows, True)

    def _fitted(self) -> None:
        if not self.coefficients_:
            raise ValueError("LogisticModel is not fitted. Call fit() first.")

    def probability(self, df: DataFrame):
        """The probability of 1 as a column of df; null where a column is missing."""
        self._fitted()
        z = F.lit(self.coefficients_[CONST])
        for c in self.columns_:
            z = z + F.lit(self.coefficients_[c]) * numeric(df, c)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        return df.withColumn(output, F.when(self._complete(df), self.probability(df)))

    def predict(self, df: DataFrame, threshold: float = 0.5, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, F.when(self._complete(df), (self.probability(df) >= threshold).cast("int")))

    def _complete(self, df: DataFrame):
        out = F.lit(True)
        for c in self.columns_:
            out = out & numeric(df, c).isNotNull()
        return out

    def significant(self, level: float = 0.05) -> list[str]:
        return [r["feature"] for r in self.table_ if r["feature"] != CONST and r["p_value"] < level]

    def to_dict(self) -> dict:
        self._fitted()
        return {"model": "logistic", "columns": self.columns_, "coefficients": self.coefficients_, "table": self.table_, "stats": self.stats_, "penalty": self.penalty, "alpha": self.alpha}

    @classmethod
    def from_dict(cls, held: dict) -> LogisticModel:
        return cls(held.get("penalty"), held.get("alpha", 0.0), columns_=list(held["columns"]), coefficients_=dict(held["coefficients"]), table_=list(held.get("table", [])), stats_=dict(held.get("stats", {})))

    def dump(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), ensure_ascii=False))

    @classmethod
    def load(cls, path: str) -> LogisticModel:
        return cls.from_dict(json.loads(Path(path).read_text()))
