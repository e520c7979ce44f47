"""Binning of numeric features: six methods, monotone and least-rows repair, transforms and statistics.

All features are fitted together. Equal width and equal frequency need one aggregate; the
other methods get counts of distinct values by feature, and their sequential part runs in
one grouped task per feature, over all of them unless pre_bins asks for cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions.columns import label, numeric, numeric_columns
from ..functions.quantiles import long_form, quantiles
from ..functions.running import running_sums
from . import binning_kernels as K
from .woe import STATS, bin_statistics, counts

METHODS = ("step", "quantile", "kmean", "dt", "chi", "opt")
SUPERVISED = ("dt", "chi", "opt")


def value_counts(df: DataFrame, features: Sequence[str], y: str | None = None) -> DataFrame:
    """(feature, x, n, bad) of the distinct non-missing values; bad is null without y."""
    keep = ["__y"] if y else []
    own = df.withColumn("__y", label(df, y)).where("__y is not null") if y else df
    long = long_form(own, features, keep=keep).where("x is not null")
    return long.groupBy("feature", "x").agg(F.count("*").alias("n"), (F.sum("__y") if y else F.lit(0)).cast("long").alias("bad"))


def pre_binned(values: DataFrame, cells: int) -> DataFrame:
    """Counts by cells of about equal rows, each taken at its mean, of the features with more than `cells` values; a value is never divided."""
    own = running_sums(values.withColumn("d", F.lit(1)), ["feature"], "x", ["n", "d"])
    cell = F.when(F.col("all_d") <= cells, F.col("before_d")).otherwise(F.floor((F.col("before_n") + F.col("n") / 2) * cells / F.col("all_n")))
    met = own.groupBy("feature", cell.alias("cell")).agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return met.select("feature", "x", "n", "bad")


def check_labels(df: DataFrame, y: str) -> None:
    """Raises unless every label is 0 or 1."""
    x = numeric(df, y)
    wrong = ~F.coalesce(x.isin(0.0, 1.0), F.lit(False))
    seen = df.where(wrong).select(F.col(y).cast("string").alias("v")).distinct().limit(5).collect()
    if seen:
        raise ValueError(f"labels must be 0 or 1, found: {sorted(str(r['v']) for r in seen)}")


class BaseBinner:
    """One binning method over several features. A subclass names one of METHODS, or brings its own as `splits_of`."""

    method = "step"
    #: (x, n, bad, n_bins) -> split points, of the sorted distinct values of one feature, their rows and their bad rows (0 without a target), in numpy. Runs on the workers, a task a feature.
    splits_of = None

    def __init__(self, n_bins: int = 5, **options):
        self.n_bins, self.options = n_bins, options
        self.splits_: dict[str, list[float]] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], y: str | None = None) -> BaseBinner:
        own = type(self).splits_of
        if own is None:
            self.splits_ = fit_splits(df, features, y, self.method, self.n_bins, **self.options)
        else:
            options = {"min_samples": None, "monotonic": None} | self.options
            if y is None and options["monotonic"]:
                raise ValueError("a monotone repair needs a target")
            self.splits_ = _grouped(value_counts(df, features, y), list(features), "own", self.n_bins, options["min_samples"], options["monotonic"], 0.0, own)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.splits_ is None:
            raise ValueError(f"{type(self).__name__} is not fitted. Call fit() first.")
        return df.withColumns({f: B.bin_code(numeric(df, f), s) for f, s in self.splits_.items()})


class EqualWidthBinner(BaseBinner):
    method = "step"


class EqualFrequencyBinner(BaseBinner):
    method = "quantile"


class KMeansBinner(BaseBinner):
    method = "kmean"


class DecisionTreeBinner(BaseBinner):
    method = "dt"


class ChiMergeBinner(BaseBinner):
    method = "chi"


class OptBinner(BaseBinner):
    method = "opt"


def fit_splits(df: DataFrame, features: Sequence[str], y: str | None = None, method: str = "chi", n_bins: int = 5, *, min_samples: int | float | None = None, monotonic: bool | str | None = None, alpha: float = 0.05, pre_bins: int | None = None) -> dict[str, list[float]]:
    """Split points of each feature; features without a value are left out.

    min_samples None: 5 % for chi, 5 % of a leaf for dt, no repair for the others.
    monotonic: False or None, True or "auto" (by the ends), "ascending", "descending".
    pre_bins: kmean, dt, chi and opt see at most so many cells of about equal rows of a feature; None: every distinct value.
    """
    if method not in METHODS:
        raise ValueError(f"unknown binning method: {method!r}; one of {METHODS}")
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    if pre_bins is not None and pre_bins < 1:
        raise ValueError("pre_bins must be at least 1")
    if y is None and (method in SUPERVISED or monotonic):
        raise ValueError(f"method {method!r} needs a target")
    if method == "chi":
        check_labels(df, y)
    features = list(features)
    if not features:
        return {}
    first: dict[str, list[float]] = {}
    if method == "step":
        ends = long_form(df, features).groupBy("feature").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a is not null").collect()
        first = {r["feature"]: K.equal_width(r["a"], r["z"], n_bins) for r in ends}
    elif method == "quantile":
        found = quantiles(df, features, [i / n_bins for i in range(n_bins + 1)])
        first = {f: sorted(set(v))[1:-1] for f, v in found.items() if v}
        flat = [f for f, v in found.items() if v and len(set(v)) < 2]
        if flat:
            first |= fit_splits(df, flat, None, "step", n_bins)
    if first:
        splits = {f: B.clean_splits(first[f]) for f in features if f in first}
        if min_samples is None and not monotonic:
            return splits
        return _repaired(df, splits, y, monotonic, min_samples)
    values = value_counts(df, features, y if method in SUPERVISED or monotonic else None)
    values = values if pre_bins is None else pre_binned(values, pre_bins)
    return _grouped(values, features, method, n_bins, min_samples, monotonic, alpha)


def _repaired(df: DataFrame, splits: dict[str, list[float]], y: str | None, monotonic, min_samples) -> dict[str, list[float]]:
    """Repairs from counts by bin, one aggregate for all features."""
    rows = coded(df, splits, keep=["__y"] if y else [], y=y).where("bin_idx >= 0").groupBy("feature", "bin_idx").agg(F.count("*").alias("n"), (F.sum("__y") if y else F.lit(0)).alias("bad")).collect()
    out = {}
    for f, own in splits.items():
        n, bad = np.zeros(len(own) + 1), np.zeros(len(own) + 1)
        for r in rows:
            if r["feature"] == f:
                n[r["bin_idx"]], bad[r["bin_idx"]] = r["n"], r["bad"] or 0
        out[f] = K.repaired(own, n, bad, monotonic, K.least_rows(min_samples, int(n.sum())))
    return out


def _grouped(values: DataFrame, features: Sequence[str], method: str, n_bins: int, min_samples, monotonic, alpha: float, own=None) -> dict[str, list[float]]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        x, n, bad = frame["x"].to_numpy(float), frame["n"].to_numpy(float), frame["bad"].to_numpy(float)
        total = int(n.sum())
        least = K.least_rows(0.05 if method == "chi" and min_samples is None else min_samples, total)
        if own is not None:
            splits = own(x, n, bad, n_bins)
        elif method == "kmean":
            splits = K.kmeans_splits(x, n, n_bins)
        elif method == "dt":
            splits = K.tree_splits(x, n, bad, n_bins, least if least else K.least_rows(0.05, total))
        elif method == "chi":
            splits = K.chimerge_splits(x, n, bad, n_bins, alpha, least)
        else:
            splits = K.optimal_splits(x, n, bad, n_bins, least or K.least_rows(0.05, total), monotonic)
        splits = sorted({float(s) for s in splits if np.isfinite(s)})
        if monotonic or min_samples is not None:
            splits = K.repaired(splits, *K.bin_counts(x, n, bad, splits), monotonic if method != "opt" or monotonic else None, least if min_samples is not None else None)
        return pd.DataFrame({"feature": [frame["feature"].iloc[0]], "splits": [splits]})

    rows = values.groupBy("feature").applyInPandas(run, "feature string, splits array<double>").collect()
    found = {r["feature"]: list(r["splits"]) for r in rows}
    return {f: found[f] for f in features if f in found}


def coded(df: DataFrame, splits: dict[str, list[float]], keep: Sequence[str] = (), y: str | None = None) -> DataFrame:
    """(feature, bin_idx, keep...) of every row and feature, missing values -1. With y, "__y" is its binary label and rows without one are left out."""
    own = df.withColumn("__y", label(df, y)).where("__y is not null") if y else df
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), B.bin_code(numeric(df, f), s).alias("bin_idx")) for f, s in splits.items()])
    return own.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.feature", "__p.bin_idx")


def described(binned: DataFrame, splits: dict[str, list[float]]) -> DataFrame:
    """binned (feature, bin_idx, ...) with bin, min and max."""
    rows = []
    for f, s in splits.items():
        bounds = [-math.inf, *map(float, s), math.inf]
        rows += [(f, -1, B.MISSING, None, None)] + [(f, i, name, bounds[i], bounds[i + 1]) for i, name in enumerate(B.labels(s))]
    table = binned.sparkSession.createDataFrame(rows, "__f string, __i int, bin string, min double, max double")  # a row a bin, from the driver
    return binned.join(F.broadcast(table), (F.col("feature") == F.col("__f")) & (F.col("bin_idx") == F.col("__i")), "left").drop("__f", "__i")


def statistics(df: DataFrame, splits: dict[str, list[float]], y: str) -> DataFrame:
    """feature, bin_idx and the 22 columns of statistics of every bin that has rows: one pass over df for all features."""
    binned = counts(coded(df, splits, keep=["__y"], y=y), ["feature", "bin_idx"], F.col("__y"))
    return bin_statistics(described(binned, splits))


class BinView:
    """One feature's bins: splits and statistics."""

    def __init__(self, binner: Binner, feature: str):
        self.binner, self.feature = binner, feature

    @property
    def splits(self) -> list[float]:
        return list(self.binner.rules_[self.feature])

    @property
    def stats(self) -> DataFrame:
        return self.binner.stats().where(F.col("feature") == self.feature)

    @property
    def woe_map(self) -> dict[str, float]:
        return dict(self.binner.woe_maps_[self.feature])


class Binner:
    """Bins of many features, their statistics and weights of evidence. The label is a column of the same DataFrame."""

    def __init__(self):
        self.rules_: dict[str, list[float]] = {}
        self.woe_maps_: dict[str, dict[str, float]] = {}
        self.iv_: dict[str, float] = {}
        self._data: DataFrame | None = None
        self._y: str | None = None

    def fit(self, df: DataFrame, y: str | None = None, features: Sequence[str] | None = None, method: str = "chi", n_bins: int = 5, min_samples: int | float | None = None, monotonic: bool | str | None = None, alpha: float = 0.05, fit_woe: bool = True, pre_bins: int | None = None) -> Binner:
        features = [f for f in (features if features is not None else numeric_columns(df)) if f != y]
        self.rules_ = fit_splits(df, features, y, method, n_bins, min_samples=min_samples, monotonic=monotonic, alpha=alpha, pre_bins=pre_bins)
        self._data, self._y = df, y
        self.woe_maps_, self.iv_ = {}, {}
        if y and fit_woe:
            self.fit_woe()
        return self

    def fit_woe(self, df: DataFrame | None = None, y: str | None = None) -> Binner:
        """Weights of evidence of all bins, on the data of the fit or on others."""
        df, y = df if df is not None else self._data, y or self._y
        if df is None or y is None:
            raise ValueError("fit_woe needs data and a target")
        self._data, self._y = df, y
        self.woe_maps_ = {f: {} for f in self.rules_}
        self.iv_ = dict.fromkeys(self.rules_, 0.0)
        if self.rules_:
            for r in statistics(df, self.rules_, y).select("feature", "bin_idx", "woe", "iv").collect():
                self.woe_maps_[r["feature"]][self._label(r["feature"], r["bin_idx"])] = r["woe"]
                self.iv_[r["feature"]] += r["iv"]
        return self

    def _label(self, feature: str, code: int) -> str:
        return B.MISSING if code < 0 else B.labels(self.rules_[feature])[code]

    def _fitted(self) -> None:
        if not self.rules_:
            raise ValueError("Binner is not fitted. Call fit() first.")

    def transform(self, df: DataFrame, labels: bool = False) -> DataFrame:
        """df with each fitted feature as its bin's number (missing -1) or text."""
        self._fitted()
        out = {}
        for f, s in self.rules_.items():
            if f in df.columns:
                code = B.bin_code(numeric(df, f), s)
                out[f] = B.label_of(code, s) if labels else code
        return df.withColumns(out)

    def woe_expression(self, df: DataFrame, feature: str) -> Column:
        splits, table = self.rules_[feature], self.woe_maps_[feature]
        names = [B.MISSING, *B.labels(splits)]
        values = F.array(*[F.lit(float(table.get(name, 0.0))) for name in names])
        return F.get(values, B.bin_code(numeric(df, feature), splits) + 1)

    def woe_transform(self, df: DataFrame) -> DataFrame:
        """df with each fitted feature as its bin's weight of evidence; bins without one: 0."""
        self._fitted()
        lacking = [f for f in self.rules_ if not self.woe_maps_.get(f)]
        if lacking:
            raise ValueError(f"no WOE for {lacking}; call fit_woe() first")
        return df.withColumns({f: self.woe_expression(df, f) for f in self.rules_ if f in df.columns})

    def stats(self, df: DataFrame | None = None, y: str | None = None) -> DataFrame:
        self._fitted()
        df, y = df if df is not None else self._data, y or self._y
        if df is None or y is None:
            raise ValueError("stats needs data and a target")
        return statistics(df, self.rules_, y)

    def iv_table(self) -> list[tuple[str, float]]:
        return sorted(self.iv_.items(), key=lambda p: -p[1])

    def features(self) -> list[str]:
        return list(self.rules_)

    def __getitem__(self, feature: str) -> BinView:
        if feature not in self.rules_:
            raise KeyError(feature)
        return BinView(self, feature)

    def get_splits(self, feature: str) -> list[float]:
        return self[feature].splits

    def set_splits(self, feature: str, splits: Sequence[float]) -> Binner:
        """Replaces a feature's splits; weights of evidence follow if data is at hand."""
        self.rules_[feature] = B.clean_splits(splits)
        if self._data is not None and self._y is not None:
            return self.fit_woe()
        self.woe_maps_.pop(feature, None)
        return self

    def print_splits(self) -> None:
        for f, s in self.rules_.items():
            print(f, s)

    def export(self) -> dict[str, dict]:
        return {f: {"splits": list(s), "woe": dict(self.woe_maps_.get(f, {})), "iv": self.iv_.get(f)} for f, s in self.rules_.items()}

    def load(self, held: dict[str, dict]) -> Binner:
        rules, maps, ivs = {}, {}, {}
        for f, own in held.items():
            if "woe_map" in own:
                raise ValueError(f"{f}: the key 'woe_map' is of an older format; use 'woe'")
            if "splits" not in own:
                raise ValueError(f"{f}: no 'splits'")
            rules[f] = B.clean_splits(own["splits"])
            maps[f] = dict(own.get("woe") or {})
            ivs[f] = own.get("iv")
        self.rules_, self.woe_maps_, self.iv_ = rules, maps, ivs
        self._data = self._y = None
        return self


__all__ = ["METHODS", "STATS", "BaseBinner", "BinView", "Binner", "ChiMergeBinner", "DecisionTreeBinner", "EqualFrequencyBinner", "EqualWidthBinner", "KMeansBinner", "OptBinner", "coded", "described", "fit_splits", "statistics", "value_counts"]
