"""Feature screening: descriptive and supervised metrics, filters, and stepwise logistic selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category, col, is_numeric, label, numeric
from ..functions.quantiles import long_form, quantile_rows
from . import metrics as M
from .correlation import high_pairs, pearson, vif
from .logistic import CONST, Fit, at_hand, fit_many, prepared
from .psi import psi_features
from .woe import batch_iv

BASIC = ("missing_rate", "min", "max", "mean", "median", "std", "skewness", "kurtosis", "q1", "q3", "variance", "mode_ratio", "nonzero_ratio", "nonnull_nonneg_ratio", "unique_count", "unique_ratio")
SUPERVISED = ("iv", "ks", "lift_10", "correlation")


def eda_summary(df: DataFrame, columns: Sequence[str], metrics: Sequence[str] = BASIC) -> DataFrame:
    """feature, dtype, count and the basic metrics asked for, in alphabetical order.

    Moments, quantiles and modes of all numeric columns come from the long form; text columns
    have missing rate, distinct values and mode only. skewness and kurtosis are of the population.
    """
    unknown = [m for m in metrics if m not in BASIC]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    columns = list(columns)
    numbers = [c for c in columns if is_numeric(df, c, booleans=True)]
    texts = [c for c in columns if c not in numbers]
    kinds = F.create_map(*[F.lit(v) for c in columns for v in (c, df.schema[c].dataType.simpleString())])
    parts = []
    if numbers:
        long = long_form(df, numbers)
        values = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
        x, present = F.col("x"), F.col("x").isNotNull()
        plain = long.groupBy("feature").agg(
            F.count("*").alias("rows"),
            F.count("x").alias("count"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.var_samp("x").alias("variance"),
            F.skewness("x").alias("skewness"),
            F.kurtosis("x").alias("kurtosis"),
            F.count_if(present & (x != 0)).alias("nonzero"),
            F.count_if(present & (x >= 0)).alias("nonneg"),
        )
        by_value = values.where(present).groupBy("feature").agg(F.count("*").alias("unique_count"), F.max("n").alias("most"))
        places = quantile_rows(long, [0.25, 0.5, 0.75], rows=df.count()).groupBy("feature").pivot("place", [0, 1, 2]).agg(F.first("value"))
        places = places.select("feature", F.col("0").alias("q1"), F.col("1").alias("median"), F.col("2").alias("q3"))
        parts.append(plain.join(by_value, "feature", "left").join(places, "feature", "left"))
    if texts:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(col(c).isNotNull(), category(df, c)).alias("v")) for c in texts])
        values = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("feature", "v").agg(F.count("*").alias("n"))
        parts.append(values.groupBy("feature").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("v").alias("unique_count"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("most")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    rows, count = F.col("rows"), F.nullif(F.col("count"), F.lit(0))
    both = both.withColumn("missing_rate", 1 - F.col("count") / rows).withColumn("unique_count", F.coalesce("unique_count", F.lit(0))).withColumn("mode_ratio", F.col("most") / count).withColumn("unique_ratio", F.col("unique_count") / count)
    if numbers:
        both = both.withColumn("nonzero_ratio", F.col("nonzero") / count).withColumn("nonnull_nonneg_ratio", F.col("nonneg") / count)
    kept = sorted(m for m in metrics if m in both.columns)
    clean = [F.when(~F.isnan(F.col(m).cast("double")), F.col(m)).alias(m) if m != "unique_count" else F.col(m) for m in kept]
    place = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (c, i)])
    return both.select("feature", kinds[F.col("feature")].alias("dtype"), "count", *clean).orderBy(place[F.col("feature")])


def supervised_summary(df: DataFrame, columns: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """feature, iv, ks, lift_10 and correlation with the target; texts have iv only. All features are ranked in one long form."""
    columns = list(columns)
    out = batch_iv(df, columns, y, bins)
    numbers = [c for c in columns if is_numeric(df, c, booleans=True)]
    if numbers:
        own = df.withColumn("__y", label(df, y))
        long = long_form(own, numbers, keep=["__y"])
        curve = M.binary_metrics(long, "__y", "x", ["feature"], levels=(0.10,)).select(F.col("feature").alias("__f"), F.col("KS").alias("ks"), F.col("10%lift").alias("lift_10"))
        target = numeric(df, y)
        corr = long_form(df.withColumn("__t", target), numbers, keep=["__t"]).where("x is not null and __t is not null").groupBy("feature").agg(pearson(F.col("x"), F.col("__t")).alias("correlation")).withColumnRenamed("feature", "__g")
        out = out.join(curve, F.col("feature") == F.col("__f"), "left").join(corr, F.col("feature") == F.col("__g"), "left").drop("__f", "__g")
        out = out.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))
    return out


class FeatureSelector:
    """Screening by missing rate, information value and correlation, in that order.

    Missing: above the threshold goes; iv: below the threshold, or none at all, goes. Of a
    highly correlated pair the one of the lower iv goes, the second on a tie; pairs are taken
    by falling correlation and a pair with a removed member only adds to the reasons.
    """

    def __init__(self, iv_threshold: float = 0.02, missing_threshold: float = 0.9, corr_threshold: float = 0.8, method: str = "pearson", bins: int = 10):
        self.iv_threshold, self.missing_threshold, self.corr_threshold, self.method, self.bins = iv_threshold, missing_threshold, corr_threshold, method, bins
        self.selected_: list[str] = []
        self.removed_: dict[str, str] = {}
        self.iv_: dict[str, float | None] = {}
        self.missing_: dict[str, float] = {}

    def fit(self, df: DataFrame, y: str, columns: Sequence[str] | None = None) -> FeatureSelector:
        columns = [c for c in (columns if columns is not None else df.columns) if c != y]
        absent = df.agg(*[F.avg((numeric(df, c) if is_numeric(df, c) else col(c)).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        self.missing_ = {c: absent[f"m{i}"] for i, c in enumerate(columns)}
        self.iv_ = {r["feature"]: r["iv"] for r in batch_iv(df, columns, y, self.bins).collect()}
        self.removed_ = {}
        left = []
        for c in columns:
            iv, missing = self.iv_.get(c), self.missing_[c]
            if missing is not None and missing > self.missing_threshold:
                self.removed_[c] = f"missing_rate={missing:.4f}"
            elif iv is None or math.isnan(iv):
                self.removed_[c] = "iv_nan"
            elif iv < self.iv_threshold:
                self.removed_[c] = f"iv={iv:.4f}"
            else:
                left.append(c)
        numbers = [c for c in left if is_numeric(df, c)]
        others = [c for c in left if c not in numbers]
        gone: dict[str, list[str]] = {}
        if len(numbers) > 1:
            for r in high_pairs(df, numbers, self.corr_threshold, self.method).collect():
                a, b, value = r["var1"], r["var2"], r["correlation"]
                if a in gone or b in gone:
                    for x, z in ((a, b), (b, a)):
                        if x in gone and z not in gone:
                            gone[x].append(f"{z}({abs(value):.3f})")
                    continue
                loser, winner = (a, b) if self.iv_[a] < self.iv_[b] else (b, a)
                gone[loser] = [f"{winner}({abs(value):.3f})"]
        for c, why in gone.items():
            self.removed_[c] = "high_corr: " + ", ".join(why)
        self.selected_ = others + [c for c in numbers if c not in gone]
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*[col(c) for c in dict.fromkeys([*self.selected_, *keep])])

    def report(self) -> list[dict]:
        return [{"feature": c, "iv": self.iv_.get(c), "missing_rate": self.missing_[c], "status": "removed" if c in self.removed_ else "selected", "reason": self.removed_.get(c, "")} for c in self.missing_]


class PostFilter:
    """Screening by stability between two samples and by variance inflation, removing the largest first."""

    def __init__(self, psi_threshold: float = 0.25, vif_threshold: float = 10.0, buckets: int = 10, iterative: bool = True):
        self.psi_threshold, self.vif_threshold, self.buckets, self.iterative = psi_threshold, vif_threshold, buckets, iterative
        self.selected_: list[str] = []
        self.removed_: dict[str, str] = {}
        self.psi_: dict[str, float | None] = {}
        self.vif_: dict[str, float] = {}

    def fit(self, train: DataFrame, test: DataFrame, columns: Sequence[str]) -> PostFilter:
        both = [c for c in columns if c in test.columns]
        numbers = [c for c in both if is_numeric(train, c)]
        self.psi_ = {r["feature"]: r["psi"] for r in psi_features(train, test, numbers, self.buckets).collect()} if numbers else {}
        self.removed_ = {c: f"psi={self.psi_[c]:.4f}" for c in numbers if self.psi_.get(c) is not None and self.psi_[c] > self.psi_threshold}
        left = [c for c in numbers if c not in self.removed_]
        self.vif_ = dict(vif(train, left))
        for _ in range(100):
            high = [(v, -i) for i, (c, v) in enumerate(self.vif_.items()) if c in left and v > self.vif_threshold]
            if not high:
                break
            if not self.iterative:
                for c in [c for c in left if self.vif_[c] > self.vif_threshold]:
                    self.removed_[c] = f"vif={self.vif_[c]:.4f}"
                    left.remove(c)
                break
            worst = list(self.vif_)[-max(high)[1]]
            self.removed_[worst] = f"vif={self.vif_[worst]:.4f}"
            left.remove(worst)
            self.vif_ = dict(vif(train, left))
        self.selected_ = [c for c in both if c not in self.removed_]
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*[col(c) for c in dict.fromkeys([*self.selected_, *keep]) if c in df.columns])


CRITERIA = ("aic", "bic", "pvalue")
DIRECTIONS = ("forward", "backward", "both")


class StepwiseSelector:
    """Stepwise logistic selection. A round's candidates are fitted together, so a round costs a handful of passes whatever their number.

    exclude: features that are always in. p_enter and p_remove hold for the criterion pvalue.
    """

    def __init__(self, direction: str = "both", criterion: str = "aic", p_enter: float = 0.05, p_remove: float = 0.10, max_iter: int = 100, exclude: Sequence[str] = ()):
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}, got {direction!r}")
        if criterion not in CRITERIA:
            raise ValueError(f"criterion must be one of {CRITERIA}, got {criterion!r}")
        self.direction, self.criterion, self.p_enter, self.p_remove, self.max_iter, self.exclude = direction, criterion, p_enter, p_remove, max_iter, list(exclude)
        self.selected_: list[str] = []
        self.history_: list[dict] = []

    def fit(self, df: DataFrame, columns: Sequence[str], y: str) -> StepwiseSelector:
        columns = list(dict.fromkeys([*self.exclude, *columns]))
        self.history_ = []
        own = prepared(df, columns, y).cache()
        try:
            self._search(df, at_hand(own), columns, y)
        finally:
            own.unpersist()
        return self

    def _search(self, df: DataFrame, own, columns: list[str], y: str) -> None:
        def fits(sets: list[list[str]]) -> list[Fit | None]:
            # from the coefficients of the model so far, few steps are left
            start = dict(zip((CONST, *now.columns), now.coefficients, strict=True)) if now is not None else None
            return fit_many(df, sets, y, own=own, columns=columns, start=start)

        def value(f: Fit | None) -> float:
            if f is None or not f.columns:
                return math.inf
            return f.bic if self.criterion == "bic" else f.aic

        def p_of(f: Fit, c: str) -> float:
            return float(f.p_values[1 + f.columns.index(c)])

        now: Fit | None = None
        held = [c for c in columns if c in self.exclude] if self.direction != "backward" else list(columns)
        now = fits([held])[0] if held else None

        def note(action: str, c: str, v: float) -> None:
            self.history_.append({"iteration": len(self.history_) + 1, "action": action, "feature": c, "criterion": self.criterion, "value": v})

        def add() -> bool:
            nonlocal held, now
            open_ = [c for c in columns if c not in held]
            made = [(c, f) for c, f in zip(open_, fits([[*held, c] for c in open_]), strict=True) if f is not None] if open_ else []
            if not made:
                return False
            if self.criterion == "pvalue":
                c, f = min(made, key=lambda m: p_of(m[1], m[0]))
                v = p_of(f, c)
                if not v < self.p_enter:
                    return False
            else:
                c, f = min(made, key=lambda m: value(m[1]))
                v = value(f)
                if not v < value(now):
                    return False
            held, now = [*held, c], f
            note("add", c, v)
            return True

        def remove() -> bool:
            nonlocal held, now
            free = [c for c in held if c not in self.exclude]
            if not free or now is None:
                return False
            if self.criterion == "pvalue":
                c = max(free, key=lambda c: p_of(now, c))
                v = p_of(now, c)
                if not v > self.p_remove:
                    return False
                held = [x for x in held if x != c]
                now = fits([held])[0] if held else None
            else:
                made = list(zip(free, fits([[x for x in held if x != c] for c in free]), strict=True))
                better = [(c, f) for c, f in made if value(f) < value(now)]
                if not better:
                    return False
                c, f = max(better, key=lambda m: p_of(now, m[0])) if self.direction == "both" else min(better, key=lambda m: value(m[1]))
                v = value(f)
                held, now = [x for x in held if x != c], f
            note("remove", c, v)
            return True

        for _ in range(self.max_iter):
            if self.direction == "forward":
                moved = add()
            elif self.direction == "backward":
                moved = remove()
            else:
                moved = add()
                moved = remove() or moved
            if not moved:
                break
        self.selected_ = held

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*[col(c) for c in dict.fromkeys([*self.selected_, *keep])])
