"""Points scorecards: building from bins and a logistic model, scoring as one expression, and SQL text that scores the same."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions.columns import numeric
from .binning import Binner
from .logistic import CONST, LogisticModel


@dataclass
class Scorecard:
    """Points of each bin of each feature. Scores and SQL are keyed by a bin's number, so they agree whatever digits labels show."""

    base_score: float = 600.0
    pdo: float = 20.0
    base_odds: float = 1.0
    points_decimals: int | None = None
    intercept: float = 0.0
    splits: dict[str, list[float]] = field(default_factory=dict)
    woe: dict[str, list[float]] = field(default_factory=dict)  # of the missing bin, then of each bin
    coefficients: dict[str, float] = field(default_factory=dict)
    version: int = 1

    def __post_init__(self):
        d = self.points_decimals
        if d is not None and (isinstance(d, bool) or not isinstance(d, int) or d < 0):
            raise ValueError("points_decimals must be None or an int of at least 0")

    @property
    def factor(self) -> float:
        return self.pdo / math.log(2)

    @property
    def offset(self) -> float:
        return self.base_score - self.factor * math.log(self.base_odds)

    def _rounded(self, x: float) -> float:
        return x if self.points_decimals is None else round(x, self.points_decimals)

    @property
    def intercept_points(self) -> float:
        return self._rounded(self.offset - self.factor * self.intercept)

    def points(self, feature: str) -> list[float]:
        """Of the missing bin, then of each bin."""
        return [self._rounded(-w * self.coefficients[feature] * self.factor) for w in self.woe[feature]]

    @classmethod
    def build(cls, binner: Binner, model: LogisticModel | Mapping, **options) -> Scorecard:
        held = model if isinstance(model, Mapping) else model.to_dict()
        table = dict(held["coefficients"])
        features = [c for c in table if c != CONST]
        lacking = [f for f in features if f not in binner.rules_ or f not in binner.woe_maps_]
        if lacking:
            raise ValueError(f"no binning rule or WOE for {lacking}")
        woe = {f: [float(binner.woe_maps_[f].get(n, 0.0)) for n in (B.MISSING, *B.labels(binner.rules_[f]))] for f in features}
        return cls(intercept=float(table.get(CONST, 0.0)), splits={f: list(binner.rules_[f]) for f in features}, woe=woe, coefficients={f: float(table[f]) for f in features}, **options)

    def _built(self) -> None:
        if not self.coefficients:
            raise ValueError("Scorecard is not built. Call build() first.")

    def feature_points(self, df: DataFrame, feature: str) -> Column:
        return F.get(F.array(*[F.lit(p) for p in self.points(feature)]), B.bin_code(numeric(df, feature), self.splits[feature]) + 1)

    def expression(self, df: DataFrame) -> Column:
        """The score; features that df lacks add nothing."""
        self._built()
        out = F.lit(self.intercept_points)
        for f in self.coefficients:
            if f in df.columns:
                out = out + self.feature_points(df, f)
        return out if self.points_decimals is None else F.bround(out, self.points_decimals)

    def score(self, df: DataFrame, output: str = "score", breakdown: bool = False) -> DataFrame:
        extra = {f"{f}_points": self.feature_points(df, f) for f in self.coefficients if f in df.columns} if breakdown else {}
        return df.withColumns({output: self.expression(df), **extra})

    def rows(self) -> list[tuple[str, str, float, float]]:
        """(feature, bin, woe, points), the intercept first."""
        self._built()
        out = [("Intercept", "-", 0.0, self.intercept_points)]
        for f in self.coefficients:
            names = [B.MISSING, *B.labels(self.splits[f])]
            order = [*range(1, len(names)), 0]
            out += [(f, names[i], self.woe[f][i], self.points(f)[i]) for i in order]
        return out

    def export(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "feature string, bin string, woe double, points double")

    def to_sql(self, table: str, alias: str = "score", breakdown: bool = False) -> str:
        """A query over `table` with the score, in SQL that Spark and DuckDB both run."""
        self._built()

        def quoted(name: str) -> str:
            return '"' + name.replace('"', '""') + '"' if not name.isidentifier() else name

        def cases(f: str) -> str:
            missing, *rest = self.points(f)
            parts = [f"WHEN {quoted(f)} IS NULL THEN CAST({missing!r} AS DOUBLE)"]
            parts += [f"WHEN {quoted(f)} <= CAST({s!r} AS DOUBLE) THEN CAST({p!r} AS DOUBLE)" for s, p in zip(self.splits[f], rest[:-1], strict=True)]
            return "CASE " + " ".join(parts) + f" ELSE CAST({rest[-1]!r} AS DOUBLE) END"

        total = " + ".join([f"CAST({self.intercept_points!r} AS DOUBLE)", *map(cases, self.coefficients)])
        if self.points_decimals is not None:
            step = 10**self.points_decimals
            total = f"(CASE WHEN abs(({total}) * {step} - floor(({total}) * {step})) = 0.5 THEN 2 * round(({total}) * {step} / 2) ELSE round(({total}) * {step}) END) / {step}"
        columns = [f"{total} AS {quoted(alias)}"]
        if breakdown:
            columns += [f"{cases(f)} AS {quoted(f + '_points')}" for f in self.coefficients]
        return f"SELECT *, {', '.join(columns)} FROM {table}"

    def to_dict(self) -> dict:
        self._built()
        return asdict(self)

    @classmethod
    def from_dict(cls, held: Mapping) -> Scorecard:
        return cls(**held)

    def dump(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), ensure_ascii=False))

    @classmethod
    def load(cls, path: str) -> Scorecard:
        return cls.from_dict(json.loads(Path(path).read_text()))
