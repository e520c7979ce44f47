"""From features to scores in named steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import numeric_columns
from ..operators.binning import Binner
from ..operators.logistic import LogisticModel
from ..operators.scorecard import Scorecard
from ..operators.selection import FeatureSelector, PostFilter, StepwiseSelector
from ..operators.woe import WOETransformer


class ScorecardPipeline:
    """prefilter, bin, woe_transform, postfilter, stepwise, build_model, generate_scorecard and score, each on what the ones before left.

    Frames stay lazy: a step keeps expressions and small fitted state, so scoring is one
    projection over the input. Features without a binning rule, texts above all, take the
    weights of evidence of their values; a scorecard needs a rule for every feature of its model.
    """

    def __init__(self, train: DataFrame, y: str, test: DataFrame | None = None, features: Sequence[str] | None = None):
        self.train, self.test, self.y = train, test, y
        self.features = [f for f in (features if features is not None else train.columns) if f != y]
        self.steps: list[str] = []
        self.selector: FeatureSelector | None = None
        self.binner: Binner | None = None
        self.encoder: WOETransformer | None = None
        self.post: PostFilter | None = None
        self.stepper: StepwiseSelector | None = None
        self.model: LogisticModel | None = None
        self.card: Scorecard | None = None
        self._woe: DataFrame | None = None
        self._woe_test: DataFrame | None = None

    def _after(self, step: str, *needed: str) -> None:
        lacking = [n for n in needed if n not in self.steps]
        if lacking:
            raise ValueError(f"{step} comes after {lacking}")
        self.steps.append(step)

    def prefilter(self, **options) -> ScorecardPipeline:
        self._after("prefilter")
        self.selector = FeatureSelector(**options).fit(self.train, self.y, self.features)
        self.features = self.selector.selected_
        return self

    def bin(self, **options) -> ScorecardPipeline:
        self._after("bin")
        self.binner = Binner().fit(self.train, self.y, numeric_columns(self.train, self.features), **options)
        return self

    def woe_transform(self) -> ScorecardPipeline:
        self._after("woe_transform", "bin")
        unbinned = [f for f in self.features if f not in self.binner.rules_]
        self.encoder = WOETransformer(unbinned).fit(self.train, self.y) if unbinned else None
        self._woe = self.encoded(self.train)
        self._woe_test = self.encoded(self.test) if self.test is not None else None
        return self

    def encoded(self, df: DataFrame) -> DataFrame:
        """df with every feature as its weight of evidence; values not seen in train: 0."""
        out = self.binner.woe_transform(df) if self.binner.rules_ else df
        return self.encoder.transform(out) if self.encoder is not None else out

    def postfilter(self, **options) -> ScorecardPipeline:
        self._after("postfilter", "woe_transform")
        self.post = PostFilter(**options).fit(self._woe, self._woe_test if self._woe_test is not None else self._woe, self.features)
        self.features = self.post.selected_
        return self

    def stepwise(self, **options) -> ScorecardPipeline:
        self._after("stepwise", "woe_transform")
        self.stepper = StepwiseSelector(**options).fit(self._woe, self.features, self.y)
        self.features = self.stepper.selected_
        return self

    def build_model(self, **options) -> ScorecardPipeline:
        self._after("build_model", "woe_transform")
        self.model = LogisticModel(**options).fit(self._woe, self.features, self.y)
        return self

    def generate_scorecard(self, **options) -> ScorecardPipeline:
        self._after("generate_scorecard", "build_model")
        self.card = Scorecard.build(self.binner, self.model, **options)
        return self

    def score(self, df: DataFrame, output: str = "score", breakdown: bool = False) -> DataFrame:
        if self.card is None:
            raise ValueError("score comes after ['generate_scorecard']")
        return self.card.score(df, output, breakdown)

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """df with the model's probability. Weights of evidence stand in for the features within the expression only."""
        if self.model is None:
            raise ValueError("predict_proba comes after ['build_model']")
        names = {f: f"__woe_{i}" for i, f in enumerate(self.model.columns_)}
        # the features once more, under names of their own, to be encoded beside the others
        ruled = {names[f]: self.binner.woe_expression(df, f) for f in names if f in self.binner.rules_}
        out = df.withColumns(ruled)
        for f in names:
            if names[f] not in ruled:
                out = self.encoder.encoders[f].transform(out, names[f])
        renamed = LogisticModel(columns_=list(names.values()), coefficients_={names.get(k, k): v for k, v in self.model.coefficients_.items()})
        return renamed.predict_proba(out, output).drop(*names.values())
