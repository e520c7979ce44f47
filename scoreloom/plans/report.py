"""The monitoring report: sheets of named tables, each a lazy DataFrame until written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, label, month_text, tag_text
from ..operators import binning, tables
from ..operators import features as FT
from ..operators.correlation import correlation_matrix
from ..operators.importance import ModelView
from ..operators.metrics import amount_metrics, binary_metrics
from ..operators.selection import eda_summary
from ..sources.xlsx import Chart, write_workbook

# Keys of sheets and their names; appendices are numbered as they come.
SHEETS = {
    "overview": "总览",
    "model_design": "1.模型设计",
    "variable_analysis": "2.变量分析",
    "scorecard_details": "评分卡计算明细",
    "model_performance": "3.模型表现",
    "dimensional_comparison": "分维度对比",
    "model_comparison": "新老模型对比",
    "amount_metrics": "金额指标",
    "portrait": "画像变量",
}
APPENDICES = ("dimensional_comparison", "model_comparison", "amount_metrics", "portrait")
INDEX = {1: "overview", 2: "model_design", 3: "variable_analysis", 4: "model_performance", 5: "scorecard_details"}


@dataclass
class Block:
    title: str
    data: DataFrame
    chart: Chart | None = None


@dataclass
class Sheet:
    key: str
    name: str
    blocks: list[Block] = field(default_factory=list)


class Report:
    """Builds the sheets that the given columns allow.

    data holds a sample set column (tag), a date or month column, labels, a score, and
    optionally features, dimensions, other scores, amounts and portrait variables.
    """

    def __init__(self, data: DataFrame, labels: Sequence[str], score: str, tag: str, date: str, features: Sequence[str] = (), dimensions: Sequence[str] = (), old_scores: Sequence[str] = (), variables: Sequence[str] = (), principal: str | None = None, loan: str | None = None, scorecard=None, dictionary: DataFrame | None = None, method: str = "quantile", model=None):
        lacking = [c for c in [*labels, score, tag, date, *features, *dimensions, *old_scores, *variables, *[c for c in (principal, loan) if c]] if c not in data.columns]
        if lacking:
            raise ValueError(f"data lacks {lacking}")
        if (principal is None) != (loan is None):
            raise ValueError("principal and loan come as a pair")
        self.month = "__month"
        self.data = data.withColumn(tag, tag_text(col(tag))).withColumn(self.month, month_text(data, date))
        self.labels, self.score, self.tag, self.features = list(labels), score, tag, list(features)
        self.dimensions, self.old_scores, self.variables, self.principal, self.loan = list(dimensions), list(old_scores), list(variables), principal, loan
        self.date, self.scorecard, self.dictionary, self.method = date, scorecard, dictionary, method
        self._made: dict[str, list[Block]] = {}
        view = model if model is not None else scorecard
        self.model = view if view is None or isinstance(view, ModelView) else ModelView(view)

    def _of(self, name: str) -> DataFrame:
        return self.data.where(F.lower(col(self.tag)) == name)

    def available(self) -> list[str]:
        oot = bool(self.dimensions or self.variables) and not self._of("oot").isEmpty()
        out = ["overview", "model_design", "variable_analysis", *(["scorecard_details"] if self.scorecard is not None else []), "model_performance"]
        out += [k for k, there in (("dimensional_comparison", self.dimensions and oot), ("model_comparison", self.old_scores), ("amount_metrics", self.loan), ("portrait", self.variables and oot)) if there]
        return out

    def build(self, sheets: Sequence[str | int] | None = None) -> list[Sheet]:
        there = self.available()
        wanted = there if sheets is None else [INDEX.get(s, s) if isinstance(s, int) else s for s in sheets]
        unknown = [s for s in wanted if s not in SHEETS]
        if unknown:
            raise ValueError(f"unknown sheets: {unknown}")
        chosen = [k for k in SHEETS if k in wanted and k in there]
        if not chosen:
            raise ValueError("none of the sheets asked for is available")
        out, appendix = [], 0
        for key in chosen:
            name = SHEETS[key]
            if key in APPENDICES:
                appendix += 1
                name = f"附{appendix} {name}"
            out.append(Sheet(key, name, self._blocks(key)))
        return out

    def _blocks(self, key: str) -> list[Block]:
        """A sheet's blocks, made once: the overview shows some of them again."""
        if key not in self._made:
            self._made[key] = getattr(self, f"_{key}")()
        return self._made[key]

    def _split(self) -> list[Block]:
        return self._blocks("split_metrics")

    def _split_metrics(self) -> list[Block]:
        by_tag, by_month = tables.split_metrics(self.data, self.labels, self.score, self.tag, self.month, principal=self.principal, loan=self.loan, date=self.date)
        return [Block("各样本集模型效果", by_tag), Block("分月模型效果", by_month)]

    def _overview(self) -> list[Block]:
        """Goals (a table to fill in), the effect of the iteration, and what the appendices show."""
        goals = self.data.sparkSession.createDataFrame([], "`迭代目标` string, `问题` string, `原因` string, `迭代方向` string")
        out = [Block("一、目标与设计方案", goals), Block("二、迭代效果 分数方向", tables.score_direction(self.data, self.labels[0], [self.score, *self.old_scores], self.tag)), *self._split()]
        there = self.available()
        for key in ("dimensional_comparison", "model_comparison", "portrait"):
            if key in there:
                out += [Block(f"{SHEETS[key]} {b.title}", b.data) for b in self._blocks(key)]
        return out

    def _model_design(self) -> list[Block]:
        out = [Block(f"样本分布 {y}", tables.label_distribution(self.data, y, self.tag, self.month)) for y in self.labels]
        counts = [binary_metrics(self.data, y, self.score, [self.tag]).select(F.lit(y).alias("样本标签"), col(self.tag).alias("样本集"), "好", "坏", "总", "坏占比", "AUC", "KS") for y in self.labels]
        return out + [Block(f"样本量与效果 {y}", c) for y, c in zip(self.labels, counts, strict=True)]

    def _variable_analysis(self) -> list[Block]:
        if not self.features:
            return []
        y, train, oot, spark = self.labels[0], self._of("train"), self._of("oot"), self.data.sparkSession
        labelled = train.where(label(train, y).isNotNull())
        rules = dict(self.scorecard.splits) if self.scorecard is not None else {}
        rules = {f: s for f, s in rules.items() if f in self.features}
        importance = self.model.importance() if self.model is not None else []
        summary = self.model.summary() if self.model is not None else []
        table = FT.variable_table(train, oot, self.features, y, rules, importance, self.dictionary, summary)
        shown_importance = self.model is not None and self.model.family not in ("scorecard", "logistic")
        if not shown_importance:
            table = table.drop("gain", "gain_per", "weight", "weight_per")
        rank = {r["feature"]: i for i, r in enumerate(importance)}
        ordered = sorted(self.features, key=lambda f: rank.get(f, len(rank)))
        top = ordered if self.scorecard is not None else ordered[: FT.TOP]
        out = [Block("一、变量筛选", FT.selection_summary(spark, len(self.features), len(top)))]
        if self.dictionary is not None:
            out.append(Block("变量类型分布", FT.type_distribution(spark, self.features, self.dictionary)))
        out += [Block("二、变量分析", table), Block("变量EDA", eda_summary(self.data, self.features))]
        if self.model is not None and (stats := self.model.model_summary()):
            out.append(Block("三、模型统计摘要", spark.createDataFrame([(n, None if v is None else float(v)) for n, v in stats], "`统计项` string, `数值` double")))
        # one pass for the bins of all features, of each set, and one for all months
        rest = [f for f in top if f not in rules]
        splits = rules | (binning.fit_splits(labelled, rest, y, self.method) if rest else {})
        bins = {name: FT.feature_bins(part, splits, y) for name, part in (("训练", train), ("OOT", oot))}
        months = FT.monthly_metrics(self.data, train, top, y, self.month, splits)
        for i, f in enumerate(top, 1):
            for name, of in bins.items():
                out.append(Block(f"{i}.{f} {name}分箱表", of.where(F.col("feature") == f).drop("feature", "bin_idx"), Chart("bin", "total_prop", "bad_rate", f"{f} {name}")))
            out.append(Block(f"{i}.{f} 按月效果", months.where(F.col("feature") == f).drop("feature")))
        return out

    def _scorecard_details(self) -> list[Block]:
        card, spark = self.scorecard, self.data.sparkSession
        view = self.model if self.model is not None and self.model.model is card else ModelView(card)
        return [Block("评分卡参数", spark.createDataFrame(view.parameters(), "`参数名称` string, `数值` string, `参数解释` string")), Block("评分卡明细", card.export(spark))]

    def _model_performance(self) -> list[Block]:
        y = self.labels[0]
        edges = tables.quantile_edges(self._of("train"), self.score)
        params = [Block("模型参数", self.data.sparkSession.createDataFrame(self.model.parameters(), "`参数名称` string, `数值` string, `参数解释` string"))] if self.model is not None else []
        return [*params, *self._split(), Block("各样本集分箱", tables.bin_performance(self.data, y, self.score, edges, [self.tag])), Block("分月分箱", tables.bin_performance(self.data, y, self.score, edges, [self.month]))]

    def _dimensional_comparison(self) -> list[Block]:
        oot = self._of("oot")
        return [Block(f"{i}.{d}", tables.dimensional_comparison(oot, [d], self.labels, self.score, principal=self.principal, loan=self.loan)) for i, d in enumerate(self.dimensions, 1)]

    def _model_comparison(self) -> list[Block]:
        out = []
        for old in self.old_scores:
            for name, by in (("分样本集", [self.tag]), ("分月", [self.month])):
                out.append(Block(f"{old} {name}", tables.model_comparison(self.data, self.labels[0], [self.score, old], by, tag=self.tag, month=self.month)))
        matrix = correlation_matrix(self._of("oot"), [self.score, *self.old_scores]).round(4)
        rows = [(name, *map(float, row)) for name, row in zip(matrix.index, matrix.to_numpy(), strict=True)]
        return [*out, Block("OOT分数相关性", self.data.sparkSession.createDataFrame(rows, ["模型", *matrix.columns]))]

    def _amount_metrics(self) -> list[Block]:
        out = []
        for y in self.labels:
            for by in ([self.tag], [self.month], *[[d] for d in self.dimensions]):
                out.append(Block(f"{y} {by[0]}", amount_metrics(self.data, y, self.score, self.principal, self.loan, by)))
        return out

    def _portrait(self) -> list[Block]:
        pivot = tables.portrait_pivot(self._of("oot"), [self.score, *self.old_scores], self.variables)
        return [Block(v, pivot.where(F.col("画像变量") == v)) for v in self.variables]

    def write(self, path: str, sheets: Sequence[str | int] | None = None) -> None:
        """A workbook of the sheets; every table is of the size of its groups or bins, and is computed once."""
        made = self.build(sheets)
        tables = {id(b.data): b.data for s in made for b in s.blocks}
        rows = {k: [list(r) for r in t.collect()] for k, t in tables.items()}
        write_workbook(path, {s.name: [(b.title, b.data.columns, rows[id(b.data)], b.chart) for b in s.blocks] for s in made})
