"""The tables of monitoring, one call each, for notebooks: from raw columns to a DataFrame in report order.

score_type says what a high score means: "probability" more risk, "score" less, which turns
AUC round and counts lift from low scores. Amounts need both columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from .functions.columns import col, month_text, tag_text
from .operators import tables

SCORE_TYPES = ("probability", "score")


def _reverse(score_type: str) -> bool:
    if score_type not in SCORE_TYPES:
        raise ValueError(f"score_type must be one of {SCORE_TYPES}, got {score_type!r}")
    return score_type == "score"


def _checked(data: DataFrame, columns: Sequence[str], principal: str | None, loan: str | None) -> None:
    if (principal is None) != (loan is None):
        raise ValueError("the amount columns come as a pair")
    lacking = [c for c in [*columns, *[c for c in (principal, loan) if c]] if c not in data.columns]
    if lacking:
        raise ValueError(f"data lacks {lacking}")


def calculate_split_metrics(data: DataFrame, tag_col: str, date_col: str, label_list: Sequence[str], score_col: str, model_name: str, score_type: str = "probability", prin_bal_amount_col: str | None = None, loan_amount_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics of every label by sample set, whose 观察点月 is its range of dates, and by month of date_col."""
    reverse = _reverse(score_type)
    _checked(data, [tag_col, date_col, *label_list, score_col], prin_bal_amount_col, loan_amount_col)
    own = data.withColumn(tag_col, tag_text(col(tag_col))).withColumn("__month", month_text(data, date_col))
    return tables.split_metrics(own, label_list, score_col, tag_col, "__month", date=date_col, model=model_name, reverse_auc=reverse, principal=prin_bal_amount_col, loan=loan_amount_col)


def calculate_dimensional_comparison(data: DataFrame, dim_list: Sequence[str], label_list: Sequence[str], score_model_columns: Sequence[tuple[str, str]], score_type: str = "probability", prin_bal_amount_col: str | None = None, loan_amount_col: str | None = None) -> DataFrame:
    """Metrics of every value of every dimension, for each label and (model name, score column)."""
    reverse = _reverse(score_type)
    _checked(data, [*dim_list, *label_list, *[s for _, s in score_model_columns]], prin_bal_amount_col, loan_amount_col)
    parts = [tables.dimensional_comparison(data, dim_list, label_list, score, model=name, reverse_auc=reverse, principal=prin_bal_amount_col, loan=loan_amount_col) for name, score in score_model_columns]
    return reduce(DataFrame.unionByName, parts).orderBy("维度列", "维度值", "样本标签", "模型")


def calculate_model_comparison(data: DataFrame, tag_col: str, date_col: str, label_col: str, score_model_columns: Sequence[tuple[str, str]], group_mode: str = "tag", score_type: str = "probability") -> DataFrame:
    """Metrics of several models on the rows where all their scores are above 0, by "tag" or "month"."""
    if group_mode not in ("tag", "month"):
        raise ValueError(f"group_mode must be 'tag' or 'month', got {group_mode!r}")
    reverse = _reverse(score_type)
    _checked(data, [tag_col, date_col, label_col, *[s for _, s in score_model_columns]], None, None)
    own = data.withColumn(tag_col, tag_text(col(tag_col))).withColumn("__month", month_text(data, date_col))
    scores = [s for _, s in score_model_columns]
    return tables.model_comparison(own, label_col, scores, [tag_col if group_mode == "tag" else "__month"], [n for n, _ in score_model_columns], tag=tag_col, month="__month", reverse=scores if reverse else ())


def calculate_bin_metrics(data: DataFrame, label_col: str, score_col: str, q: int = 10, bins: Sequence[float] | None = None, prin_bal_amount_col: str | None = None, loan_amount_col: str | None = None) -> DataFrame:
    """Performance of quantile bins, or of given edges, with amounts if both columns are named."""
    _checked(data, [label_col, score_col], prin_bal_amount_col, loan_amount_col)
    return tables.bin_metrics(data, label_col, score_col, q, bins, prin_bal_amount_col, loan_amount_col)
