"""Bins as expressions over split points."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import MISSING


def clean_splits(values: Sequence[float]) -> list[float]:
    """Finite split points, sorted and distinct."""
    return sorted({float(v) for v in values if v is not None and math.isfinite(v)})


def bin_code(x: Column, splits: Sequence[float], closed: str = "right", missing: int | None = -1) -> Column:
    """Number of the bin, from 0; null: `missing`. closed="right": (a, b]; "left": [a, b).

    The expression is a balanced tree of comparisons, so its depth is the logarithm of the
    number of splits, and stays within generated code.
    """

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        left = x <= splits[mid] if closed == "right" else x < splits[mid]
        return F.when(left, tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(x.isNull(), F.lit(missing)).otherwise(tree(0, len(splits)))


#: Features whose edges are comparisons of a plan; those of more are a table that is joined.
IN_PLAN = 16


def coded_by_feature(long: DataFrame, edges: Mapping[str, Sequence[float] | None], column: str) -> DataFrame:
    """long (feature, x) of the features in edges, with the number of x's bin [a, b) in `column`, missing -1; 0 for all of a feature without edges (None)."""
    if len(edges) <= IN_PLAN:
        code = F.lit(None).cast("int")
        for f, own in edges.items():
            code = F.when(F.col("feature") == f, F.lit(0) if own is None else bin_code(F.col("x"), list(own), closed="left")).otherwise(code)
        return long.withColumn(column, code).where(F.col("feature").isin(list(edges)))
    table = long.sparkSession.createDataFrame([(f, None if own is None else [float(e) for e in own]) for f, own in edges.items()], "__f string, __edges array<double>")
    joined = long.join(F.broadcast(table), F.col("feature") == F.col("__f"))  # a row a feature, from the driver
    code = F.when(F.col("__edges").isNull(), 0).when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("__edges", lambda e: e <= F.col("x"))))
    return joined.withColumn(column, code).drop("__f", "__edges")


def _text(value: float, digits: int) -> str:
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    if value == 0:
        return "0.0"
    whole, part = math.modf(value)[1], abs(math.modf(value)[0])
    places = digits if whole else digits - 1 - math.floor(math.log10(part)) if part else digits
    rounded = round(value, max(places, 0))
    return repr(float(rounded))


def labels(splits: Sequence[float], precision: int = 3) -> list[str]:
    """Texts of the bins (a, b], with as many digits as keep the bounds distinct."""
    bounds = [-math.inf, *splits, math.inf]
    for digits in range(precision, 20):
        texts = [_text(v, digits) for v in bounds]
        if len(set(texts)) == len(texts):
            break
    return [f"({a}, {b}]" for a, b in zip(texts[:-1], texts[1:], strict=True)]


def label_of(code: Column, splits: Sequence[float]) -> Column:
    """Text of a bin's number."""
    names = labels(splits)
    return F.when(code < 0, F.lit(MISSING)).otherwise(F.get(F.array(*[F.lit(x) for x in names]), code))


def bounds(code: Column, splits: Sequence[float]) -> tuple[Column, Column]:
    """Lower and upper bound of a bin; null for the missing bin."""
    edges = F.array(*[F.lit(float(x)) for x in (-math.inf, *splits, math.inf)])
    inside = code >= 0
    return F.when(inside, F.get(edges, code)), F.when(inside, F.get(edges, code + 1))
