"""Exact linear-interpolated quantiles of many columns, without a task that orders a column.

Values are counted, equal ones first within their task; running sums over the distinct
values (see running_sums) give the ranks that each one holds, so the two values at a wanted
rank are found by a filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import numeric
from .running import running_sums


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(by..., keep..., feature, x): one row for each column, its value as a double or null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), numeric(df, c).alias("x")) for c in columns])
    return df.select(*by, *keep, F.explode(pairs).alias("__p")).select(*by, *keep, "__p.feature", "__p.x")


def quantile_rows(long: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), times: str | None = None, rows: int | None = None) -> DataFrame:
    """(by..., feature, n, place, p, value): exact quantiles of x in long (by..., feature, x); missing values don't count. times: a column that says how often a row counts. rows: no feature of a group has more, if the caller knows."""
    keys = [*by, "feature"]
    filled = long.where(F.col("x").isNotNull())
    counted = filled.groupBy(*keys, "x").agg((F.sum(times) if times else F.count("*")).cast("long").alias("c")).where("c > 0")
    run = running_sums(counted, keys, "x", ["c"], rows=rows)
    first, after, n = F.col("before_c"), F.col("before_c") + F.col("c"), F.col("all_c")

    def rank(p):
        return F.floor((n - 1) * p)

    # generated code leaves a value or two a probability; only these see lists
    run = run.where(reduce(lambda a, b: a | b, [(rank(float(p)) < after) & (rank(float(p)) + 1 >= first) for p in probabilities]))
    wanted = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)])
    held = F.filter(wanted, lambda w: (rank(w["p"]) < after) & (rank(w["p"]) + 1 >= first))
    # a value or two for each group, feature and probability
    near = run.select(*keys, "x", first.alias("__first"), after.alias("__after"), n.alias("n"), F.explode(held).alias("__w")).select(*keys, "x", "__first", "__after", "n", "__w.*")
    near = near.withColumn("h", (F.col("n") - 1) * F.col("p")).withColumn("rank", F.floor("h"))

    def at(place):
        return F.max(F.when((F.col("__first") <= place) & (place < F.col("__after")), F.col("x")))

    ranked = near.groupBy(*keys, "n", "place", "p").agg(at(F.col("rank")).alias("a"), at(F.col("rank") + 1).alias("b"), F.max("h").alias("h"))
    value = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("h") - F.floor("h"))
    return ranked.select(*keys, "n", "place", "p", value.alias("value"))


#: Values (rows x columns) up to which one exact aggregate holds their counts.
HELD = 3_000_000


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: columns x probabilities numbers; an all-missing column has none."""
    out: dict[str, list[float]] = {c: [] for c in columns}
    if not columns:
        return out
    rows = df.count()
    if rows * len(columns) <= HELD:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        found = df.agg(*[F.percentile(numeric(df, c), wanted).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: list(found[i] or []) for i, c in enumerate(columns)}
    near = quantile_rows(long_form(df, columns), probabilities, rows=rows).select("feature", "place", "value").collect()
    for r in sorted(near, key=lambda r: (r["feature"], r["place"])):
        out[r["feature"]].append(r["value"])
    return out
