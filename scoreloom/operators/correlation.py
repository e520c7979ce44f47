"""Correlation matrices and variance inflation from one pass of sums, whatever the number of rows; rank correlations from running sums and from counts of pairs by ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric
from ..functions.running import running_sums, stretches

METHODS = ("pearson", "spearman", "kendall")
#: Pairs of columns whose sums are expressions of one aggregate; more are summed as matrices.
PAIRS = 60
#: Distinct pairs of values that one task of Kendall's count holds, about.
MOST = 1_000_000


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # the deviation of a constant may be a rounding error above 0
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(var1, var2, correlation) of all pairs in column order, over rows where both are present; null for a constant column.

    Spearman ranks each column over its present rows; Kendall is tau-b.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    columns = list(columns)
    pairs = _pairs(columns)
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "var1 string, var2 string, correlation double")
    if method == "kendall":
        return _kendall(df, pairs)
    own = df.select(*[numeric(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    if method == "spearman":
        own = _ranked(own)
    place = {c: i for i, c in enumerate(columns)}
    if len(pairs) > PAIRS:
        matrix = _pairwise(own, len(columns))
        rows = [(a, b, None if np.isnan(r := matrix[place[a], place[b]]) else float(r)) for a, b in pairs]
        return spark.createDataFrame(rows, "var1 string, var2 string, correlation double")
    exprs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"c{place[a]}"), F.col(f"c{place[b]}")
        r = pearson(x, y)
        exprs.append(F.when(~F.isnan(r), r).alias(f"p{i}"))
    row = own.agg(*exprs)
    made = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(made).alias("p")).select("p.*").orderBy("i").drop("i")


def _summed(own: DataFrame, size: int, partial) -> np.ndarray:
    """The sum over all batches of partial(rows as a matrix): numpy by batch, added up by Spark, `size` numbers on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            total += partial(batch.to_numpy(float))
        yield pd.DataFrame({"place": np.arange(size), "value": total})

    out = np.zeros(size)
    for r in own.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def _pairwise(own: DataFrame, k: int) -> np.ndarray:
    """Correlations of all pairs over rows where both are present, from k x k sums about the first values; nan where either is constant."""
    first = own.agg(*[F.first(c, ignorenulls=True).alias(c) for c in own.columns]).first()
    base = np.array([v if v is not None else 0.0 for v in first], float)

    def partial(x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        x, m = np.where(there, x - base, 0.0), there.astype(float)
        return np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]).ravel()

    n, s, q, p = _summed(own, 4 * k * k, partial).reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n
        spread = np.where(spread > 1e-12 * q, spread, 0.0)
        return (p - s * s.T / n) / np.sqrt(np.where(spread * spread.T > 0, spread * spread.T, np.nan))


def _ranked(own: DataFrame) -> DataFrame:
    """Each column as its average ranks: distinct values are counted, running sums give ranks, joined back by value."""
    for c in own.columns:
        counts = own.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").cast("double").alias("n"))
        ranks = running_sums(counts, [], c, ["n"]).select(F.col(c).alias("__v"), (F.col("before_n") + (F.col("n") + 1) / 2).alias("__r"))
        own = own.join(ranks, F.col(c) == F.col("__v"), "left").drop("__v", c).withColumnRenamed("__r", c)
    return own


def discordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weight of pairs of entries that x and y order differently, entry i counting n[i] times: for each bit of y's rank, the entries with it before those without among entries equal in higher bits."""
    if len(x) < 2:
        return 0.0
    order = np.lexsort((y, x))  # of one x, y ascends, so ties of x are never out of order
    _, rank = np.unique(y[order], return_inverse=True)
    n, total = n[order].astype(float), 0.0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        # rows are grouped by the bits above, in x order within a group
        group, one = rank >> (bit + 1), (rank >> bit) & 1
        upto = np.cumsum(n * one)
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = np.repeat(np.r_[0.0, upto][start], np.diff(np.r_[start, len(n)]))
        total += float((n * (1 - one) * (upto - before)).sum())
        place = np.argsort(2 * group + one, kind="stable")
        rank, n = rank[place], n[place]
    return total


def _kendall(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Tau-b from counts of distinct pairs of values.

    Discordant pairs are counted by a task a pair of columns, or, beyond MOST distinct pairs,
    by stretches of x and of y: pairs in different ones of both follow from the counts of all
    combinations, the others lie within a stretch of x, or within one of y but not of both.
    """
    made = F.array(*[F.struct(F.lit(i).alias("i"), numeric(df, a).alias("x"), numeric(df, b).alias("y")) for i, (a, b) in enumerate(pairs)])
    long = df.select(F.explode(made).alias("p")).select("p.*").where("x is not null and y is not null")
    counts = long.groupBy("i", "x", "y").agg(F.count("*").alias("n"))

    def ties(*by: str) -> Column:
        return F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)

    whole = counts.groupBy("i").agg(F.sum("n").alias("n"), ties().alias("both"))
    whole = whole.select("i", (F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("n0"), "both")
    tied = [counts.groupBy("i", c).agg(F.sum("n").alias("n")).groupBy("i").agg(ties().alias(f"t{c}")) for c in ("x", "y")]
    out = whole.join(tied[0], "i").join(tied[1], "i").join(_out_of_order(counts), "i")
    scale = F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))
    found = out.select("i", F.when(scale > 0, (F.col("n0") - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("d")) / scale).alias("r"))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, var1 string, var2 string")
    return names.join(found, "i", "left").orderBy("i").select("var1", "var2", F.col("r").alias("correlation"))


def _out_of_order(counts: DataFrame, most: int | None = None) -> DataFrame:
    """(i, d): the discordant pairs of counts (i, x, y, n)."""
    most = MOST if most is None else most

    def within(rows: DataFrame, *by: str) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            x, y, n = (table.column(c).to_numpy() for c in ("x", "y", "n"))
            return pa.table({"i": table.column("i")[:1].combine_chunks(), "d": pa.array([discordant(x, y, n)])})

        return rows.groupBy("i", *by).applyInArrow(run, "i int, d double").groupBy("i").agg(F.sum("d").alias("d"))

    cut = stretches(counts, ["i"], "x", most)
    if cut is None:
        return within(counts)
    cut = cut.withColumnRenamed("__at", "s")
    both = stretches(cut, ["i"], "y", most)
    both = (cut.withColumn("t", F.lit(0)) if both is None else both.withColumnRenamed("__at", "t")).select("i", "x", "y", "n", "s", "t")
    cells = both.groupBy("i", "s", "t").agg(F.sum("n").cast("double").alias("w"))  # as many as combinations of stretches
    later = cells.select(F.col("i").alias("j"), F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("w").alias("w2"))
    apart = cells.join(later, (F.col("i") == F.col("j")) & (F.col("s") < F.col("s2")) & (F.col("t") > F.col("t2"))).groupBy("i").agg(F.sum(F.col("w") * F.col("w2")).alias("d"))
    parts = [apart, within(both, "s"), within(both, "t"), within(both, "s", "t").select("i", (-F.col("d")).alias("d"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("i").agg(F.sum("d").alias("d"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> pd.DataFrame:
    """The square matrix on the driver: columns x columns numbers."""
    out = pd.DataFrame(np.eye(len(columns)), index=list(columns), columns=list(columns))
    for r in correlations(df, columns, method).collect():
        out.loc[r["var1"], r["var2"]] = out.loc[r["var2"], r["var1"]] = np.nan if r["correlation"] is None else r["correlation"]
    return out


def high_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8, method: str = "pearson") -> DataFrame:
    """(var1, var2, correlation) with an absolute value of at least threshold, the largest first, then in column order."""
    place = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (c, i)]) if columns else None
    out = correlations(df, columns, method).where(F.abs("correlation") >= threshold)
    return out.orderBy(F.desc(F.abs(F.col("correlation"))), place[F.col("var1")], place[F.col("var2")]) if columns else out


def vif(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation of each column over rows where all are present.

    One pass gives the sums of products; the k x k rest is solved on the driver. Fewer than
    two columns, or a constant one: 1; a column that others explain wholly: inf.
    """
    columns = list(columns)
    if len(columns) < 2:
        return [(c, 1.0) for c in columns]
    gram, mean, n = moments(df, columns)
    if n < 2:
        return [(c, float("nan")) for c in columns]
    cov = gram / n - np.outer(mean, mean)
    out = []
    for i, c in enumerate(columns):
        rest = [j for j in range(len(columns)) if j != i]
        if cov[i, i] <= 1e-12 * max(1.0, mean[i] ** 2):
            out.append((c, 1.0))
            continue
        scale = np.sqrt(np.maximum(np.diag(cov)[rest], 1e-300))
        a = cov[np.ix_(rest, rest)] / np.outer(scale, scale)
        b = cov[rest, i] / scale
        beta = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        r2 = float(b @ beta / cov[i, i])
        out.append((c, float("inf") if r2 >= 1 - 1e-12 else 1 / (1 - max(r2, 0.0))))
    return out


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products, means and number of rows where all columns are present: partial sums in numpy by batch, about the first row, added up by Spark."""
    k = len(columns)
    own = df.select(*[numeric(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    first = own.first()
    if first is None:
        return np.zeros((k, k)), np.zeros(k), 0
    base = np.array(list(first), float)

    def partial(x: np.ndarray) -> np.ndarray:
        x = x - base
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    values = _summed(own, 1 + k + k * k, partial)
    n, s, p = int(values[0]), values[1 : 1 + k], values[1 + k :].reshape(k, k)
    gram = p + np.outer(s, base) + np.outer(base, s) + n * np.outer(base, base)
    return gram, s / n + base, n


__all__ = ["METHODS", "correlation_matrix", "correlations", "high_pairs", "moments", "pearson", "vif"]
