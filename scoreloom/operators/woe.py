"""Weights of evidence, information values and full statistics of bins.

Rows are met once, in a count by feature and bin; all that follows is arithmetic and
windows over bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions.columns import EPSILON, MISSING, category, is_numeric, label, numeric
from ..functions.quantiles import long_form, quantile_rows
from ..functions.running import running_sums

STATS = ("bin", "min", "max", "bads", "goods", "total", "bad_rate", "good_rate", "odds", "bad_prop", "good_prop", "total_prop", "cum_bads", "cum_goods", "cum_total", "cum_bads_prop", "cum_goods_prop", "cum_total_prop", "ks", "woe", "iv", "lift")


def counts(rows: DataFrame, by: Sequence[str], y: Column) -> DataFrame:
    """total, bad and good by the columns; rows without a binary label don't count."""
    return rows.where(y.isNotNull()).groupBy(*by).agg(F.count("*").alias("total"), F.sum(y).cast("long").alias("bad")).withColumn("good", F.col("total") - F.col("bad"))


def with_woe(binned: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Counts by bin with dist_good, dist_bad, woe = ln(dist_good / dist_bad) and iv_contribution. Counts of 0 are taken as 1, totals as they are; 0 where a whole class is missing."""
    whole = Window.partitionBy(*by)
    good, bad = F.sum("good").over(whole), F.sum("bad").over(whole)
    out = binned.withColumn("__g", good).withColumn("__b", bad)
    fair = (F.col("__g") > 0) & (F.col("__b") > 0)
    out = out.withColumn("dist_good", F.when(fair, F.greatest("good", F.lit(1)) / F.nullif("__g", F.lit(0)))).withColumn("dist_bad", F.when(fair, F.greatest("bad", F.lit(1)) / F.nullif("__b", F.lit(0))))
    woe = F.coalesce(F.ln(F.col("dist_good") / F.col("dist_bad")), F.lit(0.0))
    out = out.withColumn("woe", woe)
    return out.withColumn("iv_contribution", F.coalesce((F.col("dist_good") - F.col("dist_bad")) * F.col("woe"), F.lit(0.0))).drop("__g", "__b")


def categorical_iv(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """feature, bin, counts, woe and iv_contribution of features taken by their values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), category(df, c).alias("bin")) for c in features])
    long = df.select(label(df, y).alias("__y"), F.explode(pairs).alias("p")).select("__y", "p.*")
    return with_woe(counts(long, ["feature", "bin"], F.col("__y")))


def batch_iv(df: DataFrame, features: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """feature and iv, in the order given.

    Numeric features with more distinct values than `bins` are cut at order statistics
    (n - 1) * i / k of their values, [a, b); others and texts are taken by value. Missing
    values are a bin of their own. A constant feature has 0.
    """
    numbers = [f for f in features if is_numeric(df, f, booleans=True)]
    parts = []
    if numbers:
        long = long_form(df.withColumn("__y", label(df, y)).where("__y is not null"), numbers, keep=["__y"])
        values = long.groupBy("feature", "x").agg(F.count("*").alias("total"), F.sum("__y").cast("long").alias("bad"))
        edges = _positions(values, bins, df.count())
        coded = B.coded_by_feature(values, {f: edges.get(f) for f in numbers}, "bin")
        binned = coded.withColumn("bin", F.col("bin").cast("string")).groupBy("feature", "bin").agg(F.sum("total").alias("total"), F.sum("bad").alias("bad"))
        parts.append(with_woe(binned.withColumn("good", F.col("total") - F.col("bad"))))
    texts = [f for f in features if f not in numbers]
    if texts:
        parts.append(categorical_iv(df, texts, y))
    both = parts[0] if len(parts) == 1 else parts[0].select("feature", "iv_contribution").unionByName(parts[1].select("feature", "iv_contribution"))
    place = F.create_map(*[F.lit(v) for i, f in enumerate(features) for v in (f, i)])
    return both.groupBy("feature").agg(F.sum("iv_contribution").alias("iv")).orderBy(place[F.col("feature")])


def _positions(values: DataFrame, bins: int, rows: int) -> dict[str, list[float]]:
    """For each feature of n values, d of them distinct, the values at positions round((n - 1) * i / k) of its sorted values, k = min(bins, d), inner ones, distinct; features of fewer than two values are left out.

    values: (feature, x, total), no feature more than `rows`. Positions fall into the runs of equal values, found by running sums.
    """
    own = values.where(F.col("x").isNotNull()).withColumn("one", F.lit(1))
    run = running_sums(own, ["feature"], "x", ["total", "one"], rows=rows)
    k = F.least(F.lit(bins), F.col("all_one"))
    first, after, last = F.col("before_total"), F.col("before_total") + F.col("total"), F.col("all_total") - 1
    # the first position from `first` on is of one of these numbers
    near_i = F.floor(first * k / last)
    hit = F.lit(False)
    for step in (-1, 0, 1):
        i = near_i + step
        position = F.bround(last * i / k)
        hit = hit | ((i >= 0) & (i <= k) & (position >= first) & (position < after))
    near = run.where((F.col("all_one") > 1) & hit).select("feature", "x").collect()  # at most bins + 1 a feature
    found: dict[str, list[float]] = {}
    for r in near:
        found.setdefault(r["feature"], []).append(r["x"])
    return {f: sorted(set(v))[1:-1] for f, v in found.items()}


def single_iv(df: DataFrame, feature: str, y: str, bins: int = 10) -> DataFrame:
    """bin, total, bad, good, dist_good, dist_bad, woe and iv_contribution of one feature.

    A numeric feature with more than `bins` distinct values is cut at its quantiles, (a, b];
    others are taken by value.
    """
    own = df.withColumn("__y", label(df, y)).where("__y is not null")
    if is_numeric(df, feature):
        x = numeric(df, feature)
        distinct = own.select(x.alias("x")).agg(F.count_distinct("x")).first()[0]
        if distinct > bins:
            rows = quantile_rows(long_form(own, [feature]), [i / bins for i in range(bins + 1)], rows=own.count()).select("value").collect()
            splits = sorted({r["value"] for r in rows})[1:-1]
            code = B.bin_code(x, splits)
            return with_woe(counts(own.withColumn("bin", B.label_of(code, splits)), ["bin"], F.col("__y")).withColumn("feature", F.lit(feature)))
    return with_woe(counts(own.withColumn("bin", category(df, feature)), ["bin"], F.col("__y")).withColumn("feature", F.lit(feature)))


def bin_statistics(binned: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """The full statistics of bins from (by..., bin_idx, bin, min, max, total, bad, good); bin_idx -1 is the missing bin and comes last."""
    out = with_woe(binned, by)
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(F.col("bin_idx") < 0, "bin_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_bad, all_good, all_rows = (F.sum(c).over(whole) for c in ("bad", "good", "total"))
    overall = all_bad / F.greatest(all_rows, F.lit(1))
    out = out.select(
        *by,
        "bin_idx",
        "bin",
        "min",
        "max",
        F.col("bad").alias("bads"),
        F.col("good").alias("goods"),
        "total",
        (F.col("bad") / F.greatest("total", F.lit(1))).alias("bad_rate"),
        (F.col("good") / F.greatest("total", F.lit(1))).alias("good_rate"),
        (F.col("good") / F.greatest("bad", F.lit(1))).alias("odds"),
        F.coalesce("dist_bad", F.lit(0.0)).alias("bad_prop"),
        F.coalesce("dist_good", F.lit(0.0)).alias("good_prop"),
        (F.col("total") / F.greatest(all_rows, F.lit(1))).alias("total_prop"),
        F.sum("bad").over(upto).alias("cum_bads"),
        F.sum("good").over(upto).alias("cum_goods"),
        F.sum("total").over(upto).alias("cum_total"),
        (F.sum("bad").over(upto) / F.greatest(all_bad, F.lit(1))).alias("cum_bads_prop"),
        (F.sum("good").over(upto) / F.greatest(all_good, F.lit(1))).alias("cum_goods_prop"),
        (F.sum("total").over(upto) / F.greatest(all_rows, F.lit(1))).alias("cum_total_prop"),
        "woe",
        F.col("iv_contribution").alias("iv"),
        (F.col("bad") / F.greatest("total", F.lit(1)) / F.greatest(overall, F.lit(EPSILON))).alias("lift"),
    )
    return out.withColumn("ks", F.abs(F.col("cum_bads_prop") - F.col("cum_goods_prop"))).select(*by, "bin_idx", *STATS)


#: Values of a column whose weights become part of a plan and are known to the driver; more stay a DataFrame that is joined.
IN_PLAN = 2_000


class WOEEncoder:
    """Weights of evidence of one column's values as text; values not seen get 0. Of a column with more than IN_PLAN values only `weights`, a DataFrame (bin, woe), is kept."""

    def __init__(self, column: str):
        self.column = column
        self.table: dict[str, float] | None = None
        self.weights: DataFrame | None = None
        self.iv: float | None = None

    def fit(self, df: DataFrame, y: str) -> WOEEncoder:
        own = WOETransformer([self.column]).fit(df, y).encoders[self.column]
        self.table, self.weights, self.iv = own.table, own.weights, own.iv
        return self

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        if self.table is None and self.weights is None:
            raise ValueError("WOEEncoder is not fitted. Call fit() first.")
        output = output or self.column
        if self.weights is None:
            return df.withColumn(output, self.expression(df))
        named = self.weights.select(F.col("bin").alias("__bin"), F.col("woe").alias("__woe"))
        joined = df.join(named, category(df, self.column) == F.col("__bin"), "left")
        return joined.withColumn(output, F.coalesce("__woe", F.lit(0.0))).drop("__bin", "__woe")

    def expression(self, df: DataFrame) -> Column:
        if self.table is None:
            raise ValueError(f"{self.column} has more than {IN_PLAN} values, use transform()")
        text = category(df, self.column)
        if not self.table:
            return F.lit(0.0)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in sorted(self.table.items()) for v in pair]), text), F.lit(0.0))

    def fit_transform(self, df: DataFrame, y: str) -> DataFrame:
        return self.fit(df, y).transform(df)


class WOETransformer:
    """Encoders of several columns, fitted in one pass."""

    def __init__(self, columns: Sequence[str] | None = None):
        self.columns = list(columns) if columns is not None else None
        self.encoders: dict[str, WOEEncoder] = {}

    def fit(self, df: DataFrame, y: str) -> WOETransformer:
        columns = self.columns or [c for c in df.columns if c != y]
        self.encoders = {c: WOEEncoder(c) for c in columns}
        woes = categorical_iv(df, columns, y).select("feature", "bin", "woe", "iv_contribution")
        first = F.row_number().over(Window.partitionBy("feature").orderBy("bin"))
        # IN_PLAN + 1 rows a column at most
        rows = woes.withColumn("__i", first).where(F.col("__i") <= IN_PLAN + 1).collect()
        held: dict[str, list] = {c: [] for c in columns}
        for r in rows:
            held[r["feature"]].append(r)
        wide = [c for c, own in held.items() if len(own) > IN_PLAN]
        ivs = {r["feature"]: r["iv"] for r in woes.where(F.col("feature").isin(wide)).groupBy("feature").agg(F.sum("iv_contribution").alias("iv")).collect()} if wide else {}
        for c, e in self.encoders.items():
            if c in wide:
                e.weights, e.iv = woes.where(F.col("feature") == c).select("bin", "woe"), ivs[c]
            else:
                e.table, e.iv = {r["bin"]: r["woe"] for r in held[c]}, sum((r["iv_contribution"] for r in held[c]), 0.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.encoders:
            raise ValueError("WOETransformer is not fitted. Call fit() first.")
        names = df.columns
        out = df.withColumns({c: e.expression(df) for c, e in self.encoders.items() if c in names and e.weights is None})
        for c, e in self.encoders.items():
            if c in names and e.weights is not None:
                out = e.transform(out)
        return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])

    def iv_table(self) -> list[tuple[str, float]]:
        return sorted(((c, e.iv) for c, e in self.encoders.items()), key=lambda p: -p[1])

    def export(self) -> dict[str, dict[str, float]]:
        """Tables by column. Columns of more than IN_PLAN values are gathered on the driver here."""
        return {c: dict(e.table) if e.weights is None else {r["bin"]: r["woe"] for r in e.weights.collect()} for c, e in self.encoders.items()}

    def load(self, held: dict[str, dict[str, float]]) -> WOETransformer:
        self.encoders = {}
        for c, table in held.items():
            self.encoders[c] = WOEEncoder(c)
            self.encoders[c].table = dict(table)
        return self


__all__ = ["MISSING", "STATS", "WOEEncoder", "WOETransformer", "batch_iv", "bin_statistics", "categorical_iv", "counts", "single_iv", "with_woe"]
