"""Tables of features: their bins, the variable table, monthly metrics and counts by source. All features go through one long form, never a loop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPSILON, col, label, numeric, ratio, report_order
from ..functions.quantiles import quantiles
from . import metrics as M
from . import psi as P
from .binning import coded, described
from .importance import SUMMARY
from .tables import FEATURE_BINS
from .woe import batch_iv

#: Features that a report shows one by one.
TOP = 30
VARIABLES = ("序号", "vars", "变量解释含义", "来源", "数据类型", "缺失率_train", "缺失率_oot", "iv_train", "iv_oot", "ks_train", "ks_oot", "gain", "gain_per", "weight", "weight_per", "psi", "指标表英文名")


def feature_edges(train: DataFrame, features: Sequence[str], rules: Mapping[str, Sequence[float]] | None = None, bins: int = 10) -> dict[str, list[float]]:
    """Inner edges: a feature's rule where there is one, else the quantiles of train."""
    rules = rules or {}
    rest = [f for f in features if f not in rules]
    found = quantiles(train, rest, [i / bins for i in range(bins + 1)])
    return {f: sorted(set(map(float, rules[f]))) if f in rules else P.inner_edges(found[f]) for f in features}


def feature_bins(df: DataFrame, splits: Mapping[str, Sequence[float]], y: str) -> DataFrame:
    """feature and the 14 columns of every feature's bins (a, b] with rows, missing last; shares are kept at EPSILON or above for woe and iv."""
    own = coded(df, dict(splits), keep=["__y"], y=y)
    counts = own.groupBy("feature", "bin_idx").agg(F.count_if(F.col("__y") == 0).alias("goods"), F.count_if(F.col("__y") == 1).alias("bads"), F.count("*").alias("total"))
    whole = Window.partitionBy("feature")
    order = [F.col("bin_idx") < 0, F.col("bin_idx")]
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tb, tg, tn = (F.sum(c).over(whole) for c in ("bads", "goods", "total"))
    good, bad = F.coalesce(ratio(F.col("goods"), tg), F.lit(0.0)), F.coalesce(ratio(F.col("bads"), tb), F.lit(0.0))
    woe, rate = F.ln(F.greatest(good, F.lit(EPSILON)) / F.greatest(bad, F.lit(EPSILON))), ratio(F.col("bads"), F.col("total"))
    out = counts.select(
        "feature",
        "bin_idx",
        "goods",
        "bads",
        "total",
        ratio(F.col("total"), tn).alias("total_prop"),
        good.alias("good_prop"),
        bad.alias("bad_prop"),
        rate.alias("bad_rate"),
        woe.alias("woe"),
        ((good - bad) * woe).alias("iv"),
        F.abs(F.sum("bads").over(upto) / F.greatest(tb, F.lit(1)) - F.sum("goods").over(upto) / F.greatest(tg, F.lit(1))).alias("ks"),
        ratio(rate, ratio(tb, tn)).alias("lift"),
    )
    return described(out, dict(splits)).orderBy("feature", *order).select("feature", "bin_idx", *FEATURE_BINS)


def _missing(df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """(feature, name): the share of missing values; null without rows."""
    row = df.agg(*[F.avg(numeric(df, f).isNull().cast("double")).alias(f"m{i}") for i, f in enumerate(features)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias(name)) for i, f in enumerate(features)])).alias("p")).select("p.*")


def variable_table(train: DataFrame, oot: DataFrame, features: Sequence[str], y: str, rules: Mapping[str, Sequence[float]] | None = None, importance: Sequence[Mapping] = (), dictionary: DataFrame | None = None, summary: Sequence[Mapping] = ()) -> DataFrame:
    """The columns of VARIABLES, and those of SUMMARY if given, one row a feature, by falling gain and weight, then in the order given.

    A feature with a rule takes iv and psi from the rule's bins, others from batch iv and
    quantile edges. importance: rows of feature, gain and weight. dictionary: 英文名, 中文名,
    来源, 指标表英文名; of several rows of a feature the first in text order of the others counts.
    """
    rules, features, spark = dict(rules or {}), list(features), train.sparkSession
    rules = {f: r for f, r in rules.items() if f in features}
    edges = feature_edges(train, features, rules)
    kinds = {f: train.schema[f].dataType.simpleString() for f in features}
    held = {r["feature"]: r for r in importance}
    rows = [(i, f, kinds[f], *[held.get(f, {}).get(c) for c in ("gain", "gain_per", "weight", "weight_per")]) for i, f in enumerate(features)]
    out = spark.createDataFrame(rows, "__i int, feature string, `数据类型` string, gain double, gain_per double, weight double, weight_per double")
    for name, part in (("train", train), ("oot", oot)):
        bins = feature_bins(part, edges, y).groupBy("feature").agg(F.max("ks").alias(f"ks_{name}"), F.sum("iv").alias("__iv"))
        iv = batch_iv(part, features, y).select("feature", F.col("iv").alias("__batch"))
        out = P._with(P._with(P._with(out, bins, ["feature"]), iv, ["feature"]), _missing(part, features, f"缺失率_{name}"), ["feature"])
        ruled = F.col("feature").isin(list(rules)) if rules else F.lit(False)
        out = out.withColumn(f"iv_{name}", F.when(ruled, F.col("__iv")).otherwise(F.when(F.col(f"缺失率_{name}").isNotNull(), F.col("__batch")))).drop("__iv", "__batch")
    out = P._with(out, P.psi_feature_groups(train, oot, features, (), rules), ["feature"])
    if dictionary is not None:
        names = ["中文名", "来源", "指标表英文名"]
        # one row a feature
        first = dictionary.select("英文名", *names).groupBy("英文名").agg(F.min(F.struct(*names)).alias("d")).select(F.col("英文名").alias("feature"), "d.*")
        out = P._with(out, first, ["feature"])
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("中文名", "来源", "指标表英文名")})
    order = Window.orderBy(F.desc_nulls_last("gain"), F.desc_nulls_last("weight"), "__i")  # a row a feature
    out = out.withColumns({"序号": F.row_number().over(order), "变量解释含义": F.coalesce("中文名", F.lit("")), "来源": F.coalesce("来源", F.lit("")), "指标表英文名": F.coalesce("指标表英文名", "feature")})
    out = out.withColumnRenamed("feature", "vars").select(*VARIABLES)
    if summary:
        first: dict[str, Mapping] = {}
        for r in summary:
            first.setdefault(r["feature"], r)
        table = spark.createDataFrame([(f, *[None if r.get(c) is None else float(r[c]) for c in SUMMARY[1:]]) for f, r in first.items()], "vars string, " + ", ".join(f"{c} double" for c in SUMMARY[1:]))
        out = P._with(out, table, ["vars"])
    return out.orderBy("序号")


def monthly_metrics(df: DataFrame, train: DataFrame, features: Sequence[str], y: str, month: str, rules: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """feature, month, core metrics and PSI of every feature and month, in month order.

    A row's score is the bad rate of its bin in train; a bin that train lacks scores 0, the
    missing bin 1. PSI is against train, as in variable_table. Rows without a binary label
    don't count.
    """
    rules, features = {f: r for f, r in (rules or {}).items() if f in features}, list(features)
    edges = feature_edges(train, features, rules)
    rates = coded(train, edges, keep=["__y"], y=y).groupBy("feature", "bin_idx").agg(F.avg("__y").alias("__rate"))
    own = df.withColumn("__m", col(month))
    long = P._with(coded(own, edges, keep=["__m", "__y"], y=y), rates, ["feature", "bin_idx"])
    long = long.withColumn("__s", F.coalesce("__rate", F.when(F.col("bin_idx") < 0, 1.0).otherwise(0.0)))
    scored = M.binary_metrics(long, "__y", "__s", ["feature", "__m"])
    stable = P.psi_feature_groups(train.where(label(train, y).isNotNull()), own.where(label(own, y).isNotNull()), features, ["__m"], rules)
    out = P._with(scored, stable.withColumnRenamed("psi", "PSI"), ["feature", "__m"]).withColumnRenamed("__m", "month")
    return report_order(out.select("feature", "month", *M.core_columns(), "PSI"), ["feature"], month="month")


def selection_summary(spark, total: int, kept: int | None = None) -> DataFrame:
    """筛选条件, 阈值, 筛选变量数量, 剩余变量数量."""
    # The condition and thresholds that the report names.
    return spark.createDataFrame([("重要性", "IV>=0.02 / CORR<=0.7 / VIF<=5 / PSI<0.25", total, min(total, TOP if kept is None else kept))], "`筛选条件` string, `阈值` string, `筛选变量数量` long, `剩余变量数量` long")


def type_distribution(spark, features: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """变量类型, 变量数量, 重要性占比: features by their source, null for those that the dictionary lacks."""
    own = spark.createDataFrame([(f,) for f in features], "feature string")
    named = dictionary.groupBy(F.col("英文名").alias("feature")).agg(F.min("来源").alias("变量类型"))
    counts = P._with(own, named, ["feature"]).groupBy("变量类型").agg(F.count("*").alias("变量数量"))
    return counts.withColumn("重要性占比", ratio(F.col("变量数量"), F.sum("变量数量").over(Window.partitionBy())))  # a row a source


__all__ = ["TOP", "VARIABLES", "feature_bins", "feature_edges", "monthly_metrics", "selection_summary", "type_distribution", "variable_table"]
