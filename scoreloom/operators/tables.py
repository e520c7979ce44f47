"""Monitoring tables: label counts, bin performance, portraits, and metrics by sample set, month, dimension and model pair.

Every table is a DataFrame of a few rows a group; groups are never looped over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions.columns import EPSILON, col, date_range, label, numeric, positive, ratio, report_order, tag_rank
from ..functions.quantiles import quantiles
from . import metrics as M
from . import psi as P

KEYS = ("样本标签", "模型", "样本集", "观察点月")
PSI_COLUMNS = ("train和各集合的PSI", "近期月对比各集合PSI")
PERFORMANCE = ("bin", "min", "max", "goods", "bads", "total", "total_prop", "goods_prop", "bads_prop", "bad_rate", "cum_bad_rate", "cum_bads_prop", "ks", "lift", "cum_lift")
FEATURE_BINS = ("bin", "min", "max", "goods", "bads", "total", "total_prop", "good_prop", "bad_prop", "bad_rate", "woe", "iv", "ks", "lift")
AMOUNT_BINS = ("逾期本金", "放款金额", "金额坏占比", "放款金额占比", "逾期本金占比", "金额lift")


def label_distribution(df: DataFrame, y: str, tag: str, month: str, channel: str | None = None, include_tag: bool = True) -> DataFrame:
    """样本集 (if asked), 渠道, 月, 标签, 好, 坏, 灰 and the totals without grey; null groups are groups."""
    has_channel = bool(channel) and channel in df.columns
    by = [*([tag] if include_tag else []), *([channel] if has_channel else []), month]
    x = numeric(df, y)
    out = df.groupBy(*[col(c) for c in by]).agg(*[F.count_if(x == v).alias(n) for n, v in (("好", 0), ("坏", 1), ("灰", -1))])
    total = F.col("好") + F.col("坏")
    out = out.select(
        *([col(tag).alias("样本集")] if include_tag else []),
        (col(channel) if has_channel else F.lit("")).alias("渠道"),
        col(month).alias("月"),
        F.lit(y).alias("标签"),
        "好",
        "坏",
        "灰",
        total.alias("总数（去掉灰样本）"),
        ratio(F.col("坏"), total).alias("坏占比（去掉灰样本）"),
    )
    return report_order(out, tag="样本集" if include_tag else None, month="月")


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Inner edges of reference bins: quantiles in at most as many bins as distinct values."""
    own = df.select(numeric(df, column).alias("x"))
    distinct = own.agg(F.approx_count_distinct("x").alias("n")).first()["n"]
    if distinct <= 2 * bins:
        distinct = own.agg(F.count_distinct("x").alias("n")).first()["n"]
    if distinct <= 1:
        return []
    n = min(bins, distinct)
    return P.inner_edges(quantiles(own, ["x"], [i / n for i in range(n + 1)])["x"])


def bin_performance(df: DataFrame, y: str, score: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., the 15 columns of performance) of bins (a, b] with rows, missing scores last; rows without a binary label don't count."""
    by, cuts = list(by), B.clean_splits(edges)
    lab = label(df, y)
    own = df.select(*[col(c) for c in by], lab.alias("__y"), B.bin_code(numeric(df, score), cuts).alias("code")).where("__y is not null")
    counts = own.groupBy(*by, "code").agg(F.count_if(F.col("__y") == 0).alias("goods"), F.count_if(F.col("__y") == 1).alias("bads"), F.count("*").alias("total"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(F.col("code") < 0, "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = B.bounds(F.col("code"), cuts)
    one = F.lit(1)
    tb, tg, tn = (F.sum(c).over(whole) for c in ("bads", "goods", "total"))
    out = counts.select(*by, "code", "goods", "bads", "total", tb.alias("tb"), tg.alias("tg"), tn.alias("tn"), F.sum("bads").over(upto).alias("cb"), F.sum("goods").over(upto).alias("cg"), F.sum("total").over(upto).alias("cn"))
    rate, overall = ratio(F.col("bads"), F.col("total")), ratio(F.col("tb"), F.col("tn"))
    cum_rate = F.col("cb") / F.greatest("cn", one)
    out = out.select(
        *by,
        "code",
        B.label_of(F.col("code"), cuts).alias("bin"),
        low.alias("min"),
        high.alias("max"),
        "goods",
        "bads",
        "total",
        ratio(F.col("total"), F.col("tn")).alias("total_prop"),
        ratio(F.col("goods"), F.col("tg")).alias("goods_prop"),
        ratio(F.col("bads"), F.col("tb")).alias("bads_prop"),
        rate.alias("bad_rate"),
        cum_rate.alias("cum_bad_rate"),
        (F.col("cb") / F.greatest("tb", one)).alias("cum_bads_prop"),
        F.when(F.col("tg") > 0, F.abs(F.col("cb") / F.greatest("tb", one) - F.col("cg") / F.greatest("tg", one))).alias("ks"),
        ratio(rate, overall).alias("lift"),
        (cum_rate / F.greatest(overall, F.lit(EPSILON))).alias("cum_lift"),
    )
    return out.orderBy(*by, F.col("code") < 0, "code").select(*by, *PERFORMANCE)


def bin_metrics(df: DataFrame, y: str, score: str, q: int = 10, bins: Sequence[float] | None = None, principal: str | None = None, loan: str | None = None) -> DataFrame:
    """Performance of quantile bins or of given edges, with amounts of each bin if both amount columns are named: one count for both."""
    if (principal is None) != (loan is None):
        raise ValueError("principal and loan come as a pair")
    if bins is not None:
        bins = list(bins)
        if len(bins) < 2:
            raise ValueError("bins needs at least two edges")
        if any(b <= a for a, b in zip(bins[:-1], bins[1:], strict=True)):
            raise ValueError("bins must increase")
        cuts = B.clean_splits(bins[1:-1])
    else:
        if q < 2:
            raise ValueError("q must be at least 2")
        cuts = quantile_edges(df.where(label(df, y).isNotNull()), score, q)
    out = bin_performance(df, y, score, cuts)
    if principal is None:
        return out
    code = B.bin_code(numeric(df, score), cuts)
    sums = df.where(label(df, y).isNotNull()).groupBy(B.label_of(code, cuts).alias("__bin")).agg(F.sum(F.coalesce(numeric(df, principal), F.lit(0.0))).alias("逾期本金"), F.sum(F.coalesce(numeric(df, loan), F.lit(0.0))).alias("放款金额"))
    out = out.join(F.broadcast(sums), F.col("bin") == F.col("__bin"), "left").drop("__bin")  # a row a bin
    whole = Window.partitionBy()
    p, l = F.sum("逾期本金").over(whole), F.sum("放款金额").over(whole)
    share = ratio(F.col("逾期本金"), F.col("放款金额"))
    out = out.withColumn("金额坏占比", share).withColumn("放款金额占比", ratio(F.col("放款金额"), l)).withColumn("逾期本金占比", ratio(F.col("逾期本金"), p)).withColumn("金额lift", ratio(share, ratio(p, l)))
    return out.orderBy(F.col("bin") == B.MISSING, "min").select(*PERFORMANCE, *AMOUNT_BINS)


def feature_bin_stats(df: DataFrame, feature: str, y: str, edges: Sequence[float]) -> DataFrame:
    """The 14 columns of a feature's bins (a, b]; shares are kept at EPSILON or above for woe and iv."""
    cuts = B.clean_splits(edges)
    own = df.select(label(df, y).alias("__y"), B.bin_code(numeric(df, feature), cuts).alias("code")).where("__y is not null")
    counts = own.groupBy("code").agg(F.count_if(F.col("__y") == 0).alias("goods"), F.count_if(F.col("__y") == 1).alias("bads"), F.count("*").alias("total"))
    whole = Window.partitionBy()
    upto = Window.orderBy(F.col("code") < 0, "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tb, tg, tn = (F.sum(c).over(whole) for c in ("bads", "goods", "total"))
    good, bad = F.coalesce(ratio(F.col("goods"), tg), F.lit(0.0)), F.coalesce(ratio(F.col("bads"), tb), F.lit(0.0))
    eps = F.lit(EPSILON)
    woe = F.ln(F.greatest(good, eps) / F.greatest(bad, eps))
    low, high = B.bounds(F.col("code"), cuts)
    rate = ratio(F.col("bads"), F.col("total"))
    out = counts.select(
        "code",
        B.label_of(F.col("code"), cuts).alias("bin"),
        low.alias("min"),
        high.alias("max"),
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
    return out.orderBy(F.col("code") < 0, "code").select(*FEATURE_BINS)


def portrait_means(df: DataFrame, scores: Sequence[str], variables: Sequence[str], bins: int = 10) -> DataFrame:
    """模型, 分组, 画像变量, 均值: means of variables by quantile bin of each score, one aggregate a score."""
    parts = []
    for s in scores:
        cuts = quantile_edges(df, s, bins)
        code = B.bin_code(numeric(df, s), cuts)
        means = df.groupBy(code.alias("__code")).agg(*[F.avg(numeric(df, v)).alias(f"__{i}") for i, v in enumerate(variables)])
        pairs = F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"__{i}").alias("m")) for i, v in enumerate(variables)])
        parts.append(means.select(F.lit(s).alias("模型"), B.label_of(F.col("__code"), cuts).alias("分组"), F.explode(pairs).alias("p")).select("模型", "分组", F.col("p.v").alias("画像变量"), F.col("p.m").alias("均值")))
    return reduce(DataFrame.unionByName, parts)


def portrait_pivot(df: DataFrame, scores: Sequence[str], variables: Sequence[str], bins: int = 10) -> DataFrame:
    """画像变量, 模型, 1 to bins, Missing: the means side by side."""
    parts = []
    names = [*map(str, range(1, bins + 1)), B.MISSING]
    for s in scores:
        code = B.bin_code(numeric(df, s), quantile_edges(df, s, bins))
        place = F.when(code < 0, F.lit(B.MISSING)).otherwise((code + 1).cast("string"))
        pairs = F.array(*[F.struct(F.lit(v).alias("画像变量"), numeric(df, v).alias("x")) for v in variables])
        long = df.select(place.alias("place"), F.explode(pairs).alias("p")).select("place", "p.*")
        parts.append(long.groupBy("画像变量").pivot("place", names).agg(F.avg("x")).select("画像变量", F.lit(s).alias("模型"), *[F.col(f"`{n}`") for n in names]))
    return reduce(DataFrame.unionByName, parts)


def group_metrics(df: DataFrame, y: str, score: str, by: Sequence[str], model: str | None = None, tag: str | None = None, month: str | None = None, reverse_auc: bool = False, principal: str | None = None, loan: str | None = None, train: DataFrame | None = None, latest: bool = False, levels: Sequence[float] = M.LEVELS, date: str | None = None) -> DataFrame:
    """样本标签, 模型, 样本集, 观察点月, core metrics[, amounts], PSI against train, PSI against the latest month.

    tag and month name the group columns that fill 样本集 and 观察点月; a column not grouped by
    shows the sets or months present. train: rows whose scores are the reference of the
    first PSI. latest: fill the second, each sample set against its latest month. date: a
    column of dates, whose range stands in 观察点月 of sample sets.
    """
    by = list(by)
    out = M.binary_metrics(df, y, score, by, levels=levels, reverse_auc=reverse_auc, descending=not reverse_auc)
    if principal and loan:
        out = P._with(out, M.amount_metrics(df, y, score, principal, loan, by, levels), by)
        total_loan, total_bad = (F.sum(c).over(Window.partitionBy()) for c in ("放款金额", "逾期本金"))
        out = out.withColumn("放款金额占比", ratio(F.col("放款金额"), total_loan)).withColumn("逾期本金占比", ratio(F.col("逾期本金"), total_bad))
    labelled = df.where(label(df, y).isNotNull())
    if train is not None:
        found = P.psi_groups(train.where(label(train, y).isNotNull()), labelled, score, by).withColumnRenamed("psi", PSI_COLUMNS[0])
        out = P._with(out, found, by)
    else:
        out = out.withColumn(PSI_COLUMNS[0], F.lit(None).cast("double"))
    if latest and month in by:
        partition = [c for c in by if c != month]
        found = P.grouped_psi(labelled, [month], score, "latest", month, partition_cols=partition).select(*by, F.col("psi").alias(PSI_COLUMNS[1]))
        out = P._with(out, found, by)
    else:
        out = out.withColumn(PSI_COLUMNS[1], F.lit(None).cast("double"))

    if tag and tag not in by:
        sets = df.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(tag_rank(col(tag)).alias("r"), col(tag).cast("string").alias("t")))).alias("s"))
        out = P._with(out, sets.select(*by, F.array_join(F.transform("s", lambda x: x["t"]), ",").alias("__sets")), by)
    dated = bool(date) and by == [tag]
    if dated:
        out = P._with(out, df.groupBy(*by).agg(date_range(col(date)).alias("__range")), by)
    amounts = [c for c in out.columns if "金额" in c or "本金" in c]
    others = [c for c in by if c not in (tag, month)]
    out = out.select(F.lit(y).alias("样本标签"), F.lit(model or score).alias("模型"), (col(tag) if tag in by else F.col("__sets") if tag else F.lit("")).alias("样本集"), (col(month) if month in by else F.col("__range") if dated else F.lit("")).alias("观察点月"), *others, *M.core_columns(levels), *amounts, *PSI_COLUMNS)
    return report_order(out, others, tag="样本集", month="观察点月")


def split_metrics(df: DataFrame, labels: Sequence[str], score: str, tag: str, month: str, **options) -> tuple[DataFrame, DataFrame]:
    """Metrics of every label by sample set, and by month."""
    def of(by: list[str], **more) -> DataFrame:
        return reduce(DataFrame.unionByName, [group_metrics(df, y, score, by, tag=tag, month=month, train=df.where(F.lower(col(tag).cast("string")) == "train"), **more, **options) for y in labels])

    return of([tag]), of([month], latest=True)


def dimensional_comparison(df: DataFrame, dimensions: Sequence[str], labels: Sequence[str], score: str, model: str | None = None, reverse_auc: bool = False, principal: str | None = None, loan: str | None = None) -> DataFrame:
    """维度列, 维度值, 样本标签, 模型, core metrics (and amounts) of every value of every dimension."""
    parts = []
    for d in dimensions:
        for y in labels:
            out = M.binary_metrics(df, y, score, [d], reverse_auc=reverse_auc, descending=not reverse_auc)
            if principal and loan:
                out = P._with(out, M.amount_metrics(df, y, score, principal, loan, [d]), [d])
            rest = [c for c in out.columns if c != d]
            parts.append(out.select(F.lit(d).alias("维度列"), F.coalesce(col(d).cast("string"), F.lit("None")).alias("维度值"), F.lit(y).alias("样本标签"), F.lit(model or score).alias("模型"), *rest))
    return reduce(DataFrame.unionByName, parts).orderBy("维度列", "维度值", "样本标签")


def model_comparison(df: DataFrame, y: str, scores: Sequence[str], by: Sequence[str], names: Sequence[str] | None = None, tag: str | None = None, month: str | None = None, reverse: Sequence[str] = ()) -> DataFrame:
    """Group metrics of several models on the rows where all of them are numbers, finite and above 0."""
    both = df.where(positive(df, scores))
    parts = [group_metrics(both, y, s, by, model=n, tag=tag, month=month, reverse_auc=s in reverse).withColumn("__place", F.lit(i)) for i, (s, n) in enumerate(zip(scores, names or scores, strict=True))]
    out = reduce(DataFrame.unionByName, parts)
    return report_order(out, ["样本标签"], tag="样本集", month="观察点月").orderBy("样本标签", tag_rank(F.col("样本集")), "样本集", "观察点月", "__place").drop("__place")


def score_direction(df: DataFrame, y: str, scores: Sequence[str], tag: str | None = None) -> DataFrame:
    """分数字段, 原始AUC, 原始方向, 报表计算方向, AUC反向, 保留原始分数, 判断依据. A score is turned only if its name holds "score" and its AUC (on train, or on all rows) is below 0.5."""
    train = df.where(F.lower(col(tag).cast("string")) == "train") if tag else df
    parts = []
    for s in scores:
        first = M.auc(train, y, s).select(F.col("auc").alias("a"))
        every = M.auc(df, y, s).select(F.col("auc").alias("b"))
        value = F.coalesce("a", "b")
        down = F.lit("score" in s.lower()) & F.coalesce(value < 0.5, F.lit(False))
        parts.append(first.crossJoin(every).select(F.lit(s).alias("分数字段"), value.alias("原始AUC"), F.when(value < 0.5, "越高越好").otherwise("越高越坏").alias("原始方向"), F.lit("越高越坏").alias("报表计算方向"), down.alias("AUC反向"), F.lit(True).alias("保留原始分数"), F.when(F.col("a").isNotNull(), "train").otherwise("all").alias("判断依据")))  # one row each
    return reduce(DataFrame.unionByName, parts)
