"""AUC, KS, Gini and lift of scores: exact, weighted, binned, and by group.

Scores are aggregated to distinct values first; everything exact follows from running sums
over them (see running_sums), so one aggregate serves all metrics of all groups.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_code
from ..functions.columns import col, label, numeric, ratio
from ..functions.quantiles import quantile_rows, quantiles
from ..functions.running import running_sums

LEVELS = (0.10, 0.05, 0.02, 0.01)
MODES = ("exact", "binned")


def lift_name(level: float) -> str:
    return f"{round(level * 100)}%lift"


def core_columns(levels: Sequence[float] = LEVELS) -> list[str]:
    return ["总", "好", "坏", "坏占比", "KS", "AUC", *map(lift_name, levels)]


def score_points(df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., s, rows, good, bad, wgood, wbad): one row a distinct score, s null for rows without a score or a binary label (rows, good and bad count them too)."""
    lab, x = label(df, y), numeric(df, score)
    w = numeric(df, weight) if weight else F.lit(1.0)
    own = df.select(*[col(c) for c in by], lab.alias("__y"), F.when(lab.isNotNull(), x).alias("s"), w.alias("__w"))
    return own.groupBy(*by, "s").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("__y") == 0).alias("good"),
        F.count_if(F.col("__y") == 1).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("__y") == 0, F.col("__w"))), F.lit(0.0)).alias("wgood"),
        F.coalesce(F.sum(F.when(F.col("__y") == 1, F.col("__w"))), F.lit(0.0)).alias("wbad"),
    )


def curve_metrics(points: DataFrame, by: Sequence[str] = (), levels: Sequence[float] = LEVELS, descending: bool = True, reverse_auc: bool = False, weighted: bool = False, rows: int | None = None) -> DataFrame:
    """(by..., KS, AUC, lifts) from score points; null where a group lacks a class. rows: no group has more points, if the caller knows.

    Rows of one score share what of them falls into a top k: lift takes their mean bad rate.
    """
    g, b = ("wgood", "wbad") if weighted else ("good", "bad")
    own = points.where("s is not null").select(*by, "s", F.col(g).alias("g"), F.col(b).alias("b"))
    run = running_sums(own, by, "s", ["g", "b"], rows=rows)
    run = run.withColumn("n", F.col("g") + F.col("b")).withColumn("whole", F.col("all_g") + F.col("all_b"))
    two = (F.col("all_g") > 0) & (F.col("all_b") > 0)
    up_g, up_b = F.col("before_g") + F.col("g"), F.col("before_b") + F.col("b")
    auc = F.sum(F.col("b") * (F.col("before_g") + F.col("g") / 2)) / F.nullif(F.max("all_b") * F.max("all_g"), F.lit(0).cast("double"))
    ks = F.max(F.abs(ratio(up_b, F.col("all_b")) - ratio(up_g, F.col("all_g"))))
    # rows and bads before this score, from the end at which lift begins
    rows_before = F.col("whole") - F.col("before_g") - F.col("before_b") - F.col("n") if descending else F.col("before_g") + F.col("before_b")
    bads_before = F.col("all_b") - F.col("before_b") - F.col("b") if descending else F.col("before_b")
    run = run.withColumn("__rows", rows_before).withColumn("__bads", bads_before)
    aggregates = [F.when(F.max(two), ks).alias("KS"), F.when(F.max(two), 1 - auc if reverse_auc else auc).alias("AUC")]
    for k in levels:
        top = F.greatest(F.lit(1.0), F.ceil(F.col("whole") * float(k)).cast("double"))
        crossing = (F.col("__rows") < top) & (F.col("__rows") + F.col("n") >= top)
        bads = F.max(F.when(crossing, F.col("__bads") + (top - F.col("__rows")) / F.col("n") * F.col("b")))
        aggregates.append(F.when(F.max(two), bads / F.max(top) / F.nullif(F.max(F.col("all_b") / F.col("whole")), F.lit(0.0))).alias(lift_name(k)))
    return run.groupBy(*by).agg(*aggregates) if by else run.agg(*aggregates)


def totals(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., 总, 好, 坏, 坏占比): grey and unlabelled rows count in 总 only."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("rows", "总"), ("good", "好"), ("bad", "坏"))]
    out = points.groupBy(*by).agg(*sums) if by else points.agg(*sums)
    return out.withColumn("坏占比", ratio(F.col("坏"), F.col("好") + F.col("坏")))


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return left.crossJoin(right)  # one row each
    named = right.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in right.columns if c not in by])
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = same if on is None else on & same
    return left.join(named, on, "left").drop(*[f"__{c}" for c in by])


def _named(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with copies of the group columns under names that no table here uses."""
    names = [f"__by{i}" for i in range(len(by))]
    return df.withColumns({n: col(c) for n, c in zip(names, by, strict=True)}), names


def _renamed(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], *[col(c) for c in df.columns if c not in names])


def binary_metrics(df: DataFrame, y: str, score: str, by: Sequence[str] = (), mode: str = "exact", bins: int = 10, levels: Sequence[float] = LEVELS, descending: bool = True, reverse_auc: bool = False) -> DataFrame:
    """(by..., 总, 好, 坏, 坏占比, KS, AUC, k%lift): metrics of a score, of the whole or of each group."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    shown, (df, by) = list(by), _named(df, by)
    points = score_points(df, y, score, by)
    if mode == "exact":
        curve = curve_metrics(points, by, levels, descending, reverse_auc, rows=df.count())
    else:
        curve = binned_metrics(points, by, bins, levels, descending, reverse_auc)
    return _renamed(_joined(totals(points, by), curve, by).select(*by, *core_columns(levels)), by, shown)


def score_edges(points: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """(by..., edges): inner quantile edges of each group's scores in at most as many bins as distinct scores, for [a, b)."""
    sizes = points.where("s is not null").groupBy(*by).agg(F.count("*").alias("d")) if by else points.where("s is not null").agg(F.count("*").alias("d"))
    # at most `bins` different numbers of bins
    numbers = sorted(r["k"] for r in sizes.select(F.least("d", F.lit(bins)).alias("k")).distinct().collect() if r["k"] and r["k"] > 1)
    joined = _joined(points.where("s is not null"), sizes, by)
    parts = [(k, joined.where(F.least("d", F.lit(bins)) == k)) for k in numbers]
    if not parts:
        return sizes.select(*by, F.array().cast("array<double>").alias("edges"))
    out = None
    for k, long in parts:
        weighted = long.select(*by, F.lit("s").alias("feature"), F.col("s").alias("x"), (F.col("good") + F.col("bad")).alias("times"))
        rows = quantile_rows(weighted, [i / k for i in range(k + 1)], by, "times")
        edges = rows.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("e")) if by else rows.agg(F.array_sort(F.collect_set("value")).alias("e"))
        edges = edges.select(*by, F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0))).alias("edges"))
        out = edges if out is None else out.unionByName(edges)
    return out


def binned_metrics(points: DataFrame, by: Sequence[str], bins: int, levels: Sequence[float], descending: bool, reverse_auc: bool) -> DataFrame:
    """Metrics from at most `bins` bins of equal counts instead of distinct scores; lift is interpolated within the bin that holds the last of the top k, but not within the first."""
    own = points.where("s is not null")
    edges = score_edges(points, by, bins)
    if not by:
        found = [r["edges"] for r in edges.collect() if r["edges"] is not None]
        cuts = max(found, key=len) if found else []
        coded = own.withColumn("bin", bin_code(F.col("s"), list(cuts), closed="left"))
    else:
        joined = _joined(own, edges, by)
        coded = joined.withColumn("bin", F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("s"))), F.lit(0)))
    counts = coded.groupBy(*by, "bin").agg(F.sum("good").cast("double").alias("g"), F.sum("bad").cast("double").alias("b"))
    order, sums = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.select(*by, "bin", "g", "b", (F.sum("g").over(upto) - F.col("g")).alias("before_g"), (F.sum("b").over(upto) - F.col("b")).alias("before_b"), F.sum("g").over(sums).alias("all_g"), F.sum("b").over(sums).alias("all_b"), F.min("bin").over(sums).alias("low"), F.max("bin").over(sums).alias("high"))
    two = (F.col("all_g") > 0) & (F.col("all_b") > 0)
    n, total = F.col("g") + F.col("b"), F.col("all_g") + F.col("all_b")
    auc = F.sum(F.col("b") * (F.col("before_g") + F.col("g") / 2)) / F.nullif(F.max(F.col("all_b") * F.col("all_g")), F.lit(0.0))
    ks = F.max(F.abs(ratio(F.col("before_b") + F.col("b"), F.col("all_b")) - ratio(F.col("before_g") + F.col("g"), F.col("all_g"))))
    rows_before = total - F.col("before_g") - F.col("before_b") - n if descending else F.col("before_g") + F.col("before_b")
    bads_before = F.col("all_b") - F.col("before_b") - F.col("b") if descending else F.col("before_b")
    first = F.col("bin") == (F.col("high") if descending else F.col("low"))
    last = F.col("bin") == (F.col("low") if descending else F.col("high"))
    aggregates = [F.when(F.max(two), ks).alias("KS"), F.when(F.max(two), 1 - auc if reverse_auc else auc).alias("AUC")]
    for k in levels:
        top = F.greatest(F.lit(1.0), F.ceil(total * float(k)).cast("double"))
        # the bin after whose predecessors' rows the top's rows lie
        holds = (rows_before <= top) & ((rows_before + n > top) | last)
        rate = F.when(first, ratio(F.col("b"), n)).otherwise((bads_before + (top - rows_before) * ratio(F.col("b"), n)) / top)
        aggregates.append(F.when(F.max(two), F.max(F.when(holds, rate / (F.col("all_b") / total)))).alias(lift_name(k)))
    return run.groupBy(*by).agg(*aggregates) if by else run.agg(*aggregates)


def auc(df: DataFrame, y: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc), weighted if asked."""
    shown, (df, by) = list(by), _named(df, by)
    return _renamed(curve_metrics(score_points(df, y, score, by, weight), by, (), weighted=weight is not None, rows=df.count()).select(*by, F.col("AUC").alias("auc")), by, shown)


def ks(df: DataFrame, y: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ks) in 0 to 1."""
    shown, (df, by) = list(by), _named(df, by)
    return _renamed(curve_metrics(score_points(df, y, score, by, weight), by, (), weighted=weight is not None, rows=df.count()).select(*by, F.col("KS").alias("ks")), by, shown)


def gini(df: DataFrame, y: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., gini) = 2 * auc - 1."""
    return auc(df, y, score, weight, by).select(*by, (2 * F.col("auc") - 1).alias("gini"))


def lift_table(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """bin, min_prob, max_prob, count, events, event_rate, lift of quantile bins (a, b] of the score, from the highest."""
    lab, x = label(df, y), numeric(df, score)
    own = df.select(lab.alias("y"), x.alias("s")).where("y is not null and s is not null")
    found = quantiles(own, ["s"], [i / bins for i in range(bins + 1)])["s"]
    cuts = sorted(set(found))[1:-1]
    rows = own.withColumn("bin", bin_code(F.col("s"), cuts)).groupBy("bin").agg(F.min("s").alias("min_prob"), F.max("s").alias("max_prob"), F.count("*").alias("count"), F.sum("y").cast("long").alias("events"))
    whole = Window.partitionBy()  # over bins
    rate = F.col("events") / F.col("count")
    overall = F.sum("events").over(whole) / F.sum("count").over(whole)
    return rows.select("bin", "min_prob", "max_prob", "count", "events", rate.alias("event_rate"), F.coalesce(ratio(rate, overall), F.lit(0.0)).alias("lift")).orderBy(F.desc("bin"))


def lift_at_k(df: DataFrame, y: str, score: str, k: float = 0.1, id_cols: Sequence[str] = ()) -> float:
    """Lift of the max(1, ceil(n * k)) highest scores. With id_cols ties are broken by them, ascending; without, rows of one score share."""
    if not 0 < k <= 1:
        warnings.warn(f"k must lie in (0, 1], got {k}", stacklevel=2)
        return float("nan")
    lab, x = label(df, y), numeric(df, score)
    if not id_cols:
        points = score_points(df, y, score)
        row = curve_metrics(points, (), (k,), rows=df.count()).first()
        if row[lift_name(k)] is not None:
            return row[lift_name(k)]
        seen = points.where("s is not null").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).first()
        return float("nan") if seen["b"] is None else (1.0 if seen["b"] else 0.0)
    own = df.select(lab.alias("__y"), x.alias("__s"), *id_cols).where("__y is not null and __s is not null")
    whole = own.agg(F.count("*").alias("n"), F.sum("__y").alias("b")).first()
    if not whole["n"]:
        return float("nan")
    if not whole["b"]:
        return 0.0
    top = max(1, -int(-whole["n"] * k // 1))
    hits = own.orderBy(F.desc("__s"), *id_cols).limit(top).agg(F.sum("__y")).first()[0]
    return hits / top / (whole["b"] / whole["n"])


def amount_metrics(df: DataFrame, y: str, score: str, principal: str, loan: str, by: Sequence[str] = (), levels: Sequence[float] = LEVELS) -> DataFrame:
    """(by..., 放款金额, 逾期本金, 金额坏占比, 金额AUC, 金额KS, k%金额lift): rows with a binary label, weighted by the loan.

    The bad share is overdue principal over loan; lift is that share among the top k of rows by score over all rows' share, rows of one score sharing.
    """
    shown, (df, by) = list(by), _named(df, by)
    lab, x = label(df, y), numeric(df, score)
    own = df.select(*by, lab.alias("__y"), x.alias("s"), F.coalesce(numeric(df, principal), F.lit(0.0)).alias("__p"), F.coalesce(numeric(df, loan), F.lit(0.0)).alias("__l")).where("__y is not null")
    sums = [F.sum("__l").alias("放款金额"), F.sum("__p").alias("逾期本金")]
    whole = (own.groupBy(*by).agg(*sums) if by else own.agg(*sums)).withColumn("金额坏占比", ratio(F.col("逾期本金"), F.col("放款金额")))
    points = own.where("s is not null").groupBy(*by, "s").agg(F.count("*").cast("double").alias("n"), F.sum("__p").alias("p"), F.sum("__l").alias("l"), F.coalesce(F.sum(F.when(F.col("__y") == 1, F.col("__l"))), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(F.col("__y") == 0, F.col("__l"))), F.lit(0.0)).alias("g"))
    run = running_sums(points, by, "s", ["n", "p", "l", "b", "g"], rows=df.count())
    two = (F.col("all_g") > 0) & (F.col("all_b") > 0)
    auc_value = F.sum(F.col("b") * (F.col("before_g") + F.col("g") / 2)) / F.nullif(F.max(F.col("all_b") * F.col("all_g")), F.lit(0.0))
    ks_value = F.max(F.abs(ratio(F.col("before_b") + F.col("b"), F.col("all_b")) - ratio(F.col("before_g") + F.col("g"), F.col("all_g"))))
    aggregates = [F.when(F.max(two), auc_value).alias("金额AUC"), F.when(F.max(two), ks_value).alias("金额KS")]
    above = F.col("all_n") - F.col("before_n") - F.col("n")
    for k in levels:
        top = F.greatest(F.lit(1.0), F.ceil(F.col("all_n") * float(k)).cast("double"))
        crossing = (above < top) & (above + F.col("n") >= top)
        part = (top - above) / F.col("n")
        p = F.col("all_p") - F.col("before_p") - F.col("p") + part * F.col("p")
        loans = F.col("all_l") - F.col("before_l") - F.col("l") + part * F.col("l")
        aggregates.append(F.max(F.when(crossing, ratio(ratio(p, loans), ratio(F.col("all_p"), F.col("all_l"))))).alias(lift_name(k).replace("lift", "金额lift")))
    curve = run.groupBy(*by).agg(*aggregates) if by else run.agg(*aggregates)
    return _renamed(_joined(whole, curve, by), by, shown)


__all__ = ["LEVELS", "amount_metrics", "auc", "binary_metrics", "core_columns", "curve_metrics", "gini", "ks", "lift_at_k", "lift_table", "score_points", "totals"]

