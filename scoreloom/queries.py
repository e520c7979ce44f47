"""One query for each operator over the synthetic tables, and SQL for DuckDB that says the same in its own words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import bins as B
from .functions import columns as C
from .functions.quantiles import long_form, quantile_rows
from .operators import binning, correlation, metrics, psi, selection, tables, woe
from .operators.logistic import LogisticModel
from .operators.scorecard import Scorecard
from .streaming import psi_counts, psi_of_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# the same preparation on both sides: a third of the rows is bad, every seventh line lacks its quantity
LINES = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS qn,
 l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS principal,
 CASE WHEN year(l_shipdate) <= 1998 THEN 'train' WHEN year(l_shipdate) = 1999 THEN 'test' WHEN year(l_shipdate) = 2000 THEN 'oot' ELSE 'oos' END AS tag,
 {ym} AS month FROM lineitem"""
ORDERS = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS y,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS score,
 o_totalprice + o_custkey * 50 - CASE WHEN o_orderkey % 13 = 0 THEN 1e9 ELSE 0 END AS old_score,
 CASE WHEN year(o_orderdate) <= 1997 THEN 'train' WHEN year(o_orderdate) = 1998 THEN 'test' ELSE 'oot' END AS tag,
 CAST(year(o_orderdate) AS VARCHAR(4)) AS yr, {ym} AS month,
 o_totalprice * 0.6 + o_custkey AS loan, CASE o_orderstatus WHEN 'F' THEN o_totalprice * 0.1 ELSE 0.0 END AS principal FROM orders"""
_YM = {"l": ("date_format(l_shipdate, 'yyyyMM')", "strftime(l_shipdate, '%Y%m')"), "o": ("date_format(o_orderdate, 'yyyyMM')", "strftime(o_orderdate, '%Y%m')")}
L = f"d AS ({LINES.format(ym=_YM['l'][1])})"
O = f"d AS ({ORDERS.format(ym=_YM['o'][1])})"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _table(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    view = f"__{name}_{abs(hash(sf_dir))}"
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
    return spark.sql(text.replace(f"FROM {name}", f"FROM {view}"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", LINES.format(ym=_YM["l"][0]))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", ORDERS.format(ym=_YM["o"][0]))


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, others as rounded doubles; NaN is null."""
    out = []
    for f in df.schema.fields:
        x = C.col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            x = x.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            x = x.cast("double")
            x = F.when(~F.isnan(x), F.when(F.abs(x) < 1e300, F.round(x, digits)))
        out.append(x.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: shown(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def r(expression: str, name: str, digits: int = 6) -> str:
    """A rounded double; infinite and NaN are null."""
    return f"CASE WHEN isfinite(CAST({expression} AS DOUBLE)) THEN round(CAST({expression} AS DOUBLE), {digits}) END AS \"{name}\""


def _splits_frame(spark: SparkSession, splits: dict[str, list[float]]) -> DataFrame:
    rows = [(f, i, float(x)) for f, s in splits.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "feature string, place int, split double")


def _union(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


_TENTHS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def _edges(column: str, source: str = "d", where: str = "true", probabilities: str = _TENTHS) -> str:
    """A scalar list of inner quantile edges."""
    return f"(SELECT list_sort(list_distinct(quantile_cont({column}, {probabilities})))[2:-2] FROM {source} WHERE {where})"


def _code(x: str, edges: str, closed: str = "right") -> str:
    return f"len(list_filter({edges}, lambda e: e {'<' if closed == 'right' else '<='} {x}))"


# ---- binning


@query("WITH m AS (" + _union([f"SELECT '{c}' AS feature, min({c}) AS a, max({c}) AS z FROM lineitem" for c in NUMBERS]) + f") SELECT feature, CAST(i - 1 AS BIGINT) AS place, {r('a + (z - a) * i / 5.0', 'split')} FROM m, range(1, 5) t(i)")
def bin_equal_width(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, method="step", n_bins=5))


@query("WITH q AS (" + _union([f"SELECT '{c}' AS feature, unnest(quantile_cont({c}, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])) AS v FROM lineitem" for c in NUMBERS]) + "), u AS (SELECT DISTINCT feature, v FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS i, count(*) OVER (PARTITION BY feature) AS n FROM u) SELECT feature, CAST(i - 2 AS BIGINT) AS place, round(v, 6) AS split FROM n WHERE i > 1 AND i < n")
def bin_quantile(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, method="quantile", n_bins=8))


@query("SELECT CASE WHEN l_quantity <= 10 THEN '(-inf, 10.0]' WHEN l_quantity <= 25.5 THEN '(10.0, 25.5]' ELSE '(25.5, inf]' END AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def bin_labels(spark, sf_dir):
    b = binning.Binner().load({"l_quantity": {"splits": [25.5, 10.0]}})
    return b.transform(lines(spark, sf_dir), labels=True).groupBy(F.col("l_quantity").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {L} SELECT CAST(CASE WHEN qn IS NULL THEN -1 WHEN qn <= 10 THEN 0 WHEN qn <= 20 THEN 1 WHEN qn <= 30 THEN 2 ELSE 3 END AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1")
def bin_codes_missing(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(B.bin_code(F.col("qn"), [10.0, 20.0, 30.0]).alias("code")).agg(F.count("*").alias("n"))


@query(
    f"WITH {L}, v AS (SELECT l_discount AS x, count(*) AS n, sum(y) AS b FROM d GROUP BY 1), c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS ln, sum(b) OVER (ORDER BY x) AS lb, sum(n) OVER () AS tn, sum(b) OVER () AS tb FROM v),"
    " g AS (SELECT (x + nx) / 2 AS split, 2.0 * lb * (ln - lb) / ln + 2.0 * (tb - lb) * (tn - ln - tb + lb) / (tn - ln) AS left_over FROM c WHERE nx IS NOT NULL AND ln >= ceil(0.05 * tn) AND tn - ln >= ceil(0.05 * tn))"
    " SELECT 'l_discount' AS feature, CAST(0 AS BIGINT) AS place, round(split, 6) AS split FROM g ORDER BY left_over, split LIMIT 1"
)
def bin_tree_stump(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), ["l_discount"], "y", "dt", 2))


@query()
def bin_tree(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, "y", "dt", 5))


@query()
def bin_chimerge(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, "y", "chi", 5, alpha=0.5))


@query()
def bin_kmeans(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, method="kmean", n_bins=5))


@query()
def bin_optimal(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, "y", "opt", 5, monotonic="auto_asc_desc"))


def _merged_sql(first: str, at: str, seeds: str) -> str:
    """Split points after neighbouring bins are merged as long as `at` names one: bin i and the next. first: CTEs ending in f (feature, s, n, b), lists of splits, rows and bads; seeds: columns that `at` uses."""
    return (
        f"WITH RECURSIVE {first}, m AS (SELECT 0 AS k, feature, s, n, b FROM f UNION ALL"
        " SELECT k + 1, feature, list_concat(s[:i - 1], s[i + 1:]), list_concat(list_append(n[:i - 1], n[i] + n[i + 1]), n[i + 2:]), list_concat(list_append(b[:i - 1], b[i] + b[i + 1]), b[i + 2:])"
        f" FROM (SELECT *, {at} AS i FROM (SELECT *, {seeds} FROM m)) WHERE i IS NOT NULL AND len(s) > 0),"
        " z AS (SELECT feature, arg_max(s, k) AS s FROM m GROUP BY 1)"
        f" SELECT feature, CAST(p - 1 AS BIGINT) AS place, {r('s[p]', 'split')} FROM (SELECT feature, s, unnest(range(1, len(s) + 1)) AS p FROM z)"
    )


def _counted_sql(splits: str) -> str:
    """f (feature, s, n, b) from splits, a scalar list by column."""
    parts = [f"SELECT '{c}' AS feature, any_value(s) AS s, list(n ORDER BY i) AS n, list(b ORDER BY i) AS b FROM (SELECT s, i, (SELECT count(*) FROM d WHERE {_code(c, 's')} = i) AS n, (SELECT coalesce(sum(y), 0) FROM d WHERE {_code(c, 's')} = i) AS b FROM (SELECT s, unnest(range(0, len(s) + 1)) AS i FROM (SELECT {splits.format(c=c)} AS s)))" for c in NUMBERS]
    return f"{L}, f AS ({_union(parts)})"


@query(
    _merged_sql(
        _counted_sql("(SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])))[2:-2] FROM d)"),
        "CASE WHEN len(falls) = 0 OR len(rises) = 0 THEN NULL WHEN rate[-1] > rate[1] THEN falls[1] ELSE rises[1] END",
        "list_transform(range(1, len(n) + 1), lambda j: b[j] / CAST(n[j] AS DOUBLE)) AS rate, list_filter(range(1, len(n)), lambda j: rate[j + 1] < rate[j]) AS falls, list_filter(range(1, len(n)), lambda j: rate[j + 1] > rate[j]) AS rises",
    )
)
def bin_monotone(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, "y", "quantile", 8, monotonic=True))


@query(
    _merged_sql(
        _counted_sql("(SELECT list_transform(range(1, 9), lambda i: min({c}) + (max({c}) - min({c})) * i / 9.0) FROM d)"),
        "CASE WHEN i1 IS NULL THEN NULL WHEN i1 = 1 THEN 1 WHEN i1 = len(n) THEN i1 - 1 WHEN n[i1 - 1] <= n[i1 + 1] THEN i1 - 1 ELSE i1 END",
        "list_filter(range(1, len(n) + 1), lambda j: n[j] < ceil(0.12 * list_sum(n)))[1] AS i1",
    )
)
def bin_min_samples(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), NUMBERS, "y", "step", 9, min_samples=0.12))


# ---- weights of evidence

def _woe_cte(counts: str, by: str = "feature") -> str:
    """counts: (by, bin..., total, bad)."""
    return (
        f"{counts}, t AS (SELECT *, total - bad AS good, sum(bad) OVER (PARTITION BY {by}) AS tb, sum(total - bad) OVER (PARTITION BY {by}) AS tg FROM c),"
        " w AS (SELECT *, greatest(good, 1) / CAST(tg AS DOUBLE) AS dist_good, greatest(bad, 1) / CAST(tb AS DOUBLE) AS dist_bad FROM t),"
        " z AS (SELECT *, ln(dist_good / dist_bad) AS woe, (dist_good - dist_bad) * ln(dist_good / dist_bad) AS ivc FROM w)"
    )


_QTY = f"WITH {L}, c AS (SELECT 'qn' AS feature, CASE WHEN qn IS NULL THEN -1 ELSE {_code('qn', 'e')} END AS bin_idx, count(*) AS total, sum(y) AS bad FROM (SELECT *, {_edges('qn')} AS e FROM d) GROUP BY 1, 2)"


@query(f"{_woe_cte(_QTY)} SELECT CAST(bin_idx AS BIGINT) AS bin_idx, {big('total', 'bad', 'good')}, {r('dist_good', 'dist_good')}, {r('dist_bad', 'dist_bad')}, {r('woe', 'woe')}, {r('ivc', 'iv_contribution')} FROM z")
def woe_table(spark, sf_dir):
    """The flagship: quantile bins of a column with missing values, their counts, WOE and IV."""
    df = lines(spark, sf_dir)
    splits = binning.fit_splits(df, ["qn"], method="quantile", n_bins=10)
    binned = woe.counts(binning.coded(df, splits, keep=["__y"], y="y"), ["feature", "bin_idx"], F.col("__y"))
    return woe.with_woe(binned).select("bin_idx", "total", "bad", "good", "dist_good", "dist_bad", "woe", "iv_contribution")


@query(f"{_woe_cte(_QTY)} SELECT {r('sum(woe * total)', 'woe_sum', 4)}, {r('min(woe)', 'low')}, {r('max(woe)', 'high')}, CAST(sum(total) AS BIGINT) AS n FROM z", digits=6)
def woe_transform(spark, sf_dir):
    df = lines(spark, sf_dir)
    b = binning.Binner().fit(df, "y", ["qn"], "quantile", 10)
    return b.woe_transform(df).agg(F.round(F.sum("qn"), 4).alias("woe_sum"), F.min("qn").alias("low"), F.max("qn").alias("high"), F.count("*").alias("n"))


@query(f"WITH {L}, c AS (SELECT 'f' AS feature, {_code('l_extendedprice', 'e')} AS b, count(*) AS total, sum(y) AS bad FROM (SELECT *, {_edges('l_extendedprice')} AS e FROM d) GROUP BY 1, 2)" + _woe_cte("") + f" SELECT {big('total', 'bad', 'good')}, {r('woe', 'woe')}, {r('ivc', 'iv_contribution')} FROM z")
def iv_single_numeric(spark, sf_dir):
    return woe.single_iv(lines(spark, sf_dir), "l_extendedprice", "y").select("total", "bad", "good", "woe", "iv_contribution")


@query(f"WITH {O}, c AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS bin, count(*) AS total, sum(y) AS bad FROM d WHERE y IN (0, 1) GROUP BY 1, 2)" + _woe_cte("") + f" SELECT feature, bin, {big('total', 'bad', 'good')}, {r('woe', 'woe')}, {r('ivc', 'iv_contribution')} FROM z")
def iv_single_categorical(spark, sf_dir):
    return woe.categorical_iv(orders(spark, sf_dir), ["o_orderpriority"], "y").select("feature", "bin", "total", "bad", "good", "woe", "iv_contribution")


_BATCH = "".join(
    f", s_{c} AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM d), k_{c} AS (SELECT least(10, count(DISTINCT {c})) AS k FROM d),"
    f" e_{c} AS (SELECT list_sort(list_distinct(list(x)))[2:-2] AS e FROM s_{c}, k_{c} WHERE i IN (SELECT CAST(round_even((n - 1) * j / CAST(k AS DOUBLE), 0) AS BIGINT) FROM range(0, 11) t(j) WHERE j <= k))"
    for c in NUMBERS
)


@query(
    f"WITH {L}{_BATCH}, c AS ("
    + _union([f"SELECT '{c}' AS feature, CAST({_code(c, 'e', 'left')} AS VARCHAR) AS bin, count(*) AS total, sum(y) AS bad FROM d, e_{c} GROUP BY 1, 2" for c in NUMBERS] + ["SELECT 'l_linestatus', l_linestatus, count(*), sum(y) FROM d GROUP BY 1, 2"])
    + ")"
    + _woe_cte("")
    + f" SELECT feature, {r('sum(ivc)', 'iv')} FROM z GROUP BY 1"
)
def iv_batch(spark, sf_dir):
    return woe.batch_iv(lines(spark, sf_dir), [*NUMBERS, "l_linestatus"], "y").select("feature", "iv")


_STATS_SQL = (
    _woe_cte(_QTY)
    + ", o AS (SELECT *, sum(bad) OVER w AS cb, sum(good) OVER w AS cg, sum(total) OVER w AS ct, sum(total) OVER () AS tt FROM z WINDOW w AS (ORDER BY bin_idx < 0, bin_idx))"
    + f" SELECT CAST(bin_idx AS BIGINT) AS bin_idx, CAST(bad AS BIGINT) AS bads, CAST(good AS BIGINT) AS goods, CAST(total AS BIGINT) AS total, {r('bad / total', 'bad_rate')}, {r('good / total', 'good_rate')}, {r('good / greatest(bad, 1)', 'odds')},"
    + f" {r('dist_bad', 'bad_prop')}, {r('dist_good', 'good_prop')}, {r('total / tt', 'total_prop')}, CAST(cb AS BIGINT) AS cum_bads, CAST(cg AS BIGINT) AS cum_goods, CAST(ct AS BIGINT) AS cum_total,"
    + f" {r('cb / tb', 'cum_bads_prop')}, {r('cg / tg', 'cum_goods_prop')}, {r('ct / tt', 'cum_total_prop')}, {r('abs(cb / tb - cg / tg)', 'ks')}, {r('woe', 'woe')}, {r('ivc', 'iv')}, {r('(bad / total) / (tb / tt)', 'lift')} FROM o"
)


@query(_STATS_SQL)
def bin_stats_full(spark, sf_dir):
    df = lines(spark, sf_dir)
    splits = binning.fit_splits(df, ["qn"], method="quantile", n_bins=10)
    return binning.statistics(df, splits, "y").drop("feature", "bin", "min", "max")


@query(f"{_woe_cte(_QTY)} SELECT feature, {r('sum(ivc)', 'iv')} FROM z GROUP BY 1")
def iv_rank(spark, sf_dir):
    b = binning.Binner().fit(lines(spark, sf_dir), "y", ["qn"], "quantile", 10)
    return spark.createDataFrame(b.iv_table(), "feature string, iv double")


@query(f"WITH {O}, c AS (SELECT o_orderpriority AS feature, o_orderpriority AS bin, count(*) AS total, sum(y) AS bad FROM d WHERE y IN (0, 1) GROUP BY 1, 2), t AS (SELECT *, total - bad AS good, sum(bad) OVER () AS tb, sum(total - bad) OVER () AS tg FROM c) SELECT bin, {r('ln((good / CAST(tg AS DOUBLE)) / (bad / CAST(tb AS DOUBLE)))', 'woe')}, CAST(total AS BIGINT) AS n FROM t")
def woe_encoder(spark, sf_dir):
    df = orders(spark, sf_dir)
    e = woe.WOEEncoder("o_orderpriority").fit(df, "y")
    return e.transform(df.where("y in (0, 1)"), "woe").groupBy(F.col("o_orderpriority").alias("bin"), "woe").agg(F.count("*").alias("n"))


# ---- metrics

_CORE = ["总", "好", "坏", "坏占比", "KS", "AUC", "10%lift", "5%lift", "2%lift", "1%lift"]


def _metrics_cte(by: str = "'all'", source: str = "d", y: str = "y", s: str = "score", weight: str | None = None) -> str:
    """CTEs ending in m (k, KS, AUC, lifts) and tot (k, totals)."""
    g, b = (f"sum(CASE WHEN {y} = 0 THEN {weight} ELSE 0 END)", f"sum(CASE WHEN {y} = 1 THEN {weight} ELSE 0 END)") if weight else (f"CAST(count(*) FILTER ({y} = 0) AS DOUBLE)", f"CAST(count(*) FILTER ({y} = 1) AS DOUBLE)")
    lifts = ", ".join(f"max(CASE WHEN up < greatest(1, ceil(n_all * {k})) AND up + n >= greatest(1, ceil(n_all * {k})) THEN ((ub + (greatest(1, ceil(n_all * {k})) - up) / n * b) / greatest(1, ceil(n_all * {k}))) / (tb / n_all) END) AS l{int(k * 100)}" for k in (0.1, 0.05, 0.02, 0.01))
    return (
        f"tot AS (SELECT {by} AS k, count(*) AS n, count(*) FILTER ({y} = 0) AS good, count(*) FILTER ({y} = 1) AS bad FROM {source} GROUP BY 1),"
        f" p AS (SELECT {by} AS k, {s} AS s, CAST(count(*) AS DOUBLE) AS n, {g} AS g, {b} AS b FROM {source} WHERE {y} IN (0, 1) AND {s} IS NOT NULL GROUP BY 1, 2),"
        " q AS (SELECT *, sum(g) OVER (PARTITION BY k) AS tg, sum(b) OVER (PARTITION BY k) AS tb, sum(n) OVER (PARTITION BY k) AS n_all,"
        " coalesce(sum(g) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pg, coalesce(sum(b) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,"
        " coalesce(sum(n) OVER (PARTITION BY k ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up, coalesce(sum(b) OVER (PARTITION BY k ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ub FROM p),"
        f" m AS (SELECT k, max(abs((pb + b) / tb - (pg + g) / tg)) AS ks, sum(b * (pg + g / 2)) / max(tb * tg) AS auc, {lifts} FROM q GROUP BY 1)"
    )


_CORE_SQL = f'CAST(n AS BIGINT) AS "总", CAST(good AS BIGINT) AS "好", CAST(bad AS BIGINT) AS "坏", {r("bad / CAST(good + bad AS DOUBLE)", "坏占比")}, {r("ks", "KS")}, {r("auc", "AUC")}, {r("l10", "10%lift")}, {r("l5", "5%lift")}, {r("l2", "2%lift")}, {r("l1", "1%lift")}'


@query(f"WITH {O}, {_metrics_cte()} SELECT {r('auc', 'auc')} FROM m")
def auc_exact(spark, sf_dir):
    return metrics.auc(orders(spark, sf_dir), "y", "score")


@query(f"WITH {O}, {_metrics_cte()} SELECT {r('ks', 'ks')} FROM m")
def ks_exact(spark, sf_dir):
    return metrics.ks(orders(spark, sf_dir), "y", "score")


@query(f"WITH {O}, {_metrics_cte()} SELECT {r('2 * auc - 1', 'gini')} FROM m")
def gini(spark, sf_dir):
    return metrics.gini(orders(spark, sf_dir), "y", "score")


@query(f"WITH {O}, {_metrics_cte(weight='loan')} SELECT {r('auc', 'auc')} FROM m")
def auc_weighted(spark, sf_dir):
    return metrics.auc(orders(spark, sf_dir), "y", "score", "loan")


@query(f"WITH {O}, {_metrics_cte(weight='loan')} SELECT {r('ks', 'ks')} FROM m")
def ks_weighted(spark, sf_dir):
    return metrics.ks(orders(spark, sf_dir), "y", "score", "loan")


@query(f"WITH {O}, {_metrics_cte()} SELECT {_CORE_SQL} FROM tot JOIN m USING (k)")
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(orders(spark, sf_dir), "y", "score")


@query(f"WITH {O}, {_metrics_cte('o_orderpriority')} SELECT k AS o_orderpriority, {_CORE_SQL} FROM tot JOIN m USING (k)")
def binary_metrics_grouped(spark, sf_dir):
    return metrics.binary_metrics(orders(spark, sf_dir), "y", "score", ["o_orderpriority"])


_BINNED = (
    f"WITH {O}, v AS (SELECT * FROM d WHERE y IN (0, 1) AND score IS NOT NULL), p AS (SELECT {_code('score', 'e', 'left')} AS bin, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS g, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS b FROM (SELECT *, {_edges('score', 'v')} AS e FROM v) GROUP BY 1),"
    " q AS (SELECT *, sum(g) OVER () AS tg, sum(b) OVER () AS tb, sum(g) OVER (ORDER BY bin) AS cg, sum(b) OVER (ORDER BY bin) AS cb FROM p)"
)


@query(f"{_BINNED} SELECT {r('max(abs(cb / tb - cg / tg))', 'KS')}, {r('sum(b * (cg - g + g / 2)) / max(tb * tg)', 'AUC')} FROM q")
def binary_metrics_binned(spark, sf_dir):
    return metrics.binary_metrics(orders(spark, sf_dir), "y", "score", mode="binned").select("KS", "AUC")


@query(
    f"WITH {O}, v AS (SELECT * FROM d WHERE y IN (0, 1) AND score IS NOT NULL), p AS (SELECT {_code('score', 'e')} AS bin, min(score) AS a, max(score) AS z, count(*) AS n, sum(y) AS b FROM (SELECT *, {_edges('score', 'v')} AS e FROM v) GROUP BY 1)"
    f" SELECT CAST(bin AS BIGINT) AS bin, {r('a', 'min_prob')}, {r('z', 'max_prob')}, CAST(n AS BIGINT) AS count, CAST(b AS BIGINT) AS events, {r('b / CAST(n AS DOUBLE)', 'event_rate')}, {r('(b / CAST(n AS DOUBLE)) / (sum(b) OVER () / sum(n) OVER ())', 'lift')} FROM p"
)
def lift_table(spark, sf_dir):
    return metrics.lift_table(orders(spark, sf_dir), "y", "score")


@query(f"WITH {O}, v AS (SELECT * FROM d WHERE y IN (0, 1) AND score IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) AS i, count(*) OVER () AS n, avg(y) OVER () AS a FROM v) SELECT {r('avg(y) / max(a)', 'lift')} FROM n WHERE i <= ceil(n * 0.1)")
def lift_at_k(spark, sf_dir):
    return spark.createDataFrame([(metrics.lift_at_k(orders(spark, sf_dir), "y", "score", 0.1, ["o_orderkey"]),)], "lift double")


_AMOUNT = (
    f"WITH {O}, v AS (SELECT * FROM d WHERE y IN (0, 1)), p AS (SELECT score AS s, CAST(count(*) AS DOUBLE) AS n, sum(principal) AS p, sum(loan) AS l, sum(CASE WHEN y = 1 THEN loan ELSE 0 END) AS b, sum(CASE WHEN y = 0 THEN loan ELSE 0 END) AS g FROM v WHERE score IS NOT NULL GROUP BY 1),"
    " q AS (SELECT *, sum(g) OVER (ORDER BY s) - g AS pg, sum(b) OVER (ORDER BY s) AS cb, sum(g) OVER (ORDER BY s) AS cg, sum(b) OVER () AS tb, sum(g) OVER () AS tg FROM p), t AS (SELECT sum(loan) AS loan, sum(principal) AS principal FROM v)"
)


@query(f"{_AMOUNT} SELECT {r('max(t.loan)', '放款金额', 3)}, {r('max(t.principal)', '逾期本金', 3)}, {r('max(t.principal) / max(t.loan)', '金额坏占比')}, {r('sum(b * (pg + g / 2)) / max(tb * tg)', '金额AUC')}, {r('max(abs(cb / tb - cg / tg))', '金额KS')} FROM q, t")
def amount_metrics(spark, sf_dir):
    out = metrics.amount_metrics(orders(spark, sf_dir), "y", "score", "principal", "loan")
    return out.select(F.round("放款金额", 3).alias("放款金额"), F.round("逾期本金", 3).alias("逾期本金"), "金额坏占比", "金额AUC", "金额KS")


# ---- stability


def _psi_sql(expected: str, actual: str, column: str, keys: str = "'all'", missing: bool = True, buckets: int = 10, edges: str | None = None, closed: str = "left", key_sql: str = "k") -> str:
    """expected: a WHERE for d; actual: another. The result: CTE res (k, psi)."""
    e = edges or f"(SELECT list_sort(list_distinct(quantile_cont({column}, [i / CAST({buckets} AS DOUBLE) FOR i IN range(0, {buckets + 1})])))[2:-2] FROM d WHERE {expected})"
    code = f"CASE WHEN {column} IS NULL THEN -1 ELSE {_code(column, 'e', closed)} END"
    low = -1 if missing else 0
    return (
        f"x AS (SELECT *, {e} AS e FROM d), cx AS (SELECT {code} AS bucket, count(*) AS n FROM x WHERE {expected} GROUP BY 1), ca AS (SELECT {keys} AS k, {code} AS bucket, count(*) AS n FROM x WHERE {actual} GROUP BY 1, 2),"
        f" grid AS (SELECT k, bucket FROM (SELECT DISTINCT k FROM ca), range({low}, {buckets}) t(bucket)), f AS (SELECT grid.k, grid.bucket, coalesce(cx.n, 0) AS ne, coalesce(ca.n, 0) AS na FROM grid LEFT JOIN cx ON cx.bucket = grid.bucket LEFT JOIN ca ON ca.bucket = grid.bucket AND ca.k = grid.k),"
        " s AS (SELECT *, greatest(ne / CAST(sum(ne) OVER (PARTITION BY k) AS DOUBLE), 1e-8) AS pe, greatest(na / CAST(sum(na) OVER (PARTITION BY k) AS DOUBLE), 1e-8) AS pa FROM f),"
        " res AS (SELECT k, sum((pa - pe) * ln(pa / pe)) AS psi FROM s GROUP BY 1)"
    )


@query(f"WITH {L}, {_psi_sql('''tag = 'train' ''', '''tag = 'oot' ''', 'qn')} SELECT {r('psi', 'psi')} FROM res")
def psi_pair(spark, sf_dir):
    df = lines(spark, sf_dir)
    return spark.createDataFrame([(psi.psi(df.where("tag = 'train'"), df.where("tag = 'oot'"), "qn"),)], "psi double")


@query(f"WITH {L}, {_psi_sql('''tag = 'train' ''', '''tag = 'oot' ''', 'qn', missing=False)} SELECT {r('psi', 'psi')} FROM res")
def psi_exclude_nan(spark, sf_dir):
    df = lines(spark, sf_dir)
    return spark.createDataFrame([(psi.psi(df.where("tag = 'train'"), df.where("tag = 'oot'"), "qn", nan_strategy="exclude"),)], "psi double")


@query(f"WITH {L}, {_psi_sql('''tag = 'train' ''', 'true', 'net', keys='tag')} SELECT k AS tag, {r('psi', 'psi')} FROM res")
def psi_batch(spark, sf_dir):
    df = lines(spark, sf_dir)
    return psi.psi_groups(df.where("tag = 'train'"), df, "net", ["tag"])


@query(f"WITH {L} " + _union([f"SELECT * FROM (WITH {_psi_sql('''tag = 'train' ''', '''tag = 'test' ''', c)} SELECT '{c}' AS feature, {r('psi', 'psi')} FROM res)" for c in ("qn", "l_extendedprice", "l_discount")]))
def psi_feature_pairs(spark, sf_dir):
    df = lines(spark, sf_dir)
    return psi.psi_features(df.where("tag = 'train'"), df.where("tag = 'test'"), ["qn", "l_extendedprice", "l_discount"])


@query(f"WITH {O}, {_psi_sql('''yr = (SELECT max(yr) FROM d)''', 'true', 'score', keys='yr')} SELECT k AS yr, {r('psi', 'psi')}, k = (SELECT max(yr) FROM d) AS is_reference FROM res")
def psi_grouped_latest(spark, sf_dir):
    return psi.grouped_psi(orders(spark, sf_dir), ["yr"], "score")


@query(f"WITH {O}, {_psi_sql('''yr = '1996' ''', 'true', 'score', keys='yr', buckets=5)}, n AS (SELECT yr AS k, count(*) AS n, count(*) - count(score) AS m FROM d GROUP BY 1) SELECT k AS yr, {r('psi', 'psi')}, k = '1996' AS is_reference, CAST(n AS BIGINT) AS sample_count, CAST(m AS BIGINT) AS missing_count, (SELECT CAST(n AS BIGINT) FROM n WHERE k = '1996') AS reference_sample_count, (SELECT CAST(m AS BIGINT) FROM n WHERE k = '1996') AS reference_missing_count FROM res JOIN n USING (k)")
def psi_grouped_value(spark, sf_dir):
    return psi.grouped_psi(orders(spark, sf_dir), ["yr"], "score", "value", "yr", "1996", buckets=5, include_stats=True)


@query(f"WITH {O} " + _union([f"SELECT * FROM (WITH {_psi_sql('''tag = 'train' ''', 'true', c, keys='tag')} SELECT '{c}' AS feature, k AS compare_value, {r('psi', 'psi')}, k = 'train' AS is_reference FROM res)" for c in ("score", "o_totalprice")]))
def psi_feature_against_base(spark, sf_dir):
    return psi.feature_psi_against_base(orders(spark, sf_dir), ["score", "o_totalprice"], "tag", "train", "tag").select("feature", "compare_value", "psi", "is_reference")


def _latest(tag: str) -> str:
    return f"SELECT * FROM (WITH {_psi_sql(f'''tag = '{tag}' AND month = (SELECT max(month) FROM d WHERE tag = '{tag}')''', f'''tag = '{tag}' ''', 'o_totalprice', keys='month')} SELECT '{tag}' AS tag, k AS month, {r('psi', 'latest_month_psi')} FROM res)"


@query(f"WITH {O} " + _union([_latest(t) for t in ("train", "test", "oot")]))
def psi_latest_month(spark, sf_dir):
    return psi.latest_month_psi(orders(spark, sf_dir), "tag", "month", "o_totalprice")


@query(f"WITH {L}, {_psi_sql('''tag = 'train' ''', '''tag = 'oot' ''', 'l_extendedprice', edges='[20000.0, 50000.0, 80000.0]', buckets=4)} SELECT {r('psi', 'psi')} FROM res")
def psi_given_edges(spark, sf_dir):
    df = lines(spark, sf_dir)
    return spark.createDataFrame([(psi.psi_with_edges(df.where("tag = 'train'"), df.where("tag = 'oot'"), "l_extendedprice", [20000.0, 50000.0, 80000.0]),)], "psi double")


@query(f"WITH {L}, {_psi_sql('''tag = 'train' ''', '''tag = 'oot' ''', 'l_quantity', edges='[10.0, 25.0, 40.0]', buckets=4, closed='right')} SELECT {r('psi', 'psi')} FROM res")
def psi_scorecard_edges(spark, sf_dir):
    df = lines(spark, sf_dir)
    return spark.createDataFrame([(psi.psi_with_edges(df.where("tag = 'train'"), df.where("tag = 'oot'"), "l_quantity", [10.0, 25.0, 40.0], closed="right"),)], "psi double")


_DAYS = "d AS (SELECT CAST(ts AS DATE) AS day, value FROM events)"


@query(f"WITH {_DAYS}, {_psi_sql('day = (SELECT min(day) FROM d)', 'true', 'value', keys='day', edges='[50.0, 100.0, 200.0]', buckets=4)} SELECT CAST(k AS DATE) AS day, {r('psi', 'psi')} FROM res")
def stream_psi(spark, sf_dir):
    """Stability by window of event time, from the counts that a stream keeps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = psi_counts(events, "value", [50.0, 100.0, 200.0], "ts")
    first = counts.agg(F.min("start").alias("s"))
    reference = counts.join(F.broadcast(first), F.col("start") == F.col("s")).select("bucket", "n")  # one row
    return psi_of_counts(counts, reference, 4).select(F.col("start").cast("date").alias("day"), "psi")


# ---- tables


@query(f"WITH {O} SELECT tag AS \"样本集\", o_orderpriority AS \"渠道\", yr AS \"月\", 'y' AS \"标签\", CAST(count(*) FILTER (y = 0) AS BIGINT) AS \"好\", CAST(count(*) FILTER (y = 1) AS BIGINT) AS \"坏\", CAST(count(*) FILTER (y = -1) AS BIGINT) AS \"灰\", CAST(count(*) FILTER (y >= 0) AS BIGINT) AS \"总数（去掉灰样本）\", {r('avg(y) FILTER (y >= 0)', '坏占比（去掉灰样本）')} FROM d GROUP BY 1, 2, 3")
def label_distribution(spark, sf_dir):
    return tables.label_distribution(orders(spark, sf_dir), "y", "tag", "yr", "o_orderpriority")


_PERF = (
    f"WITH {O}, x AS (SELECT CASE WHEN score IS NULL THEN -1 WHEN score <= 100000 THEN 0 WHEN score <= 250000 THEN 1 WHEN score <= 400000 THEN 2 ELSE 3 END AS code, y, loan, principal FROM d WHERE y IN (0, 1)), p AS (SELECT code, count(*) FILTER (y = 0) AS g, count(*) FILTER (y = 1) AS b, count(*) AS n, sum(principal) AS pr, sum(loan) AS lo FROM x GROUP BY 1),"
    " q AS (SELECT *, CAST(sum(g) OVER () AS DOUBLE) AS tg, CAST(sum(b) OVER () AS DOUBLE) AS tb, CAST(sum(n) OVER () AS DOUBLE) AS tn, sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(n) OVER w AS cn, sum(pr) OVER () AS tpr, sum(lo) OVER () AS tlo FROM p WINDOW w AS (ORDER BY code < 0, code))"
)
_PERF_COLUMNS = f"CASE code WHEN -1 THEN 'Missing' WHEN 0 THEN '(-inf, 100000.0]' WHEN 1 THEN '(100000.0, 250000.0]' WHEN 2 THEN '(250000.0, 400000.0]' ELSE '(400000.0, inf]' END AS bin, CAST(g AS BIGINT) AS goods, CAST(b AS BIGINT) AS bads, CAST(n AS BIGINT) AS total, {r('n / tn', 'total_prop')}, {r('g / tg', 'goods_prop')}, {r('b / tb', 'bads_prop')}, {r('b / CAST(n AS DOUBLE)', 'bad_rate')}, {r('cb / CAST(cn AS DOUBLE)', 'cum_bad_rate')}, {r('cb / tb', 'cum_bads_prop')}, {r('abs(cb / tb - cg / tg)', 'ks')}, {r('(b / CAST(n AS DOUBLE)) / (tb / tn)', 'lift')}, {r('(cb / CAST(cn AS DOUBLE)) / (tb / tn)', 'cum_lift')}"


@query(f"{_PERF} SELECT {_PERF_COLUMNS} FROM q")
def bin_performance(spark, sf_dir):
    return tables.bin_performance(orders(spark, sf_dir), "y", "score", [100000.0, 250000.0, 400000.0]).drop("min", "max")


@query(f"{_PERF} SELECT {_PERF_COLUMNS}, {r('pr', '逾期本金', 3)}, {r('lo', '放款金额', 3)}, {r('pr / lo', '金额坏占比')}, {r('lo / tlo', '放款金额占比')}, {r('pr / tpr', '逾期本金占比')}, {r('(pr / lo) / (tpr / tlo)', '金额lift')} FROM q")
def bin_metrics_amount(spark, sf_dir):
    out = tables.bin_metrics(orders(spark, sf_dir), "y", "score", bins=[-1.0, 100000.0, 250000.0, 400000.0, 1e9], principal="principal", loan="loan").drop("min", "max")
    return out.withColumn("逾期本金", F.round("逾期本金", 3)).withColumn("放款金额", F.round("放款金额", 3))


@query(f"{_PERF} SELECT CAST(g AS BIGINT) AS goods, CAST(b AS BIGINT) AS bads, CAST(n AS BIGINT) AS total, {r('n / tn', 'total_prop')}, {r('g / tg', 'good_prop')}, {r('b / tb', 'bad_prop')}, {r('b / CAST(n AS DOUBLE)', 'bad_rate')}, {r('ln((g / tg) / (b / tb))', 'woe')}, {r('(g / tg - b / tb) * ln((g / tg) / (b / tb))', 'iv')}, {r('abs(cb / tb - cg / tg)', 'ks')}, {r('(b / CAST(n AS DOUBLE)) / (tb / tn)', 'lift')} FROM q")
def feature_bin_stats(spark, sf_dir):
    return tables.feature_bin_stats(orders(spark, sf_dir), "score", "y", [100000.0, 250000.0, 400000.0]).drop("bin", "min", "max")


_PORTRAIT = f"WITH {O}, p AS (SELECT CASE WHEN score IS NULL THEN -1 ELSE {_code('score', 'e')} END AS code, avg(o_custkey) AS a, avg(o_totalprice) AS t, count(*) AS n FROM (SELECT *, {_edges('score', probabilities='[0.0, 0.25, 0.5, 0.75, 1.0]')} AS e FROM d) GROUP BY 1)"


@query(f"{_PORTRAIT} SELECT 'score' AS \"模型\", 'o_custkey' AS \"画像变量\", {r('a', '均值', 4)} FROM p UNION ALL SELECT 'score', 'o_totalprice', round(t, 4) FROM p", digits=4)
def portrait_means(spark, sf_dir):
    return tables.portrait_means(orders(spark, sf_dir), ["score"], ["o_custkey", "o_totalprice"], 4).drop("分组")


@query(f"{_PORTRAIT} SELECT 'o_custkey' AS \"画像变量\", 'score' AS \"模型\", " + ", ".join(f'round(max(a) FILTER (code = {i}), 4) AS "{i + 1}"' for i in range(4)) + ', round(max(a) FILTER (code = -1), 4) AS "Missing" FROM p', digits=4)
def portrait_pivot(spark, sf_dir):
    return tables.portrait_pivot(orders(spark, sf_dir), ["score"], ["o_custkey"], 4)


def _split_sql(by: str, tag: str, month: str) -> str:


    psi_cte = _psi_sql("tag = 'train' AND y IN (0, 1)", "y IN (0, 1)", "score", keys=by)
    return f"WITH {O}, {_metrics_cte(by)}, {psi_cte} SELECT 'y' AS \"样本标签\", 'score' AS \"模型\", {tag} AS \"样本集\", {month} AS \"观察点月\", {_CORE_SQL}, {r('psi', 'train和各集合的PSI')} FROM tot JOIN m USING (k) JOIN res USING (k)"


@query(_split_sql("tag", "k", "''"))
def split_metrics_tag(spark, sf_dir):
    by_tag, _ = tables.split_metrics(orders(spark, sf_dir), ["y"], "score", "tag", "yr")
    return by_tag.drop("近期月对比各集合PSI")


@query(_split_sql("yr", "(SELECT string_agg(t, ',' ORDER BY CASE t WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END) FROM (SELECT DISTINCT tag AS t FROM d WHERE yr = tot.k))", "k"))
def split_metrics_month(spark, sf_dir):
    _, by_month = tables.split_metrics(orders(spark, sf_dir), ["y"], "score", "tag", "yr")
    return by_month.drop("近期月对比各集合PSI")


@query(f"WITH {O}, {_metrics_cte('o_orderpriority')} SELECT 'o_orderpriority' AS \"维度列\", k AS \"维度值\", 'y' AS \"样本标签\", 'm1' AS \"模型\", {_CORE_SQL} FROM tot JOIN m USING (k)")
def dimensional_comparison(spark, sf_dir):
    return tables.dimensional_comparison(orders(spark, sf_dir), ["o_orderpriority"], ["y"], "score", model="m1")


def _pair(by: str, tag: str, month: str) -> str:
    parts = [f"SELECT * FROM (WITH {_metrics_cte(by, 'v', s=s)} SELECT 'y' AS \"样本标签\", '{s}' AS \"模型\", {tag} AS \"样本集\", {month} AS \"观察点月\", {_CORE_SQL} FROM tot JOIN m USING (k))" for s in ("score", "old_score")]
    return f"WITH {O}, v AS (SELECT * FROM d WHERE score > 0 AND old_score > 0) {_union(parts)}"


@query(_pair("tag", "k", "''"))
def model_comparison_tag(spark, sf_dir):
    return tables.model_comparison(orders(spark, sf_dir), "y", ["score", "old_score"], ["tag"], tag="tag").drop(*tables.PSI_COLUMNS)


@query(_pair("yr", "''", "k"))
def model_comparison_month(spark, sf_dir):
    return tables.model_comparison(orders(spark, sf_dir), "y", ["score", "old_score"], ["yr"], month="yr").drop(*tables.PSI_COLUMNS)


@query(f"WITH {O}, {_metrics_cte(source='(SELECT * FROM d WHERE tag = $$train$$)')} SELECT 'score' AS \"分数字段\", {r('auc', '原始AUC')}, auc < 0.5 AS \"AUC反向\", 'train' AS \"判断依据\" FROM m")
def score_direction(spark, sf_dir):
    return tables.score_direction(orders(spark, sf_dir), "y", ["score"], "tag").select("分数字段", "原始AUC", "AUC反向", "判断依据")


# ---- screening

_PAIRS = [(a, b) for i, a in enumerate(["qn", *NUMBERS[1:]]) for b in ["qn", *NUMBERS[1:]][i + 1 :]]


@query(f"WITH {L} " + _union([f"SELECT '{a}' AS var1, '{b}' AS var2, {r(f'corr({a}, {b})', 'correlation')} FROM d" for a, b in _PAIRS]))
def corr_pearson(spark, sf_dir):
    return correlation.correlations(lines(spark, sf_dir), ["qn", *NUMBERS[1:]])


@query(f"WITH {O}, x AS (SELECT * FROM d), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs FROM x WHERE score IS NOT NULL), c AS (SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS rc FROM x) SELECT 'score' AS var1, 'o_custkey' AS var2, {r('corr(rs, rc)', 'correlation')} FROM k JOIN c USING (o_orderkey)")
def corr_spearman(spark, sf_dir):
    return correlation.correlations(orders(spark, sf_dir), ["score", "o_custkey"], "spearman")


@query(
    f"WITH {L}, p AS ("
    + _union([f"SELECT {i} AS i, '{a}' AS var1, '{b}' AS var2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM d WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, (a, b) in enumerate([("qn", "l_discount"), ("qn", "l_tax"), ("l_discount", "l_tax")])])
    + "), c AS (SELECT i, var1, var2, x, y, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL)"
    + f" SELECT a.var1, a.var2, {r('sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.n * b.n * abs(sign(a.x - b.x))) * sum(a.n * b.n * abs(sign(a.y - b.y))))', 'correlation')} FROM c a JOIN c b USING (i) GROUP BY 1, 2"
)
def corr_kendall(spark, sf_dir):
    return correlation.correlations(lines(spark, sf_dir), ["qn", "l_discount", "l_tax"], "kendall")


@query(f"WITH {L}, p AS ({_union([f'''SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS c FROM d''' for a, b in [('l_extendedprice', 'net'), ('l_extendedprice', 'principal'), ('net', 'principal')]])}) SELECT var1, var2, {r('c', 'correlation')} FROM p WHERE abs(c) >= 0.6")
def high_corr_pairs(spark, sf_dir):
    return correlation.high_pairs(lines(spark, sf_dir), ["l_extendedprice", "net", "principal"], 0.6)


def _eda(c: str, kind: str) -> str:
    m = f"(SELECT avg({c}) FROM d)"
    return (
        f"SELECT '{c}' AS feature, '{kind}' AS dtype, CAST(count({c}) AS BIGINT) AS count, {r(f'avg(power({c} - {m}, 4)) / power(avg(power({c} - {m}, 2)), 2) - 3', 'kurtosis', 4)}, {r(f'max({c})', 'max', 4)}, {r(f'avg({c})', 'mean', 4)}, {r(f'median({c})', 'median', 4)}, {r(f'min({c})', 'min', 4)}, {r(f'1 - count({c}) / CAST(count(*) AS DOUBLE)', 'missing_rate', 4)},"
        f" {r(f'quantile_cont({c}, 0.25)', 'q1', 4)}, {r(f'quantile_cont({c}, 0.75)', 'q3', 4)}, {r(f'avg(power({c} - {m}, 3)) / power(avg(power({c} - {m}, 2)), 1.5)', 'skewness', 4)}, {r(f'stddev_samp({c})', 'std', 4)}, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM d"
    )


@query(f"WITH {L} {_eda('qn', 'double')} UNION ALL {_eda('l_discount', 'double')}", digits=4)
def eda_summary(spark, sf_dir):
    return selection.eda_summary(lines(spark, sf_dir), ["qn", "l_discount"], ["missing_rate", "min", "max", "mean", "median", "std", "skewness", "kurtosis", "q1", "q3", "unique_count"])


@query(f"WITH {L} SELECT 'qn' AS feature, {r('avg(CASE WHEN qn IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM d UNION ALL SELECT 'l_tax', 0.0 FROM (SELECT 1)")
def missing_rate(spark, sf_dir):
    return selection.eda_summary(lines(spark, sf_dir), ["qn", "l_tax"], ["missing_rate"]).select("feature", "missing_rate")


@query(f"WITH {L} SELECT 'l_extendedprice' AS feature, {r('1 / (1 - power(corr(l_extendedprice, principal), 2))', 'vif')} FROM d UNION ALL SELECT 'principal', round(1 / (1 - power(corr(l_extendedprice, principal), 2)), 6) FROM d")
def vif_two_features(spark, sf_dir):
    return spark.createDataFrame(correlation.vif(lines(spark, sf_dir), ["l_extendedprice", "principal"]), "feature string, vif double")


@query(f"WITH {L} " + _union([f"SELECT * FROM (WITH {_psi_sql('''tag = 'train' ''', '''tag = 'oot' ''', c)} SELECT '{c}' AS feature, {r('psi', 'psi')}, CASE WHEN psi > 0.0001 THEN 'removed' ELSE 'selected' END AS status FROM res)" for c in ("l_extendedprice", "l_discount", "l_tax")]))
def postfilter_psi(spark, sf_dir):
    df = lines(spark, sf_dir)
    p = selection.PostFilter(psi_threshold=0.0001, vif_threshold=1e9).fit(df.where("tag = 'train'"), df.where("tag = 'oot'"), ["l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame([(c, p.psi_[c], "removed" if c in p.removed_ else "selected") for c in p.psi_], "feature string, psi double, status string")


@query(SQL["iv_batch"].replace(f"SELECT feature, {r('sum(ivc)', 'iv')} FROM z GROUP BY 1", f"SELECT feature, {r('sum(ivc)', 'iv')}, CASE WHEN sum(ivc) < 0.0003 THEN 'removed' ELSE 'selected' END AS status FROM z GROUP BY 1"))
def feature_filter(spark, sf_dir):
    s = selection.FeatureSelector(iv_threshold=0.0003, corr_threshold=0.99).fit(lines(spark, sf_dir).select(*NUMBERS, "l_linestatus", "y"), "y")
    return spark.createDataFrame([(x["feature"], x["iv"], x["status"]) for x in s.report()], "feature string, iv double, status string")


@query(f"WITH {O}, {_metrics_cte()} SELECT 'score' AS feature, {r('ks', 'ks')}, {r('l10', 'lift_10')} FROM m")
def supervised_summary(spark, sf_dir):
    return selection.supervised_summary(orders(spark, sf_dir).where("y >= 0"), ["score"], "y").select("feature", "ks", "lift_10")


# ---- models and scorecards

CARD = {"splits": {"l_quantity": [10.0, 25.0, 40.0], "l_discount": [0.025, 0.065]}, "woe": {"l_quantity": [0.05, 0.31, 0.12, -0.07, -0.33], "l_discount": [0.0, 0.21, -0.04, -0.18]}}


def _card(decimals: int | None = None) -> Scorecard:
    return Scorecard(intercept=-0.7, splits=CARD["splits"], woe=CARD["woe"], coefficients={"l_quantity": -0.9, "l_discount": -1.1}, points_decimals=decimals)


def _points(f: str, b: float, value: str) -> str:
    w, s = CARD["woe"][f], CARD["splits"][f]
    cases = " ".join(f"WHEN {value} <= {x} THEN {-v * b} * 20 / ln(2)" for x, v in zip(s, w[1:], strict=False))
    return f"CASE WHEN {value} IS NULL THEN {-w[0] * b} * 20 / ln(2) {cases} ELSE {-w[-1] * b} * 20 / ln(2) END"


_SCORE = f"600 + 0.7 * 20 / ln(2) + {_points('l_quantity', -0.9, 'l_quantity')} + {_points('l_discount', -1.1, 'l_discount')}"


@query(f"WITH s AS (SELECT {_SCORE} AS score FROM lineitem) SELECT {r('score', 'score', 4)}, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1", digits=4)
def scorecard_score(spark, sf_dir):
    return _card().score(lines(spark, sf_dir)).groupBy(F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))


SQL["scorecard_sql"] = f"WITH s AS ({_card().to_sql('lineitem')}) SELECT {r('score', 'score', 4)}, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1"


@query(SQL["scorecard_sql"], digits=4)
def scorecard_sql(spark, sf_dir):
    """The generated text runs on both engines."""
    view = f"__card_{abs(hash(sf_dir))}"
    lines(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(_card().to_sql(view)).groupBy(F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))


@query("WITH f(feature, b, i, w) AS (VALUES " + ", ".join(f"('{f}', {b}, {i}, {w})" for f, b in (("l_quantity", -0.9), ("l_discount", -1.1)) for i, w in enumerate(CARD["woe"][f])) + f") SELECT feature, CAST(i AS BIGINT) AS place, {r('w', 'woe')}, {r('-w * b * 20 / ln(2)', 'points')} FROM f")
def scorecard_points(spark, sf_dir):
    card = _card()
    rows = [(f, i, w, p) for f in card.coefficients for i, (w, p) in enumerate(zip(card.woe[f], card.points(f), strict=True))]
    return spark.createDataFrame(rows, "feature string, place int, woe double, points double")


_ROUND = "round_even(600 + 0.7 * 20 / ln(2), 0) + CASE WHEN l_quantity <= 10 THEN round_even({0} * 20 / ln(2), 0) WHEN l_quantity <= 25 THEN round_even({1} * 20 / ln(2), 0) WHEN l_quantity <= 40 THEN round_even({2} * 20 / ln(2), 0) ELSE round_even({3} * 20 / ln(2), 0) END + CASE WHEN l_discount <= 0.025 THEN round_even({4} * 20 / ln(2), 0) WHEN l_discount <= 0.065 THEN round_even({5} * 20 / ln(2), 0) ELSE round_even({6} * 20 / ln(2), 0) END".format(*[0.9 * w for w in CARD["woe"]["l_quantity"][1:]], *[1.1 * w for w in CARD["woe"]["l_discount"][1:]])


@query(f"WITH s AS (SELECT {_ROUND} AS score FROM lineitem) SELECT {r('score', 'score')}, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1")
def score_rounding(spark, sf_dir):
    return _card(0).score(lines(spark, sf_dir)).groupBy("score").agg(F.count("*").alias("n"))


@query(f"WITH d AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y, CASE WHEN c_acctbal > 4500 THEN 1.0 ELSE 0.0 END AS x FROM customer), t AS (SELECT count(*) FILTER (y = 1 AND x = 0) AS b0, count(*) FILTER (y = 0 AND x = 0) AS g0, count(*) FILTER (y = 1 AND x = 1) AS b1, count(*) FILTER (y = 0 AND x = 1) AS g1 FROM d) SELECT 'const' AS feature, {r('ln(b0 / CAST(g0 AS DOUBLE))', 'coefficient')}, {r('sqrt(1.0 / b0 + 1.0 / g0)', 'std_error')} FROM t UNION ALL SELECT 'x', round(ln((b1 / CAST(g1 AS DOUBLE)) / (b0 / CAST(g0 AS DOUBLE))), 6), round(sqrt(1.0 / b0 + 1.0 / g0 + 1.0 / b1 + 1.0 / g1), 6) FROM t")
def logistic_closed_form(spark, sf_dir):
    """One binary input, where the estimates have a closed form."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), (F.col("c_acctbal") > 4500).cast("double").alias("x"))
    m = LogisticModel().fit(df, ["x"], "y")
    return spark.createDataFrame([(t["feature"], t["coefficient"], t["std_error"]) for t in m.table_], "feature string, coefficient double, std_error double")


@query()
def logistic_model(spark, sf_dir):
    m = LogisticModel().fit(lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "y")
    return spark.createDataFrame([(t["feature"], t["coefficient"], t["std_error"], t["z_value"], t["p_value"]) for t in m.table_], "feature string, coefficient double, std_error double, z_value double, p_value double")


@query()
def stepwise(spark, sf_dir):
    s = selection.StepwiseSelector("both", "aic").fit(orders(spark, sf_dir).withColumn("k", F.col("o_orderkey") % 7), ["o_totalprice", "o_custkey", "k"], "y")
    return spark.createDataFrame([(h["iteration"], h["action"], h["feature"], h["value"]) for h in s.history_], "iteration int, action string, feature string, value double")


@query()
def pipeline_scorecard(spark, sf_dir):
    from .plans import ScorecardPipeline

    df = lines(spark, sf_dir).withColumn("y", (F.col("l_quantity") * 3 + F.col("l_discount") * 300 + F.pmod(F.hash("l_orderkey"), F.lit(100)) > 120).cast("int"))
    p = ScorecardPipeline(df.where("tag = 'train'"), "y", df.where("tag = 'test'"), NUMBERS).prefilter().bin(method="quantile").woe_transform().postfilter().build_model().generate_scorecard()
    return p.score(df).groupBy("tag").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


# ---- keys of reports


@query("SELECT CASE WHEN i % 5 = 0 THEN '202401' WHEN i % 5 = 1 THEN '202402' WHEN i % 5 = 2 THEN '202403' WHEN i % 5 = 3 THEN '' ELSE 'n/a' END AS month, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey AS i FROM orders) GROUP BY 1")
def month_normalize(spark, sf_dir):
    i = F.col("o_orderkey")
    raw = F.when(i % 5 == 0, "2024-01-15").when(i % 5 == 1, "2024/02/03 10:00").when(i % 5 == 2, "20240309").when(i % 5 == 3, F.lit(None)).otherwise("n/a")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(raw.alias("m"))
    return df.groupBy(C.month_text(df, "m").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN i % 3 = 0 THEN 'None' WHEN i % 3 = 1 THEN 'None' ELSE 'train' END AS tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey AS i FROM orders) GROUP BY 1")
def tag_normalize(spark, sf_dir):
    i = F.col("o_orderkey")
    raw = F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, "  ").otherwise(" train ")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(C.tag_text(raw).alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT 'l_extendedprice' AS feature, " + ", ".join(f'round(quantile_cont(l_extendedprice, {p}), 6) AS "p{i}"' for i, p in enumerate((0.0, 0.01, 0.5, 0.99, 1.0))) + " FROM lineitem")
def exact_quantiles(spark, sf_dir):
    rows = quantile_rows(long_form(lines(spark, sf_dir), ["l_extendedprice"]), [0.0, 0.01, 0.5, 0.99, 1.0])
    return rows.groupBy("feature").pivot("place", list(range(5))).agg(F.first("value")).select("feature", *[F.col(str(i)).alias(f"p{i}") for i in range(5)])


__all__ = ["QUERIES", "SQL", "lines", "orders", "woe_table"]


from . import queries_models, queries_report  # noqa: E402, F401  they register their queries here
