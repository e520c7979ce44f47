"""Queries of the report's feature tables, of importance, dictionaries and the interactive entry points, with SQL in its own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import interactive
from .functions.columns import date_range as range_of
from .operators import features, woe
from .operators.binning import BaseBinner
from .operators.importance import ModelView
from .operators.logistic import LogisticModel
from .operators.scorecard import Scorecard
from .plans import ScorecardPipeline
from .queries import _CORE_SQL, L, O, _code, _edges, _metrics_cte, _psi_sql, _splits_frame, _union, _woe_cte, lines, orders, query, r

FEATURES = ["qn", "l_discount", "l_extendedprice"]
RULES = {"l_discount": [0.025, 0.055]}
_TRAIN, _OOT = "tag = 'train'", "tag = 'oot'"


def _cuts(c: str) -> str:
    return f"{RULES[c]}" if c in RULES else _edges(c, "d", _TRAIN)


def _bins_sql(c: str, where: str) -> str:
    """Rows of a feature's bins of a set: counts, shares, woe, iv and ks."""
    eps = "1e-8"
    return (
        f"(SELECT *, abs(sum(bads) OVER w / tb - sum(goods) OVER w / tg) AS ks, (gp - bp) * ln(greatest(gp, {eps}) / greatest(bp, {eps})) AS iv, ln(greatest(gp, {eps}) / greatest(bp, {eps})) AS woe FROM"
        f" (SELECT *, bads / tb AS bp, goods / tg AS gp FROM (SELECT *, CAST(sum(bads) OVER () AS DOUBLE) AS tb, CAST(sum(goods) OVER () AS DOUBLE) AS tg, sum(total) OVER () AS tn FROM"
        f" (SELECT CASE WHEN {c} IS NULL THEN -1 ELSE {_code(c, 'e')} END AS bin_idx, count(*) FILTER (y = 0) AS goods, count(*) FILTER (y = 1) AS bads, count(*) AS total FROM (SELECT *, {_cuts(c)} AS e FROM d) WHERE {where} GROUP BY 1)))"
        " WINDOW w AS (ORDER BY bin_idx < 0, bin_idx))"
    )


@query(
    f"WITH {L} "
    + _union([f"SELECT '{c}' AS feature, CAST(bin_idx AS BIGINT) AS bin_idx, CAST(goods AS BIGINT) AS goods, CAST(bads AS BIGINT) AS bads, {r('total / tn', 'total_prop')}, {r('bads / total', 'bad_rate')}, {r('woe', 'woe')}, {r('iv', 'iv')}, {r('ks', 'ks')}, {r('(bads / total) / (tb / tn)', 'lift')} FROM {_bins_sql(c, _OOT)}" for c in FEATURES])
)
def feature_bins_all(spark, sf_dir):
    """Bins of all features of one set in one pass, over another set's edges."""
    df = lines(spark, sf_dir)
    edges = features.feature_edges(df.where(_TRAIN), FEATURES, RULES)
    return features.feature_bins(df.where(_OOT), edges, "y").select("feature", "bin_idx", "goods", "bads", "total_prop", "bad_rate", "woe", "iv", "ks", "lift")


_CARD = Scorecard(intercept=0.1, splits={"qn": [10.0], "l_discount": [0.025, 0.055]}, woe={"qn": [0.0, 0.3, -0.1], "l_discount": [0.0, 0.2, 0.1, -0.4]}, coefficients={"qn": -0.4, "l_discount": -1.2})
_GAINS = {"qn": 0.4, "l_discount": 1.2}


def _psi_of(c: str) -> str:
    how = f"edges='{RULES[c]}', buckets={len(RULES[c]) + 1}, closed='right'" if c in RULES else ""
    args = {"edges": f"{RULES[c]}", "buckets": len(RULES[c]) + 1, "closed": "right"} if how else {}
    return f"(SELECT psi FROM (WITH {_psi_sql(_TRAIN, _OOT, c, **args)} SELECT psi FROM res))"


def _batch_iv_sql(c: str, where: str) -> str:
    """IV over order statistics, missing values a bin."""
    edges = f"(SELECT list_sort(list_distinct(list(x)))[2:-2] FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM d WHERE {where} AND {c} IS NOT NULL) WHERE i IN (SELECT CAST(round_even((n - 1) * j / 10.0, 0) AS BIGINT) FROM range(0, 11) t(j)))"
    counts = f"c AS (SELECT '{c}' AS feature, CASE WHEN {c} IS NULL THEN -1 ELSE {_code(c, 'e', 'left')} END AS bin, count(*) AS total, sum(y) AS bad FROM (SELECT *, {edges} AS e FROM d) WHERE {where} GROUP BY 1, 2)"
    return f"(SELECT sum(ivc) FROM (WITH {_woe_cte(counts)} SELECT ivc FROM z))"


@query(
    f"WITH {L}, k AS ("
    + _union([
        f"SELECT {i} AS i, '{c}' AS vars, {_GAINS.get(c, 'NULL')} AS gain, (SELECT avg(CAST({c} IS NULL AS INTEGER)) FROM d WHERE {_TRAIN}) AS mt, (SELECT avg(CAST({c} IS NULL AS INTEGER)) FROM d WHERE {_OOT}) AS mo,"
        f" {f'(SELECT sum(iv) FROM {_bins_sql(c, _TRAIN)})' if c in RULES else _batch_iv_sql(c, _TRAIN)} AS it, {f'(SELECT sum(iv) FROM {_bins_sql(c, _OOT)})' if c in RULES else _batch_iv_sql(c, _OOT)} AS io,"
        f" (SELECT max(ks) FROM {_bins_sql(c, _TRAIN)}) AS kt, (SELECT max(ks) FROM {_bins_sql(c, _OOT)}) AS ko, {_psi_of(c)} AS psi"
        for i, c in enumerate(FEATURES)
    ])
    + f") SELECT CAST(row_number() OVER (ORDER BY gain DESC NULLS LAST, i) AS BIGINT) AS \"序号\", vars, {r('mt', '缺失率_train')}, {r('mo', '缺失率_oot')}, {r('it', 'iv_train')}, {r('io', 'iv_oot')}, {r('kt', 'ks_train')}, {r('ko', 'ks_oot')}, {r('gain', 'gain')}, {r('gain / 1.6', 'gain_per')}, {r('psi', 'psi')}, {r('CASE vars WHEN \'qn\' THEN -0.4 WHEN \'l_discount\' THEN -1.2 END', 'coefficient')} FROM k"
)
def variable_table(spark, sf_dir):
    """Missing shares, iv, ks, importance, stability and the logistic summary of each feature, numbered by importance; one feature has a rule."""
    df, view = lines(spark, sf_dir), ModelView(_CARD)
    out = features.variable_table(df.where(_TRAIN), df.where(_OOT), FEATURES, "y", RULES, view.importance(), None, view.summary())
    return out.select("序号", "vars", "缺失率_train", "缺失率_oot", "iv_train", "iv_oot", "ks_train", "ks_oot", "gain", "gain_per", "psi", "coefficient")


def _monthly_sql(c: str) -> str:
    source = (
        f"t AS (SELECT bin_idx, bads / total AS rate FROM {_bins_sql(c, _TRAIN)}), scored AS (SELECT b.* EXCLUDE (e), CAST(year(b.l_shipdate) AS VARCHAR) AS yr, coalesce(t.rate, CASE WHEN b.code < 0 THEN 1.0 ELSE 0.0 END) AS score"
        f" FROM (SELECT *, CASE WHEN {c} IS NULL THEN -1 ELSE {_code(c, 'e')} END AS code FROM (SELECT *, {_cuts(c)} AS e FROM d)) b LEFT JOIN t ON t.bin_idx = b.code)"
    )
    args = {"edges": f"{RULES[c]}", "buckets": len(RULES[c]) + 1, "closed": "right"} if c in RULES else {}
    psi_cte = _psi_sql(_TRAIN, "true", c, keys="yr", **args).replace("FROM d", "FROM scored")
    return f"SELECT * FROM (WITH {source}, {_metrics_cte('yr', 'scored')}, {psi_cte} SELECT '{c}' AS feature, k AS month, {_CORE_SQL}, {r('psi', 'PSI')} FROM tot JOIN m USING (k) JOIN res USING (k))"


@query(f"WITH {L} " + _union([_monthly_sql(c) for c in ("qn", "l_discount")]))
def feature_monthly(spark, sf_dir):
    """A feature's bins, valued by their bad rate in train, as a score of each year, and its stability."""
    df = lines(spark, sf_dir).withColumn("yr", F.year("l_shipdate").cast("string"))
    return features.monthly_metrics(df, df.where(_TRAIN), ["qn", "l_discount"], "y", "yr", RULES)


@query("SELECT * FROM (VALUES ('l_discount', round(1.2, 6), round(1.2 / 1.6, 6)), ('qn', round(0.4, 6), round(0.4 / 1.6, 6))) t(feature, gain, gain_per)".replace("round(", "round(1.0::DOUBLE * "))
def importance_scorecard(spark, sf_dir):
    return spark.createDataFrame([(x["feature"], x["gain"], x["gain_per"]) for x in ModelView(_CARD).importance()], "feature string, gain double, gain_per double")


@query(
    "WITH d AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y, CASE WHEN c_acctbal > 4500 THEN 1.0 ELSE 0.0 END AS x FROM customer), t AS (SELECT CAST(count(*) FILTER (y = 1 AND x = 0) AS DOUBLE) AS b0, count(*) FILTER (y = 0 AND x = 0) AS g0, count(*) FILTER (y = 1 AND x = 1) AS b1, count(*) FILTER (y = 0 AND x = 1) AS g1 FROM d), e AS (SELECT ln((b1 / g1) / (b0 / g0)) AS b, sqrt(1 / b0 + 1 / g0 + 1 / b1 + 1 / g1) AS s, b0, b1, g0, g1, b0 * ln(b0 / (b0 + g0)) + g0 * ln(g0 / (b0 + g0)) + b1 * ln(b1 / (b1 + g1)) + g1 * ln(g1 / (b1 + g1)) AS ll FROM t)"
    f" SELECT 'x' AS feature, {r('b', 'coefficient')}, {r('s', 'std_error')}, {r('b - 1.959963984540054 * s', 'ci_lower')}, {r('exp(b)', 'odds_ratio')}, {r('4 - 2 * ll', 'aic', 4)} FROM e UNION ALL SELECT 'z', NULL, NULL, NULL, NULL, {r('4 - 2 * ll', 'aic', 4)} FROM e"
)
def logistic_summary(spark, sf_dir):
    """A scorecard's features beside the statistics of the model behind it; a feature without any has none."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), (F.col("c_acctbal") > 4500).cast("double").alias("x"))
    view = ModelView(Scorecard(splits={"x": [0.5], "z": []}, woe={"x": [0, 1, 1], "z": [0, 1]}, coefficients={"x": 1.0, "z": 1.0}), LogisticModel().fit(df, ["x"], "y"))
    aic = dict(view.model_summary())["AIC"]
    rows = [(s["feature"], s["coefficient"], s["std_error"], s["ci_lower"], s["odds_ratio"], round(aic, 4)) for s in view.summary()]
    return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, ci_lower double, odds_ratio double, aic double")


@query(f"WITH {O} SELECT tag, strftime(min(o_orderdate), '%Y%m%d') || '-' || strftime(max(o_orderdate), '%Y%m%d') AS days FROM d GROUP BY 1")
def date_range(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("tag").agg(range_of(F.col("o_orderdate")).alias("days"))


@query("SELECT CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'a' ELSE 'b' END AS \"变量类型\", CAST(count(*) AS BIGINT) AS \"变量数量\", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS \"重要性占比\" FROM (SELECT DISTINCT p_size FROM part) GROUP BY 1")
def type_distribution(spark, sf_dir):
    """Features by source, from a dictionary that names some twice and lacks others."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("string").alias("英文名"), F.when(F.col("p_size") % 3 == 1, "a").when(F.col("p_size") % 3 == 2, "b").alias("来源"))
    sizes = [x[0] for x in names.select("英文名").distinct().collect()]
    return features.type_distribution(spark, sizes, names.where("`来源` is not null"))


_STATUS = f"{L}, b AS (SELECT *, CAST((CASE l_linestatus WHEN 'O' THEN 30 ELSE 0 END + l_orderkey % 100 > 60) AS INTEGER) AS bad FROM d)"


@query(f"WITH {_STATUS}, t AS (SELECT l_linestatus AS s, sum(bad) AS b, sum(1 - bad) AS g FROM b WHERE tag = 'train' GROUP BY 1), p AS (SELECT s, b / CAST(b + g AS DOUBLE) AS p FROM t) SELECT tag, {r('avg(p.p)', 'mean_probability')}, CAST(count(*) AS BIGINT) AS n FROM b JOIN p ON p.s = b.l_linestatus GROUP BY 1")
def pipeline_text_feature(spark, sf_dir):
    """A text feature goes by the weights of evidence of its values; alone in a model it gives the bad rate of each value."""
    df = lines(spark, sf_dir).withColumn("y", F.expr("CAST((CASE l_linestatus WHEN 'O' THEN 30 ELSE 0 END + l_orderkey % 100 > 60) AS INTEGER)"))
    p = ScorecardPipeline(df.where(_TRAIN), "y", None, ["l_linestatus"]).bin().woe_transform().build_model()
    return p.predict_proba(df).groupBy("tag").agg(F.avg("probability").alias("mean_probability"), F.count("*").alias("n"))


@query(f"WITH {O}, {_metrics_cte('tag', s='-score')}, g AS (SELECT tag AS k, strftime(min(o_orderdate), '%Y%m%d') || '-' || strftime(max(o_orderdate), '%Y%m%d') AS days FROM d GROUP BY 1) SELECT 'm' AS \"模型\", k AS \"样本集\", days AS \"观察点月\", {_CORE_SQL} FROM tot JOIN m USING (k) JOIN g USING (k)")
def interactive_split(spark, sf_dir):
    """Of a score that is high for safe rows: AUC turned round, lift from the low end, and each set's dates."""
    by_tag, _ = interactive.calculate_split_metrics(orders(spark, sf_dir), "tag", "o_orderdate", ["y"], "score", "m", "score")
    return by_tag.select("模型", "样本集", "观察点月", "总", "好", "坏", "坏占比", "KS", "AUC", "10%lift", "5%lift", "2%lift", "1%lift")


class MedianBinner(BaseBinner):
    """Two bins at the value that holds the middle row."""

    @staticmethod
    def splits_of(x, n, bad, n_bins):
        at = int((n.cumsum() * 2 >= n.sum()).argmax())
        return [float(x[at])]


@query("SELECT feature, CAST(0 AS BIGINT) AS place, round(CAST(x AS DOUBLE), 6) AS split FROM (" + _union([f"SELECT '{c}' AS feature, quantile_disc({c}, 0.5) AS x FROM lineitem" for c in ("l_quantity", "l_tax")]) + ")")
def bin_own_method(spark, sf_dir):
    """A method of one's own, by subclass."""
    return _splits_frame(spark, MedianBinner().fit(lines(spark, sf_dir), ["l_quantity", "l_tax"]).splits_)


@query(f"WITH {O}, v AS (SELECT o_custkey AS k, count(*) AS n, sum(y) AS b FROM d WHERE y IN (0, 1) GROUP BY 1), t AS (SELECT *, sum(b) OVER () AS tb, sum(n - b) OVER () AS tg FROM v), w AS (SELECT k, ln((greatest(n - b, 1) / CAST(tg AS DOUBLE)) / (greatest(b, 1) / CAST(tb AS DOUBLE))) AS woe FROM t) SELECT CAST(count(*) AS BIGINT) AS n, {r('sum(coalesce(woe, 0))', 'woe_sum', 3)}, {r('min(woe)', 'low')}, {r('max(woe)', 'high')} FROM d LEFT JOIN w ON w.k = d.o_custkey")
def woe_of_many_values(spark, sf_dir):
    """A column of very many values: its weights stay a table that is joined."""
    df = orders(spark, sf_dir)
    e = woe.WOEEncoder("o_custkey").fit(df, "y")
    return e.transform(df, "woe").agg(F.count("*").alias("n"), F.round(F.sum("woe"), 3).alias("woe_sum"), F.min(F.when(F.col("woe") != 0, F.col("woe"))).alias("low"), F.max(F.when(F.col("woe") != 0, F.col("woe"))).alias("high"))
