"""Queries of binning on columns of few values and of models, with SQL that searches or iterates in its own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import binning, selection
from .operators.logistic import LogisticModel
from .plans import ScorecardPipeline
from .queries import L, _code, _splits_frame, _union, lines, query, r

FEW = ["l_quantity", "l_discount", "l_tax"]
# lists by column: values, rows and bads, and running counts from 0 on
_VALUES = ", v AS (" + _union([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS b FROM d GROUP BY ALL" for c in FEW]) + ")"
_LISTS = _VALUES + ", f AS (SELECT feature, list(x ORDER BY x) AS x, list(n ORDER BY x) AS n, list(b ORDER BY x) AS b FROM v GROUP BY 1), u AS (SELECT *, list_prepend(0.0::DOUBLE, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[:i]))) AS cn, list_prepend(0.0::DOUBLE, list_transform(range(1, len(n) + 1), lambda i: list_sum(b[:i]))) AS cb FROM f)"


def _impurity(a: str, z: str) -> str:
    n, b = f"(cn[{z}] - cn[{a}])", f"(cb[{z}] - cb[{a}])"
    return f"2 * ({b} / {n}) * (1 - {b} / {n}) * {n}"


# cut p parts values p and p + 1; a segment runs from the cut before to the next
_GAIN = f"list_transform(range(1, len(x)), lambda p: CASE WHEN NOT list_contains(cuts, p) AND cn[p + 1] - cn[lo[p]] >= least AND cn[hi[p]] - cn[p + 1] >= least THEN {_impurity('lo[p]', 'hi[p]')} - {_impurity('lo[p]', '(p + 1)')} - {_impurity('(p + 1)', 'hi[p]')} ELSE -1.0 END)"


@query(
    f"WITH RECURSIVE {L}{_LISTS}, t AS (SELECT 0 AS k, feature, x, cn, cb, ceil(0.05 * cn[-1]) AS least, [0]::BIGINT[] AS cuts FROM u UNION ALL"
    " SELECT k + 1, feature, x, cn, cb, least, list_append(cuts, list_position(g, list_max(g))) FROM (SELECT *, " + _GAIN + " AS g FROM (SELECT *,"
    " list_transform(range(1, len(x)), lambda p: coalesce(list_max(list_filter(cuts, lambda c: c < p)), 0) + 1) AS lo, list_transform(range(1, len(x)), lambda p: coalesce(list_min(list_filter(cuts, lambda c: c > p)), len(x)) + 1) AS hi FROM t)) WHERE k < 4 AND list_max(g) > 1e-12),"
    " z AS (SELECT feature, any_value(x) AS x, list_sort(arg_max(cuts, k))[2:] AS cuts FROM t GROUP BY 1)"
    f" SELECT feature, CAST(i - 1 AS BIGINT) AS place, {r('(x[cuts[i]] + x[cuts[i] + 1]) / 2', 'split')} FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS i FROM z)"
)
def bin_tree_few(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), FEW, "y", "dt", 5))


def _chi(i: str) -> str:
    """Chi-squared of bins i and i + 1 with Yates' correction."""
    j = f"({i} + 1)"
    share = {"b": f"((b[{i}] + b[{j}]) / (n[{i}] + n[{j}]))"}
    cells = []
    for k in (i, j):
        e, g = f"(n[{k}] * {share['b']})", f"(n[{k}] * (1 - {share['b']}))"
        cells += [f"pow(abs(b[{k}] - {e}) - 0.5, 2) / greatest({e}, 1e-9)", f"pow(abs(n[{k}] - b[{k}] - {g}) - 0.5, 2) / greatest({g}, 1e-9)"]
    return "(" + " + ".join(cells) + ")"


@query(
    f"WITH RECURSIVE {L}{_LISTS}, m AS (SELECT 0 AS k, feature, x, n, b FROM f UNION ALL"
    " SELECT k + 1, feature, list_concat(x[:i], x[i + 2:]), list_concat(list_append(n[:i - 1], n[i] + n[i + 1]), n[i + 2:]), list_concat(list_append(b[:i - 1], b[i] + b[i + 1]), b[i + 2:])"
    f" FROM (SELECT *, list_position(chi, list_min(chi)) AS i FROM (SELECT *, list_transform(range(1, len(n)), lambda i: {_chi('i')}) AS chi FROM m)) WHERE len(n) > 1 AND (len(n) > 5 OR list_min(chi) < 3.841458820694124)),"
    " s AS (SELECT 0 AS k, feature, arg_max(x, k) AS x, arg_max(n, k) AS n, arg_max(b, k) AS b FROM m GROUP BY 2), w AS (SELECT *, list_sum(n) AS whole FROM s UNION ALL"
    " SELECT k + 1, feature, list_concat(x[:i], x[i + 2:]), list_concat(list_append(n[:i - 1], n[i] + n[i + 1]), n[i + 2:]), list_concat(list_append(b[:i - 1], b[i] + b[i + 1]), b[i + 2:]), whole"
    f" FROM (SELECT *, list_position(chi, list_min(chi)) AS i FROM (SELECT *, list_transform(range(1, len(n)), lambda i: CASE WHEN least(n[i], n[i + 1]) < ceil(0.05 * whole) THEN {_chi('i')} END) AS chi FROM w)) WHERE len(n) > 1 AND list_min(n) < ceil(0.05 * whole)),"
    " z AS (SELECT feature, arg_max(x, k) AS x FROM w GROUP BY 1)"
    f" SELECT feature, CAST(i - 1 AS BIGINT) AS place, {r('(x[i] + x[i + 1]) / 2', 'split')} FROM (SELECT *, unnest(range(1, len(x))) AS i FROM z)"
)
def bin_chimerge_few(spark, sf_dir):
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), FEW, "y", "chi", 5))


def _spread(a: str, z: str) -> str:
    """Squared error of values a + 1 to z."""
    return f"(q[{z}] - q[{a}] - pow(s[{z}] - s[{a}], 2) / (w[{z}] - w[{a}]))"


_SUMS = ", " + ", ".join(f"list_prepend(0.0::DOUBLE, list_transform(range(1, len(n) + 1), lambda i: list_sum(list_transform(range(1, i + 1), lambda j: {e})))) AS {name}" for name, e in (("w", "n[j]"), ("s", "n[j] * x[j]"), ("q", "n[j] * x[j] * x[j]")))


@query(
    f"WITH {L}{_LISTS}, a AS (SELECT feature, x{_SUMS} FROM f), c AS (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM a), e AS (SELECT *, unnest(range(i + 1, len(x) + 1)) AS j FROM c),"
    f" g AS (SELECT feature, i, j, s, w, {_spread('1', 'i')} + {_spread('i', 'j')} + {_spread('j', 'len(w)')} AS cost FROM e), z AS (SELECT feature, arg_min(i, cost) AS i, arg_min(j, cost) AS j, any_value(s) AS s, any_value(w) AS w FROM g GROUP BY 1),"
    " t AS (SELECT feature, s[i] / w[i] AS one, (s[j] - s[i]) / (w[j] - w[i]) AS two, (s[-1] - s[j]) / (w[-1] - w[j]) AS three FROM z)"
    f" SELECT feature, CAST(0 AS BIGINT) AS place, {r('(one + two) / 2', 'split')} FROM t UNION ALL SELECT feature, CAST(1 AS BIGINT), {r('(two + three) / 2', 'split')} FROM t"
)
def bin_kmeans_few(spark, sf_dir):
    """Three intervals of the least squared error, which SQL finds among all pairs of cuts."""
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), FEW, method="kmean", n_bins=3))


def _rate(a: str, z: str) -> str:
    return f"((cb[{z}] - cb[{a}]) / (cn[{z}] - cn[{a}]))"


def _worth(a: str, z: str) -> str:
    b, g = f"(greatest(cb[{z}] - cb[{a}], 0.5) / cb[-1])", f"(greatest(cn[{z}] - cn[{a}] - cb[{z}] + cb[{a}], 0.5) / (cn[-1] - cb[-1]))"
    return f"(({g} - {b}) * ln({g} / {b}))"


def _large(a: str, z: str) -> str:
    return f"cn[{z}] - cn[{a}] >= ceil(0.05 * cn[-1])"


_END = "len(cn)"
_THREE = [("1", "i"), ("i", "j"), ("j", _END)]


@query(
    f"WITH {L}{_LISTS}, k AS (SELECT feature, x, cn, cb FROM u WHERE feature <> 'l_quantity'), c AS (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM k), e AS (SELECT *, unnest(range(i + 1, len(x) + 1)) AS j FROM c), o AS ("
    f"SELECT feature, x, []::BIGINT[] AS cuts, {_worth('1', _END)} AS iv FROM k UNION ALL"
    f" SELECT feature, x, [i], {_worth('1', 'i')} + {_worth('i', _END)} FROM c WHERE {_large('1', 'i')} AND {_large('i', _END)} AND {_rate('1', 'i')} <> {_rate('i', _END)} UNION ALL"
    f" SELECT feature, x, [i, j], {' + '.join(_worth(*p) for p in _THREE)} FROM e WHERE {' AND '.join(_large(*p) for p in _THREE)} AND (({_rate(*_THREE[0])} < {_rate(*_THREE[1])} AND {_rate(*_THREE[1])} < {_rate(*_THREE[2])}) OR ({_rate(*_THREE[0])} > {_rate(*_THREE[1])} AND {_rate(*_THREE[1])} > {_rate(*_THREE[2])}))),"
    " z AS (SELECT feature, any_value(x) AS x, arg_max(cuts, iv) AS cuts FROM o GROUP BY 1)"
    f" SELECT feature, CAST(p - 1 AS BIGINT) AS place, {r('(x[cuts[p] - 1] + x[cuts[p]]) / 2', 'split')} FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS p FROM z)"
)
def bin_optimal_few(spark, sf_dir):
    """At most three bins of monotone bad rates with the largest information value, which SQL finds among all cuts."""
    return _splits_frame(spark, binning.fit_splits(lines(spark, sf_dir), ["l_discount", "l_tax"], "y", "opt", 3, monotonic="auto_asc_desc"))


# ---- logistic regression: Newton's steps in recursive SQL, over counts of the distinct inputs


def _newton(inputs: str, k: int, name: str) -> str:
    """CTE `name` (m, beta, info, ll, n) after 30 steps for each model m. inputs: a CTE (m, e), e a list of (x: k inputs after 1, n, b)."""
    size = range(1, k + 1)
    p = "(1 / (1 + exp(-(" + " + ".join(f"beta[{i}] * e.x[{i}]" for i in size) + "))))"
    slope = "[" + ", ".join(f"list_sum(list_transform(v, lambda e: (e.b - e.n * {p}) * e.x[{i}]))" for i in size) + "]"
    info = "[" + ", ".join("[" + ", ".join(f"list_sum(list_transform(v, lambda e: e.n * {p} * (1 - {p}) * e.x[{i}] * e.x[{j}]))" for j in size) + "]" for i in size) + "]"
    step = "[" + ", ".join(f"beta[{i}] + " + " + ".join(f"inv[{i}][{j}] * slope[{j}]" for j in size) for i in size) + "]"
    ll = f"list_sum(list_transform(v, lambda e: e.b * ln({p}) + (e.n - e.b) * ln(1 - {p})))"
    return (
        f"{name}_i AS (SELECT 0 AS k, m, v, [{', '.join(['0.0::DOUBLE'] * k)}] AS beta FROM (SELECT m, list(e) AS v FROM {inputs} GROUP BY 1) UNION ALL"
        f" SELECT k + 1, m, v, {step} FROM (SELECT *, {_inverse(k)} AS inv FROM (SELECT *, {slope} AS slope, {info} AS h FROM {name}_i)) WHERE k < 30),"
        f" {name} AS (SELECT m, beta, {_inverse(k)} AS inv, ll FROM (SELECT m, beta, {info} AS h, {ll} AS ll FROM {name}_i WHERE k = 30))"
    )


def _inverse(k: int) -> str:
    """Of the matrix h, by cofactors."""
    if k == 2:
        det = "(h[1][1] * h[2][2] - h[1][2] * h[2][1])"
        return f"[[h[2][2] / {det}, -h[1][2] / {det}], [-h[2][1] / {det}, h[1][1] / {det}]]"

    def minor(i: int, j: int) -> str:
        a, b = (x for x in (1, 2, 3) if x != i)
        c, d = (x for x in (1, 2, 3) if x != j)
        return f"(h[{a}][{c}] * h[{b}][{d}] - h[{a}][{d}] * h[{b}][{c}])"

    det = "(" + " + ".join(f"{'' if j % 2 else '-'}h[1][{j}] * {minor(1, j)}" for j in (1, 2, 3)) + ")"
    return "[" + ", ".join("[" + ", ".join(f"{'' if (i + j) % 2 == 0 else '-'}{minor(j, i)} / {det}" for j in (1, 2, 3)) + "]" for i in (1, 2, 3)) + "]"


_PAIR = "{}, g AS (SELECT 'both' AS m, struct_pack(x := [1.0::DOUBLE, CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE)], n := CAST(count(*) AS DOUBLE), b := CAST(sum(y) AS DOUBLE)) AS e FROM d GROUP BY l_quantity, l_discount)".format(L)


@query(
    f"WITH RECURSIVE {_PAIR}, {_newton('g', 3, 'w')}"
    + _union([f" SELECT '{name}' AS feature, {r(f'beta[{i}]', 'coefficient')}, {r(f'sqrt(inv[{i}][{i}])', 'std_error')}, {r(f'beta[{i}] / sqrt(inv[{i}][{i}])', 'z_value', 4)}, {r('6 - 2 * ll', 'aic', 2)} FROM w" for i, name in enumerate(("const", "l_quantity", "l_discount"), 1)])
)
def logistic_newton(spark, sf_dir):
    """Two inputs of few values."""
    m = LogisticModel().fit(lines(spark, sf_dir), ["l_quantity", "l_discount"], "y")
    rows = [(t["feature"], t["coefficient"], t["std_error"], round(t["z_value"], 4), round(m.stats_["aic"], 2)) for t in m.table_]
    return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, z_value double, aic double")


_BAD = "CAST((l_quantity + l_discount * 300 + l_orderkey % 100 > 80) AS INTEGER)"
_ONE = f"{L}, b AS (SELECT *, {_BAD} AS bad FROM d), g AS (" + _union([f"SELECT '{c}' AS m, struct_pack(x := [1.0::DOUBLE, CAST({c} AS DOUBLE)], n := CAST(count(*) AS DOUBLE), b := CAST(sum(bad) AS DOUBLE)) AS e FROM b GROUP BY {c}" for c in ("l_quantity", "l_discount")]) + ")"
_TWO = "h AS (SELECT 'both' AS m, struct_pack(x := [1.0::DOUBLE, CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE)], n := CAST(count(*) AS DOUBLE), b := CAST(sum(bad) AS DOUBLE)) AS e FROM b GROUP BY l_quantity, l_discount)"


@query(
    f"WITH RECURSIVE {_ONE}, {_newton('g', 2, 'w')}, {_TWO}, {_newton('h', 3, 'z')}, o AS (SELECT arg_min(m, 4 - 2 * ll) AS m, min(4 - 2 * ll) AS aic FROM w)"
    f" SELECT CAST(1 AS BIGINT) AS iteration, 'add' AS action, m AS feature, {r('aic', 'value', 2)} FROM o UNION ALL"
    f" SELECT CAST(2 AS BIGINT), 'add', CASE o.m WHEN 'l_quantity' THEN 'l_discount' ELSE 'l_quantity' END, {r('6 - 2 * ll', 'value', 2)} FROM o, z WHERE 6 - 2 * ll < aic"
)
def stepwise_forward(spark, sf_dir):
    """Forward selection by AIC between two inputs, each model fitted by SQL too."""
    df = lines(spark, sf_dir).withColumn("y", F.expr(_BAD))
    s = selection.StepwiseSelector("forward", "aic").fit(df, ["l_quantity", "l_discount"], "y")
    return spark.createDataFrame([(h["iteration"], h["action"], h["feature"], round(h["value"], 2)) for h in s.history_], "iteration int, action string, feature string, value double")


@query(
    f"WITH {L}, b AS (SELECT *, {_BAD} AS bad FROM d), e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))[2:-2] AS e FROM b WHERE tag = 'train'),"
    f" c AS (SELECT tag, {_code('l_quantity', 'e')} AS bin, count(*) AS n, sum(bad) AS b FROM b, e GROUP BY ALL), t AS (SELECT bin, b, n - b AS g, sum(b) OVER () AS tb, sum(n - b) OVER () AS tg FROM c WHERE tag = 'train'),"
    " p AS (SELECT bin, 600 + 20 / ln(2) * (ln((g / CAST(tg AS DOUBLE)) / (b / CAST(tb AS DOUBLE))) - ln(tb / CAST(tg AS DOUBLE))) AS points FROM t)"
    f" SELECT tag, {r('sum(points * n) / sum(n)', 'mean_score', 4)}, CAST(sum(n) AS BIGINT) AS n FROM c JOIN p USING (bin) GROUP BY 1"
)
def pipeline_one_feature(spark, sf_dir):
    """All steps on one feature: the model on its weights of evidence has the closed form ln(bad / good) - woe, from which SQL gives the scores."""
    df = lines(spark, sf_dir).withColumn("y", F.expr(_BAD))
    p = ScorecardPipeline(df.where("tag = 'train'"), "y", df.where("tag = 'test'"), ["l_quantity"]).prefilter().bin(method="quantile").woe_transform().postfilter().stepwise().build_model().generate_scorecard()
    return p.score(df).groupBy("tag").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count("*").alias("n"))
