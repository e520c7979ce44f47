"""Population stability: histograms over a reference's quantile edges and their divergence.

Edges come from the reference once; actual groups are counted in one aggregate by group and
bucket and meet the reference's ten or so counts in a join of counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_code, coded_by_feature
from ..functions.columns import EPSILON, col, month_rank, numeric
from ..functions.quantiles import long_form, quantile_rows, quantiles

STRATEGIES = ("separate", "exclude")
COUNTS = ("sample_count", "missing_count", "reference_sample_count", "reference_missing_count")


def _checked(buckets: int, strategy: str) -> None:
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    if strategy not in STRATEGIES:
        raise ValueError(f"nan_strategy must be one of {STRATEGIES}, got {strategy!r}")


def inner_edges(values: Sequence[float]) -> list[float]:
    """Inner edges from quantiles: distinct ones without the ends."""
    return sorted({v for v in values if v is not None})[1:-1]


def divergence(expected: Column, actual: Column, expected_total: Column, actual_total: Column, epsilon: float = EPSILON) -> Column:
    """One bucket's (a - e) * ln(a / e), shares not below epsilon."""
    e = F.greatest(expected / F.nullif(expected_total.cast("double"), F.lit(0.0)), F.lit(epsilon))
    a = F.greatest(actual / F.nullif(actual_total.cast("double"), F.lit(0.0)), F.lit(epsilon))
    return (a - e) * F.ln(a / e)


def _psi(counts: DataFrame, keys: Sequence[str], buckets: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(keys..., psi) from counts (keys..., bucket, e, a) with empty buckets filled up to `buckets` (bucket); null without any expected or actual rows."""
    whole = Window.partitionBy(*keys)
    grid = counts.select(*keys).distinct().crossJoin(F.broadcast(buckets))  # a dozen buckets
    named = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bucket").alias("__bucket"), "e", "a")
    on = F.col("bucket") == F.col("__bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    full = grid.join(named, on, "left").select(*keys, "bucket", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    full = full.withColumn("te", F.sum("e").over(whole)).withColumn("ta", F.sum("a").over(whole))
    part = divergence(F.col("e"), F.col("a"), F.col("te"), F.col("ta"), epsilon)
    total = F.when((F.max("te") > 0) & (F.max("ta") > 0), F.sum(part)).alias("psi")
    return full.groupBy(*keys).agg(total) if keys else full.agg(total)


def psi(expected: DataFrame, actual: DataFrame, column: str, buckets: int = 10, nan_strategy: str = "separate", actual_column: str | None = None) -> float | None:
    """PSI of one column of two DataFrames, over the expected one's quantile edges [a, b)."""
    _checked(buckets, nan_strategy)
    other = actual_column or column
    both = expected.select(F.lit(0).alias("side"), numeric(expected, column).alias("x")).unionByName(actual.select(F.lit(1).alias("side"), numeric(actual, other).alias("x")))
    return _pairs(both.withColumn("feature", F.lit("x")), ["x"], buckets, nan_strategy, quantiles(expected.select(numeric(expected, column).alias("x")), ["x"], [i / buckets for i in range(buckets + 1)])).first()["psi"]


def _pairs(long: DataFrame, features: Sequence[str], buckets: int, strategy: str, found: dict[str, list[float]]) -> DataFrame:
    """(feature, psi) of long (feature, side 0 expected or 1 actual, x)."""
    counts = coded_by_feature(long, {f: inner_edges(found.get(f, [])) for f in features}, "bucket")
    if strategy == "exclude":
        counts = counts.where("bucket >= 0")
    counts = counts.groupBy("feature", "bucket").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("a"))
    grid = long.sparkSession.range(-1 if strategy == "separate" else 0, buckets).select(F.col("id").cast("int").alias("bucket"))
    return _psi(counts, ["feature"], grid)


def psi_features(expected: DataFrame, actual: DataFrame, features: Sequence[str], buckets: int = 10, nan_strategy: str = "separate") -> DataFrame:
    """(feature, psi) of many columns: one pass for all edges, one for all counts."""
    _checked(buckets, nan_strategy)
    features = list(features)
    both = long_form(expected, features).withColumn("side", F.lit(0)).unionByName(long_form(actual, features).withColumn("side", F.lit(1)))
    return _pairs(both, features, buckets, nan_strategy, quantiles(expected, features, [i / buckets for i in range(buckets + 1)]))


def _named(data: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """data with copies of the columns under names that no table here uses, and these names."""
    names = {c: f"__key{i}" for i, c in enumerate(dict.fromkeys(columns))}
    return data.withColumns({n: col(c) for c, n in names.items()}), names


def psi_groups(reference: DataFrame, data: DataFrame, column: str, groups: Sequence[str], buckets: int = 10, nan_strategy: str = "separate") -> DataFrame:
    """(groups..., psi) of each group of data against one reference."""
    _checked(buckets, nan_strategy)
    shown, (data, names) = list(groups), _named(data, groups)
    out = _psi_groups(reference, data, column, [names[g] for g in groups], buckets, nan_strategy)
    return out.select(*[F.col(names[g]).alias(g) for g in shown], "psi")


def _psi_groups(reference: DataFrame, data: DataFrame, column: str, groups: Sequence[str], buckets: int, nan_strategy: str) -> DataFrame:
    cuts = inner_edges(quantiles(reference.select(numeric(reference, column).alias("x")), ["x"], [i / buckets for i in range(buckets + 1)])["x"])

    def counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        own = df.select(*[col(k) for k in keys], bin_code(numeric(df, column), cuts, closed="left").alias("bucket"))
        own = own if nan_strategy == "separate" else own.where("bucket >= 0")
        return own.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))

    return _against(counted(reference, []).withColumnRenamed("n", "e"), counted(data, groups).withColumnRenamed("n", "a"), [], groups)


def _against(expected: DataFrame, actual: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(keys..., by..., psi) from counts expected (keys..., bucket, e) and actual (keys..., by..., bucket, a). Buckets empty on both sides add nothing, so none are filled in."""
    groups = actual.select(*keys, *by).distinct()
    first = groups.join(expected, list(keys)) if keys else groups.crossJoin(expected)  # a dozen buckets
    rows = first.select(*keys, *by, "bucket", "e", F.lit(0).cast("long").alias("a")).unionByName(actual.select(*keys, *by, "bucket", F.lit(0).cast("long").alias("e"), "a"))
    cells = rows.groupBy(*keys, *by, "bucket").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    whole = Window.partitionBy(*keys, *by)
    cells = cells.withColumn("te", F.sum("e").over(whole)).withColumn("ta", F.sum("a").over(whole))
    part = divergence(F.col("e"), F.col("a"), F.col("te"), F.col("ta"))
    return cells.groupBy(*keys, *by).agg(F.when((F.max("te") > 0) & (F.max("ta") > 0), F.sum(part)).alias("psi"))


def psi_feature_groups(reference: DataFrame, data: DataFrame, features: Sequence[str], groups: Sequence[str] = (), rules: Mapping[str, Sequence[float]] | None = None, buckets: int = 10) -> DataFrame:
    """(feature, groups..., psi) of each feature in each group of data against one reference: over a feature's rule, (a, b], or else over the reference's quantiles, [a, b). One pass for all edges, one for all counts; missing values are a bucket."""
    _checked(buckets, "separate")
    features, rules = list(features), rules or {}
    shown, (data, names) = list(groups), _named(data, groups)
    by = [names[g] for g in shown]
    found = quantiles(reference, [f for f in features if f not in rules], [i / buckets for i in range(buckets + 1)])
    edges = {f: sorted(set(map(float, rules[f]))) if f in rules else inner_edges(found[f]) for f in features}

    def counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), bin_code(numeric(df, f), edges[f], closed="right" if f in rules else "left").alias("bucket")) for i, f in enumerate(features)])
        return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").groupBy("i", *keys, "bucket").agg(F.count("*").alias("n"))

    expected = counted(reference, []).withColumnRenamed("n", "e")
    actual = counted(data, by).withColumnRenamed("n", "a")
    out = _against(expected, actual, ["i"], by)
    return out.select(F.get(F.array(*[F.lit(f) for f in features]), F.col("i")).alias("feature"), *[F.col(names[g]).alias(g) for g in shown], "psi")


def psi_with_edges(reference: DataFrame, actual: DataFrame, column: str, edges: Sequence[float], closed: str = "left") -> float | None:
    """PSI over given inner edges; "left": [a, b), "right": (a, b]. Missing values are a bucket."""
    cuts = sorted({float(e) for e in edges if e == e and abs(e) != float("inf")})
    both = reference.select(F.lit(0).alias("side"), numeric(reference, column).alias("x")).unionByName(actual.select(F.lit(1).alias("side"), numeric(actual, column).alias("x")))
    counts = both.withColumn("bucket", bin_code(F.col("x"), cuts, closed=closed)).groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("a"))
    grid = reference.sparkSession.range(-1, len(cuts) + 1).select(F.col("id").cast("int").alias("bucket"))
    return _psi(counts, [], grid).first()["psi"]


def grouped_psi(data: DataFrame, group_cols: Sequence[str], score: str, reference_mode: str = "latest", reference_col: str | None = None, reference_value=None, partition_cols: Sequence[str] = (), buckets: int = 10, nan_strategy: str = "separate", include_stats: bool = False) -> DataFrame:
    """(partitions..., groups..., psi, is_reference[, counts]): each group against its partition's reference.

    The reference is the rows whose reference_col is the latest (by month order, in which null
    and blank come last, so are the latest) or equals reference_value. Every partition has edges
    of its own; partitions are handled together, without a loop.
    """
    _checked(buckets, nan_strategy)
    groups, partitions = list(group_cols), list(partition_cols)
    if reference_mode not in ("latest", "value"):
        raise ValueError(f"reference_mode must be 'latest' or 'value', got {reference_mode!r}")
    reference_col = reference_col or (groups[0] if len(groups) == 1 else None)
    if reference_col is None:
        raise ValueError("reference_col is needed with several group columns")
    if reference_mode == "value" and reference_value is None:
        raise ValueError("reference_value is needed with reference_mode='value'")
    for c in (reference_col, score, *groups, *partitions):
        if c not in data.columns:
            raise KeyError(c)
    data, names = _named(data, [*partitions, *groups, reference_col])
    shown = [*partitions, *[g for g in groups if g not in partitions]]
    out = _grouped(data, [names[g] for g in groups], score, reference_mode, names[reference_col], reference_value, [names[p] for p in partitions], buckets, nan_strategy)
    return out.select(*[F.col(names[c]).alias(c) for c in shown], "psi", "is_reference", *(COUNTS if include_stats else ()))


def _grouped(data: DataFrame, groups: list[str], score: str, reference_mode: str, reference_col: str, reference_value, partitions: list[str], buckets: int, nan_strategy: str) -> DataFrame:
    own = data.select(*[col(c) for c in dict.fromkeys([*partitions, *groups, reference_col])], numeric(data, score).alias("x"))
    if reference_mode == "latest":
        key = month_rank(F.col(reference_col))
        last = own.groupBy(*partitions).agg(F.max(key).alias("__last")) if partitions else own.agg(F.max(key).alias("__last"))
        own = _with(own, last, partitions).withColumn("__ref", key == F.col("__last"))
    else:
        own = own.withColumn("__ref", F.coalesce(F.col(reference_col).cast("string") == str(reference_value), F.lit(False)))
    whole = own.withColumn("__one", F.lit(1))
    keys = partitions or ["__one"]
    rows = quantile_rows(whole.where("__ref").select(*keys, F.lit("x").alias("feature"), "x"), [i / buckets for i in range(buckets + 1)], keys, rows=data.count())
    edges = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("e"))
    edges = edges.select(*keys, F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0))).alias("edges"))
    coded = _with(whole, edges, keys).withColumn("bucket", F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e <= F.col("x")))))
    counts = coded.groupBy(*keys, *[g for g in groups if g not in keys], "bucket").agg(F.count("*").alias("a"), F.count_if("__ref").alias("r"), F.min("__ref").alias("__all"))
    expected = counts.groupBy(*keys, "bucket").agg(F.sum("r").alias("e"))
    names = [*keys, *[g for g in groups if g not in keys]]
    refs = counts.groupBy(*names).agg(F.min("__all").alias("__all"), F.sum("a").alias("sample_count"), F.sum(F.when(F.col("bucket") == -1, F.col("a")).otherwise(0)).alias("missing_count"))
    base = expected.groupBy(*keys).agg(F.sum("e").alias("reference_sample_count"), F.sum(F.when(F.col("bucket") == -1, F.col("e")).otherwise(0)).alias("reference_missing_count"))
    low = -1 if nan_strategy == "separate" else 0
    grid = data.sparkSession.range(low, buckets).select(F.col("id").cast("int").alias("bucket"))
    cells = counts.select(*names).distinct().crossJoin(F.broadcast(grid))
    cells = _with(cells, expected, [*keys, "bucket"])
    cells = _with(cells, counts.select(*names, "bucket", "a"), [*names, "bucket"])
    cells = cells.select(*names, "bucket", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    out = _psi(cells, names, grid)
    out = _with(_with(out, refs, names), base, keys)
    shown = F.col("__all") if reference_col in groups else F.lit(False)
    out = out.withColumn("is_reference", shown)
    return out.select(*partitions, *[g for g in groups if g not in partitions], "psi", "is_reference", *COUNTS)


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys, nulls equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    return left.join(named, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def latest_month_psi(data: DataFrame, tag: str, month: str, score: str, buckets: int = 10) -> DataFrame:
    """(tag, month, latest_month_psi): each month of a sample set against its latest."""
    return grouped_psi(data, [month], score, "latest", month, partition_cols=[tag], buckets=buckets).select(tag, month, F.col("psi").alias("latest_month_psi"))


def feature_psi_against_base(data: DataFrame, features: Sequence[str], base_col: str, base_value, compare_col: str, buckets: int = 10, nan_strategy: str = "separate") -> DataFrame:
    """(feature, base_col, base_value, compare_col, compare_value, psi, is_reference, counts): every value of compare_col against the rows of base_col = base_value, feature by feature, in one pass."""
    _checked(buckets, nan_strategy)
    features = list(features)
    is_base = F.coalesce(col(base_col).cast("string") == str(base_value), F.lit(False))
    base = data.where(is_base)
    found = quantiles(base, features, [i / buckets for i in range(buckets + 1)])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), bin_code(numeric(data, f), inner_edges(found.get(f, [])), closed="left").alias("bucket")) for f in features])
    long = data.select(col(compare_col).cast("string").alias("compare_value"), is_base.alias("__base"), F.explode(pairs).alias("__p")).select("compare_value", "__base", "__p.*")
    counts = long.groupBy("feature", "compare_value", "bucket").agg(F.count("*").alias("a"), F.count_if("__base").alias("r"))
    expected = counts.groupBy("feature", "bucket").agg(F.sum("r").alias("e"))
    names = ["feature", "compare_value"]
    grid = data.sparkSession.range(-1 if nan_strategy == "separate" else 0, buckets).select(F.col("id").cast("int").alias("bucket"))
    cells = _with(_with(counts.select(*names).distinct().crossJoin(F.broadcast(grid)), expected, ["feature", "bucket"]), counts.select(*names, "bucket", "a"), [*names, "bucket"])
    out = _psi(cells.select(*names, "bucket", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a")), names, grid)
    own = counts.groupBy(*names).agg(F.sum("a").alias("sample_count"), F.sum(F.when(F.col("bucket") == -1, F.col("a")).otherwise(0)).alias("missing_count"))
    ref = expected.groupBy("feature").agg(F.sum("e").alias("reference_sample_count"), F.sum(F.when(F.col("bucket") == -1, F.col("e")).otherwise(0)).alias("reference_missing_count"))
    out = _with(_with(out, own, names), ref, ["feature"])
    same = F.coalesce(F.col("compare_value") == str(base_value), F.lit(False)) if compare_col == base_col else F.lit(False)
    return out.select("feature", F.lit(base_col).alias("base_col"), F.lit(str(base_value)).alias("base_value"), F.lit(compare_col).alias("compare_col"), "compare_value", "psi", same.alias("is_reference"), *COUNTS)
