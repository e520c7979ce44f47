"""Running sums over a whole ordering without one task that holds it.

A group of at most MOST rows is a window of its own. Larger groups are cut into stretches of
their ordering, at quantiles of a sketch of the group itself, as many as its rows ask for;
sums by stretch are few, so a window over them gives each stretch its start, and windows
within stretches the rest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a few numbers that one window holds, and stretches of a group at most.
MOST, STRETCHES = 1_000_000, 4_096
#: Cuts that stand in one list: a search reads the lists' first cuts, then one list.
LIST = 64


def matched(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """All pairs are equal, nulls included."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))


def stretches(df: DataFrame, by: Sequence[str], order: str, most: int | None = None, rows: int | None = None) -> DataFrame | None:
    """df with __at, the stretch of the group's ordering that a row lies in, 0 in groups of at most `most` rows; None where no group is larger. rows: no group has more, if the caller knows."""
    most = MOST if most is None else most
    if rows is not None and rows <= most:
        return None
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    largest = sizes.agg(F.max("__n")).first()[0]
    if largest is None:
        return None
    k = min(STRETCHES, max(2, math.ceil(2 * largest / most)))
    named = [F.col(c).alias(f"__c{i}") for i, c in enumerate(by)]
    on = matched([(F.col(c), F.col(f"__c{i}")) for i, c in enumerate(by)])
    large = df.join(sizes.select(*named), on, "left_semi") if by else df
    cuts = large.groupBy(*named).agg(F.array_distinct(F.percentile_approx(order, [i / k for i in range(1, k)], 4 * k)).alias("__cuts"))
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size("__cuts") - 1) / LIST).cast("int")), lambda i: F.slice("__cuts", i * LIST + 1, LIST))
    # at most one row for every `most` rows of df
    cuts = cuts.withColumn("__lists", lists).withColumn("__heads", F.transform("__lists", lambda x: F.get(x, F.lit(0)))).drop("__cuts")
    joined = df.join(cuts, on, "left") if by else df.crossJoin(F.broadcast(cuts))  # one row
    head = F.size(F.filter("__heads", lambda c: c < F.col(order)))
    inner = F.when(head > 0, LIST * (head - 1) + F.size(F.filter(F.get("__lists", head - 1), lambda c: c < F.col(order))))
    return joined.withColumn("__at", F.coalesce(F.when(F.col("__heads").isNotNull(), inner), F.lit(0)).cast("int")).drop("__lists", "__heads", *[f"__c{i}" for i in range(len(by))])


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], most: int | None = None, rows: int | None = None) -> DataFrame:
    """df (by..., a numeric column `order` without nulls, and sums), one row for each value of by and order, with "before_<s>", the sum over smaller values of order in the same group, and "all_<s>". rows: no group has more, if the caller knows, which saves counting them."""
    own, group = stretches(df, by, order, most, rows), Window.partitionBy(*by)
    if own is None:
        within = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"before_{s}") for s in sums], *[F.sum(s).over(group).alias(f"all_{s}") for s in sums])
    part = own.groupBy(*by, "__at").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    earlier = group.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
        F.col("__at").alias("__k"),
        *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__start_{s}") for s in sums],
        *[F.sum(f"__{s}").over(group).alias(f"all_{s}") for s in sums],
    )
    out = own.join(starts, matched([(F.col("__at"), F.col("__k")), *[(F.col(c), F.col(f"__k{i}")) for i, c in enumerate(by)]]))
    within = Window.partitionBy(*by, "__at").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"__start_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0)))
    return out.select(*df.columns, *[f"before_{s}" for s in sums], *[f"all_{s}" for s in sums])
