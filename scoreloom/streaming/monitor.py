"""Scoring and stability counts of streams.

Both are projections and counts: they run on batch and streaming DataFrames alike, state is
one count a window and bucket, and a watermark bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_code
from ..functions.columns import col, numeric
from ..operators.psi import _psi
from ..operators.scorecard import Scorecard


def scored(rows: DataFrame, card: Scorecard, output: str = "score") -> DataFrame:
    """rows with a scorecard's score."""
    return card.score(rows, output)


def psi_counts(rows: DataFrame, column: str, edges: Sequence[float], time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, bucket, n) by window of event time over frozen inner edges [a, b), missing values in bucket -1."""
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    code = bin_code(numeric(rows, column), list(edges), closed="left")
    return own.groupBy(F.window(col(time), window).alias("w"), code.alias("bucket")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bucket", "n")


def psi_of_counts(counts: DataFrame, reference: DataFrame, buckets: int) -> DataFrame:
    """(start, psi) of counts written by a stream, against a reference's (bucket, n)."""
    grid = counts.sparkSession.range(-1, buckets).select(F.col("id").cast("int").alias("bucket"))
    ref = reference.select(F.col("bucket").alias("__b"), F.col("n").alias("e"))
    actual = counts.select(F.col("start").alias("__s"), F.col("bucket").alias("__c"), F.col("n").alias("a"))
    cells = counts.select("start").distinct().crossJoin(F.broadcast(grid))  # a dozen buckets
    cells = cells.join(F.broadcast(ref), F.col("bucket") == F.col("__b"), "left").join(actual, (F.col("start") == F.col("__s")) & (F.col("bucket") == F.col("__c")), "left")
    return _psi(cells.select("start", "bucket", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a")), ["start"], grid)
