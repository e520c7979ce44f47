"""Readers. All go through Spark, so pruning and pushdown reach the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

# The dictionary's columns and the headers that are read as each.
DICTIONARY = {
    "英文名": ("英文名", "变量名", "变量英文名", "feature", "vars", "name"),
    "中文名": ("中文名", "变量中文名", "变量解释含义", "含义", "description"),
    "指标表英文名": ("指标表英文名", "表名", "table"),
    "来源": ("来源", "数据来源", "source"),
}


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[col(c) for c in columns]) if columns else df


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_spaced(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Lines of fields apart by any white space, as text; lines of other lengths give nulls, blank ones nothing."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace(F.col("value"), r"^\s+|\s+$", ""), r"\s+")
    return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def normalise_dictionary(df: DataFrame) -> DataFrame:
    """The dictionary's four columns: headers by any of their names, the first non-blank value where several match."""
    lower = {}
    for c in df.columns:
        lower.setdefault(c.strip().lower(), []).append(c)
    out = []
    for name, aliases in DICTIONARY.items():
        found = [c for a in aliases for c in lower.get(a.lower(), [])]
        blank = [F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in found]
        out.append((F.coalesce(*blank) if blank else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def feature_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A feature dictionary from CSV; of a feature's rows one stays."""
    return normalise_dictionary(spark.read.option("header", True).csv(path)).where(F.col("英文名").isNotNull()).dropDuplicates(["英文名"])
