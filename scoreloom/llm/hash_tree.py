"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, each by weighted hash draws.

At a node every child draws -ln(u) / weight, u a hash of key and child in (0, 1); the
smallest draw wins. A child's chance is its share of the weight, and a changed weight moves
keys only between that child and its siblings, so only within subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import saved


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Equal shards in racks and regions, filled in order; a shard beyond full regions opens a new one, so it takes keys only into itself."""
    return [Leaf(f"r{i // (per_rack * racks)}", f"k{i // per_rack}", i) for i in range(shards)]


def _draw(key: Column, child: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + child)).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 1.0) / float(2**52 + 1)) / float(weight)


def _smallest(key: Column, children: list[tuple[str, float]]) -> Column:
    """Name of the child with the smallest draw; ties to the smaller name."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, c, w).alias("draw"), F.lit(c).alias("child")) for c, w in children]))["child"]


def _totals(leaves: list[Leaf], of: str) -> list[tuple[str, float]]:
    sums: dict[str, float] = {}
    for x in leaves:
        sums[str(getattr(x, of))] = sums.get(str(getattr(x, of)), 0.0) + x.weight
    return sorted(sums.items())


def assign(docs: DataFrame, key: Column, tree: list[Leaf], column: str) -> DataFrame:
    """docs with the shard of each row's key (null: the text "null") in `column`. Three draws a row, whatever the number of shards below other nodes."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs leaves of positive weight")
    own, region, rack = "__key", "__region", "__rack"
    out = docs.withColumn(own, F.coalesce(key.cast("string"), F.lit("null")))
    out = out.withColumn(region, _smallest(F.col(own), _totals(tree, "region")))
    racks, shards = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, _ in _totals(tree, "region"):
        inside = [x for x in tree if x.region == r]
        racks = F.when(F.col(region) == r, _smallest(F.col(own), _totals(inside, "rack"))).otherwise(racks)
        for k, _ in _totals(inside, "rack"):
            leaves = [x for x in inside if x.rack == k]
            shards = F.when((F.col(region) == r) & (F.col(rack) == k), _smallest(F.col(own), _totals(leaves, "shard"))).otherwise(shards)
    out = out.withColumn(rack, racks)
    return out.withColumn(column, shards.cast("int")).drop(own, region, rack)


def numbered(rows: DataFrame, group: str, order: list[str], column: str) -> DataFrame:
    """rows with a gapless number from 0 within each group, in `order`, without gathering a group in one task.

    Rows are dealt by ranges of `order` and written; a range's start in its group is the sum
    of the counts before it. Rows equal in `order` are dealt by a random number, however many.
    """
    dealt = saved(rows.withColumn("__tie", F.rand(1)).repartitionByRange(*order, "__tie").withColumn("__range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("__range", group).agg(F.count("*").alias("__count"))
    # as many rows as ranges and groups
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__range").alias("__r"), F.col(group).alias("__g"), F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__start"))
    joined = dealt.join(starts, (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    within = F.row_number().over(Window.partitionBy("__range", group).orderBy(*order, "__tie"))
    return joined.withColumn(column, F.col("__start") + within - 1).drop("__range", "__r", "__g", "__start", "__tie")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text; other columns are not read).

    The law is `key`: doc_id and the number of shards decide. size: UTF-8 bytes of the text
    (null: none) plus 1. slot: place in the shard by doc_id, then size and crc. grown_shard:
    the shard with one shard more. A null doc_id is a key like others; repeated rows share
    their shard and have slots of their own. An empty table has no rows in any shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    slim = assign(slim, F.col("doc_id"), layout(shards), "shard")
    slim = assign(slim, F.col("doc_id"), layout(shards + 1), "grown_shard")
    return numbered(slim, "shard", ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
