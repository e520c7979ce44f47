"""Mixing sources to target weights by Poisson replication.

Each document's count is the inverse of a Poisson distribution, with its source's target
repetition rate as the mean, at a number hashed from seed and document: the same in every
run, independent between documents, and with the right mean for every source at any size.
Documents are exploded by their counts and dealt out in the order of another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import saved

#: Weight of a source of s code points: s ** POWER, over the sum of all.
POWER = 0.5
SEED = "mix-1"


def unit(*parts: Column | str) -> Column:
    """A number in (0, 1), hashed from the parts (null: the text "null")."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, budget: float = 1.0) -> DataFrame:
    """source and rate, the target repetitions of each of its documents.

    Sources are weighed by `weights` (sources without one: 0) or by size ** power; the
    mixture holds budget times the code points of docs. A null source is a source; one
    without code points has rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(float(power))))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0)).cast("double") if weights else F.lit(0.0))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_size") * float(budget) / F.col("size")
    return sizes.crossJoin(F.broadcast(total)).select("source", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))  # one row of totals


#: Steps of a distribution that stand in one list; a search reads the heads of the lists, then one list.
STEPS = 32
#: Copies of a document that one task makes, about.
COPIES = 1000


def with_steps(rated: DataFrame) -> DataFrame:
    """Adds low, heads and steps: the cumulative probabilities of low, low + 1, ... for the rate, in lists of STEPS, and the first of each list; what lies outside weighs under 1e-16."""
    spread = 12 * F.sqrt("rate") + 20
    low, high = F.greatest(F.floor(F.col("rate") - spread), F.lit(0)), F.ceil(F.col("rate") + spread)
    out = rated.where("rate > 0").withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
    first = F.aggregate(F.sequence(F.lit(1), F.greatest("low", F.lit(1))), F.lit(0.0), lambda s, k: s + F.ln(k.cast("double")))
    at_low = F.when(F.col("low") == 0, -F.col("rate")).otherwise(F.col("low") * F.ln("rate") - F.col("rate") - first)
    each = out.withColumn("at_low", at_low).withColumn("k", F.explode(F.sequence("low", "high")))
    # a source has some 24 * sqrt(rate) steps
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("p", F.sum(F.when(F.col("k") == F.col("low"), F.col("at_low")).otherwise(F.ln("rate") - F.ln(F.col("k").cast("double")))).over(upto))
    each = each.withColumn("c", F.sum(F.exp("p")).over(upto)).withColumn("list", F.floor((F.col("k") - F.col("low")) / STEPS))
    lists = each.groupBy("source", "rate", "low", "list").agg(F.sort_array(F.collect_list("c")).alias("own"))
    lists = lists.groupBy("source", "rate", "low").agg(F.transform(F.sort_array(F.collect_list(F.struct("list", "own"))), lambda x: x["own"]).alias("steps"))
    lists = lists.withColumn("heads", F.transform("steps", lambda x: F.get(x, F.lit(0))))
    none = rated.where("not rate > 0").select("source", "rate", F.lit(0).alias("low"), F.array(F.array(F.lit(1.0))).alias("steps"), F.array(F.lit(1.0)).alias("heads"))
    return lists.select(*none.columns).unionByName(none)


def counted(docs: DataFrame, rated: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with rate and n_copies. The table of sources is written first, so Spark knows its size: under the broadcast threshold docs stay where they are, beyond it a hot source is split."""
    return _counted(docs, saved(with_steps(rated), "mix-sources"), seed)


def _counted(docs: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    joined = docs.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    joined = joined.withColumn("__u", unit(seed, F.col("doc_id")))
    joined = joined.withColumn("__list", F.size(F.filter("heads", lambda c: c < F.col("__u"))))
    below = F.when(F.col("__list") > 0, STEPS * (F.col("__list") - 1) + F.size(F.filter(F.get("steps", F.col("__list") - 1), lambda c: c < F.col("__u")))).otherwise(0)
    return joined.withColumn("n_copies", F.when(F.col("rate") > 0, F.col("low") + below).otherwise(0).cast("int")).drop("__source", "__u", "__list", "heads", "steps", "low")


def mix(docs: DataFrame, rated: DataFrame | None = None, seed: str = SEED, shuffled: bool = True) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with rate, n_copies, copy (from 1) and shuffle_key, one row a copy, in the order of shuffle_key.

    Rows with equal doc_id get equal counts; a null doc_id is hashed as "null". A null or
    empty text adds nothing to its source's size and is repeated like others; an empty table
    gives an empty one. Columns of docs named as the added ones are replaced. The order is
    global: rows are dealt by ranges of a hash, so no source or copy stays together. Where a
    rate is high, a document's copies are made by several tasks.
    """
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    sources = saved(with_steps(rated if rated is not None else rates(docs)), "mix-sources")
    out = _counted(docs, sources, seed).where("n_copies > 0")
    if (sources.agg(F.max("rate")).first()[0] or 0) > COPIES:
        out = out.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / COPIES).cast("int"))))
        out = out.repartition(F.xxhash64("doc_id", "__part")).withColumn("copy", F.explode(F.sequence(COPIES * F.col("__part") + 1, F.least(COPIES * (F.col("__part") + 1), "n_copies")))).drop("__part")
    else:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", unit(seed, "order", F.col("doc_id"), F.col("copy")))
    return out.orderBy("shuffle_key", "doc_id", "copy") if shuffled else out
