"""Largest inner products by score-aware quantisation.

What a vector is beyond its partition's centre is cut into pairs of dimensions with 16
centres each. Codes and centres minimise an anisotropic loss: the part of the error along
the vector, which changes its large inner products most, weighs `eta` times the part across.
A query makes a table of 16 numbers for each pair of dimensions; four-bit codes look them
up, and a fixed number of the best of all that it looked up are ranked again by exact inner
products. What the sample shows to be far below these is not handed on.

Tables are dealt to partitions around coarse centres. A query reads those whose
centres promise most, as many as a measurement on the sample found enough, and as hold
enough rows. Partitions are cut into blocks of bounded rows and their queries into chunks,
so a task compares one chunk with one block, however common a vector or a direction is.
Equal vectors are one class, with their smallest ids; every class is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._io import drop, saved, shuffles_cleaned

#: Vectors that centres and the number of partitions read are fitted on, at most: those of the smallest hashes.
SAMPLE = 16_384
#: Rows of a partition, about, and partitions at most; beyond, partitions grow.
PART_ROWS, PARTS = 4_096, 1_024
#: Rows of a block and queries of a chunk, about.
ROWS, CHUNK = 8_192, 2_048
#: Rough best of a query, over all that it reads, that are ranked exactly, and by how much more than so many the sample's floor must let pass.
DEPTH, SLACK = 768, 1.5
#: Share of true neighbours on the sample that the partitions read must hold, and queries that measure it.
RECALL, MEASURED = 0.985, 256
#: Cosine from which inner products should be right (threshold of the loss).
THRESHOLD = 0.2


def eta(width: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual against the orthogonal one."""
    return max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """centres: pairs of dimensions x 16 x 2."""

    def __init__(self, centres: np.ndarray, weight: float, width: int):
        self.centres, self.weight, self.width = centres, weight, width

    def cut(self, x: np.ndarray) -> np.ndarray:
        """rows x pairs x 2, an odd last dimension filled up with 0."""
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)

    def codes(self, x: np.ndarray, base: np.ndarray | float = 0.0, rounds: int = 2) -> np.ndarray:
        """Codes of x - base by coordinate descent on the anisotropic loss of x, from the nearest centres."""
        parts = self.cut(x - base)
        unit = self.cut(x) / np.linalg.norm(x, axis=1)[:, None, None]
        n, m, _ = parts.shape
        residual = parts[:, :, None, :] - self.centres[None]  # rows x pairs x 16 x 2
        plain, along = (residual**2).sum(3), np.einsum("nmkd,nmd->nmk", residual, unit)
        code = plain.argmin(2)
        rows = np.arange(n)
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[rows, j, code[:, j]]
                code[:, j] = (plain[:, j] + (self.weight - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                total = rest + along[rows, j, code[:, j]]
        return code.astype(np.uint8)

    def refit(self, x: np.ndarray, code: np.ndarray, base: np.ndarray | float = 0.0) -> None:
        """Centres that minimise the loss for these codes, one pair of dimensions after another."""
        parts = self.cut(x - base)
        unit = self.cut(x) / np.linalg.norm(x, axis=1)[:, None, None]
        w = self.weight - 1
        taken = np.take_along_axis(self.centres[None], code[:, :, None, None].astype(int), 2)[:, :, 0]
        total = ((parts - taken) * unit).sum((1, 2))
        for j in range(parts.shape[1]):
            u, p = unit[:, j], parts[:, j]
            rest = total - ((p - taken[:, j]) * u).sum(1)
            left = np.eye(2)[None] + w * u[:, :, None] * u[:, None, :]
            right = p + w * (rest + (p * u).sum(1))[:, None] * u
            for k in range(16):
                own = code[:, j] == k
                if own.any():
                    self.centres[j, k] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
            taken[:, j] = self.centres[j, code[:, j]]
            total = rest + ((p - taken[:, j]) * u).sum(1)

    def rebuilt(self, code: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        return np.take_along_axis(self.centres[None], code[:, :, None, None].astype(int), 2)[:, :, 0].reshape(len(code), -1)[:, : self.width]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: inner products with two pairs' centres for each byte of two codes."""
        parts = self.cut(queries)
        one = np.einsum("qmd,mkd->qmk", parts, self.centres)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(one), 1, 16))], 1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(one), -1, 256).astype(np.float32)


def packed(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
    return (code[:, 0::2] << 4) | code[:, 1::2]


def fit(sample: np.ndarray, base: np.ndarray | float = 0.0, rounds: int = 6) -> Quantiser:
    """Centres from a sample, by Lloyd's steps and then anisotropic ones. The same sample gives the same centres."""
    width = sample.shape[1]
    parts = Quantiser(np.zeros((0, 16, 2)), 1.0, width).cut(sample - base)
    at = np.linspace(0, len(sample) - 1, 16).astype(int)
    centres = np.stack([parts[np.lexsort((parts[:, j, 1], parts[:, j, 0]))[at], j] for j in range(parts.shape[1])])
    own = Quantiser(centres.astype(float), 1.0, width)
    for i in range(2 * rounds):
        own.weight = 1.0 if i < rounds else eta(width)
        own.refit(sample, own.codes(sample, base, 0 if i < rounds else 2), base)
    own.weight = eta(width)
    return own


class Coarse:
    """Centres of partitions, and how many of them a query reads."""

    def __init__(self, sample: np.ndarray, parts: int, k: int, rounds: int = 10):
        """Lloyd's steps from evenly spread vectors of the sample. The same sample gives the same centres."""
        self.centres = sample[np.linspace(0, len(sample) - 1, min(parts, len(sample))).astype(int)].copy()
        for _ in range(rounds if parts > 1 else 1):
            part = self.nearest(sample)
            counts = np.bincount(part, minlength=len(self.centres))
            sums = np.stack([np.bincount(part, sample[:, d], len(self.centres)) for d in range(sample.shape[1])], 1)
            self.centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centres)
        self.reads = self._measured(sample, k) if parts > 1 else 1

    def nearest(self, x: np.ndarray) -> np.ndarray:
        half = (self.centres**2).sum(1) / 2
        return np.concatenate([(x[at : at + 4096] @ self.centres.T - half).argmax(1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Partitions of each query, the most promising first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")

    def _measured(self, sample: np.ndarray, k: int) -> int:
        part = self.nearest(sample)
        at = np.linspace(0, len(sample) - 1, min(MEASURED, len(sample))).astype(int)
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        k = min(k, len(sample) - 1)
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        place = np.argsort(self.order(sample[at]), axis=1)  # of each partition in the query's order
        found = np.sort(np.take_along_axis(place, part[best], 1).ravel())
        return int(found[min(int(np.ceil(RECALL * len(found))), len(found)) - 1]) + 1

    def read(self, queries: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The partitions that each query reads: `reads` of those with rows, and more while they hold fewer than `least` rows."""
        order = self.order(queries)
        held = sizes[order]
        number = np.cumsum(held > 0, axis=1)
        before = np.cumsum(held, axis=1) - held
        take = (held > 0) & ((number <= self.reads) | (before < least))
        return [order[i][take[i]].astype(np.int32) for i in range(len(order))]


def _usable(column: Column, width: int) -> Column:
    """No null, no odd length, no null or non-finite component, not zero."""
    whole = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) == width) & whole & F.exists(column, lambda x: x != 0)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _classes(rows: DataFrame, width: int, ids: int) -> DataFrame:
    """embedding and ids: of each distinct vector the `ids` smallest vec_ids, gathered by batch first, so a vector of many rows costs one row a batch."""

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), width) + 0.0  # no -0.0
            own = batch.column("vec_id").to_numpy()
            order = np.lexsort((own, *x.T[::-1]))
            x, own = x[order], own[order]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)]) if len(x) else np.zeros(0, int)
            lists = [np.unique(own[a:b])[:ids] for a, b in zip(first, np.r_[first[1:], len(x)], strict=True)]
            flat = pa.array(x[first].ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * width), flat), pa.array(lists, pa.list_(pa.int64()))], ["embedding", "ids"])

    met = rows.mapInArrow(run, "embedding array<double>, ids array<long>").groupBy("embedding")
    return met.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("ids"))


_SCHEMA = "query_id long, rank int, vec_id long, score double"


def _one_vector(own: DataFrame) -> DataFrame:
    """own with one vector an id: of several different ones under one vec_id, that of the smallest hash."""
    hashed = own.withColumn("h", F.xxhash64("embedding"))
    several = saved(hashed.groupBy("vec_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select(F.col("vec_id").alias("several"), "low"), "anisotropic-several", slim="light")
    if several.isEmpty():
        drop(several)
        return own
    return hashed.join(several, F.col("vec_id") == F.col("several"), "left").where("low is null or low = h").select(*own.columns)


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of the largest inner products with each query, of vectors (vec_id, embedding; other columns are not read).

    Queries are the rows for which is_query holds; a query's own vec_id is no candidate. Ties
    of the exact score go to the smaller vec_id. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part, nor do rows
    without a vec_id; rows repeated under one vec_id count once, and of different vectors
    under one vec_id one counts, that of the smallest hash. Fewer candidates than k are all
    returned; without queries the result is empty.
    """
    spark = vectors.sparkSession
    own = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("embedding"), is_query.alias("is_query"))
    found = own.select(F.size("embedding").alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not found:
        return spark.createDataFrame([], _SCHEMA)
    width, total = found[0]["n"], found[0]["count"]
    own = own.where(_usable(F.col("embedding"), width))
    drawn = own.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").orderBy("h", "vec_id", "embedding").limit(sample).select("embedding").toArrow()  # at most `sample` rows
    if not drawn.num_rows:
        return spark.createDataFrame([], _SCHEMA)
    drawn = _matrix(drawn.column("embedding").combine_chunks(), width)
    keep = k + 1  # the query itself may be among the best
    coarse = Coarse(drawn, min(max(total // PART_ROWS, 1), PARTS), k)
    own_centres = coarse.centres[coarse.nearest(drawn)]
    quantiser = fit(drawn, own_centres)
    seen_rows = (own_centres + quantiser.rebuilt(quantiser.codes(drawn, own_centres))).astype(np.float32)
    # the place among the sample's rough scores below which no row of the best `depth` is to be expected
    place = int(SLACK * depth * len(drawn) / total) + 10
    with shuffles_cleaned(spark):
        own = _one_vector(own)
        index = saved(_indexed(_classes(own.select("vec_id", "embedding"), width, keep), quantiser, coarse, width), "anisotropic-index")
        sizes = np.zeros(len(coarse.centres), np.int64)
        for r in index.groupBy("part").count().collect():  # PARTS rows at most
            sizes[r["part"]] = r["count"]
        queries = own.where("is_query").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
        queries = saved(queries.withColumn("vector", F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ",").cast("binary"), 256)), "anisotropic-queries")
        # a vector is sought once, whatever the number of its queries
        seen = queries.groupBy("vector").agg(F.min("query_id").alias("sought"))
        once = queries.join(seen, "vector").where("query_id = sought").select("sought", "embedding")
        sought = saved(_reading(once, coarse, sizes, width, depth, seen_rows, place), "anisotropic-sought")
        near = saved(_near(index, sought, quantiser, coarse, sizes, width, keep, depth), "anisotropic-found")
        drop(index)
        drop(sought)
    pairs = queries.select("query_id", "vector").join(seen, "vector").select("query_id", "sought").join(near, "sought").where("vec_id != query_id")
    return _best(pairs.select("query_id", "vec_id", "score"), "query_id", k).select("query_id", "rank", "vec_id", "score")


def _best(df: DataFrame, by: str, k: int, order: str = "score", tie: str = "vec_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), tie))).where(F.col("rank") <= k)


def _indexed(classes: DataFrame, quantiser: Quantiser, coarse: Coarse, width: int) -> DataFrame:
    """key (the smallest id), ids, embedding, code and part of each class."""

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("embedding"), width)
                nearest = coarse.nearest(x)
                code = packed(quantiser.codes(x, coarse.centres[nearest]))
                yield pa.RecordBatch.from_arrays([part.column("ids"), part.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(nearest.astype(np.int32))], ["ids", "embedding", "code", "part"])

    return classes.mapInArrow(run, "ids array<long>, embedding array<double>, code binary, part int").withColumn("key", F.get("ids", F.lit(0)))


def _reading(queries: DataFrame, coarse: Coarse, sizes: np.ndarray, width: int, least: int, seen: np.ndarray, place: int) -> DataFrame:
    """queries (sought, embedding) with the partitions that each reads, and the score of `place` among the sample's rows."""
    sent = queries.sparkSession.sparkContext.broadcast(seen)  # the sample

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column("embedding"), width)
                floor = np.full(len(x), -np.inf, np.float32) if place >= len(rows) else -np.partition(-(x.astype(np.float32) @ rows.T), place, axis=1)[:, place]
                yield pa.RecordBatch.from_arrays([part.column("sought"), part.column("embedding"), pa.array(coarse.read(x, sizes, least), pa.list_(pa.int32())), pa.array(floor)], ["sought", "embedding", "parts", "floor"])

    return queries.mapInArrow(run, "sought long, embedding array<double>, parts array<int>, floor float")


def _near(index: DataFrame, sought: DataFrame, quantiser: Quantiser, coarse: Coarse, sizes: np.ndarray, width: int, keep: int, depth: int) -> DataFrame:
    """sought, vec_id and exact score of the best ids of each query."""
    spark = index.sparkSession
    asked = np.zeros(len(sizes), np.int64)
    for r in sought.select(F.explode("parts").alias("part")).groupBy("part").count().collect():  # PARTS rows at most
        asked[r["part"]] = r["count"]
    rows = [(i, int(-(-n // ROWS)), int(max(1, -(-m // CHUNK)))) for i, (n, m) in enumerate(zip(sizes, asked, strict=True))]
    cuts = F.broadcast(spark.createDataFrame(rows, "part int, blocks int, chunks int"))  # PARTS rows at most
    # a class belongs to one block, a query to one chunk of each partition
    index = index.join(cuts, "part").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunk = F.pmod(F.xxhash64("sought"), F.col("chunks")).cast("int").alias("chunk")
    keys = ["part", "block", "chunk"]
    asking = sought.select("sought", "embedding", "floor", F.explode("parts").alias("part")).join(cuts, "part").select("sought", "embedding", "floor", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk)

    def looked_up(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The `depth` rough best of the block for each query, from its floor on."""
        out = {"sought": [], "part": [], "block": [], "key": [], "rough": []}
        n = min(depth, rows.num_rows)
        if queries.num_rows and n:
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            key = rows.column("key").to_numpy()
            asks, names, floor = _matrix(queries.column("embedding").combine_chunks(), width), queries.column("sought").to_numpy(), queries.column("floor").to_numpy()
            centre = coarse.centres[rows.column("part")[0].as_py()]
            for at in range(0, len(asks), 64):
                tables = quantiser.tables(asks[at : at + 64])
                rough = np.repeat((asks[at : at + 64] @ centre)[:, None], len(code), 1).astype(np.float32)
                for j in range(code.shape[1]):
                    rough += tables[:, j].take(code[:, j], axis=1)
                top = np.argpartition(-rough, n - 1, axis=1)[:, :n]
                score = np.take_along_axis(rough, top, 1)
                high = score >= floor[at : at + 64, None]
                out["sought"].append(np.repeat(names[at : at + 64], high.sum(1)))
                out["key"].append(key[top[high]])
                out["rough"].append(score[high])
        flat = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
        size = len(flat["sought"])
        for c in ("part", "block"):
            flat[c] = np.full(size, rows.column(c)[0].as_py() if size else 0)
        types = {"sought": pa.int64(), "part": pa.int32(), "block": pa.int32(), "key": pa.int64(), "rough": pa.float32()}
        return pa.table({c: pa.array(flat[c]).cast(t) for c, t in types.items()})

    rough = asking.groupBy(*keys).cogroup(index.select(*keys, "key", "code").groupBy(*keys)).applyInArrow(looked_up, "sought long, part int, block int, key long, rough float")
    best = _best(rough, "sought", depth, "rough", "key").groupBy("sought", "part", "block").agg(F.collect_list("key").alias("keys"))
    ranked = best.join(sought.select("sought", "embedding"), "sought").join(cuts, "part").select("sought", "embedding", "keys", "part", "block", chunk)

    def exact(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Inner products of each query with its candidates in the block; the best classes' ids."""
        names, ids, scores = [], [], []
        if queries.num_rows and rows.num_rows:
            x, key = _matrix(rows.column("embedding").combine_chunks(), width), rows.column("key").to_numpy()
            order = np.argsort(key)
            lists = rows.column("ids").combine_chunks()
            begins, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            asks, wanted = _matrix(queries.column("embedding").combine_chunks(), width), queries.column("keys").to_pylist()
            for i, name in enumerate(queries.column("sought").to_pylist()):
                at = order[np.searchsorted(key, np.array(wanted[i]), sorter=order)]
                score = np.einsum("nd,d->n", x[at], asks[i])
                for j in np.lexsort((key[at], -score))[:keep]:
                    own = flat[begins[at[j]] : begins[at[j] + 1]]
                    names.append(np.full(len(own), name))
                    ids.append(own)
                    scores.append(np.full(len(own), score[j]))
        made = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((names, np.int64), (ids, np.int64), (scores, float))]
        return pa.table({"sought": made[0], "vec_id": made[1], "score": made[2]})

    found = ranked.groupBy(*keys).cogroup(index.select(*keys, "key", "ids", "embedding").groupBy(*keys)).applyInArrow(exact, "sought long, vec_id long, score double")
    return _best(found, "sought", keep).drop("rank")
