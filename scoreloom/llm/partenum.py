"""Set similarity join of word shingles with PartEnum signatures, as connected components.

Sets fall into bands of sizes a factor 1/threshold apart; linked sets lie in one band or
in neighbouring ones, and differ in at most k elements, k known from the band. The domain of
shingle hashes is cut into parts and each part into cells, so that some part holds few
enough of the k differences to leave several of its cells equal in both sets: a set's
signatures are all choices of so many cells of each part, and linked sets share one.

Equal sets are one node. Each block of texts and then each bucket of signatures ties the
nodes of a signature to its smallest one, so a signature costs one entry a block and no
task needs the pairs of a group. What the ties hold together, directly or through others,
falls apart where sizes and sketches rule links out, and the rest is compared exactly: small
groups as they are, larger ones in pairs of bounded blocks of equal or neighbouring
size bands. A task gives back only links that span what it linked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._graph import merged
from ._io import drop, saved, shuffles_cleaned

#: Signatures that a task holds before it deals them out.
_FLUSH = 1 << 20


def shingle_sets(block: T.Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the block's texts, text after text and sorted, and their number by text."""
    lower = T.LOWER[block.data]
    n = len(block.offsets) - 1
    w = T.spans(lower, block.offsets, T.SPACE)
    key = T.hashes(lower, w.starts, w.ends)
    made, at = T.shingles(key, w.doc, words)
    cut = np.searchsorted(w.doc[at], np.arange(n + 1))
    count = T.per_doc(w.doc, n)
    begins = np.r_[0, np.cumsum(count)]
    out = []
    for d in range(n):
        if count[d] >= words:
            out.append(np.unique(made[cut[d] : cut[d + 1]]))
        elif count[d]:
            h = np.uint64(count[d])
            for x in key[begins[d] : begins[d + 1]]:
                h = T.mix(np.array([h ^ x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def digests(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A node's name: a 64-bit hash of its set. Two different sets share one with a chance of 2^-64."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = _sums(owner, T.mix(elements + np.uint64(0x51ED270B)), len(sizes))
    return T.mix(total + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by owner; up to 2^21 values of one owner are exact, more are still the same for the same set in the same order."""
    low = np.bincount(owner, (values & np.uint64(0xFFFFFFFF)).astype(float), n)
    high = np.bincount(owner, (values >> np.uint64(32)).astype(float), n)
    return np.fmod(low, 2.0**64).astype(np.uint64) + (np.fmod(high, 2.0**32).astype(np.uint64) << np.uint64(32))


def bands(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Band of each size, and k of each band: the most elements in which linked sets differ whose smaller one lies in it."""
    tops, low = [], 1
    while not tops or tops[-1] < sizes.max(initial=1):
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    tops = np.array(tops, np.int64)
    return np.searchsorted(tops, sizes), tops * (100 - percent) // percent


#: Seeds under which a set's domain is cut in turn while some of its signatures are empty.
SEEDS = 5


def _plan(k: int) -> tuple[int, int, int, int]:
    """Parts, cells of a part, cells of a signature, and spare parts, for sets that differ in at most k elements.

    A part with at most `cells - taken` differences leaves `taken` clean cells; there are
    more such parts than spare ones. Few differences take the domain as one part.
    """
    if k <= 8:
        return 1, k + 3, 3, 0
    spare = 1 if k <= 24 else 2 + k // 64
    return k // 2 + 1 + spare, 3, 2, spare


def signatures(elements: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the set of each. Bands with k = 0 link equal sets only, which are one node already.

    Linked sets share a signature that is not empty if one of them has no more parts with an
    empty signature than spare ones. A set with more also takes the signatures of the next
    seed, where its like meet again; only after the last are empty ones given out.
    """
    band, most = bands(sizes, percent)
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    starts = np.r_[0, np.cumsum(sizes)]
    for down in (0, 1):
        at = band - down
        all_k = np.where((at >= 0) & (sizes > 0), most[np.maximum(at, 0)], 0)
        for wide in (False, True):  # one part of k + 3 cells, or several of 3
            live = np.flatnonzero((all_k > 8) if wide else ((all_k > 0) & (all_k <= 8)))
            for kinds in [live] if wide else [live[all_k[live] == k] for k in np.unique(all_k[live])]:
                for seed in range(SEEDS):
                    if not len(kinds):
                        break
                    key, owner, thin = _cut(elements, starts, sizes, kinds, all_k[kinds], at[kinds], seed)
                    found.append(key)
                    owners.append(owner)
                    kinds = kinds[thin]
    return np.concatenate(found), np.concatenate(owners)


def _cut(elements, starts, sizes, which, k, band, seed):
    """Signatures of the sets `which` under a seed, and which of them have too many empty ones. All have one plan, but for the number of parts."""
    plans = {int(v): _plan(int(v)) for v in np.unique(k)}
    _, cells, taken, _ = next(iter(plans.values()))
    parts, spare = (np.array([plans[int(v)][i] for v in k], np.int64) for i in (0, 3))
    base = np.r_[0, np.cumsum(cells * parts)]
    size = sizes[which]
    owner = np.repeat(np.arange(len(which)), size)
    x = elements[np.repeat(starts[which] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
    place = T.mix(x + np.uint64(0x2545F4914F6CDD1D + 0x9E3779B9 * seed))
    part = ((place >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)
    cell = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(cells)) >> np.uint64(32)
    cell = base[owner] + (cells * part + cell).astype(np.int64)
    total = _sums(cell, T.mix(x * np.uint64(3) + np.uint64(0x1234567)), base[-1]).reshape(-1, cells)
    count = np.bincount(cell, minlength=base[-1]).reshape(-1, cells)
    of = np.repeat(np.arange(len(which)), parts)
    number = np.arange(len(of)) - np.repeat(base[:-1] // cells, parts)
    tag = T.mix((band[of].astype(np.uint64) << np.uint64(40)) + (np.uint64(seed) << np.uint64(36)) + number.astype(np.uint64))
    chosen = np.array(list(itertools.combinations(range(cells), taken)))
    key, filled = np.zeros((len(of), len(chosen)), np.uint64), np.zeros((len(of), len(chosen)), np.int64)
    for j in range(taken):
        key += total[:, chosen[:, j]]
        filled += count[:, chosen[:, j]]
    key = T.mix(key + T.mix(tag[:, None] + np.arange(1, len(chosen) + 1, dtype=np.uint64)))
    thin = np.bincount(of, (filled == 0).any(1), len(which)) > spare
    take = (filled > 0) | (thin[of][:, None] & (seed == SEEDS - 1))
    return key[take], np.broadcast_to(which[of][:, None], key.shape)[take], thin


def _ties(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts (key, node) pairs. Returns ties (member, smallest node of its key), distinct, and the places of one entry a key: the smallest node."""
    order = np.lexsort((node, key))
    k, v = key[order], node[order]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    low = v[np.flatnonzero(first)][np.cumsum(first) - 1] if len(k) else v
    tied = v != low
    pairs = np.unique(np.stack([v[tied], low[tied]], 1), axis=0) if tied.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], order[first]


def _ids_schema(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


#: Bits of the smallest sketch; sets above SKETCH_STEPS elements have 4 and 16 times as many.
SKETCH, SKETCH_STEPS = 1024, (1000, 4000)


def sketches(elements: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set some bits, each the parity of the elements hashed to it: sets differ in at least as many elements as their sketches in bits. A longer sketch folds into a shorter one by exclusive or."""
    place = (T.mix(elements + np.uint64(0x7F4A7C15)) >> np.uint64(40)).astype(np.int64)
    wide = SKETCH * np.array([1, 4, 16])[np.searchsorted(SKETCH_STEPS, sizes, side="right")]
    base = np.r_[0, np.cumsum(wide)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.bincount(base[owner] + place % wide[owner], minlength=base[-1]) & 1
    packed, cut = np.packbits(bits.astype(bool)).tobytes(), base // 8
    return [packed[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _folded(sketch: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest."""
    words = min(map(len, sketch)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in sketch])


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size, node and sketch of each text's set; no node for an empty set."""

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                elements, sizes = shingle_sets(block, words)
                node = pa.array(digests(elements, sizes), mask=sizes == 0)
                sketch = pa.array(sketches(elements, sizes), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.rows.start, len(sizes)), pa.array(sizes), node, sketch], ["doc_id", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(run, f"doc_id {_ids_schema(docs)}, n_shingles long, node long, sketch binary")


def _tied(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Distinct (a, b): node a shares a signature with b, the smallest node of that signature in a block or overall."""
    spark = docs.sparkSession
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    @T.tidied
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, node = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            a, b, first = _ties(key, node)
            key, node = key[first], node[first]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            bucket, key, node = bucket[order], key[order], node[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            keys = [key[x:y].astype(np.uint32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            nodes = [node[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            at = [int(x) for x in bucket[cut[:-1]]]
            # ties of this block, to the bucket of the member
            deal_to = (T.mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(deal_to, kind="stable")
            a, b, deal_to = a[order], b[order], deal_to[order]
            cut = np.flatnonzero(np.r_[True, deal_to[1:] != deal_to[:-1], True]) if len(a) else np.zeros(1, int)
            ties = [np.stack([a[x:y], b[x:y]], 1).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            to = [int(x) for x in deal_to[cut[:-1]]]
            return pa.RecordBatch.from_arrays([pa.array(at + to, pa.int32()), pa.array(keys + [None] * len(to), pa.binary()), pa.array(nodes + ties, pa.binary())], ["bucket", "keys", "nodes"])

        size = 0
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                elements, sizes = shingle_sets(block, words)
                node = digests(elements, sizes)
                _, once = np.unique(node, return_index=True)
                if len(once) < len(node):  # copies
                    keep = np.zeros(len(node), bool)
                    keep[once] = True
                    elements, sizes, node = elements[np.repeat(keep, sizes)], sizes[keep], node[keep]
                key, owner = signatures(elements, sizes, percent)
                held.append((key, node[owner]))
                size += len(key)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    @T.tidied
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, ready = [], [], []
        for batch in batches:
            for bucket, k, v in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                if k is None:
                    ready.append(np.frombuffer(v, np.int64).reshape(-1, 2))
                else:
                    keys.append(np.frombuffer(k, np.uint32).astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)))
                    nodes.append(np.frombuffer(v, np.int64))
        pairs = np.concatenate(ready) if ready else np.zeros((0, 2), np.int64)
        if keys:
            a, b, _ = _ties(np.concatenate(keys), np.concatenate(nodes))
            pairs = np.concatenate([pairs, np.stack([a, b], 1)])
        if len(pairs):
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    dealt = docs.mapInArrow(deal, "bucket int, keys binary, nodes binary").repartition("bucket")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


#: Words of 64 bits in the filter of doc_ids; it is of this size whatever the input.
FILTER_WORDS = 1 << 18


def _bits(hashed: np.ndarray) -> np.ndarray:
    """Four bits of the filter for each hash."""
    return np.stack([T.mix(hashed.view(np.uint64) + np.uint64(j)) % np.uint64(64 * FILTER_WORDS) for j in range(4)])


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most rows whose doc_id is not in ids: a Bloom filter of fixed size goes to all tasks, so that few texts are dealt out by the join that decides. With too many ids it lets all pass."""

    @T.tidied
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_WORDS, np.uint64)
        for batch in batches:
            at = _bits(batch.column("h").to_numpy()).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full].view(np.int64))], ["word", "bits"])

    met = ids.select(F.xxhash64("doc_id").alias("h")).mapInArrow(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_WORDS rows at most
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[met.column("word").to_numpy()] = met.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def might(h: pd.Series) -> pd.Series:
        at = _bits(h.to_numpy())
        return pd.Series(((sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0))

    return docs.where(might(F.xxhash64("doc_id")))


def _elements(docs: DataFrame, dealt: DataFrame, words: int) -> DataFrame:
    """dealt (node, doc_id, whole, low, i, high, j) with the nodes' sets as packed 64-bit hashes: one text a node is read again."""
    keys = ["node", *_PAIR]

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                elements, sizes = shingle_sets(block, words)
                cut, data = np.r_[0, np.cumsum(sizes)] * 8, elements.tobytes()
                packed = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                own = [batch.column(k).slice(block.rows.start, len(sizes)) for k in keys]
                out = pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary())], [*keys, "elements"])
                yield out.filter(pa.array(digests(elements, sizes) == own[0].to_numpy()))  # an id may stand on several texts

    near = _among(docs, dealt.select("doc_id"))
    return near.join(dealt, "doc_id").select(*keys, "text").mapInArrow(run, "node long, whole long, low int, i int, high int, j int, elements binary")


_PAIR = ("whole", "low", "i", "high", "j")
#: Sets, and elements of sets, that a block holds about; a task compares two blocks.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 1 << 21


def _blocks(by_elements: bool):
    """Number of blocks of a group; blocks of sketches hold twice as many rows."""
    n = F.ceil(F.count("*") / (BLOCK_SETS if by_elements else 2 * BLOCK_SETS))
    return (F.greatest(n, F.ceil(F.sum("size") / BLOCK_ELEMENTS)) if by_elements else n).cast("int")


def _large(members: DataFrame) -> DataFrame:
    """Groups (whole) of more than two blocks."""
    return members.groupBy("whole").agg(_blocks(True).alias("n")).where("n > 2").select("whole")


def _dealt(members: DataFrame, percent: int, by_elements: bool = True) -> DataFrame:
    """(node, whole, low, i, high, j) of each pair of blocks that a node is part of. members: (node, whole, size).

    What fits into two blocks stays together. Larger groups are cut by bands of sizes, as only
    equal and neighbouring bands hold linked sets, and the bands into blocks by a hash.
    """
    wholes = _large(members)
    small = members.join(wholes, "whole", "left_anti").select("node", "whole", *[F.lit(0).alias(x) for x in ("low", "i", "high", "j")])
    band = F.floor(F.ln(F.col("size").cast("double")) / float(np.log(100 / percent))).cast("int")
    large = members.join(wholes, "whole", "left_semi").withColumn("band", band)
    # as many rows as bands of large groups
    counts = saved(large.groupBy("whole", "band").agg(_blocks(by_elements).alias("n")), "partenum-bands", slim="light")

    def beside(step: int, name: str) -> DataFrame:
        return counts.select("whole", (F.col("band") - step).alias("band"), F.col("n").alias(name))

    large = large.join(counts, ["whole", "band"]).join(beside(1, "n_above"), ["whole", "band"], "left").join(beside(-1, "n_below"), ["whole", "band"], "left")
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))

    def key(low, i, high, j):
        return F.struct(low.cast("int").alias("low"), i.cast("int").alias("i"), high.cast("int").alias("high"), j.cast("int").alias("j"))

    def others(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    b, k = F.col("band"), F.col("block")
    own = F.transform(others("n"), lambda x: key(b, F.least(k, x), b, F.greatest(k, x)))
    above = F.transform(others("n_above"), lambda x: key(b, k, b + 1, x))
    below = F.transform(others("n_below"), lambda x: key(b - 1, x, b, k))
    return small.unionByName(large.select("node", "whole", F.explode(F.concat(own, above, below)).alias("x")).select("node", "whole", "x.*"))


def _overlaps(packed: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections. Elements of one set only never count."""
    n, sizes = len(packed), [len(x) for x in packed]
    flat, owner = np.concatenate(packed), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    place = np.cumsum(first) - 1
    shared = np.bincount(place)[place] > 1
    owner, place = owner[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    wide = max(1, (1 << 22) // n)
    cuts = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else 0) + wide + 1, wide))
    for t, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if z > a:
            cells = np.zeros((n, min(wide, int(place[z - 1]) - t * wide + 1)), np.float32)
            cells[owner[a:z], place[a:z] - t * wide] = 1
            out += cells @ cells.T
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches."""
    n = len(near)
    root = np.arange(n)
    while True:
        low = np.where(near, root[None, :], n).min(1)
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _spanning(node: np.ndarray, near: np.ndarray) -> pa.Table:
    root = _roots(near)
    tied = root != np.arange(len(node))
    return pa.table({"a": pa.array(node[tied]), "b": pa.array(node[root[tied]])})


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold together what is linked within each pair of blocks: each set with the smallest it reaches there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, once = np.unique(table.column("node").to_numpy(), return_index=True)
        column = table.column("elements")
        packed = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in once]
        sizes = np.array([len(x) for x in packed])
        common = _overlaps(packed).astype(np.int64)
        return _spanning(node, 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))

    return sets.groupBy(*_PAIR).applyInArrow(run, "a long, b long")


def _possible(dealt: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Like _linked, of all pairs whose sizes and sketches don't rule out a link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, once = np.unique(table.column("node").to_numpy(), return_index=True)
        size = table.column("size").to_numpy()[once]
        sketch = table.column("sketch")
        words = _folded([sketch[int(i)].as_py() for i in once])
        near = np.zeros((len(node), len(node)), bool)
        for at in range(0, len(node), 64):
            part = slice(at, at + 64)
            apart = np.bitwise_count(words[part, None] ^ words[None]).sum(2, dtype=np.int64)
            both = size[part, None] + size[None]
            near[part] = (100 + percent) * apart <= (100 - percent) * both
            near[part] &= 100 * np.minimum(size[part, None], size[None]) >= percent * np.maximum(size[part, None], size[None])
        return _spanning(node, near)

    return dealt.join(sketched, "node").groupBy(*_PAIR).applyInArrow(run, "a long, b long")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text; other columns are not read).

    A text's set holds its distinct shingles of `words` words (A-Z in lower case); a shorter
    text's whole word sequence is its one shingle. Texts link when their sets' Jaccard
    similarity is at least percent / 100; component_id is the smallest doc_id reachable.
    A null, empty or blank text has an empty set and links with nothing; rows without a
    doc_id take no part and have no component. Repeated rows are copies.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with shuffles_cleaned(spark):
        sized = saved(_sets(docs, words), "partenum-sized")
        ties = saved(_tied(docs.where("doc_id is not null"), words, percent), "partenum-ties", slim="heavy")
        known = sized.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
        # equal sets have equal sketches
        sketched = sized.where("node is not null and doc_id is not null").select("node", "doc_id", "sketch")
        classes = saved(known, "partenum-classes", slim="light")
        nodes = ties.select(F.col("a").alias("node")).union(ties.select("b")).distinct()
        start = saved(nodes.withColumn("label", F.col("node")), "partenum-labels", slim="light")
        # what shares signatures, directly or through others
        coarse = merged(saved(start, "partenum-coarse", slim="light"), ties)
        members = coarse.select("node", F.col("label").alias("whole")).join(classes, "node").select("node", "whole", "size", "doc_id")
        members = saved(members, "partenum-members", slim="light")
        # groups fall apart where sizes and sketches rule links out
        possible = members.select("node", "size", "doc_id").join(sketched, ["node", "doc_id"]).select("node", "size", "sketch")
        tied = saved(_possible(_dealt(members.select("node", "whole", "size"), percent, by_elements=False), possible, percent), "partenum-possible", slim="heavy")
        finer = merged(saved(members.select("node", F.col("node").alias("label")), "partenum-finer", slim="light"), tied)
        finer = saved(members.select("node", "size", "doc_id").join(finer, "node").select("node", F.col("label").alias("whole"), "size", "doc_id"), "partenum-members", slim="light")
        several = finer.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole")
        finer = finer.join(several, "whole", "left_semi")
        dealt = _dealt(finer.select("node", "whole", "size"), percent).join(finer.select("node", "doc_id"), "node")
        dealt = saved(dealt, "partenum-dealt", slim="light")
        links = saved(_linked(_elements(docs, dealt, words), percent), "partenum-links", slim="heavy")
        labels = merged(start, links)
        smallest = labels.join(classes, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = labels.join(smallest, "label").select("node", "component_id")
        result = classes.join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
        result = saved(result, "partenum-result", slim="light")
        for old in (ties, classes, coarse, members, tied, dealt, links, labels):
            drop(old)
    # empty sets have no node, and would all meet under one key
    named = sized.where("node is not null").select("doc_id", "n_shingles", "node").join(result, "node", "left")
    named = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return named.unionByName(sized.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is the smallest of its component; one of rows repeated in doc_id and text. Rows without a doc_id stay."""
    found = link_components(docs, words, percent)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    own = own.withColumn("__again", F.row_number().over(again)).where("__again = 1").select(*docs.columns)
    return own.unionByName(docs.where("doc_id is null"))
