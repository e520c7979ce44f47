"""Fits the line fields on a bounded sample of labelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _crf as C
from . import _text as T

#: The most labelled texts that a fit reads, lines of a text that takes part, and lines in all. Fixed, so a fit costs the same at any size.
MAX_LABELLED, MAX_TEXT_LINES, MAX_LINES = 4000, 1000, 100_000


@T.tidied
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for block in T.blocks(batch.column("text")):
            n = len(block.offsets) - 1
            if len(block.data) > 4 * T.BLOCK_BYTES:  # one very long text
                at += n
                continue
            x = C.line_inputs(block)
            cut = np.searchsorted(x.doc, np.arange(n + 1))
            whole = np.diff(cut) <= MAX_TEXT_LINES
            own = [x.own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            length = [x.length[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column("h").slice(at, n), batch.column("label").slice(at, n), pa.array(own, pa.binary()), pa.array(length, pa.binary())], ["h", "label", "own", "length"])
            yield made.filter(pa.array(whole))
            at += n


def labelled_sample(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, limit: int = MAX_LABELLED) -> tuple[C.Lines, np.ndarray]:
    """Line inputs of at most `limit` texts with label 0 or 1, those with the smallest hash of doc_id.

    Rows of `labels` with a null or other label, or refused by `eligible`, take no part; of
    several labels of one doc_id the largest counts. Texts of more than MAX_TEXT_LINES lines
    or four blocks aren't learned from, nor what is beyond MAX_LINES lines in the order of
    the hash. Only inputs of lines reach the driver.
    """
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if eligible is not None:
        own = own.where(eligible)
    own = own.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    own = own.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    # at most `limit` rows of three numbers
    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("h", "label", "text")
    rows = found.mapInArrow(_packed, "h long, label int, own binary, length binary").collect()
    rows = sorted(rows, key=lambda r: (r["h"], bytes(r["own"]), bytes(r["length"]), r["label"]))[:limit]
    upto = np.cumsum([len(r["length"]) // 4 for r in rows])
    rows = rows[: int(np.searchsorted(upto, MAX_LINES, side="right"))]
    label = np.array([r["label"] for r in rows], int)
    counts = [len(r["length"]) // 4 for r in rows]
    inputs = np.frombuffer(b"".join(bytes(r["own"]) for r in rows), np.uint8).reshape(-1, C.INPUTS)
    length = np.frombuffer(b"".join(bytes(r["length"]) for r in rows), np.int32)
    return C.Lines(np.repeat(np.arange(len(rows)), counts), length, inputs, len(rows)), label


def fit_lines(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, limit: int = MAX_LABELLED, bags: bool = False) -> C.Model:
    """A field whose lines take their text's label, calibrated; with bags=True one that finds which lines of a text are unlike its label. With no labelled line at all, one that says the prior.

    Null and empty texts hold no line and teach only the prior; repeated rows count again;
    tables may be empty and hold further columns.
    """
    lines, label = labelled_sample(docs, labels, eligible, limit)
    if not len(lines.doc):
        return C.Model(np.zeros(C.WIDTH), np.zeros((2, 2)))
    return C.fit_bags(lines, label) if bags else C.fit_texts(lines, label)
