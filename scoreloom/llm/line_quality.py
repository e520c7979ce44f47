"""Quality classifier: a linear-chain conditional random field labels every line good or bad from its own and its neighbours' inputs.

Forward-backward marginals, weighted by the lines' lengths, aggregate into a score of the
text, calibrated on the labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _crf as C
from . import _text as T

#: The remainder of crc32(doc_id as text) by 3 whose labels are never learned from.
HELD_OUT = 1


def fold(column: str = "doc_id"):
    """The remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3


def _scores(texts: pa.Array, model: C.Model) -> np.ndarray:
    parts = [C.text_score(model, C.scored(b, model)) for b in T.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: C.Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text; other columns are not read).

    A null, empty or blank text scores as the sample's share of label 1, calibrated. Equal
    texts score equally, repeated rows give repeated results, an empty table none. One
    narrow pass over whole texts, without a shuffle.
    """

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: C.Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose text scores at least `least`; repeated rows share their fate, null and empty texts are scored by the prior."""

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), model) >= least))

    return docs.mapInArrow(run, docs.schema)
