"""Quality rules: counts over a text's words and lines, then the likeliest content/boilerplate labels of its lines.

A linear-chain conditional random field labels the lines by Viterbi decoding; a text
stays if lines of content hold at least `share` of the code points of its labelled lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _crf as C
from . import _text as T

_SYMBOLS = C._CLASSES[0] | C._CLASSES[1]
_SOLID = T.LEAD & ~T.SPACE
#: Share of content from which a text stays.
CONTENT_SHARE = 0.5


def counts(block: T.Block, limit: int = T.BLOCK_BYTES) -> dict[str, np.ndarray]:
    """Per text of a block: the base counts of words and symbols."""
    data, offsets = block.data, block.offsets
    n = len(offsets) - 1
    if n == 1 and len(data) > limit:
        return _long_counts(data, limit)
    words = T.spans(data, offsets, T.SPACE)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    key = T.hashes(data, words.starts, words.ends)
    triples, at = T.shingles(key, words.doc, 3)
    _, repeated = T.seen_before(words.doc[at], triples)
    covered = np.zeros(len(key), bool)
    for j in range(3):
        covered[at[repeated] + j] = True
    return {
        "n_words": T.per_doc(words.doc, n),
        "word_chars": T.per_doc(owner[_SOLID[data]], n),
        "n_symbols": T.per_doc(owner[_SYMBOLS[data]], n),
        "n_repeat_words": T.per_doc(words.doc[covered], n),
    }


def _long_counts(data: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """The counts of one long text, read in pieces; a hash a word is kept."""
    keys, chars, symbols = [np.zeros(0, np.uint64)], 0, 0
    for a, b in T.pieces(data, T.SPACE, limit):
        words = T.spans(data[a:b], np.array([0, b - a], np.int64), T.SPACE)
        keys.append(T.hashes(data[a:b], words.starts, words.ends))
        for at in range(a, b, limit):
            part = data[at : min(at + limit, b)]
            chars += int(_SOLID[part].sum())
            symbols += int(_SYMBOLS[part].sum())
    key = np.concatenate(keys)
    del keys
    covered = np.zeros(len(key), bool)
    if len(key) >= 3:
        triples = np.zeros(len(key) - 2, np.uint64)
        for j in range(3):
            triples = T.mix(triples + key[j : len(key) - 2 + j] * np.uint64(2 * j + 3))
        ordered = np.sort(triples)
        several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        for at in range(0, len(triples) if len(several) else 0, limit):
            part = triples[at : at + limit]
            place = np.minimum(np.searchsorted(several, part), len(several) - 1)
            found = np.flatnonzero(several[place] == part) + at
            for j in range(3):
                covered[found + j] = True
    return {name: np.array([x], np.int64) for name, x in (("n_words", len(key)), ("word_chars", chars), ("n_symbols", symbols), ("n_repeat_words", covered.sum()))}


def states(lines: C.Scored, model: C.Model) -> np.ndarray:
    """1 for each line of content, 0 for boilerplate."""
    return C.viterbi(lines.z, lines.doc, model.move)


def judge(docs: DataFrame, model: C.Model, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, n_lines, n_content, content_share, base_failed and kept of every row of docs (doc_id, text; other columns are not read).

    A null text counts as empty. A text without a labelled line has content_share null and
    no words, so fails the base. n_lines counts lines with a word, n_content those labelled
    content; ties of the labels go to content. Repeated rows give repeated results, an empty
    table none. One narrow pass: no shuffle, and memory of a block, or of a few numbers a
    line and a word of the longest text.
    """

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for block in T.blocks(batch.column("text")):
                own = counts(block)
                lines = C.scored(block, model)
                n = lines.n_docs
                own["n_dup_lines"] = np.bincount(lines.doc, lines.again, n)
                own["n_lines"] = np.bincount(lines.doc, minlength=n)
                content = states(lines, model)
                own["n_content"] = np.bincount(lines.doc, content, n)
                held = C.weighted_mean(lines, content, np.nan)
                failed = (own["n_words"] < 50) | (100 * own["n_repeat_words"] > 50 * own["n_words"])
                arrays = [ids.slice(at, n), *(pa.array(v.astype(np.int64)) for v in own.values()), pa.array(held, from_pandas=True), pa.array(failed), pa.array(~failed & (np.nan_to_num(held, nan=0.0) >= share))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *own, "content_share", "base_failed", "kept"])
                at += n

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_repeat_words long, n_dup_lines long, n_lines long, n_content long, content_share double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
