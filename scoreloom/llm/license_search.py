"""Fuzzy search for short licence notices.

Texts are reduced to lower-case words one space apart. A notice that may differ in k
characters is cut into k + 1 pieces; at least one stands unchanged wherever the notice does
(pigeonhole), so exact finds of pieces give all candidate places. There the regex library
matches whole runs of words there with the notice, with at most k insertions, deletions and
substitutions. Where finds of different labels overlap, those of
the fewest errors stay, so versions of a licence that differ in a digit are told apart.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _text as T

# Phrases that count as they stand, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of well-known notices, as words, and their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("either version 2 of the license or at your option any later version", "gpl-2"),
    ("either version 3 of the license or at your option any later version", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd-3-clause"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd-2-clause"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("subject to the terms of the common development and distribution license", "cddl"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("to the extent possible under law the author has dedicated all copyright", "cc0"),
    ("licensed under the european union public licence", "eupl"),
)
#: Score of a phrase alone, without a notice.
PHRASE_SCORE = 0.5
#: One character in so many may differ.
PER_ERROR = 14


class Notice(NamedTuple):
    label: str
    text: bytes
    errors: int
    pieces: tuple[tuple[int, bytes], ...]  # place in the notice, piece
    pattern: object


def compiled(notices=NOTICES, per_error: int = PER_ERROR) -> list[Notice]:
    out = []
    for words, label in notices:
        text = words.encode()
        errors = max(1, len(text) // per_error)
        cut = [len(text) * i // (errors + 1) for i in range(errors + 2)]
        pieces = tuple((a, text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
        out.append(Notice(label, text, errors, pieces, regex.compile(b"(?b)(?:" + regex.escape(text) + b"){e<=%d}" % errors)))
    return out


class Reduced(NamedTuple):
    data: np.ndarray  # lower-case words one space apart, a line for each text
    source: np.ndarray  # place in the block of each byte
    line_starts: np.ndarray  # of each text, and the end
    starts: np.ndarray  # of words
    ends: np.ndarray


def reduced(block: T.Block) -> Reduced:
    n = len(block.offsets) - 1
    data = np.insert(T.LOWER[block.data], block.offsets[1:], 10)
    source = np.insert(np.arange(len(block.data)), block.offsets[1:], block.offsets[1:])
    ends = block.offsets[1:] + np.arange(n)
    out = np.where(T.NOT_ALNUM[data], 0x20, data).astype(np.uint8)
    out[ends] = 10
    gap = out <= 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~((out[1:] == 0x20) & gap[:-1])
    kept = np.flatnonzero(keep)
    solid = out[kept] > 0x20
    starts, ends = np.flatnonzero(solid & np.r_[True, ~solid[:-1]]), np.flatnonzero(solid & np.r_[~solid[1:], True]) + 1
    return Reduced(out[kept], source[kept], np.r_[0, np.flatnonzero(out[kept] == 10) + 1], starts, ends)


def _finds(data: bytes, piece: bytes) -> list[int]:
    out, at = [], data.find(piece)
    while at >= 0:
        out.append(at)
        at = data.find(piece, at + 1)
    return out


class Found(NamedTuple):
    doc: int
    label: str
    start: int  # in the reduced block
    end: int
    errors: int
    size: int


def notices_in(r: Reduced, data: bytes, notices: list[Notice]) -> list[Found]:
    """Runs of whole words with at most a notice's errors; of a notice's overlapping runs those of the fewest errors."""
    out, starts, ends = [], r.starts, r.ends
    for notice in notices:
        size, k = len(notice.text), notice.errors
        runs: set[tuple[int, int, int]] = set()
        for place, piece in notice.pieces:
            for at in _finds(data, piece):
                doc = int(np.searchsorted(r.line_starts, at, side="right")) - 1
                line, line_end = int(r.line_starts[doc]), int(r.line_starts[doc + 1]) - 1
                low, high = max(at - place - k, line), min(at - place + size + k, line_end)
                begins = starts[np.searchsorted(starts, low) : np.searchsorted(starts, at - place + k, side="right")]
                closes = ends[np.searchsorted(ends, at - place + size - k) : np.searchsorted(ends, high, side="right")]
                runs.update((doc, int(a), int(z)) for a in begins for z in closes if abs(z - a - size) <= k)
        found = []
        for doc, a, z in runs:
            if m := notice.pattern.fullmatch(data, a, z):
                found.append(Found(doc, notice.label, a, z, sum(m.fuzzy_counts), size))
        kept: list[int] = []  # starts of runs that stay, which don't overlap
        held: dict[int, int] = {}
        for f in sorted(found, key=lambda f: (f.errors, f.start, f.end)):
            i = bisect.bisect_right(kept, f.start)
            if (i == 0 or held[kept[i - 1]] <= f.start) and (i == len(kept) or kept[i] >= f.end):
                kept.insert(i, f.start)
                held[f.start] = f.end
                out.append(f)
    return _closest(out)


def _closest(found: list[Found]) -> list[Found]:
    """found without those that overlap one of another label with fewer errors."""
    found = sorted(found, key=lambda f: (f.start, f.end))
    longest = max((f.end - f.start for f in found), default=0)
    out = []
    for i, f in enumerate(found):
        beaten = False
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(found) and not beaten and abs(found[j].start - f.start) <= longest:
                g = found[j]
                beaten = g.label != f.label and g.errors < f.errors and g.start < f.end and f.start < g.end
                j += step
        if not beaten:
            out.append(f)
    return out


def scan_block(block: T.Block, notices: list[Notice]) -> dict[str, list]:
    r = reduced(block)
    n = len(block.offsets) - 1
    data = r.data.tobytes()
    starts = r.starts
    word_doc = np.searchsorted(r.line_starts, starts, side="right") - 1
    n_words = np.bincount(word_doc, minlength=n)
    before = np.r_[0, np.cumsum(n_words)]
    base: list[list[int]] = [[] for _ in range(n)]
    base_labels: list[set[str]] = [set() for _ in range(n)]
    spans: list[list[tuple]] = [[] for _ in range(n)]
    score = np.zeros(n)
    lead = np.r_[0, np.cumsum(T.LEAD[block.data])]

    def place(at: int, doc: int) -> int:
        return int(lead[r.source[at]] - lead[block.offsets[doc]])

    def end_place(at: int, doc: int) -> int:
        return int(lead[r.source[at - 1] + 1] - lead[block.offsets[doc]]) if at else 0

    for phrase, label in PHRASES:
        text = phrase.encode()
        for at in _finds(data, text):
            to = at + len(text)
            if (at == 0 or data[at - 1] <= 0x20) and (to == len(data) or data[to] <= 0x20):
                doc = int(np.searchsorted(r.line_starts, at, side="right")) - 1
                base[doc].append(int(np.searchsorted(starts, at)) - int(before[doc]))
                base_labels[doc].add(label)
                spans[doc].append((label, place(at, doc), end_place(to, doc), 0))
                score[doc] = PHRASE_SCORE
    labels = [set(x) for x in base_labels]
    for f in notices_in(r, data, notices):
        labels[f.doc].add(f.label)
        spans[f.doc].append((f.label, place(f.start, f.doc), end_place(f.end, f.doc), f.errors))
        score[f.doc] = max(score[f.doc], 1 - f.errors / f.size)
    return {
        "n_words": list(map(int, n_words)),
        "n_base": [len(x) for x in base],
        "first_word": [min(x, default=None) for x in base],
        "last_word": [max(x, default=None) for x in base],
        "base_labels": [",".join(sorted(x)) for x in base_labels],
        "labels": [",".join(sorted(x)) for x in labels],
        "score": list(map(float, score)),
        "spans": [[dict(zip(("label", "start", "end", "errors"), x, strict=True)) for x in sorted(set(s), key=lambda x: (x[1], x[2], x[0], x[3]))] for s in spans],
    }


def search(docs: DataFrame, notices=NOTICES, per_error: int = PER_ERROR) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, start, end in code points, errors) of every row of docs (doc_id, text; other columns are not read).

    A null text counts as empty: no words, no labels, score 0. score is the largest share of
    a notice's characters that are unchanged, PHRASE_SCORE for a phrase of PHRASES alone. One
    narrow pass over whole texts; repeated rows give repeated results, an empty table none.
    """
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64())]))
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(notices, per_error)
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                found = scan_block(block, own)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.rows.start, len(block.offsets) - 1), *(pa.array(v, types[k]) for k, v in found.items())], ["doc_id", *found])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,errors:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
