"""Words, lines and shingles of many texts at once, over UTF-8 bytes in numpy.

A block is a run of whole texts of about a megabyte; one longer text is a block of its
own, so memory follows the block or the longest text, never the batch or partition.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: [\x20\x09-\x0D]; bytes of longer UTF-8 sequences are all 0x80 and above.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: [\x00-\x2F\x3A-\x60\x7B-\x7F], for lower-cased texts.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
BREAK = byte_set((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First bytes of code points.
LEAD = (np.arange(256) & 0xC0) != 0x80


#: Of each operator that keeps something from task to task in a worker: how it is forgotten.
_kept: dict[str, Callable[[], None]] = {}
_worker = {"owner": ""}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """What a module keeps in a worker process goes when the worker takes up another module's work."""
    _kept[owner] = forget


def takes_up(owner: str) -> None:
    """A task of the module `owner` begins in this worker."""
    if _worker["owner"] != owner:
        _worker["owner"] = owner
        others = [forget for name, forget in _kept.items() if name != owner]
        for forget in others:
            forget()
        if others:
            gives_back()


def gives_back() -> None:
    """Freed memory goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run):
    """A task's function over batches that gives freed memory back to the machine when the task ends: workers live on for other stages."""
    owner = run.__module__

    @functools.wraps(run)
    def own(batches):
        takes_up(owner)
        try:
            yield from run(batches)
        finally:
            gives_back()

    return own


class Block(NamedTuple):
    rows: slice
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string array (null: empty) into blocks."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Block(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Spans(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # text in the block


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> Spans:
    """Maximal runs of bytes outside the set `apart`, within a text."""
    inside = ~apart[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, z = offsets[:-1][full], offsets[1:][full] - 1
    first[a] = inside[a]
    last[z] = inside[z]
    starts = np.flatnonzero(first)
    return Spans(starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1)


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """\\n-split lines, empty ones included; a text without bytes has one empty line."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    doc = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    owner = np.concatenate([np.arange(n), doc])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(0, int)
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:]
    return Spans(starts, ends, owner)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the bytes of one piece."""
    up, down = np.full(BLOCK_BYTES + 1, _BASE, np.uint64), np.full(BLOCK_BYTES + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _long_hash(data: np.ndarray) -> np.uint64:
    """The sum of one span longer than a piece, a piece at a time."""
    up, _ = _power_tables()
    total, shift = 0, 1
    for at in range(0, len(data), BLOCK_BYTES):
        piece = data[at : at + BLOCK_BYTES]
        total = (total + shift * int((_BYTE[piece] * up[: len(piece)]).sum(dtype=np.uint64))) % (1 << 64)
        shift = shift * pow(_BASE, BLOCK_BYTES, 1 << 64) % (1 << 64)
    return np.uint64(total)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands. Spans are in order and don't overlap; memory follows BLOCK_BYTES."""
    up, down = _power_tables()
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = max(int(np.searchsorted(ends, begin + BLOCK_BYTES, side="right")), at + 1)
        end = int(ends[to - 1])
        if end - begin > BLOCK_BYTES:
            out[at] = _long_hash(data[begin:end])
        else:
            piece = data[begin:end]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * up[: len(piece)], out=total[1:])
            a = starts[at:to] - begin
            out[at:to] = (total[ends[at:to] - begin] - total[a]) * down[a]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * _LENGTH)


def pieces(data: np.ndarray, apart: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a text after bytes of the set `apart` into runs of about `limit` bytes; what holds none for longer is a run of its own."""
    at = 0
    while at < len(data):
        to = min(at + limit, len(data))
        if to < len(data):
            last = np.flatnonzero(apart[data[at:to]])
            if len(last):
                to = at + int(last[-1]) + 1
            else:
                while to < len(data):
                    found = np.flatnonzero(apart[data[to : to + limit]])
                    if len(found):
                        to += int(found[0]) + 1
                        break
                    to = min(to + limit, len(data))
        yield at, to
        at = to


def shingles(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a text, and the first word's index."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out + word_hash[at + j] * np.uint64(2 * j + 3))
    return out, at


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)


def seen_before(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether an earlier one of its text has the same key, and whether any other has. Entries are in text order."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    d, k = doc[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    again = same.copy()
    again[:-1] |= same[1:]
    out = np.empty((2, len(key)), bool)
    out[0, order], out[1, order] = same, again
    return out[0], out[1]


def repeated(key: np.ndarray) -> np.ndarray:
    """For each entry: whether an earlier one has the same key."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out
