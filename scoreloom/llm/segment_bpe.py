"""Byte pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves hold rank and place of each pair of neighbours, inner nodes the smaller child,
so the root is the leftmost pair of the lowest rank; a merge changes three leaves, each in
logarithmic time. Pieces never cross white space, so what stands between white space is
encoded once and remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _text as T

_NONE = 1 << 62
#: Remembered strings a generation and worker; two generations are kept.
MEMORY = 300_000


def merge(ids: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Merges the leftmost pair of the lowest rank until no pair of neighbours has one. ranks: pair -> rank << 32; made: rank -> id of the merged symbol."""
    n = len(ids)
    if n < 2:
        return ids
    ids, get = list(ids), ranks.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    # a leaf is rank and place, or _NONE and more
    leaves = [get(pair, _NONE) + i for i, pair in enumerate(zip(ids, ids[1:]))]
    tree = [_NONE] * width + leaves + [_NONE] * (width - n + 1)
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        new = ids[i] = made[root >> 32]
        k = after[i] = after[j]
        # the leaves of the pairs that are gone or changed
        changed = [(width + j, _NONE)] if j < n - 1 else []
        if k < n:
            before[k] = i
            changed.append((width + i, get((new, ids[k]), _NONE) + i))
        else:
            changed.append((width + i, _NONE))
        if (h := before[i]) >= 0:
            changed.append((width + h, get((ids[h], new), _NONE) + h))
        for at, value in changed:
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: visible ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class _Memory(dict):
    """chunk -> packed ids, made when missing."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


# The normaliser, the splitter and the settings of a file that Codec reads.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SETTINGS = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def unfit(held: dict) -> list[str]:
    """What of a tokenizer file Codec would not follow."""
    out = [name for name, wanted in (("normalizer", NORMALIZER), ("pre_tokenizer", SPLITTER), ("decoder", None)) if held.get(name) != wanted]
    model = held.get("model") or {}
    out += [f"model.{name}" for name, wanted in SETTINGS.items() if (model.get(name) or None) != (wanted or None)]
    for x in held.get("added_tokens") or []:
        if any(x.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")) or not x["content"].startswith("<|") or not x["content"].isascii() or re.search(r"\s", x["content"]):
            out.append(f"added token {x['content']!r}")
    letters = set(_byte_letters())
    lacking = letters - set(model.get("vocab") or {}) or {x for x in letters if x + (model.get("end_of_word_suffix") or "") not in model["vocab"]}
    return out + [f"{len(lacking)} bytes without a symbol"] * bool(lacking)


class Codec:
    """Encoder and decoder of one tokenizer file (BPE over byte letters, an end-of-word suffix, white space dropped). Raises ValueError for a file that asks for anything else."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        held = json.loads(text)
        if found := unfit(held):
            raise ValueError(f"this codec doesn't follow {', '.join(found)} of the tokenizer file")
        model = held["model"]
        library = Tokenizer.from_str(text)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        vocab = self.vocab
        self.ranks, self.made = {}, []
        for i, (a, b) in enumerate(pairs):
            self.ranks[vocab[a], vocab[b]] = i << 32
            self.made.append(vocab[a + b])
        self.letters = _byte_letters()
        self.simple = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self.pieces, self.chunks = _Memory(self._piece), _Memory(self._chunk)
        # white space of the normaliser: str.split() also parts at these four
        self.odd, self.spaces = re.compile("[\x1c-\x1f]"), re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def _piece(self, piece: str) -> bytes:
        """One word in byte letters."""
        symbols = list(piece)
        symbols[-1] += self.suffix
        ids = [self.vocab[x] for x in symbols]
        return np.array(merge(ids, self.ranks, self.made), np.int32).tobytes()

    def _plain(self, chunk: str) -> bytes:
        if chunk.isascii():
            words = self.simple.findall(chunk.lower())
            if not chunk.isprintable():
                words = ["".join(self.letters[b] for b in w.encode()) for w in words]
        else:
            words = [w for w, _ in self.cut(self.normalise(chunk))]
        return b"".join([self.pieces[w] for w in words])

    def _chunk(self, chunk: str) -> bytes:
        if self.specials is None or "<|" not in chunk:
            return self._plain(chunk)
        parts = (x for x in self.specials.split(chunk) if x)
        return b"".join(np.array([self.special[x]], np.int32).tobytes() if x in self.special else self._plain(x) for x in parts)

    def forget(self) -> None:
        """Empties the memories but for one generation of pieces; the worker may go on with other work."""
        self.chunks.old, self.pieces.old = {}, {}
        self.chunks.clear()

    def encode(self, text: str) -> np.ndarray:
        chunks = [x for x in self.spaces.split(text) if x] if self.odd.search(text) else text.split()
        out = np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), np.int32)
        self.chunks.trim()
        self.pieces.trim()
        return out


def token_names(held: dict) -> list[str | None]:
    """Of a tokenizer file: the name of each id."""
    names = {i: t for t, i in held["model"]["vocab"].items()} | {x["id"]: x["content"] for x in held["added_tokens"]}
    return [names.get(i) for i in range(max(names) + 1)]


def decoded(ids: pa.Array, names: pa.Array) -> pa.Array:
    """Texts of a list array of ids: the tokens' names with a space between, as the file has no decoder."""
    first, last = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
    offsets = pc.subtract(ids.offsets, ids.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets.cast(pa.int32()), names.take(ids.values.slice(first, last - first))), " ")


_codecs: dict[str, Codec] = {}
T.keeps(__name__, _codecs.clear)


def _codec(text: str) -> Codec:
    """One codec a worker process."""
    if text not in _codecs:
        _codecs.clear()
        _codecs[text] = Codec(text)
    return _codecs[text]


def encode(docs: DataFrame, tokenizer_path: str, and_decode: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs (doc_id, text; other columns are not read), special tokens neither added nor treated as text.

    A null or empty text has no ids. Repeated rows give repeated results, an empty table none.
    The file at tokenizer_path is read by the driver (a vocabulary of one or two MB) and sent
    along; one that Codec doesn't follow raises ValueError here. and_decode: adds what decode
    would, by the same workers in the same pass, so that a task keeps one of them.
    """
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    held = json.loads(text)
    if found := unfit(held):
        raise ValueError(f"segment_bpe doesn't follow {', '.join(found)} of {tokenizer_path}")
    sent = docs.sparkSession.sparkContext.broadcast((text, token_names(held) if and_decode else []))

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, names = sent.value
        codec, names = _codec(text), pa.array(names, pa.string())
        for batch in batches:
            rows, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(texts), 500):
                ids = [codec.encode(x or "") for x in texts.slice(at, 500).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                made = {"doc_id": rows.slice(at, 500), "ids": column} | ({"decoded": decoded(column, names)} if and_decode else {})
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))
        codec.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * and_decode)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and decoded of every row of encoded (doc_id, ids; other columns are not read): the text of its ids, special tokens included. Null and empty ids give the empty text."""
    held = json.loads(Path(tokenizer_path).read_text(encoding="utf-8"))
    if found := unfit(held):
        raise ValueError(f"segment_bpe doesn't follow {', '.join(found)} of {tokenizer_path}")
    # names alone: the worker that decodes needs neither ranks nor memories
    sent = encoded.sparkSession.sparkContext.broadcast(token_names(held))

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pc.fill_null(part.column("ids"), []) if part.column("ids").null_count else part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decoded(ids, names)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
