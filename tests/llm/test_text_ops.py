"""Operators over texts: against plain versions, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import _crf as C
from scoreloom.llm import _text as T
from scoreloom.llm import crf_training, hash_tree, license_search, line_quality, line_rules, poisson_mix, queries, segment_bpe

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\r\n"),
    (4, "one"),
    (5, "A b a b a b a b\nA b a b\n\nA b a b"),
    (6, "é 日本  x |#*$%&<> \x1c \x85 end"),
    (7, "w" * 300_000),
    (8, "the cat sat on the mat. " * 20_000),
    (9, "same"),
    (9, "same"),
    (None, "no id"),
    (10, "\n".join(f"line {i % 7}" for i in range(50))),
]
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Texts that are odd, with columns named like results."""
    return spark.createDataFrame([(i, t, 0.5, "x", 7) for i, t in ODD], "doc_id long, text string, score double, n_words string, ids int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def model(seed=0):
    rng = np.random.default_rng(seed)
    return C.Model(rng.normal(size=C.WIDTH), rng.normal(size=(2, 2)))


def base_counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_line_rules_counts(odd, none):
    rows = line_rules.judge(odd, model()).collect()
    assert len(rows) == len(ODD) and line_rules.judge(none, model()).count() == 0
    want = collections.Counter((i, *base_counts(t or "")) for i, t in ODD)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and (r.content_share is None) == (r.n_words == 0)


def brute_chain(emit, move):
    """Marginals of 1, the best path and the log partition by enumeration."""
    n = len(emit)
    scores = {}
    for bits in range(2**n):
        path = [(bits >> i) & 1 for i in range(n)]
        scores[tuple(path)] = sum(emit[i][s] for i, s in enumerate(path)) + sum(move[a][b] for a, b in zip(path, path[1:]))
    top = max(scores.values())
    z = sum(math.exp(v - top) for v in scores.values())
    good = [sum(math.exp(v - top) for p, v in scores.items() if p[i]) / z for i in range(n)]
    return good, max(scores, key=scores.get), top + math.log(z)


@pytest.mark.parametrize("width", [1, 2, 3, 512])
def test_chain_against_enumeration(width):
    rng = np.random.default_rng(1)
    lengths = [1, 5, 2, 7, 3, 11]
    doc = np.repeat(np.arange(6), lengths)
    z, move = rng.normal(size=len(doc)) * 3, rng.normal(size=(2, 2))
    good, pairs, log_z = C.forward_backward(z, doc, move, width)
    assert np.allclose(C.marginals(z, doc, move, width), good)
    path = C.viterbi(z, doc, move, width)
    wanted, wanted_pairs = 0.0, np.zeros((2, 2))
    for d in range(6):
        at = doc == d
        g, p, partition = brute_chain([(0.0, x) for x in z[at]], move)
        assert np.allclose(good[at], g) and tuple(path[at]) == p
        wanted += partition
    assert np.isclose(log_z, wanted) and np.isclose(pairs.sum(), len(doc) - 6)
    # pair sums are the slopes of the log partition
    for a in (0, 1):
        for b in (0, 1):
            moved = move.copy()
            moved[a, b] += 1e-5
            wanted_pairs[a, b] = (C.forward_backward(z, doc, moved, width)[2] - log_z) / 1e-5
    assert np.allclose(pairs, wanted_pairs, atol=1e-3)


def test_chain_gradient():
    rng = np.random.default_rng(2)
    own = (C._BEGINS[:-1] + rng.integers(0, 2, (18, C.INPUTS))).astype(np.uint8)
    lines = C.Lines(np.repeat(np.arange(6), 3), np.ones(18), own, 6)
    label = np.array([0, 1, 1, 0, 1, 0])
    fitted = C.fit(lines, label[lines.doc], rounds=60)
    score = C.weighted_mean(lines, C.marginals(fitted.emit(lines), lines.doc, fitted.move), 0.5)
    assert ((score > 0.5) == (label == 1)).all()


def as_block(*texts):
    return next(T.blocks(pa.array(texts)))


def test_long_texts_in_pieces():
    """A text read in pieces gives what it gives whole: counts, scores, states, hashes."""
    rng = random.Random(3)
    words = ["alpha", "beta!!", "g", "| x", "ÉÉ", "***", "12,5", "w" * 90]
    m = model(5)
    for lines in (1, 3, 400):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(lines)) + "\n"
        block = as_block(text)
        whole, parts = C.scored(block, m), C.scored(block, m, limit=64)
        assert np.allclose(whole.z, parts.z, atol=1e-4) and (whole.again == parts.again).all() and (whole.length == parts.length).all()
        a, b = line_rules.counts(block), line_rules.counts(block, limit=64)
        assert {k: list(v) for k, v in a.items()} == {k: list(v) for k, v in b.items()}
    long = np.frombuffer(("x" * 3_000_000 + " " + "x" * 3_000_000 + " y").encode(), np.uint8)
    spans = T.spans(long, np.array([0, len(long)]), T.SPACE)
    h = T.hashes(long, spans.starts, spans.ends)
    assert h[0] == h[1] != h[2] and h[2] == T.hashes(np.array([121], np.uint8), np.array([0]), np.array([1]))[0]
    cut = T.hashes(np.r_[long[:3_000_000]], np.array([0, 1_000_000]), np.array([1_000_000, 3_000_000]))
    assert cut[0] == T.hashes(long[:1_000_000], np.array([0]), np.array([1_000_000]))[0]


@pytest.mark.parametrize("text", ["ab c\n" * 2_000_000, "a\n" * 5_000_000, "some words " * 900_000, "w" * 10_000_000])
def test_long_texts_memory(text):
    """Ten MB of short lines, or of one line, need some 30 bytes a byte of text at the most."""
    import tracemalloc

    block, m = as_block(text), model(6)
    C.scored(as_block("x y\n" * 10), m)
    tracemalloc.start()
    line_rules.counts(block)
    lines = C.scored(block, m)
    C.text_score(m, lines)
    line_rules.states(lines, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(text)


CLEAN = "The river carried the boats down to the harbour, where merchants waited with their wares and the children watched."
JUNK = ["BUY!! NOW!! FREE!! OFFER!! CLICK!! HERE!!", "a | b | c | d | e | f | g | h | i | j", "*** $$$ &&& ### *** $$$ &&& ### *** $$$"]


def test_fields_of_lines_from_labels_of_texts(spark):
    """Good texts with junk lines and bad ones with clean lines: lines are told apart, shares lie inside (0, 1)."""
    rng = random.Random(4)
    vocabulary = CLEAN.replace(",", "").replace(".", "").split()

    def clean():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 25))).capitalize() + "."

    texts, label, truth = [], [], []
    for i in range(300):
        good = i % 3 > 0
        odd = {rng.randrange(8) for _ in range(rng.randrange(0, 3))}
        kinds = [good != (k in odd) for k in range(8)]
        texts.append("\n".join(clean() if k else rng.choice(JUNK) for k in kinds))
        label.append(int(good))
        truth += kinds
    block = as_block(*texts)
    lines = C.line_inputs(block)
    m = C.fit_bags(lines, np.array(label))
    states = C.viterbi(m.emit(lines), lines.doc, m.move)
    assert (states == np.array(truth)).mean() > 0.99
    share = C.weighted_mean(lines, states, np.nan)
    assert ((share > 0) & (share < 1)).sum() > 150
    mixed = "\n".join([CLEAN, JUNK[0], CLEAN, CLEAN, JUNK[2], JUNK[1]])
    own = C.scored(as_block(mixed), m)
    assert list(line_rules.states(own, m)) == [1, 0, 1, 1, 0, 0]
    junk = "\n".join([*JUNK, *JUNK, CLEAN, *JUNK])
    rows = line_rules.judge(spark.createDataFrame([(1, "\n".join([mixed] * 3)), (2, junk), (3, CLEAN)], "doc_id int, text string"), m).collect()
    assert [(r.doc_id, r.n_lines, r.n_content, r.base_failed) for r in rows[1:]] == [(2, 10, 1, True), (3, 1, 1, True)]
    assert 0.5 < rows[0].content_share < 1 and rows[0].n_content == 9 and 0 < rows[1].content_share < 0.5


def test_line_quality_odd_and_labels(spark, odd, none):
    m = model()
    rows = line_quality.score(odd, m).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and line_quality.score(none, m).count() == 0
    empties = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empties) == 1
    kept = line_quality.keep_good(odd, m, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    labels = spark.createDataFrame([(1, 1), (None, 0), (5, None), (8, 0), (8, 1), (10, 3)], "doc_id long, quality int")
    lines, label = crf_training.labelled_sample(odd, labels)
    assert sorted(label) == [1, 1] and lines.n_docs == 2
    assert crf_training.fit_lines(none, labels).prior == 0.5
    assert crf_training.labelled_sample(odd, labels, limit=1)[0].n_docs == 1


def test_line_quality_held_out(spark):
    out = queries.op4_line_quality(spark, SF).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.index]).all()
    both = out.join(labels, how="inner")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.97
    rules = queries.op1_line_rules(spark, SF).toPandas().set_index("doc_id").join(labels, how="inner")
    rules = rules[~rules.base_failed]
    assert rules[rules.quality == 1].kept.mean() > 0.97 and rules[rules.quality == 0].kept.mean() < 0.2
    inside = (rules.content_share > 0) & (rules.content_share < 1)
    assert inside.any() and (rules.n_content[inside] < rules.n_lines[inside]).all()


def test_rules_and_scores_against_plain(spark):
    """kept and score of every document, from enumerated chains of the texts' own lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(60)
    m = model(9)
    kept = {r.doc_id: r for r in line_rules.judge(docs, m).collect()}
    scores = {r.doc_id: r.score for r in line_quality.score(docs, m).collect()}
    for r in docs.collect():
        lines = C.line_inputs(as_block(r.text))
        z = m.emit(lines)
        if not 0 < len(z) <= 12:
            continue
        good, path, _ = brute_chain([(0.0, x) for x in z], m.move)
        length = lines.length.astype(float)
        share = float((length * np.array(path)).sum() / length.sum())
        assert np.isclose(kept[r.doc_id].content_share, share)
        assert kept[r.doc_id].kept == (not kept[r.doc_id].base_failed and share >= 0.5)
        mean = np.clip((length * np.array(good)).sum() / length.sum(), 1e-6, 1 - 1e-6)
        assert np.isclose(scores[r.doc_id], mean, atol=1e-6)


# ---- licences

FIND = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LICENCES = [
    (1, None),
    (2, "Released under the MIT License."),
    (3, "x Released under the MIT Lisense y"),
    (4, "CC BY cc-by CC/BY; excc by"),
    (5, "GNU General Public\n\nLicense, GNU  general,public.license"),
    (6, "Lizensed under the Apache Licnse, Version 2.0"),
    (7, "é released under the mit license é"),
    (8, "nothing here " * 5000),
    (9, ""),
    (9, ""),
    (10, "licensed under cc by"),
]


def test_license_base_and_fuzzy(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in LICENCES], "doc_id long, text string, labels string")
    rows = license_search.search(df).collect()
    assert len(rows) == len(LICENCES) and license_search.search(df.where("1=0")).count() == 0
    by = {r.doc_id: r for r in rows}
    for i, t in LICENCES:
        words = FIND.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        places = [(k, name) for p, name in license_search.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = by[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(t)
    assert by[3].base_labels == "" and by[3].labels == "mit" and 0 < by[3].score < 1
    assert LICENCES[2][1][by[3].spans[0].start : by[3].spans[0].end] == "Released under the MIT Lisense"
    assert by[6].labels == "apache" and by[2].score == 1.0 and by[8].score == 0.0 and by[10].score == license_search.PHRASE_SCORE


def plain_labels(text):
    """Labels by edit distance of every run of words with every notice; of overlapping finds with different labels the fewest errors."""
    words = FIND.findall(text.translate({k: k + 32 for k in range(65, 91)}))
    found = []
    for n in license_search.compiled():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if abs(len(run) - len(n.text)) <= n.errors and (d := edits(run.encode(), n.text)) <= n.errors:
                    found.append((i, j, n.label, d))
    stay = [f for f in found if not any(g[2] != f[2] and g[3] < f[3] and g[0] < f[1] and f[0] < g[1] for g in found)]
    return {f[2] for f in stay} | {name for p, name in license_search.PHRASES if f" {p} " in f" {' '.join(words)} "}, max((1 - f[3] / len(n.text) for f in stay for n in license_search.compiled() if n.label == f[2]), default=0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_license_labels_against_edit_distance(spark):
    texts = [
        "unreleased under the mit licenses x",
        "xreleased under the mit licensed",
        "released under the mit licens",
        "under the gnu general public license version 2 here",
        "under the gnu general public license version 3, or so",
        "either version 3 of the License, or (at your option) any later version.",
        "either version 2 of the Licence, or at your option any later version.",
        "licensed under cc by sa 4.0 and licensed under cc by nc 4.0",
        "made available under the terms of the Eclipse Public Licence",
        "distributed under the Boost Software License, Version 1.0.",
        "the mit license",
        "nothing",
    ]
    rows = license_search.search(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        assert set(filter(None, r.labels.split(","))) == plain_labels(texts[r.doc_id])[0], texts[r.doc_id]
        for s in r.spans:  # whole words only
            around = f" {texts[r.doc_id]} "
            assert not around[s.start].isalnum() and not around[s.end + 1].isalnum()
    assert rows[3].labels == "gpl,gpl-2" and rows[4].labels == "gpl,gpl-3" and rows[5].labels == "gpl-3" and rows[10].score == 0.5


def test_license_pigeonhole():
    """Every notice with as many edits as it may have is found."""
    rng = random.Random(4)
    for notice in license_search.compiled():
        for _ in range(20):
            text = list(notice.text.decode())
            for _ in range(notice.errors):
                # within words: a word that goes would take its space along
                at = rng.choice([i for i in range(1, len(text) - 1) if "".join(text[i - 1 : i + 2]).isalnum()])
                kind = rng.randrange(3)
                if kind == 0:
                    text[at] = rng.choice("abcxyz")
                elif kind == 1:
                    del text[at]
                else:
                    text.insert(at, rng.choice("abcxyz"))
            block = next(T.blocks(pa.array(["some words before " + "".join(text) + " and after"])))
            r = license_search.reduced(block)
            assert license_search.notices_in(r, r.data.tobytes(), [notice])


# ---- byte pair encoding


@pytest.fixture(scope="module")
def files():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def plain_merge(ids, ranks):
    ids = list(ids)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        if not found:
            return ids
        _, i = min(found)
        ids[i : i + 2] = [ranks[ids[i], ids[i + 1]][1]]


def test_segment_tree_against_plain():
    rng = random.Random(5)
    ranks = {(a, b): (r, 10 + r) for r, (a, b) in enumerate({(rng.randrange(20), rng.randrange(20)) for _ in range(60)})}
    made = [10 + r for r in range(len(ranks))]
    for _ in range(300):
        ids = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        assert segment_bpe.merge(ids, {k: r << 32 for k, (r, _) in ranks.items()}, made) == plain_merge(ids, ranks)


def test_codec_equals_library(files):
    path, library = files
    import json

    held = open(path, encoding="utf-8").read()
    codec, names = segment_bpe.Codec(held), pa.array(segment_bpe.token_names(json.loads(held)), pa.string())
    rng = random.Random(6)
    texts = [t or "" for _, t in ODD] + ["ΣΑΣ ΟΔΟΣ", "İI", "x<|endoftext|>y <|startoftext|>", "a　b\x85c\x1cd", "don't We'LL 12x", "é ́a", "🙂🙂 x🙂", "'tis"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x2000, 0x2100), rng.randrange(0xD7FF)])) for _ in range(50)) for _ in range(200)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t).tolist() == ids
        assert segment_bpe.decoded(pa.array([ids], pa.list_(pa.int32())), names)[0].as_py() == library.decode(ids, skip_special_tokens=False)


def test_bpe_frames(odd, none, files):
    path, library = files
    rows = segment_bpe.decode(segment_bpe.encode(odd, path), path).collect()
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    at_once = segment_bpe.encode(odd, path, and_decode=True).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in at_once) == collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows)
    assert segment_bpe.encode(none, path).count() == 0 and segment_bpe.encode(none, path, and_decode=True).count() == 0


# ---- sharding


def test_shards(odd, none):
    rows = hash_tree.shard(odd.withColumn("slot", F.lit("x"))).collect()
    assert len(rows) == len(ODD) and hash_tree.shard(none).count() == 0
    texts = collections.defaultdict(list)
    for i, t in ODD:
        texts[i].append((t or "").encode())
    for r in rows:
        assert any(r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) for t in texts[r.doc_id])
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_weighted_tree(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id")
    tree = [hash_tree.Leaf("a", "a1", 0, 1.0), hash_tree.Leaf("a", "a2", 1, 3.0), hash_tree.Leaf("b", "b1", 2, 4.0)]
    more = [*tree[:2], hash_tree.Leaf("b", "b1", 2, 6.0)]
    both = hash_tree.assign(hash_tree.assign(df, F.col("doc_id"), tree, "x"), F.col("doc_id"), more, "y").groupBy("x", "y").count().collect()
    share = collections.Counter()
    for r in both:
        share[r.x] += r["count"] / 40_000
        assert r.x == r.y or r.y == 2  # only into the subtree that gained weight
    assert abs(share[0] - 1 / 8) < 0.01 and abs(share[1] - 3 / 8) < 0.01 and abs(share[2] - 1 / 2) < 0.01
    with pytest.raises(ValueError):
        hash_tree.assign(df, F.col("doc_id"), [], "x")


def test_grown_layouts(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    out = hash_tree.assign(hash_tree.assign(df, F.col("doc_id"), hash_tree.layout(8), "x"), F.col("doc_id"), hash_tree.layout(9), "y")
    assert out.where("x != y and y != 8").count() == 0 and 400 < out.where("y = 8").count() < 720


# ---- mixing


def plain_poisson(rate, u):
    c = 0.0
    for k in range(int(rate + 20 * rate**0.5 + 50)):
        c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if c >= u:
            return k
    raise ValueError(rate)


def test_poisson_counts(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}" if i % 7 else None) for i in range(3000)], "doc_id long, text string, source string")
    rated = spark.createDataFrame([("s0", 0.3), ("s1", 2.0), ("s2", 40.0), (None, 0.0)], "source string, rate double")
    rows = poisson_mix.counted(docs, rated).collect()
    rate = {"s0": 0.3, "s1": 2.0, "s2": 40.0, None: 0.0}
    sums, n = collections.Counter(), collections.Counter()
    for r in rows:
        u = (int(hashlib.md5(f"mix-1/{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert r.n_copies == (plain_poisson(rate[r.source], u) if rate[r.source] else 0)
        sums[r.source] += r.n_copies
        n[r.source] += 1
    assert len(rows) == 3000
    for s in ("s0", "s1", "s2"):
        assert abs(sums[s] / n[s] - rate[s]) < 5 * math.sqrt(rate[s] / n[s])


def test_poisson_sql_of_high_rates(spark):
    docs = pd.DataFrame([(i, "x", f"s{i % 3}") for i in range(3)] + [(3, "y" * 1_000_000, "large"), (4, "z" * 500, None)], columns=["doc_id", "text", "source"])
    size = docs.assign(n=docs.text.str.len()).groupby("source", dropna=False).n.sum()
    rate = {None if pd.isna(k) else k: v for k, v in (size**0.5 / (size**0.5).sum() * size.sum() / size).items()}
    assert rate["s0"] > 900
    want = {}
    for r in docs.itertuples():
        u, m, upto, k = (int(hashlib.md5(f"mix-1/{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, rate[None if pd.isna(r.source) else r.source], 0.0, 0
        while (upto := upto + math.exp(k * math.log(m) - m - math.lgamma(k + 1))) < u:
            k += 1
        want[r.doc_id] = k
    con = duckdb.connect()
    con.register("documents", docs)
    found = collections.Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op9_poisson_mix']})").fetchall())
    assert found == collections.Counter({k: v for k, v in want.items() if v}) and max(want.values()) > 900
    assert collections.Counter(r.doc_id for r in poisson_mix.mix(spark.createDataFrame(docs.astype(object).where(docs.notna(), None), "doc_id long, text string, source string")).collect()) == found


def test_mix_targets_and_odd(spark, odd):
    docs = odd.withColumn("source", F.when(F.col("doc_id") > 5, "a").when(F.col("doc_id") > 2, "b")).withColumn("copy", F.lit("clash"))
    out = poisson_mix.mix(docs)
    assert set(docs.columns) - {"copy"} < set(out.columns)
    rows = out.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    per = collections.Counter((r.doc_id, r.text) for r in rows)
    assert all(per[r.doc_id, r.text] == r.n_copies * sum(x == (r.doc_id, r.text) for x in ODD) for r in rows)
    assert poisson_mix.mix(docs.where("1=0")).count() == 0
    weights = poisson_mix.rates(docs, {"a": 1.0}).collect()
    assert {r.source: r.rate > 0 for r in weights} == {"a": True, "b": False, None: False}


def test_codec_refuses_other_files(tmp_path, spark):
    import json

    import public_tokenizers

    held = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert segment_bpe.unfit(held) == []
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel"}}, {"model": held["model"] | {"unk_token": "!"}}, {"added_tokens": [held["added_tokens"][0] | {"lstrip": True}]}):
        assert segment_bpe.unfit(held | change)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(held | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    with pytest.raises(ValueError, match="normalizer"):
        segment_bpe.encode(spark.createDataFrame([(1, "x")], "doc_id int, text string"), str(other))


def test_mix_of_high_rates(spark):
    """A tiny source of a very high rate beside a large one: counts as the plain distribution says, every copy once."""
    docs = spark.createDataFrame([(i, "x" * 4000, "big") for i in range(30)] + [(100, "y", "tiny"), (101, None, "tiny"), (102, "", "none")], "doc_id long, text string, source string")
    out = poisson_mix.mix(docs, budget_rates(docs)).toPandas()
    rate = {r.source: r.rate for r in budget_rates(docs).collect()}
    assert rate["tiny"] > poisson_mix.COPIES and rate["none"] == 0
    for i, source in [(100, "tiny"), (101, "tiny"), (3, "big")]:
        u = (int(hashlib.md5(f"mix-1/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        own = out[out.doc_id == i]
        assert sorted(own["copy"]) == list(range(1, plain_poisson(rate[source], u) + 1))
    assert 102 not in set(out.doc_id)


def budget_rates(docs):
    return poisson_mix.rates(docs, {"big": 0.9, "tiny": 0.1})


def test_shards_of_many_equal_rows(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    out = hash_tree.shard(rows, 8).toPandas()
    assert out.shard.nunique() == 1 and sorted(out.slot) == list(range(20_000))


def test_workers_forget_other_work(spark, odd):
    """A codec stays in a worker between its own tasks, and goes when another operator's task begins there."""
    import public_tokenizers

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    codec = segment_bpe._codec(text)

    @T.tidied
    def other(batches):
        yield len(segment_bpe._codecs)

    T.takes_up(segment_bpe.__name__)
    assert segment_bpe._codec(text) is codec
    assert list(other([])) == [0]  # this test's module is another owner
    T.takes_up(segment_bpe.__name__)
    assert segment_bpe._codec(text) is not codec
