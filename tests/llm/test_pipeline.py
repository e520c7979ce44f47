"""The corpus pipeline, stage by stage, against plain versions."""

import collections
import hashlib
import math

import corpus_pipeline
import pandas as pd
import pytest
from test_group_ops import plain_components, plain_spans
from test_text_ops import plain_poisson

from scoreloom.llm import crf_training, line_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    frames = [pd.read_parquet(f"{SF}/documents.parquet")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        frames.append(docs.toPandas())
    return frames


def rows(frame):
    return collections.Counter(map(tuple, frame.itertuples(index=False)))


def test_columns(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf_training.fit_lines(docs, spark.read.parquet(f"{SF}/labels.parquet"), line_quality.fold() != line_quality.HELD_OUT)
    good = {r.doc_id for r in line_quality.score(docs, model).collect() if r.score >= 0.5}
    assert rows(stages[1]) == rows(stages[0][stages[0].doc_id.isin(good)])
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = set(labels[labels.quality == 1].doc_id)
    assert len(clean & set(stages[1].doc_id)) >= 0.97 * len(clean & set(stages[0].doc_id))


def test_near_copies(stages):
    want = plain_components(list(zip(stages[1].doc_id, stages[1].text)), 5, 80)
    first = {d for d, (_, c) in want.items() if d == c}
    assert rows(stages[2]) == rows(stages[1][stages[1].doc_id.isin(first)])


def test_secrets(stages):
    def masked(t):
        at, kept = 0, ""
        for a, _, _, b in plain_spans(t):
            if a >= at:
                kept += t[at:a] + "[secret]"
            at = max(at, b)
        return kept + t[at:]

    want = stages[2].copy()
    want["text"] = want.text.map(masked)
    want["n_chars"] = want.text.str.len()
    assert rows(stages[3]) == rows(want)


def test_mixing(stages):
    size = stages[3].assign(n=stages[3].text.str.len()).groupby("source").n.sum()
    share = size**0.5 / (size**0.5).sum()
    rate = share * size.sum() / size
    want = collections.Counter()
    for row in stages[3].itertuples(index=False):
        u = (int(hashlib.md5(f"mix-1/{row.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[tuple(row)] += plain_poisson(rate[row.source], u)
    assert rows(stages[4]) == +want
    order = [int(hashlib.md5(f"mix-1/order/{d}/1".encode()).hexdigest()[:13], 16) for d in stages[4].doc_id]
    assert not math.isclose(len(order), 0) and order != sorted(stages[4].doc_id)


def test_encoding(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for row in stages[4].itertuples():
        want[row.doc_id, tuple(library.encode(row.text, add_special_tokens=False).ids)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in stages[5].itertuples()) == want
    assert (stages[5].n_tokens == stages[5].ids.map(len)).all()


def test_decoding(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(stages[5])
    for row in stages[5].itertuples():
        text = library.decode(list(row.ids), skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
