"""Stages that turn the documents into training tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import blob_ledger, crf_training, line_quality, partenum, poisson_mix, segment_bpe
from scoreloom.llm._io import fresh, read, saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good; fitted on labelled documents outside the held-out fold.

    A null, empty or blank text is scored by the sample's share of good ones; equal texts and
    repeated rows share their fate; a score of just 0.5 stays; empty tables give an empty one.
    """
    model = crf_training.fit_lines(docs, read(spark, sf_dir, "labels"), line_quality.fold() != line_quality.HELD_OUT)
    return line_quality.keep_good(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five words, 0.8).

    Null and empty texts are nobody's copy and stay, as do documents without a doc_id; of rows
    repeated in doc_id and text one stays; an empty table gives an empty one.
    """
    return partenum.first_of_groups(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; overlapping secrets by one.

    Null texts stay null and empty ones empty, n_chars null or 0 with them; repeated rows are
    masked alike; an empty table gives an empty one.
    """
    ledger = fresh(spark, "ledger")
    blob_ledger.update(docs.select(F.col("doc_id").alias("path"), "text"), ledger)
    masked = blob_ledger.redacted(docs, blob_ledger.by_blob(blob_ledger.findings(spark, ledger)))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a Poisson number with their source's target rate as mean says, in a global shuffle.

    A null source is a source, a null doc_id an id; rows of one doc_id are repeated equally
    often; a source without a character is left out; an empty table gives an empty one.
    """
    return poisson_mix.mix(docs).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each copy, and the digest of the text that the ids decode to.

    A null or empty text has no ids and decodes to the empty text; copies stay copies; an
    empty table gives an empty one.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    out = segment_bpe.encode(docs, path, and_decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]
#: SQL states neither the classifier nor the encoder; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents, each written and read again for the next."""
    out = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = saved(out, "pipeline") if k else out
        out = stage(spark, out, sf_dir)
    return out
