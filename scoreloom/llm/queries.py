"""The subpackage's queries over the synthetic tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, blob_ledger, crf_training, hash_tree, license_search, line_quality, line_rules, partenum, poisson_mix, segment_bpe, warc
from ._io import drop, fresh, read, shuffles_cleaned
from .oracle import SQL


def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_rules.judge(docs, crf_training.fit_lines(docs, read(spark, sf_dir, "labels"), bags=True))


def op2_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first knows the English documents, the second all of them, and scans what the ledger lacks."""
    ledger = fresh(spark, "ledger")
    versions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", "lang")
    with shuffles_cleaned(spark):
        drop(blob_ledger.update(versions.where("lang = 'en'"), ledger))
        paths = blob_ledger.update(versions, ledger)
    out = blob_ledger.by_path(paths, blob_ledger.by_blob(blob_ledger.findings(spark, ledger)))
    base = F.filter("spans", lambda x: x["rule"].isin(*blob_ledger.BASE))
    counts = [F.size(F.filter(F.transform("spans", lambda x: x["rule"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in blob_ledger.BASE]
    return out.select(F.col("path").alias("doc_id"), *counts, F.sha2(blob_ledger.joined(base), 256).alias("base_sha256"), blob_ledger.joined(F.col("spans")).alias("spans"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = crf_training.fit_lines(docs, read(spark, sf_dir, "labels"), line_quality.fold() != line_quality.HELD_OUT)
    scored = line_quality.score(docs, model)
    return scored.select("doc_id", (line_quality.fold() == line_quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.link_components(read(spark, sf_dir, "documents"), words=4, percent=85)


def op6_license_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_search.search(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["errors"].cast("string"))), ",")
    return out.withColumn("spans", spans)


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(read(spark, sf_dir, "documents"), 8)


def op8_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = segment_bpe.encode(read(spark, sf_dir, "documents"), path, and_decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "text", F.round("rate", 6).alias("rate"), "n_copies", "copy", F.round("shuffle_key", 9).alias("shuffle_key"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path).select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))


QUERIES = {
    f.__name__: f
    for f in (op1_line_rules, op2_anisotropic, op3_blob_ledger, op4_line_quality, op5_partenum, op6_license_search, op7_hash_tree, op8_segment_bpe, op9_poisson_mix, op10_warc)
}

__all__ = ["QUERIES", "SQL"]
