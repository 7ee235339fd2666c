"""The corpus operators' registered queries, each over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, neardup, pii, quality, sharding, sql, topk, toxicity, urlfilter, warc
from tessera.llm.common import table


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


#: The session's setting that holds the key of op4 and of the pipeline. Its name makes Spark's UI hide it.
PII_KEY = "spark.tessera.pii.secret"


def pii_key(spark: SparkSession) -> str:
    """The session's key. Where none is set, one is drawn for the session: pseudonyms are then linked within it only, and nobody can invert them later."""
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(16))
    return spark.conf.get(PII_KEY)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_found", "kinds")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    whole = F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", *whole)


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.fetch_times(table(spark, sf_dir, "pages").select("page_id", "url"))
    return urlfilter.evaluate(captures, urlfilter.entries(spark))


def tokenizer_path() -> str:
    """The tokenizer of op8 and of the pipeline's last stage."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), digest.alias("items_sha256"), (n >= 2).alias("contaminated"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return dict(sql.ORACLE)
