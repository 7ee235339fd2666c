"""The corpus pipeline: toxicity, near-duplicates, decontamination, pseudonyms, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again, so a lost executor costs at most the stage that runs, and a result goes once the next is written. All stages but the last return the columns of ``documents``.

Defined results: null and empty texts are kept by the filters (they are neither toxic, nor linked, nor contaminated), pass the pseudonyms as they are, and have no tokens; an empty table
passes through; columns beyond those of ``documents``, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, neardup, pii, toxicity
from tessera.llm.common import Scratch, held_out, table, unused, without
from tessera.llm.queries import pii_key, tokenizer_path

#: No SQL expresses the trained classifier's or the tokenizer's stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None
#: Links of the near-duplicate stage: 100 * intersection >= PERCENT * union.
PERCENT = 80


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the classifier's threshold. The labels of held-out rows teach nothing."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out(F.col("doc_id")))
    score = unused("score", docs)
    return toxicity.score(docs, model, into=score).where(F.col(score) < toxicity.THRESHOLD).select(*_columns(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row of the least doc_id (of rows that repeat it with an equal text, one); documents without words are all kept."""
    return neardup.representatives(docs, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a full window (``decontam.WINDOW`` words) of a benchmark item.

    An item of fewer words is one short window, which clean texts may have by chance ("the end"), so such items count only where a document has two of them.
    """
    digest, scratch = unused("digest", docs), Scratch(spark, "contaminated")
    named = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    found = decontam.decontaminate(named.select(F.col(digest).alias("key"), "text"), table(spark, sf_dir, "benchmark"), key="key", scratch=scratch)
    bad = found.where((F.size("whole_items") > 0) | (F.size("items") >= 2)).select(F.col("key").alias(digest)).distinct()
    bad = scratch.write(bad, "bad")
    scratch.drop("index")
    return without(named, bad, [digest]).select(*_columns(docs))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values in their texts replaced by pseudonyms of the same format; n_chars is the new text's."""
    out = pii.pseudonymise(docs, pii_key(spark), n_found=unused("n_found", docs), kinds=unused("kinds", docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*_columns(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of all documents."""
    return bpe.roundtrip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents``."""
    scratch, docs, last = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
