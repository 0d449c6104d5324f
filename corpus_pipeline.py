"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; each result is written as Parquet and
read again. All stages but the last return the columns of documents.

Defined cases: rows whose doc_id is null, repeated rows, and further columns of any name go through every stage; a null or empty
text is never toxic, has no language and goes in the language stage; near copies tie to the least doc_id, then to a digest of
the row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.llm import lang_id, minhash, packing, secret_scan, toxicity
from scorelane.llm.common import Scratch, table
from scorelane.llm.queries import language_model, toxicity_model

MOST_TOXIC = 0.5  # documents with this score or more go
LANGUAGE_DIMS = 2048  # at 512 the scores of random letters reach those of clean documents
LEAST_LANGUAGE = 0.16  # what a long text must reach with some language; random letters score 0.1 at any length
SHORT = 30  # code points of distinct words of which nothing is asked; from there the bound grows with the length


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are likelier toxic than not."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct(*docs.columns).alias("doc"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.where(F.col("score") < MOST_TOXIC).select("doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter, or are like no language: the cosine of their distinct words with the nearest one is
    under LEAST_LANGUAGE * (1 - SHORT / size), size being the code points of these words, so the less text, the less is asked. A
    missing lang is filled in. Repeated words count once, else a word that stands everywhere in a text is all that is
    compared."""
    words = docs.select(F.struct(*docs.columns).alias("doc"), F.array_join(F.array_distinct(F.split("text", r"\s+")), " ").alias("words"))
    found = words.select("doc", F.length("words").alias("size"), lang_id.predict(language_model(docs, LANGUAGE_DIMS), F.col("words")).alias("p"))
    odd = (F.col("p.lang") == lang_id.UNKNOWN) | (F.col("p.score") < LEAST_LANGUAGE * (1 - SHORT / F.greatest("size", F.lit(1))))
    kept = found.where(~odd)
    return kept.select(*[(F.coalesce("doc.lang", "p.lang") if c == "lang" else F.col("doc")[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, null ids being greatest. Rows of the same
    doc_id and text are copies, rows of the same doc_id and another text are not."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("text"), F.struct(*docs.columns).alias("doc"))
    found = minhash.near_duplicates(keyed.select("key", "text"), key="key").select("key", "component_id").distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    kept = found.join(keyed.select("key", "id").distinct(), "key").groupBy("component_id").agg(least).select("least.key")
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that look live are cut out of their texts. Widely copied examples stay."""
    found = Scratch(spark, "pipeline-secrets").put(secret_scan.find_candidates(docs, repo=F.sha2("text", 256), keep=docs.columns), "found")
    scanned = secret_scan.scan_secrets(found, live_repos=secret_scan.FAMILY)
    text = secret_scan.redact(F.col("doc.text"), F.col("live"))
    cut = scanned.select("doc", F.when(F.size("live") > 0, F.struct(text.alias("text"))).alias("cut"))
    changed = {"text": F.col("cut.text"), "n_chars": F.length("cut.text").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[F.when(F.col("cut").isNotNull(), changed[c]).otherwise(F.col("doc")[c]).alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    out = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # learnt models, near duplicates and packing aren't expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
