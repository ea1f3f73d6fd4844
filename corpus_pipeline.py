"""From raw documents to training rows: five stages, each a written table that the next one reads.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe, decontam, langid, neardup, secrets
from skarn.llm.common import durable, table
from skarn.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text, or no letter) go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies (five-word shingles, similarity 0.8) stays: one with the smallest id.

    Rows with a null id stay, and texts without words, which are linked with nothing. Each row is a document: rows that
    share an id and hold different texts fall by their own groups, and of equal rows one stays.
    """
    found = durable(neardup.group(docs, k=5, percent=80), "near-duplicates")
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": neardup.text_key(F.col("text"))})
    lost = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    out = keyed.join(lost.hint("merge"), ["__id", "__key"], "left_anti").select(docs.columns)
    # Several rows of a group share its smallest id only where ids repeat: then one of them is chosen.
    several = found.where("kept and root is not null").groupBy("root").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
    if not several.isEmpty():
        fate = found.join(several, "root").where("kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), (F.col("key") == F.col("least")).alias("__first")).distinct()
        keyed = out.withColumns({"__id": F.col("doc_id").cast("long"), "__key": neardup.text_key(F.col("text"))}).join(fate.hint("merge"), ["__id", "__key"], "left")
        first = keyed.where("__first").groupBy("__id", "__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
        out = keyed.where("__first is null").select(docs.columns).union(first)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go; proximity matches alone don't count.

    A row with a null id can't be named by the matches and stays.
    """
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select("doc_id").distinct()
    return docs.join(hit.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the new text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as digests, after encoding and decoding."""
    return bpe.round_trip(docs, bpe.Bpe.from_file(tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("bpe", encode),
]

#: A learned classifier and BPE merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
