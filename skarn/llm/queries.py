"""The queries of this subpackage over the sf tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe, chat, counts, decontam, idcodec, langid, neardup, secrets, spans, sql, topk
from skarn.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.Bpe.from_file(tokenizer_path("byte_bpe_50k.json")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), bpe.Bpe.from_file(tokenizer_path("word_bpe_49k.json")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = idcodec.write_ids(table(spark, sf_dir, "documents"), bpe.Bpe.from_file(tokenizer_path("byte_bpe_50k.json")))
    return idcodec.read_ids(frames, digest=True)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held))
    out = langid.predict(docs, model)
    return out.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(spans.remove(table(spark, sf_dir, "documents"), tails=True))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"), k=2, percent=80).drop("key", "root")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("n_near_items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_token_counts, op3_token_files, op4_secrets, op5_chat, op6_language, op7_span_dedup, op8_near_dup, op9_topk, op10_decontaminate)
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
