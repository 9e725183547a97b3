"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import (
    bpe, collocations, decontaminate, grader, jaccard, language, passages, piece_bpe, quality, secrets, token_files,
    url_filter, whitening,
)
from tallyfold.llm.sql import QUALITY_SQL, URL_SQL
from tallyfold.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The rules of op1 as (verdict, host, path).
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def _query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


@_query("op1_url_filter", URL_SQL)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(_table(spark, folder, "pages"), rules)


@_query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measure_quality(_table(spark, folder, "documents")).drop("char_distance", "word_distance")


@_query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.learn(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


@_query("op4_token_files")
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.tokenize(_table(spark, folder, "documents"))


@_query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, folder, "documents"))


@_query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_repeated(_table(spark, folder, "documents"))


@_query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"), k=3, percent=90)


@_query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    grader_ = grader.learn(docs, labels.select("doc_id", grade.alias("grade")))
    return grader.grade_documents(docs, grader_)


@_query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_table(_table(spark, folder, "documents"))


@_query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_query("op12_phrase_collocations")
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(_table(spark, folder, "documents"))


@_query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.encode_table(_table(spark, folder, "documents"))
