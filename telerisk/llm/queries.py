"""Registered queries of the operators for training data, with their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telerisk.llm import (collocations, credentials, decontaminate, ledger, licences, mixing, nearest, oracles, repeats, resampling, simhash, tokens, toxicity,
                           wrappers)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op6_rule_ledger", oracles.OP6)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.apply_policy(ledger.ledger(table(spark, sf, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@query("op8_simhash_groups")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op9_suffix_repeats")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeats(table(spark, sf, "documents")).drop("spans")


@query("op10_credential_links", oracles.OP10)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.scan(table(spark, sf, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op3_toxic_spans")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted", "spans")


@query("op7_pfair_mix")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source"))


#: a public vocabulary; another place can be named by this variable
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@query("op1_token_sections")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokens.attribute(docs, VOCABULARY).select(
        "row.doc_id", "n_tokens", F.explode_outer("sections").alias("s")).select(
        "doc_id", F.col("n_tokens").alias("doc_tokens"), "s.section", "s.start", "s.end", F.col("s.tokens").alias("n_tokens"), F.col("s.crossing").alias("n_crossing"))


@query("op5_wrapper_text")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf, "pages"))


@query("op2_latent_leaks")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_licence_notices")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents"))


@query("op11_rotated_codes", oracles.OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return nearest.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


@query("op12_collocations", oracles.OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query("op13_target_resampling")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
