"""The registered queries of this subpackage and their DuckDB SQL, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, licenses, preference, pst, secrets, simhash, token_counts, winnow
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; it is opened by path on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), decoded=True))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["dice"], 6), x["start"], x["end"]))
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digest(preference.format_preferences(preference.reply_pairs(table(spark, sf_dir, "conversations"))))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_texts(table(spark, sf_dir, "documents"), whole_symbols=True)


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.edited_fingerprints(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(documents).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_license": op4_license,
    "op5_preference": op5_preference,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_winnow": op8_winnow,
    "op9_language_id": op9_language_id,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {"op5_preference": preference.ORACLE}
