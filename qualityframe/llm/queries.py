"""The registered queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    cap_filters,
    decontaminate,
    perplexity,
    personal_data,
    pieces,
    resample,
    secret_scan,
    sharding,
    simhash,
    token_files,
    toxicity,
    warc,
    whitening,
)
from .common import table


WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pieces(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return pieces.op1(table(spark, sf_dir, "documents"), model)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op2(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op3(table(spark, sf_dir, "pages"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.op4(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5(spark, sf_dir)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op7(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = WORDS) -> DataFrame:
    return token_files.op8(table(spark, sf_dir, "documents"), vocabulary)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9(table(spark, sf_dir, "documents"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.op10(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op12(table(spark, sf_dir, "embeddings"))


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pieces,
        op2_secret_scan,
        op3_warc,
        op4_personal_data,
        op5_toxicity,
        op6_decontaminate,
        op7_sharding,
        op8_token_files,
        op9_simhash,
        op10_perplexity,
        op11_resample,
        op12_whitening,
        op13_cap_filters,
    )
}
ORACLES: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op11_resample": resample.OP11_SQL}
