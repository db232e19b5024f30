"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns documents; between stages the rows are written as Parquet and reread.

Defined cases, the same for every stage: a null text counts as empty and stays null; a row
with a null id stays unless its text is toxic, a near copy of a kept one or leaked; repeated
rows share their fate but for near duplicates, of which one stays; an empty table gives an
empty table; texts are read whole; further columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qualityframe.llm import decontaminate, pieces, secret_scan, simhash, toxicity
from qualityframe.llm.common import stored, table
from qualityframe.llm.queries import PIECES


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model rejects."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; the documents stay."""
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of each text."""
    return pieces.with_pieces(docs, PIECES)


STAGES = [
    ("toxicity", clean),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", redact),
    ("pieces", tokenize),
]

#: Model fitting, fingerprints and token search have no SQL form; tests hold the stages
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
