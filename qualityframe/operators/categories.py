"""Logical types, value counts, and everything derived from value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profiling
from ..functions.cells import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXTUAL,
    col,
    columns_of,
    kind,
    q,
    safe_ratio,
    sketch_distinct,
)
from .scale import local_frame
from .structure import distinct_counts, look, value_groups

SKETCH_ERROR = 0.02  # above the 1.6 % standard error of the sketch
SKETCH_MARGIN = 6 * SKETCH_ERROR


def shape_exprs(name: str) -> dict[str, str]:
    """Non-null count, mean length and a distinct-count sketch of a text column."""
    c = q(name)
    return {
        "n": f"count({c})",
        "mean": f"avg(char_length({c}))",
        "approx": sketch_distinct(f"if({c} IS NULL, NULL, xxhash64({c}))"),
    }


def text_shape(df: DataFrame, names: list[str]) -> dict[str, dict]:
    return look(df, {c: shape_exprs(c) for c in names})


def string_type(n: int, mean_length: float | None, distinct: float, cfg: Profiling) -> str:
    if n == 0:
        return "text"
    few = distinct < cfg.categorical_unique_count or distinct / n < cfg.categorical_unique_ratio
    return "categorical" if (mean_length or 0) < cfg.text_mean_length and few else "text"


def sketched_types(df: DataFrame, cfg: Profiling, shape: dict) -> tuple[dict[str, str], list[str]]:
    """Logical types that schema and sketch settle, and the text columns they do not:
    those whose estimate lies within six standard errors of a limit."""
    out: dict[str, str] = {}
    close = []
    for f in df.schema.fields:
        k = kind(f.dataType)
        if k in (NUMERIC, BOOLEAN, DATETIME):
            out[f.name] = k
        elif k != TEXTUAL:
            out[f.name] = "unknown"
    for c in columns_of(df, TEXTUAL):
        s = shape[c]
        low, high = s["approx"] * (1 - SKETCH_MARGIN), s["approx"] * (1 + SKETCH_MARGIN)
        verdicts = {string_type(s["n"], s["mean"], d, cfg) for d in (low, high)}
        if len(verdicts) == 1:
            out[c] = verdicts.pop()
        else:
            close.append(c)
    return out, close


def infer_types(df: DataFrame, cfg: Profiling = Profiling(), shape: dict | None = None) -> dict[str, str]:
    """Logical type of every column; what the sketch leaves open is counted exactly."""
    if shape is None:
        shape = text_shape(df, columns_of(df, TEXTUAL))
    out, close = sketched_types(df, cfg, shape)
    if close:
        for row in distinct_counts(df, close).collect():
            s = shape[row.column]
            out[row.column] = string_type(s["n"], s["mean"], row.distinct_count, cfg)
    return out


def logical_types(df: DataFrame, cfg: Profiling = Profiling()) -> DataFrame:
    types = infer_types(df, cfg)
    dtypes = dict(df.dtypes)
    rows = [(c, dtypes[c], t) for c, t in sorted(types.items())]
    return local_frame(df.sparkSession, rows, "column string, dtype string, logical_type string")


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n, total, share): the frequency table of text columns.

    `total` comes from the counts themselves, one row per column.
    """
    text = df.select(*[col(c).cast("string").alias(c) for c in names])
    counts = value_groups(text, names)[0]
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").withColumn(
        "share", F.col("n") / F.col("total")
    )


def rare_categories(counts: DataFrame, cfg: Profiling = Profiling()) -> DataFrame:
    """Values below the rare share, as rows: their number has no bound."""
    return counts.where(F.col("share") < cfg.rare_category_threshold).select(
        "column", "value", "n", "share"
    )


def frequent_values(counts: DataFrame, threshold: float) -> DataFrame:
    """Values at or above a share; at most 1 / threshold per column."""
    return counts.where(F.col("share") >= threshold).select("column", "value")


def categorical_summary(counts: DataFrame, cfg: Profiling = Profiling()) -> DataFrame:
    """Cardinality, entropy, mode and rare share per column.

    Second aggregate over the value counts: partial sums per task, one row per
    column in the shuffle. Mode: highest count, smallest value on a tie.
    """
    n = F.col("n").cast("double")
    top = F.min(F.struct((-F.col("n")).alias("less"), F.col("value").alias("value")))
    base = counts.groupBy("column").agg(
        F.first("total").alias("non_null"),
        F.count(F.lit(1)).alias("cardinality"),
        F.sum(n * F.log2(n)).alias("nlogn"),
        top.alias("top"),
        F.count_if(F.col("share") < cfg.rare_category_threshold).alias("rare_count"),
    )
    total = F.col("non_null").cast("double")
    entropy = F.greatest(F.log2(total) - F.col("nlogn") / total, F.lit(0.0))
    evenness = F.when(F.col("cardinality") > 1, entropy / F.log2(F.col("cardinality"))).otherwise(
        entropy
    )
    mode_ratio = -F.col("top.less") / total
    return base.select(
        "column",
        "non_null",
        "cardinality",
        entropy.alias("entropy"),
        F.col("top.value").alias("mode"),
        mode_ratio.alias("mode_ratio"),
        mode_ratio.alias("dominance_ratio"),
        "rare_count",
        safe_ratio(F.col("rare_count"), F.col("cardinality")).alias("outlier_ratio"),
        (F.lit(1.0) - evenness).alias("imbalance"),
    )


def categorical_profile(df: DataFrame, names: list[str], cfg: Profiling = Profiling()) -> DataFrame:
    d = cfg.rounding
    return categorical_summary(value_counts(df, names), cfg).select(
        "column",
        "cardinality",
        F.round("entropy", d).alias("entropy"),
        "mode",
        F.round("mode_ratio", d).alias("mode_ratio"),
        F.round("dominance_ratio", d).alias("dominance_ratio"),
        "rare_count",
    )


def categorical_behavior(df: DataFrame, names: list[str], cfg: Profiling = Profiling()) -> DataFrame:
    """Rare share of the labels; unevenness used for both tail and variance."""
    d = cfg.rounding
    return categorical_summary(value_counts(df, names), cfg).select(
        "column",
        F.round("outlier_ratio", d).alias("outlier_ratio"),
        F.round("imbalance", d).alias("heavy_tail_score"),
        F.round("mode_ratio", d).alias("multimodality_score"),
        F.round("imbalance", d).alias("low_variance_indicator"),
    )
