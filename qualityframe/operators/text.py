"""Text shape: length and the share of digits, white space and special characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profiling
from ..functions.cells import (
    NOT_DIGITS,
    NOT_SPACES,
    NOT_SPECIAL,
    TEXTUAL,
    characters_left,
    col,
    columns_of,
    q,
)
from .scale import dealt, per_column


def text_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Whole texts, one scan. Characters are counted by removing runs of the others."""

    def stats(c: str) -> dict:
        size = f"char_length({q(c)})"

        def share(removed: str) -> str:
            return f"coalesce(try_divide(sum({characters_left(c, removed)}), sum({size})), 0D)"

        return {
            "avg_length": f"coalesce(avg({size}), 0D)",
            "length_std": f"CASE WHEN count({q(c)}) > 0 THEN stddev({size}) ELSE 0D END",
            "digit_ratio": share(NOT_DIGITS),
            "whitespace_ratio": share(NOT_SPACES),
            "special_char_ratio": share(NOT_SPECIAL),
        }

    return per_column(dealt(df.select(*[col(c) for c in names])), names, stats, batch=6)


def text_profile(
    df: DataFrame, names: list[str] | None = None, cfg: Profiling = Profiling()
) -> DataFrame:
    names = columns_of(df, TEXTUAL) if names is None else names
    out = text_stats(df, names)
    return out.select(
        "column", *[F.round(c, cfg.rounding).alias(c) for c in out.columns if c != "column"]
    )
