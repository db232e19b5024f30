"""Date and time columns: range and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Profiling
from ..functions.cells import DATETIME, col, columns_of, q
from .scale import ROWS_PER_SORT_TASK, materialize, per_column, range_bucket

DAY_MICROS = 86_400_000_000


def micros(name: str, data_type: T.DataType) -> str:
    """Microseconds since 1970 as bigint, the same for every session time zone."""
    c = q(name)
    if isinstance(data_type, T.DateType):
        return f"CAST(unix_date({c}) AS BIGINT) * {DAY_MICROS}L"
    if isinstance(data_type, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})"
    return f"unix_micros({c})"


def iso(value: str, data_type: T.DataType) -> str:
    """ISO 8601, fraction only when there is one; dates as midnight."""
    whole = f"date_format({value}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    if isinstance(data_type, T.DateType):
        return whole
    part = f"date_format({value}, 'SSSSSS')"
    return f"CASE WHEN {part} = '000000' THEN {whole} ELSE concat({whole}, '.', {part}) END"


def datetime_stats(df: DataFrame, names: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}

    def stats(c: str) -> dict:
        m = micros(c, types[c])
        return {
            "min": f"coalesce({iso(f'min({q(c)})', types[c])}, '')",
            "max": f"coalesce({iso(f'max({q(c)})', types[c])}, '')",
            "range_days": f"coalesce((max({m}) - min({m})) / {DAY_MICROS}D, 0D)",
        }

    return per_column(df, names, stats)


def datetime_profile(
    df: DataFrame, names: list[str] | None = None, cfg: Profiling = Profiling()
) -> DataFrame:
    names = columns_of(df, DATETIME) if names is None else names
    return datetime_stats(df, names).withColumn("range_days", F.round("range_days", cfg.rounding))


def monotonic(
    df: DataFrame, name: str, order_by: str, rows_per_bucket: int = ROWS_PER_SORT_TASK
) -> DataFrame:
    """Does `name` never fall when rows are read by `order_by`? Nulls are skipped.

    Rows of one order value collapse to their lowest and highest value before the
    sort, so a hot order value is one row. Sorted range buckets are checked in
    parallel and then joined end to end, one row per bucket.
    """
    steps = (
        df.where(col(name).isNotNull() & col(order_by).isNotNull())
        .groupBy(col(order_by).alias("k"))
        .agg(F.min(col(name)).alias("low"), F.max(col(name)).alias("high"))
    )
    steps = materialize(steps)
    bucketed = range_bucket(steps, ["k"], steps.count(), rows_per_bucket)
    inside = Window.partitionBy("bucket").orderBy("k")
    checked = bucketed.withColumn("prev", F.lag("high").over(inside)).groupBy("bucket").agg(
        F.count_if(F.col("prev") > F.col("low")).alias("falls"),
        F.min_by("low", "k").alias("first"),
        F.max_by("high", "k").alias("last"),
    )
    seam = F.lag("last").over(Window.orderBy("bucket"))
    return (
        checked.withColumn("seam", F.when(seam > F.col("first"), 1).otherwise(0))
        .agg(
            F.count(F.lit(1)).alias("buckets"),
            F.coalesce(F.sum("falls") + F.sum("seam"), F.lit(0)).alias("drops"),
        )
        .select(
            F.lit(name).alias("column"),
            ((F.col("drops") == 0) & (F.col("buckets") > 0)).alias("monotonic"),
        )
    )
