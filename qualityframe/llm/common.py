"""What the operators of this folder share: tables, stored intermediates, row helpers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scale import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and
    a lost executor costs a reread, not a recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    context = spark.sparkContext
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def kept(name: str, make: Callable):
    """Something a Python worker builds once and keeps for its later tasks.

    The package travels by value, so its own globals are new in each task.
    """
    store = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def only_kept(name: str, make: Callable):
    """As `kept`; what other steps kept in this worker is let go."""
    store = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if name not in store:
        for other in [k for k in store if not k.startswith("__")]:
            del store[other]
    return kept(name, make)


def by_batch(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, rows: int | None = None
) -> DataFrame:
    """One Arrow batch in, one out; the rows of a batch are bounded by Spark, or by `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows or batch.num_rows or 1):
                yield step(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """`step` on rows whose columns, but for those used, bear names that clash with nothing;
    the columns get their names back."""
    hidden = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in used}
    out = step(docs.withColumnsRenamed(hidden))
    return out.withColumnsRenamed({name: c for c, name in hidden.items()})


def whole(text: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `dropped`; rows with a null key stay.

    `dropped` is a stored table, so its size is known when the join is planned.
    """
    gone = dropped.select(F.col(key).alias("__gone"))
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")
