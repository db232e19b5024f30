"""Helpers for work that must not gather an unbounded group in one place."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.cells import col, word

ROWS_PER_SORT_TASK = 1_000_000
SPREAD_BYTES = 64 << 20
HOT_SHARE = 1000
JOBS_AT_ONCE = 10
WIDER = 6


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in spark.checkpoint.dir.

    Only where that setting is absent and everything runs in one process, a
    folder of our own is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="qualityframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read many: reliable checkpoint, so a lost executor costs no rerun."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def is_small(df: DataFrame) -> bool:
    """Is the estimated input below a fixed size?"""
    query = df._jdf.queryExecution()
    return int(str(query.optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES


def dealt(df: DataFrame) -> DataFrame:
    """A small input dealt out to all cores; anything larger or cached as it is.

    A small file is often one row group, hence one busy task. Larger inputs already
    have enough splits.
    """
    cached = "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
    if cached or not is_small(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def spread(df: DataFrame) -> Iterator[DataFrame]:
    """For repeated scans: deal out a small input and keep it while the block runs."""
    out = dealt(df)
    if out is df:
        yield df
        return
    out.persist()
    try:
        yield out
    finally:
        out.unpersist()


def together(spark: SparkSession, *steps: Callable) -> list:
    """Submit independent jobs side by side, so one job's tail does not idle the cluster."""
    with ThreadPoolExecutor(max_workers=min(len(steps), JOBS_AT_ONCE)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [w.result() for w in waiting]


def _cell(value, data_type: T.DataType):
    """A Python value in the form Arrow expects for a Spark type."""
    if value is None:
        return None
    if isinstance(data_type, T.StructType):
        fields = data_type.fields
        items = value.values() if isinstance(value, dict) else value
        return {f.name: _cell(v, f.dataType) for f, v in zip(fields, items)}
    if isinstance(data_type, T.MapType):
        return list(value.items()) if isinstance(value, dict) else value
    if isinstance(data_type, T.DoubleType):
        return float(value)
    return value


def local_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A few driver rows as a local table, which the optimizer can see through.

    A plain createDataFrame of a list would be an opaque RDD of unknown size.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    dicts = [
        {f.name: _cell(v, f.dataType) for f, v in zip(kind.fields, row)} for row in rows
    ]
    return spark.createDataFrame(pa.Table.from_pylist(dicts, to_arrow_schema(kind)), kind)


def pin(df: DataFrame) -> DataFrame:
    """Freeze a table that has one row per column, pair or action of a schema."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def one_row(df: DataFrame, exprs: dict[str, str], batch: int = 16) -> dict:
    """Run a wide global aggregate, given as SQL text, and return {name: value}.

    Each batch reads only the columns it names; batches are submitted together. On
    small inputs narrow batches win, as their code compiles fast; on large ones the
    number of tasks counts, so batches are `WIDER` times as wide.
    """
    names = list(exprs)
    if len(names) > batch and not is_small(df):
        batch *= WIDER
    parts = [names[i : i + batch] for i in range(0, len(names), batch)]

    def run(part: list[str]) -> dict:
        row = df.selectExpr(*[f"{exprs[n]} AS x{i}" for i, n in enumerate(part)]).first()
        return dict(zip(part, row))

    if len(parts) == 1:
        return run(parts[0])
    out: dict = {}
    for found in together(df.sparkSession, *[partial(run, part) for part in parts]):
        out |= found
    return out


def per_column(
    df: DataFrame, names: list[str], stats: Callable[[str], dict[str, str]], batch: int = 12
) -> DataFrame:
    """One lazily computed row per column, from global aggregates over column batches.

    `stats(name)` gives {output: aggregate as SQL}. Every batch scans only its columns.
    """
    if len(names) > batch and not is_small(df):
        batch *= WIDER
    pieces = []
    for start in range(0, len(names), batch):
        part = names[start : start + batch]
        aggs, structs = [], []
        for i, name in enumerate(part):
            fields = stats(name)
            aggs += [f"{v} AS `{i}_{k}`" for k, v in fields.items()]
            cells = "".join(f", {word(k)}, `{i}_{k}`" for k in fields)
            structs.append(f"named_struct('column', {word(name)}{cells})")
        pieces.append(df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(structs)}))"))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def range_bucket(df: DataFrame, keys: list[str], rows: int, rows_per_bucket: int) -> DataFrame:
    """Add `bucket`: consecutive ranges of the keys, about `rows_per_bucket` rows each.

    The ranges come from Spark's range partitioner, so keys of any sortable type
    work. They are written out once: a bucket number must not change on a rerun.
    """
    wanted = math.ceil(rows / rows_per_bucket)
    if wanted <= 1:
        return df.withColumn("bucket", F.lit(0))
    dealt = df.repartitionByRange(wanted, *[col(k) for k in keys])
    return materialize(dealt.withColumn("bucket", F.spark_partition_id()))


def running_total(
    counts: DataFrame,
    key: str,
    weight: str,
    at_most: int | None = None,
    rows_per_bucket: int = ROWS_PER_SORT_TASK,
) -> DataFrame:
    """Add `before` = sum of `weight` over smaller keys; keys must be distinct.

    Range buckets are summed in parallel; only one total per bucket is summed in
    order. `at_most` is a known bound on the number of keys and saves counting them.
    """
    rows = counts.count() if at_most is None else at_most
    bucketed = range_bucket(counts, [key], rows, rows_per_bucket)
    inside = Window.partitionBy("bucket").orderBy(col(key)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = bucketed.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("bucket")
        .agg(F.sum(weight).alias("__t"))
        .select("bucket", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__off"))
    )
    # one row per bucket, and there are rows / rows_per_bucket buckets
    return (
        local.join(F.broadcast(offsets), "bucket")
        .withColumn("before", F.col("__in") + F.col("__off"))
        .drop("bucket", "__in", "__off")
    )


def lookup(left: DataFrame, right: DataFrame, keys: dict[str, str], total: int) -> DataFrame:
    """Left join to a table unique on its keys; adds `found`, a struct of its columns.

    `keys` maps left to right key columns; left keys must not be null. A key held by
    over a thousandth of the left rows (there are at most a thousand) is answered by
    broadcast, and its rows cross the shuffle under a salt instead of their key.
    """
    names = list(keys)
    heavy = (
        left.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > total / HOT_SHARE)
        .select(*[F.col(k).alias(keys[k]) for k in names])
    )
    fields = F.struct(*[col(c) for c in right.columns])

    def keyed(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(
            *[col(keys[k]).alias(f"__{tag}{i}") for i, k in enumerate(names)],
            fields.alias(f"__{tag}"),
        )

    hot = keyed(right.join(F.broadcast(heavy), list(keys.values()), "left_semi"), "h")
    cold = keyed(right, "c")
    on_hot = [left[k] == hot[f"__h{i}"] for i, k in enumerate(names)]
    marked = left.join(F.broadcast(hot), on_hot, "left").withColumn(
        "__salt",
        F.when(F.col("__h").isNull(), F.lit(0)).otherwise(
            1 + F.pmod(F.xxhash64(*[col(c) for c in left.columns]), F.lit(1 << 20))
        ),
    )
    on_cold = [marked[k] == cold[f"__c{i}"] for i, k in enumerate(names)]
    joined = marked.join(cold.withColumn("__zero", F.lit(0).cast("long")), [
        *on_cold, F.col("__salt").cast("long") == F.col("__zero")
    ], "left")
    return joined.select(
        *[col(c) for c in left.columns], F.coalesce("__h", "__c").alias("found")
    )
