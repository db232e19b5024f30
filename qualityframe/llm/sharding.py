"""Sharding: jump consistent hashing, as DataFrame expressions.

Method. The key seeds a linear congruential sequence of 64-bit numbers; the shard jumps
forward along it and the last jump below the number of shards stands. There is no ring
table, the shards get equal shares, and with one more shard a row either stays or moves
to the new one. The 64-bit arithmetic is done in decimals, which neither wrap nor lose
digits whatever the session's overflow rules are.

Rows of a shard are numbered without gaps. Each shard is numbered in many small runs,
whose offsets are added up, so no task sees a whole shard.

Defined cases: a null key counts as key 0; a null text has no bytes; equal keys share a
shard; repeated rows get a slot each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole

# Fixed values of the method: the multiplier of the sequence and the word size.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64
SHARDS = 24
ROW_OVERHEAD = 8
LEAST_RUNS = 64
ROWS_PER_RUN = 100_000


def jump(key: str, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a whole-number key."""
    seed = f"cast(pmod(cast(coalesce(`{key}`, 0) AS decimal(38, 0)), {WORD}BD) AS decimal(20, 0))"
    after = f"cast((a.k * {MULTIPLIER}BD + 1BD) % {WORD}BD AS decimal(20, 0))"
    return F.expr(f"""aggregate(
        sequence(1, {shards}),
        named_struct('k', {seed}, 'shard', 0L, 'next', 0L),
        (a, i) -> if(a.next >= {shards}, a, aggregate(
            array({after}),
            named_struct('k', a.k, 'shard', a.next, 'next', a.next),
            (b, k) -> named_struct('k', k, 'shard', b.shard, 'next',
                cast(floor((b.shard + 1) * (2147483648D / cast((k div {1 << 33}BD) + 1 AS double))) AS bigint)))),
        a -> cast(a.shard AS int))""")


def numbered(rows: DataFrame, group: str, order: list[str], runs: int) -> DataFrame:
    """Add `slot`, 0 upwards without gaps in each group; `rows` must be stored.

    A group is dealt into `runs` by row, so a frequent key is spread as well.
    """
    dealt = rows.withColumn("__run", F.pmod(F.xxhash64("__row"), F.lit(runs)))
    ahead = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "__run").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(group, "__run", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__run").orderBy(*order, "__row")
    placed = dealt.withColumn("__at", F.row_number().over(inside) - 1)
    out = placed.join(offsets, [group, "__run"])
    return out.withColumn("slot", (F.col("__offset") + F.col("__at")).cast("long")).drop("__run", "__at", "__offset")


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) for each row."""
    rows = docs.select(
        F.col(key),
        (F.octet_length(whole(text)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(whole(text).cast("binary")).alias("text_crc32"),
        jump(key, shards).alias("shard"),
        jump(key, shards + 1).alias("grown_shard"),
    ).withColumn("__row", F.monotonically_increasing_id())
    fixed = stored(rows, "shards")
    runs = max(LEAST_RUNS, -(-fixed.count() // (shards * ROWS_PER_RUN)))
    return numbered(fixed, "shard", [key], runs).drop("__row")


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write the documents as one folder for each shard."""
    docs.withColumn("shard", jump(key, shards)).write.partitionBy("shard").parquet(path)


def op7(docs: DataFrame) -> DataFrame:
    return assign(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
