"""Counts, missing values, uniqueness, duplicates, size, fingerprint, sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Profiling
from ..functions.cells import (
    TEXTUAL,
    UNKNOWN,
    col,
    columns_of,
    dbl,
    kind,
    q,
    row_digest,
    safe_ratio,
    short_key,
    sketch_distinct,
)
from .scale import local_frame, one_row, per_column

WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
}


def null_ratio(df: DataFrame) -> DataFrame:
    """Rows, nulls and null share of every column, in one scan."""
    return per_column(
        df,
        sorted(df.columns),
        lambda c: {"row_count": "count(1)", "null_count": f"count_if({q(c)} IS NULL)"},
        batch=32,
    ).withColumn("null_ratio", safe_ratio(F.col("null_count"), F.col("row_count")))


def total_null_ratio(df: DataFrame) -> DataFrame:
    """Null cells / all cells."""
    return null_ratio(df).agg(
        F.coalesce(
            F.try_divide(F.sum("null_count"), F.sum("row_count")), F.lit(0.0)
        ).alias("total_null_ratio")
    )


def value_groups(
    df: DataFrame, names: list[str], digest: set[str] | frozenset[str] = frozenset()
) -> list[DataFrame]:
    """(column, value, n) of non-null values, as one frame per value type.

    Columns of one type are stacked together, so the grouping key stays narrow
    and each column is read once. Map-side counting collapses hot values before
    the shuffle. Columns named in `digest` travel as SHA-256 when long.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    by_type: dict[str, list[str]] = {}
    for name in names:
        by_type.setdefault(types[name].simpleString(), []).append(name)
    frames = []
    for group in by_type.values():
        cells = ", ".join(
            f"{i}, {short_key(c) if c in digest else q(c)}" for i, c in enumerate(group)
        )
        listed = F.array(*[F.lit(c) for c in group])
        frames.append(
            df.selectExpr(f"stack({len(group)}, {cells}) AS (slot, value)")
            .where(F.col("value").isNotNull())
            .groupBy("slot", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.get(listed, F.col("slot")).alias("column"), "value", "n")
        )
    return frames


def distinct_counts(df: DataFrame, names: list[str], exact: bool = True, digest=frozenset()) -> DataFrame:
    """(column, distinct_count): exact by grouping, or a HyperLogLog sketch (1.6 % error)."""
    if not exact:
        return per_column(
            df, names, lambda c: {"distinct_count": sketch_distinct(f"if({q(c)} IS NULL, NULL, xxhash64({q(c)}))")}
        )
    pieces = [
        g.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
        for g in value_groups(df, names, digest)
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    listed = local_frame(df.sparkSession, [(c,) for c in names], "column string")
    return listed.join(F.broadcast(out), "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count")
    )


def countable(df: DataFrame) -> list[str]:
    """Columns whose values can be counted (nested and binary ones are not)."""
    return [
        f.name
        for f in sorted(df.schema.fields, key=lambda f: f.name)
        if kind(f.dataType) != UNKNOWN
    ]


def uniqueness(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-null values / all rows, and its complement."""
    names = countable(df)
    texts = set(columns_of(df, TEXTUAL))
    rows = null_ratio(df.select(*[col(c) for c in names])).select("column", "row_count")
    return (
        rows.join(F.broadcast(distinct_counts(df, names, exact, texts)), "column")
        .withColumn("unique_ratio", safe_ratio(F.col("distinct_count"), F.col("row_count")))
        .withColumn(
            "duplicate_ratio",
            safe_ratio(F.col("row_count") - F.col("distinct_count"), F.col("row_count")),
        )
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat another row, and their share.

    Rows meet by a 128-bit digest, so 16 bytes per distinct row are shuffled
    whatever the row width; for 10^12 rows a false match has odds near 10^-15.
    """
    h1, h2 = row_digest(df.columns, df.schema)
    seen = (
        df.selectExpr(f"{h1} AS h1", f"{h2} AS h2")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn(
        "duplicate_row_ratio", safe_ratio(F.col("duplicate_rows"), F.col("row_count"))
    )


def row_look(df: DataFrame) -> DataFrame:
    """One row: rows, the share of repeated ones, and the sums of the fingerprint; one scan."""
    h1, h2 = row_digest(df.columns, df.schema)
    seen = df.selectExpr(f"{h1} AS h1", f"{h2} AS h2").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return row_sums(seen)


def row_sums(digests: DataFrame) -> DataFrame:
    """`row_look` from distinct row digests (h1, h2) and how often (n) each occurs."""
    return digests.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        safe_ratio(F.sum(F.col("n") - 1), F.sum("n")).alias("duplicate_row_ratio"),
        # an even number of equal hashes cancels out
        F.expr("coalesce(bit_xor(if(n % 2 = 1, h1, 0L)), 0L)").alias("row_xor"),
        F.expr("coalesce(sum(CAST(h2 AS DECIMAL(38,0)) * n), 0)").cast("decimal(38,0)").alias("row_sum"),
    )


def byte_size(field: T.StructField) -> str:
    """Bytes held by a column: fixed width per value, or the text's own length."""
    c = q(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType, T.CharType, T.VarcharType)):
        return f"coalesce(sum(octet_length({c})), 0L)"
    if kind(field.dataType) == UNKNOWN:
        return f"coalesce(sum(octet_length(to_json(struct({c})))), 0L)"
    if isinstance(field.dataType, T.DecimalType):
        return f"count({c}) * 16L"
    return f"count({c}) * {WIDTH.get(type(field.dataType), 8)}L"


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, bytes, null share, duplicate share, types."""
    fields = df.schema.fields
    types: dict[str, int] = {}
    for f in fields:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    type_map = F.create_map(*[F.lit(x) for pair in sorted(types.items()) for x in pair])
    nulls = " + ".join(["0L", *(f"count_if({q(f.name)} IS NULL)" for f in fields)])
    size = " + ".join(["0L", *(byte_size(f) for f in fields)])
    scanned = df.selectExpr(f"{nulls} AS nulls", f"{size} AS bytes")
    # both sides are single rows
    return (
        duplicate_rows(df)
        .join(F.broadcast(scanned))
        .select(
            "row_count",
            F.lit(len(fields)).cast("long").alias("column_count"),
            "duplicate_row_ratio",
            "bytes",
            safe_ratio(F.col("nulls"), F.col("row_count") * len(fields)).alias(
                "total_null_ratio"
            ),
            type_map.alias("type_distribution"),
        )
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free identity of a table: schema, row count, xor and sum of row hashes."""
    h1, h2 = row_digest(df.columns, df.schema)
    rows = df.selectExpr(f"{h1} AS h1", f"{h2} AS h2").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h1"), F.lit(0)).alias("row_xor"),
        F.coalesce(F.sum(F.col("h2").cast("decimal(38,0)")), F.lit(0)).alias("row_sum"),
    )
    schema = F.sha2(F.lit(df.schema.simpleString()), 256)
    return rows.select(
        "row_count",
        F.sha2(
            F.concat_ws(
                "|",
                schema,
                F.col("row_count").cast("string"),
                F.col("row_xor").cast("string"),
                F.col("row_sum").cast("string"),
            ),
            256,
        ).alias("fingerprint"),
    )


def fingerprint_of(schema: T.StructType, rows: int, row_xor: int, row_sum: int) -> str:
    """The text of `fingerprint` from sums that were taken elsewhere."""
    shape = hashlib.sha256(schema.simpleString().encode()).hexdigest()
    return hashlib.sha256(f"{shape}|{rows}|{row_xor or 0}|{int(row_sum or 0)}".encode()).hexdigest()


def sample_rows(
    df: DataFrame, key: list[str], cfg: Profiling = Profiling(), rows: int | None = None
) -> DataFrame:
    """Exactly `sample_size` rows when the table has more than `sampling_threshold`.

    Rows with the smallest md5 of (seed, key) win, so the choice does not depend
    on partitioning. A prefix filter leaves about twice the wanted rows before the
    top-n, and is widened until it holds enough.
    """
    if rows is None:
        rows = df.count()
    if rows <= cfg.sampling_threshold or rows <= cfg.sample_size:
        return df
    texts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in key]
    order = F.md5(F.concat_ws("|", F.lit(str(cfg.global_seed)), *texts))
    hashed = df.withColumn("__order", order)
    share = 2.0 * cfg.sample_size / rows
    while share < 1.0:
        cut = format(int(share * 16**12), "012x")
        kept = hashed.where(F.substring("__order", 1, 12) < cut)
        if kept.count() >= cfg.sample_size:
            hashed = kept
            break
        share *= 4
    ranked = hashed.orderBy("__order", *[col(k) for k in key]).limit(cfg.sample_size)
    return ranked.drop("__order")


def base_exprs(name: str) -> dict[str, str]:
    """Counts and pilot values of a numeric column."""
    x = dbl(name)
    return {
        "n": f"count({q(name)})",
        "mean": f"avg({x})",
        "min": f"min({x})",
        "max": f"max({x})",
        "zeros": f"count_if({x} = 0)",
    }


def look(df: DataFrame, wanted: dict[str, dict[str, str]], batch: int = 20) -> dict[str, dict]:
    """Aggregates per column in as few scans as `one_row` needs: {column: {field: value}}."""
    exprs = {(c, k): e for c, fields in wanted.items() for k, e in fields.items()}
    flat = one_row(df, exprs, batch) if exprs else {}
    return {c: {k: flat[c, k] for k in fields} for c, fields in wanted.items()}


def base_stats(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Counts and pilot values of numeric columns from one pruned scan."""
    return look(df, {c: base_exprs(c) for c in names})
