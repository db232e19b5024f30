"""Cell-level expressions: types, missing values, number parsing, text counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, TEXTUAL, BOOLEAN, DATETIME, UNKNOWN = (
    "numeric",
    "string",
    "boolean",
    "datetime",
    "unknown",
)

# What counts as a plain decimal number or an infinity in text.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"

# Runs of everything that is NOT counted; removing them leaves the counted characters.
NOT_DIGITS = r"(?U)\D+"
NOT_SPACES = r"(?U)[^\s\x1c-\x1f]+"
NOT_SPECIAL = r"(?U)[\p{L}\p{N}_\s\x1c-\x1f]+"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXTUAL
    return UNKNOWN


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    """Column names of the given kinds, in name order."""
    return sorted(f.name for f in df.schema.fields if kind(f.dataType) in kinds)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One spelling of missing: NaN in float and double columns becomes null."""
    floats = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    return col(name).cast("double")


def parse_number(c: Column) -> Column:
    """Text to double; null where the text is not a number (`1d` is not one)."""
    return F.when(c.rlike(PLAIN_NUMBER), F.trim(c).try_cast("double")).when(
        c.rlike(INFINITE),
        F.when(F.ltrim(c).startswith("-"), F.lit(float("-inf"))).otherwise(
            F.lit(float("inf"))
        ),
    )


def q(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def dbl(name: str) -> str:
    return f"CAST({q(name)} AS DOUBLE)"


def number(value: float) -> str:
    """A double as a SQL literal with all its digits."""
    if math.isinf(value):
        return f"CAST('{'-' if value < 0 else ''}Infinity' AS DOUBLE)"
    return f"({value!r}D)"


def raw(pattern: str) -> str:
    """A regular expression as a raw SQL string."""
    return f"r'{pattern}'"


def word(value: str) -> str:
    """Any text as a SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def characters_left(name: str, removed: str) -> str:
    """Characters that remain when all runs of a pattern are removed."""
    return f"char_length(regexp_replace({q(name)}, {raw(removed)}, ''))"


def short_key(name: str, limit: int = 64) -> str:
    """A grouping key for long text: itself when short, else its SHA-256.

    Keeps documents out of the shuffle; the digest stands for the whole text.
    """
    c = q(name)
    return f"CASE WHEN octet_length({c}) <= {limit} THEN {c} ELSE concat('sha256:', sha2({c}, 256)) END"


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))


def holds_map(data_type: T.DataType) -> bool:
    """Is there a map at any depth?"""
    if isinstance(data_type, T.StructType):
        return any(holds_map(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return holds_map(data_type.elementType)
    return isinstance(data_type, T.MapType)


def _nested_hash(x: str, data_type: T.DataType, salt: str, depth: int = 0) -> str:
    """SQL hash of a value that tells nulls, lengths and places apart at every level."""
    v = f"x{depth}"
    if isinstance(data_type, T.ArrayType):
        inner = _nested_hash(v, data_type.elementType, salt, depth + 1)
        return f"xxhash64({salt}, coalesce(size({x}), -1), transform({x}, {v} -> {inner}))"
    if isinstance(data_type, T.MapType):
        key = _nested_hash(f"{v}.key", data_type.keyType, salt, depth + 1)
        value = _nested_hash(f"{v}.value", data_type.valueType, salt, depth + 1)
        pairs = f"transform(map_entries({x}), {v} -> xxhash64({salt}, {key}, {value}))"
        return f"xxhash64({salt}, coalesce(size({x}), -1), array_sort({pairs}))"
    if isinstance(data_type, T.StructType):
        parts = [_nested_hash(f"{x}.{q(f.name)}", f.dataType, salt, depth + 1) for f in data_type.fields]
        return f"xxhash64({salt}, {x} IS NULL, {', '.join(parts) or '0'})"
    return f"xxhash64({salt}, {x} IS NULL, {x})"


def row_digest(names: list[str], schema: T.StructType) -> tuple[str, str]:
    """Two 64-bit hashes over the whole row, 16 bytes whatever the row width.

    A null does not move Spark's hash, so the null pattern is hashed first, and nested
    values are hashed level by level with their nulls and lengths. Maps are equal if
    their entries are, in any order.
    """
    types = {f.name: f.dataType for f in schema.fields}
    if not names:
        return "0L", "0L"
    nulls = "concat(" + ", ".join(f"if({q(c)} IS NULL, '1', '0')" for c in names) + ")"

    def values(salt: str) -> str:
        return ", ".join(_nested_hash(q(c), types[c], salt) if is_nested(types[c]) else q(c) for c in names)

    return f"xxhash64({nulls}, {values("'first'")})", f"xxhash64('second', {nulls}, {values("'second'")})"


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def sketch_distinct(value: str) -> str:
    """Estimated number of distinct values of a hash, 1.6 % standard error."""
    return f"hll_sketch_estimate(hll_sketch_agg({value}, 12))"
