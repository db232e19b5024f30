"""Readers: every source becomes a lazy DataFrame with one spelling of missing."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import PLAIN_NUMBER, TEXTUAL, col, columns_of, nan_to_null

# Text a CSV field may use for a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# URI prefixes of databases and of warehouses.
DATABASES = ("postgresql", "postgres", "mysql", "sqlite", "oracle", "mssql", "duckdb")
WAREHOUSES = ("snowflake", "bigquery", "redshift")

EXACT = 1 << 53  # beyond it a double skips whole numbers
WHOLE = r"^\s*[+-]?\d+\s*$"
TRUTH = r"(?i)^(true|false)$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"


class SourceError(ValueError):
    """A source that cannot be recognised or read here."""


def missing_to_null(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text columns become null."""
    texts = set(columns_of(df, TEXTUAL))
    return df.select(
        *[
            F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c) if c in texts else col(c)
            for c in df.columns
        ]
    )


def _fits(x: Column) -> dict[str, Column]:
    """Whether a text fits a type without losing anything, narrowest type first.

    A whole number is a long or a decimal of 38 digits, never a rounded double.
    """
    whole, number = x.rlike(WHOLE), F.trim(x)
    exact = F.coalesce(number.try_cast("decimal(38,0)").between(-EXACT, EXACT), F.lit(False))
    return {
        "long": whole & number.try_cast("long").isNotNull(),
        "decimal(38,0)": whole & number.try_cast("decimal(38,0)").isNotNull(),
        "double": x.rlike(PLAIN_NUMBER) & (~whole | exact),
        "boolean": x.rlike(TRUTH),
        "date": x.rlike(DAY),
        "timestamp_ntz": x.rlike(MOMENT),
    }


def infer_columns(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit, in one scan."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        tests = _fits(col(c))
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        aggs += [F.count_if(test).alias(f"{t}{i}") for t, test in tests.items()]
    seen = df.agg(*aggs).first()
    types: dict[str, str] = {}
    for i, c in enumerate(names):
        total = seen[f"n{i}"]
        fits = [t for t in tests if total and seen[f"{t}{i}"] == total]
        if fits:
            types[c] = fits[0]

    def typed(c: str) -> Column:
        t = types.get(c)
        if t is None:
            return col(c)
        value = F.trim(col(c)) if t in ("long", "decimal(38,0)", "double") else col(c)
        return value.try_cast(t).alias(c)

    return df.select(*[typed(c) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV with a header. Tokens such as NA are nulled before types are inferred.

    Give a schema to skip the inference scan.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
    )
    if schema is not None:
        return nan_to_null(missing_to_null(reader.schema(schema).csv(path)))
    return infer_columns(missing_to_null(reader.csv(path)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_json(
    spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | str | None = None
) -> DataFrame:
    """An array of records, or with `lines=True` one record per line (splittable)."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if "_corrupt_record" in df.columns:
        raise SourceError(f"not a JSON array of records: {path}")
    return nan_to_null(df)


def read_table(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A DataFrame, table or view; frames are immutable, so nothing is copied."""
    df = source if isinstance(source, DataFrame) else spark.table(source)
    return nan_to_null(df)


def jdbc_options(
    url: str,
    query: str,
    partition: tuple[str, str, str, int] | None = None,
    **options: str,
) -> dict[str, str]:
    """Reader options; `partition` = (column, lower, upper, parts) reads in parallel."""
    if not query:
        raise SourceError("a database source needs a query")
    target = url if url.startswith("jdbc:") else jdbc_url(url)
    out = {"url": target, **options}
    if partition is None:
        return out | {"query": query}
    column, lower, upper, parts = partition
    return out | {
        "dbtable": f"({query}) source",
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
    }


def jdbc_url(uri: str) -> str:
    """The JDBC form of a database URI; credentials go to options, not the URL."""
    parts = urlsplit(uri)
    scheme = parts.scheme.split("+")[0]
    host = parts.hostname or ""
    if parts.port:
        host += f":{parts.port}"
    if scheme in ("postgres", "postgresql"):
        return f"jdbc:postgresql://{host}{parts.path}"
    if scheme == "sqlite":
        return "jdbc:sqlite:" + re.sub(r"^sqlite:///?", "", uri)
    if scheme == "duckdb":
        return "jdbc:duckdb:" + re.sub(r"^duckdb:///?", "", uri)
    if scheme == "mssql":
        return f"jdbc:sqlserver://{host};databaseName={parts.path.lstrip('/')}"
    if scheme == "oracle":
        return f"jdbc:oracle:thin:@//{host}{parts.path}"
    return f"jdbc:{scheme}://{host}{parts.path}"


def credentials(uri: str) -> dict[str, str]:
    parts = urlsplit(uri)
    found = {"user": parts.username, "password": parts.password}
    return {k: v for k, v in found.items() if v}


def read_database(
    spark: SparkSession,
    url: str,
    query: str,
    partition: tuple[str, str, str, int] | None = None,
    **options: str,
) -> DataFrame:
    """A query run by an outside database or warehouse through its JDBC driver."""
    given = options if url.startswith("jdbc:") else credentials(url) | options
    reader = spark.read.format("jdbc").options(**jdbc_options(url, query, partition, **given))
    return nan_to_null(reader.load())


def resolve(path: str, **options) -> dict:
    """Kind and settings of a source, from its prefix or extension."""
    scheme = path.split("://")[0] if "://" in path else ""
    if path.startswith("jdbc:") or scheme in DATABASES + WAREHOUSES:
        query = options.pop("query", None)
        if not query:
            raise SourceError(f"database source without a query: {path}")
        kind = "warehouse" if scheme in WAREHOUSES else "database"
        label = {"warehouse_type": scheme} if kind == "warehouse" else {}
        return {"kind": kind, "url": path, "query": query} | label | options
    if scheme in ("http", "https"):
        raise SourceError(f"download the file to shared storage first: {path}")
    suffix = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = suffix.rsplit(".", 1)[1].lower() if "." in suffix else ""
    if scheme in ("s3", "s3a"):
        bucket, _, key = path.split("://", 1)[1].partition("/")
        return object_store(bucket, key, suffix or "parquet", **options)
    known = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "jsonl"}
    if suffix in known:
        return {"kind": known[suffix], "path": path} | options
    if suffix in ("db", "sqlite"):
        query = options.pop("query", None)
        if not query:
            raise SourceError(f"database source without a query: {path}")
        return {"kind": "database", "url": f"sqlite:///{path}", "query": query} | options
    if suffix in ("xls", "xlsx"):
        raise SourceError(f"spreadsheets have no Spark source; save as CSV: {path}")
    raise SourceError(f"cannot tell the kind of source: {path}")


def object_store(
    bucket: str, key: str, format: str = "csv", region: str | None = None, **options
) -> dict:
    """The same file readers on an s3a URI."""
    kinds = {"csv": "csv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "pq": "parquet"}
    kind = kinds.get(format.lower())
    if kind is None:
        raise SourceError(f"no Spark reader for {format!r} objects")
    out = {"kind": kind, "path": f"s3a://{bucket}/{key}"} | options
    return out | ({"region": region} if region else {})


def load(spark: SparkSession, source: DataFrame | str | dict, **options) -> DataFrame:
    """Read any supported source: a frame, a URI or path, or the result of `resolve`."""
    if isinstance(source, DataFrame):
        return read_table(spark, source)
    found = dict(source) if isinstance(source, dict) else resolve(source, **options)
    kind = found.pop("kind")
    found.pop("warehouse_type", None)
    region = found.pop("region", None)
    if region:
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.s3a.endpoint.region", region)
    if kind == "csv":
        return read_csv(spark, **found)
    if kind == "parquet":
        return read_parquet(spark, **found)
    if kind in ("json", "jsonl"):
        return read_json(spark, lines=found.pop("lines", kind == "jsonl"), **found)
    return read_database(spark, **found)


def describe(source: str, **options) -> dict:
    """Source metadata for the lineage table, without credentials."""
    found = resolve(source, **options)
    return {
        k: re.sub(r"//[^/@]*@", "//", v) if isinstance(v, str) else v
        for k, v in found.items()
        if k != "password"
    }
