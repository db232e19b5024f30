"""Writers for repaired tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Text forms of times that keep every digit.
MICROSECONDS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, one file per partition; times keep their microseconds."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .options(**MICROSECONDS)
        .csv(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line."""
    df.write.mode(mode).option("ignoreNullFields", False).options(**MICROSECONDS).json(path)
