"""What a column holds, judged from its name and its values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Detection, Profiling
from ..functions.cells import DATETIME, TEXTUAL, kind, q, raw
from .scale import dealt, local_frame, one_row
from .structure import sample_rows

# Classes in tie-break order, value pattern, words in the column name.
CLASSES = [
    (
        "email",
        r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
        ["email", "mail", "contact"],
    ),
    ("phone", r"^\+?[\d\s\-\(\)]{7,20}$", ["phone", "tel", "mobile", "cell"]),
    (
        "credit_card",
        r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}"
        r"|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})$",
        ["credit", "card", "visa", "mastercard", "amex", "cc_number"],
    ),
    (
        "ssn",
        r"^\d{3}-\d{2}-\d{4}$|^\d{9}$",
        ["ssn", "social_security", "national_id", "tax_id"],
    ),
    (
        "date_of_birth",
        r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$",
        ["dob", "birth", "birthday", "born"],
    ),
    ("ip_address", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", ["ip", "address", "host"]),
    ("identifier", r"^\d+$|^[0-9a-fA-F-]{8,36}$", ["id", "uuid", "pk", "key", "code"]),
    ("country_code", r"^[A-Z]{2,3}$", ["country", "nation", "cc"]),
]

# Classes that are personal data, and words that mark a sensitive column.
PERSONAL = {
    "email",
    "phone",
    "ssn",
    "credit_card",
    "address",
    "name",
    "date_of_birth",
    "bank_account",
    "driver_license",
}
SENSITIVE = ["gender", "sex", "race", "ethnicity", "age", "religion", "disability"]

# How long a value of a class can be, as its pattern implies; a final line break is allowed.
LENGTHS = {
    "email": (6, None),
    "phone": (7, 21),
    "credit_card": (13, 16),
    "ssn": (9, 11),
    "date_of_birth": (10, 10),
    "ip_address": (7, 15),
    "identifier": (1, None),
    "country_code": (2, 3),
}
LINE_BREAK = 2

# Classes the digits of a whole number can spell.
NUMBER_CLASSES = {"phone", "credit_card", "ssn", "identifier"}

# Classes whose pattern a date such as 2001-02-03 fits.
DAY_CLASSES = {"phone", "date_of_birth", "identifier"}

SEMANTIC_SCHEMA = "column string, predicted_class string, confidence double"


def match_share(value: str, label: str, pattern: str) -> str:
    """Share of values that match a class. Most are settled by their length alone."""
    low, high = LENGTHS[label]
    size = f"char_length({value})"
    fits = f"{size} >= {low}" if high is None else f"{size} BETWEEN {low} AND {high + LINE_BREAK}"
    hit = f"{fits} AND {value} RLIKE {raw('(?U)' + pattern)}"
    return f"avg(CASE WHEN {value} IS NULL THEN NULL WHEN {hit} THEN 1D ELSE 0D END)"


def share(field: T.StructField, label: str, pattern: str) -> str | None:
    """Share of values that match; None when the type cannot spell the class."""
    name, t = field.name, field.dataType
    if kind(t) == TEXTUAL:
        return match_share(q(name), label, pattern)
    whole = isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)
    if whole and label in NUMBER_CLASSES:
        return match_share(f"CAST({q(name)} AS STRING)", label, pattern)
    if kind(t) == DATETIME and label in DAY_CLASSES:
        # a column of pure dates is written as dates; one time of day turns all into timestamps
        day = f"CAST(CAST({q(name)} AS DATE) AS {t.simpleString()})"
        return f"min(CASE WHEN {q(name)} = {day} THEN 1D ELSE 0D END)"
    return None


def classify(df: DataFrame, cfg: Profiling = Profiling()) -> dict[str, tuple[str, float]]:
    """{column: (class, confidence)} for columns that reach the minimum confidence.

    One scan over all values. A class is tested only where name and type together
    could still reach the minimum.
    """
    exprs: dict[str, str] = {}
    for f in df.schema.fields:
        for label, pattern, _ in CLASSES:
            matched = share(f, label, pattern)
            if matched is not None:
                exprs[f"{f.name}\0{label}"] = matched
    if not exprs:
        return {}
    df = dealt(df)
    if cfg.semantic_sample_size:
        size = cfg.semantic_sample_size
        df = sample_rows(df, df.columns, replace(cfg, sampling_threshold=size, sample_size=size))
    return decided(df.columns, one_row(df, exprs, batch=8), cfg)


def decided(columns: list[str], shares: dict[str, float], cfg: Profiling = Profiling()) -> dict[str, tuple[str, float]]:
    """{column: (class, confidence)} from the shares, {column NUL class: share}."""
    out = {}
    for name in sorted(columns):
        best = None
        for label, _, words in CLASSES:
            named = any(w in name.lower() for w in words)
            score = (shares.get(f"{name}\0{label}") or 0.0) * cfg.semantic_weight_pattern + named * cfg.semantic_weight_keyword
            if score > 0.1 and (best is None or score > best[1]):
                best = (label, score)
        if best and best[1] >= cfg.semantic_min_confidence:
            out[name] = best
    return out


def semantic_class(df: DataFrame, cfg: Profiling = Profiling()) -> DataFrame:
    rows = [(c, label, score) for c, (label, score) in classify(df, cfg).items()]
    return local_frame(df.sparkSession, rows, SEMANTIC_SCHEMA).withColumn(
        "confidence", F.round("confidence", cfg.rounding)
    )


def tag_columns(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """Attach the class of each column as its semantic tag."""
    return (
        profile.join(classes.select("column", "predicted_class"), "column", "left")
        .withColumn(
            "semantic_tags",
            F.when(F.col("predicted_class").isNotNull(), F.array("predicted_class")).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .drop("predicted_class")
    )


def name_has(words: list[str], c: Column, whole_word: bool = False) -> Column:
    """Does a column name contain one of the words?"""
    if whole_word:
        return F.lower(c).rlike("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)")
    return F.lower(c).rlike("|".join(words))


def pii(classes: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Columns whose class is personal data and sure enough."""
    return classes.where(
        F.col("predicted_class").isin(sorted(PERSONAL))
        & (F.col("confidence") > cfg.pii_confidence)
    )
