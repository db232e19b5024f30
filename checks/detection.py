"""One query per detector over the dirty table, and all of them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.config import Config
from qualityframe.operators import detectors
from qualityframe.plans.analyze import inspect
from qualityframe.plans.profile import Profiles, profile

from .inputs import frame, sql, table
from .profiling import (
    DIRT,
    DIRT_LABELS,
    DIRT_NUMBERS,
    SUMMARY,
    classes_sql,
    counts_cte,
    outlier_cte,
    stats_cte,
    union,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SHOWN = "detector issue_type dimension column columns scope severity confidence".split()
RANGE = Config().with_detection(min_value=0.0, max_value=100.0)
ML = Config(ml_enabled=True)


def shown(found: DataFrame) -> DataFrame:
    return found.select(
        *[
            F.array_join("columns", ",").alias("columns") if c == "columns"
            else F.round("severity", 6).alias("severity") if c == "severity"
            else F.col(c)
            for c in SHOWN
        ]
    )


def context(
    df: DataFrame, parts: set[str], cfg: Config = Config(), baseline: Profiles | None = None
) -> detectors.Context:
    p = profile(df, cfg, parts=parts)
    return detectors.Context(
        p.columns, p.dataset, p.correlations, p.classes(), df,
        None if baseline is None else baseline.columns, cfg,
    )


def add(name: str, detector, parts: set[str], oracle: str, cfg: Config = Config(), source: str = "dirt"):
    def run(spark, sf_dir):
        return shown(detector(context(frame(spark, sf_dir, source), parts, cfg)))

    QUERIES[name] = run
    ORACLES[name] = oracle


def finding(
    detector: str, issue: str, dimension: str, severity: str, source: str, where: str,
    column: str = "col", columns: str = "CAST(NULL AS VARCHAR)", scope: str = "column",
    confidence: str = "1.0",
) -> str:
    return f"""SELECT '{detector}' AS detector, '{issue}' AS issue_type, '{dimension}' AS dimension,
      {column} AS "column", {columns} AS columns, '{scope}' AS scope,
      round(CAST({severity} AS DOUBLE), 6) AS severity, CAST({confidence} AS DOUBLE) AS confidence
      FROM {source} WHERE {where}"""


SRC = f"src AS MATERIALIZED (SELECT * FROM {sql('dirt')} AS t)"
SIZES = "sizes AS MATERIALIZED (" + union(
    [
        f"SELECT '{c}' AS col, count(*) AS r, count(*) - count({c}) AS n0, count(DISTINCT {c}) AS k FROM src"
        for c in DIRT
    ]
) + ")"
DUP = (
    "dup AS MATERIALIZED (SELECT 1 - count(*) / sum(n)::DOUBLE AS ratio FROM "
    f"(SELECT count(*) AS n FROM src GROUP BY {', '.join(DIRT)}) AS g)"
)
NUMBERS = "stats AS" + stats_cte(sql("dirt"), DIRT_NUMBERS).split(", stats AS", 1)[1]
FENCED = outlier_cte(DIRT_NUMBERS)
COUNTS = "counts AS" + counts_cte(sql("dirt"), DIRT_LABELS).split(", counts AS", 1)[1]
LABELS = f"summary AS MATERIALIZED ({SUMMARY.format()})"
PAIRS = "pairs AS MATERIALIZED (" + union(
    [
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM src"
        for i, a in enumerate(DIRT_NUMBERS)
        for b in DIRT_NUMBERS[i + 1 :]
    ]
) + ")"
TEXTS = ["email", "gender", "grade", "phone", "status", "zip_code"]
CLASSES = "cls AS MATERIALIZED (" + classes_sql(
    "src", TEXTS, ["age", "birth_year", "lot"], ["ship"]
) + ")"
QUASI = ["age", "birth_year", "gender", "zip_code"]
COMBOS = [
    [a, b] for i, a in enumerate(QUASI) for b in QUASI[i + 1 :]
] + [
    [a, b, c]
    for i, a in enumerate(QUASI)
    for j, b in enumerate(QUASI[i + 1 :], i + 1)
    for c in QUASI[j + 1 :]
]
COMBO = "combo AS MATERIALIZED (" + union(
    [
        f"SELECT '{','.join(k)}' AS names, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM src) AS d)"
        f" / (SELECT count(*) FROM src)::DOUBLE AS ratio"
        for k in COMBOS
    ]
) + ")"
EMAILS = (
    "emails AS MATERIALIZED (SELECT 'email' AS col, "
    "avg(CASE WHEN regexp_matches(email, '^(.+@.+\\..+)') THEN 1.0 ELSE 0.0 END) AS share FROM src)"
)
NUMERIC_TEXT = "numtext AS MATERIALIZED (" + union(
    [
        f"SELECT '{c}' AS col, avg(CASE WHEN regexp_matches({c}, "
        f"'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN 1.0 ELSE 0.0 END) AS share FROM src"
        for c in TEXTS
    ]
) + ")"

F_MISSING = finding(
    "MissingValuesDetector", "missing_values", "completeness", "n0 / r::DOUBLE", "sizes", "n0 / r::DOUBLE > 0.2"
)
F_CONSTANT = finding(
    "ConstantColumnDetector", "constant_column", "uniqueness", "1.0", "sizes", "k > 0 AND k <= 1"
)
F_DUPLICATES = finding(
    "DuplicateRowsDetector", "duplicate_rows", "uniqueness", "ratio", "dup", "ratio > 0.1",
    column="CAST(NULL AS VARCHAR)", scope="dataset",
)
F_SKEW = finding(
    "SkewnessDetector", "high_skewness", "validity", "least(abs(skew) / 10, 1.0)", "stats", "abs(skew) > 1"
)
F_CORRELATION = finding(
    "CorrelationDetector", "high_correlation", "consistency", "abs(v)", "pairs",
    "NOT isnan(v) AND abs(v) > 0.9", column="CAST(NULL AS VARCHAR)", columns="a || ',' || b", scope="cross_column",
)
F_IMBALANCE = finding(
    "ImbalanceDetector", "imbalance", "validity", "mode_ratio", "summary", "mode_ratio > 0.9",
    column='"column"',
)
F_QUASI = finding(
    "QuasiIdentifierDetector", "quasi_identifier_risk", "privacy", "ratio", "combo", "ratio > 0.8",
    column="CAST(NULL AS VARCHAR)", columns="names", scope="cross_column",
)
F_BOUNDS = finding(
    "SemanticBoundaryDetector", "semantic_violation", "validity", "1.0", "stats", "col = 'age' AND lo < 0"
) + " UNION ALL " + finding(
    "SemanticBoundaryDetector", "semantic_violation", "validity", "1.0", "stats", "col = 'age' AND hi > 125"
)
F_PATTERN = finding(
    "PatternDetector", "pattern_violation", "validity", "1.0 - share", "emails",
    "share < 0.8 AND col IN (SELECT col FROM cls WHERE predicted_class = 'email')",
)
F_RANGE = finding(
    "RangeDetector", "range_violation", "validity", "1.0", "stats", "lo < 0"
) + " UNION ALL " + finding(
    "RangeDetector", "range_violation", "validity", "1.0", "stats", "hi > 100"
)
F_OUTLIERS = finding(
    "OutlierDetector", "outliers", "validity", "outlier_ratio", "fenced", "outlier_ratio > 0.05"
) + " UNION ALL " + finding(
    "OutlierDetector", "outliers", "validity", "rare_count / cardinality::DOUBLE", "summary",
    "rare_count / cardinality::DOUBLE > 0.05", column='"column"',
)
F_ZERO = finding(
    "ZeroValueDetector", "zero_value", "completeness", "zeros", "stats", "zeros > 0.3"
)
F_RARE = finding(
    "RareCategoryDetector", "rare_category", "validity", "0.5", "summary", "rare_count > 0", column='"column"'
)
F_TYPE = finding(
    "TypeMismatchDetector", "type_mismatch", "integrity", "0.7", "numtext", "share > 0.8"
)
PERSONAL = "'email', 'phone', 'ssn', 'credit_card', 'address', 'name', 'date_of_birth', 'bank_account', 'driver_license'"
F_PII = finding(
    "PIIDetector", "pii_detected", "privacy", "confidence", "cls",
    f"predicted_class IN ({PERSONAL}) AND confidence > 0.6", confidence="0.9",
)
F_BIAS = finding(
    "BiasDetector", "potential_bias", "bias", "mode_ratio", "summary",
    "\"column\" = 'gender' AND mode_ratio > 0.9", column='"column"', confidence="0.8",
)


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


add("det_missing", detectors.missing, set(), with_(SRC, SIZES, body=F_MISSING))
add("det_constant", detectors.constant, {"distinct", "labels"}, with_(SRC, SIZES, body=F_CONSTANT))
add("det_duplicates", detectors.duplicates, {"rows"}, with_(SRC, DUP, body=F_DUPLICATES))
add("det_skewness", detectors.skewness, {"numbers"}, with_(SRC, NUMBERS, body=F_SKEW))
add("det_correlation", detectors.correlation, {"pairs"}, with_(SRC, PAIRS, body=F_CORRELATION))
add("det_imbalance", detectors.imbalance, {"labels"}, with_(SRC, COUNTS, LABELS, body=F_IMBALANCE))
add("det_quasi_id", detectors.quasi_identifiers, set(), with_(SRC, COMBO, body=F_QUASI))
add("det_semantic_bounds", detectors.semantic_bounds, {"numbers"}, with_(SRC, NUMBERS, body=F_BOUNDS))
add("det_pattern", detectors.pattern, {"classes"}, with_(SRC, CLASSES, EMAILS, body=F_PATTERN))
add("det_range", detectors.value_range, {"numbers"}, with_(SRC, NUMBERS, body=F_RANGE), RANGE)
add(
    "det_outliers", detectors.outliers, {"numbers", "labels"},
    with_(SRC, NUMBERS, FENCED, COUNTS, LABELS, body=F_OUTLIERS),
)
add("det_zero", detectors.zeros, {"numbers"}, with_(SRC, NUMBERS, body=F_ZERO))
add("det_rare", detectors.rare, {"labels"}, with_(SRC, COUNTS, LABELS, body=F_RARE))
add("pii", detectors.personal_data, {"classes"}, with_(SRC, CLASSES, body=F_PII))
add("bias", detectors.bias, {"labels", "classes"}, with_(SRC, COUNTS, LABELS, body=F_BIAS))


def _types(spark, sf_dir) -> DataFrame:
    dirt = detectors.types(context(frame(spark, sf_dir, "dirt"), set()))
    nested = detectors.types(context(table(spark, sf_dir, "embeddings"), set()))
    return shown(dirt.unionByName(nested))


QUERIES["det_type"] = _types
ORACLES["det_type"] = with_(
    SRC, NUMERIC_TEXT,
    body=F_TYPE + " UNION ALL "
    + finding("TypeMismatchDetector", "unknown_logical_type", "integrity", "0.5",
              "(SELECT 'embedding' AS col, count(*) AS n FROM embeddings) AS e", "n > 0"),
)


def _drift(spark, sf_dir) -> DataFrame:
    parts = {"numbers", "labels"}
    base = profile(frame(spark, sf_dir, "orders_before"), parts=parts)
    return shown(
        detectors.drift(context(frame(spark, sf_dir, "orders_after"), parts, baseline=base))
    )


QUERIES["det_drift"] = _drift
ORACLES["det_drift"] = f"""
WITH b AS (SELECT * FROM {sql('orders_before')} AS t), a AS (SELECT * FROM {sql('orders_after')} AS t),
moved AS (
  """ + union(
    [
        f"SELECT '{c}' AS col, abs((SELECT avg({c}) FROM a) - (SELECT avg({c}) FROM b)) / abs((SELECT avg({c}) FROM b)) AS shift"
        for c in ("o_orderkey", "total", "cust")
    ]
    + [
        f"SELECT '{c}' AS col, abs((SELECT max(n) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM a WHERE {c} IS NOT NULL GROUP BY {c}) AS g)"
        f" - (SELECT max(n) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM b WHERE {c} IS NOT NULL GROUP BY {c}) AS g)) AS shift"
        for c in ("priority", "service")
    ]
) + """)
""" + finding("DriftDetector", "data_drift", "integrity", "least(shift, 1.0)", "moved", "shift > 0.2")


MEANS = {c: f"avg({c})" for c in DIRT_NUMBERS}
TOPS = {
    c: f"(SELECT max(n) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM {{t}} WHERE {c} IS NOT NULL GROUP BY {c}) AS g)"
    for c in DIRT_LABELS
}
MOVED = f"before AS MATERIALIZED (SELECT * FROM {sql('dirt_before')} AS t), moved AS MATERIALIZED (" + union(
    [
        f"SELECT '{c}' AS col, abs((SELECT {m} FROM src) - (SELECT {m} FROM before)) / abs((SELECT {m} FROM before)) AS shift"
        for c, m in MEANS.items()
    ]
    + [f"SELECT '{c}' AS col, abs({m.format(t='src')} - {m.format(t='before')}) AS shift" for c, m in TOPS.items()]
) + ")"
F_DRIFT = finding("DriftDetector", "data_drift", "integrity", "least(shift, 1.0)", "moved", "shift > 0.2")


def _all(spark, sf_dir) -> DataFrame:
    """All rules and models; only what no detector reads is left out of the profile."""
    cfg = ML.with_detection(min_value=0.0, max_value=100.0)
    parts = {"labels", "distinct", "numbers", "pairs", "classes", "rows"}
    base = profile(frame(spark, sf_dir, "dirt_before"), cfg, parts={"numbers", "labels"})
    _, found = inspect(frame(spark, sf_dir, "dirt"), cfg, baseline=base, parts=parts)
    return shown(found)


QUERIES["all_findings"] = _all
# SQL cannot grow the forest's trees, so the query has no oracle: a test holds its other rows to this
ALL_BUT_FOREST = with_(
    SRC, SIZES, DUP, NUMBERS, FENCED, COUNTS, LABELS, PAIRS, CLASSES, COMBO, EMAILS, NUMERIC_TEXT, MOVED,
    body=union(
        [
            F_MISSING, F_CONSTANT, F_DUPLICATES, F_SKEW, F_CORRELATION, F_IMBALANCE, F_DRIFT, F_QUASI, F_BOUNDS,
            F_PATTERN, F_RANGE, F_OUTLIERS, F_ZERO, F_RARE, F_TYPE, F_PII, F_BIAS,
        ]
    ),
)
