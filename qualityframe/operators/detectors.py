"""Detectors: predicates over profile tables, and a few direct scans.

A detector takes a `Context` and returns finding rows. Detectors that only read
profiles work on any number of runs and datasets at once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Detection
from ..functions.cells import (
    INFINITE,
    PLAIN_NUMBER,
    TEXTUAL,
    col,
    columns_of,
    dbl,
    nan_to_null,
    q,
    raw,
    row_digest,
    sketch_distinct,
)
from . import forest, semantic
from .scale import dealt, local_frame, one_row, per_column, spread

FINDING_COLUMNS = (
    "run_id dataset_id kind detector issue_type dimension column columns scope severity "
    "confidence metrics description"
).split()

# Words that mark a quasi-identifier, and plausible ranges by word.
QUASI_WORDS = ["zip", "postal", "birth", "gender", "sex", "age", "race", "ethnicity"]
BOUNDS = [
    ("age", 0.0, 125.0),
    ("price", 0.0, None),
    ("count", 0.0, None),
    ("percentage", 0.0, 100.0),
    ("probability", 0.0, 1.0),
]
EMAIL_SHAPE = r"^(?:.+@.+\..+)"
NUMERIC_TEXT_SHARE = 0.8
COMBO_SKETCH_ERROR = 0.02


@dataclass
class Context:
    """What a detector may look at."""

    columns: DataFrame
    dataset: DataFrame
    correlations: DataFrame
    classes: DataFrame
    data: DataFrame | None = None
    baseline: DataFrame | None = None
    config: Config = field(default_factory=Config)
    key: list[str] | None = None
    run: tuple[str, str] | None = None  # (run_id, dataset_id) of the data
    pattern: str = EMAIL_SHAPE
    pattern_class: str = "email"

    @property
    def limits(self) -> Detection:
        return self.config.detection


def finding(
    rows: DataFrame,
    detector: str,
    issue: str,
    dimension: str,
    severity: Column,
    description: Column,
    metrics: dict[str, Column],
    column: Column | None = None,
    columns: Column | None = None,
    scope: str = "column",
    kind: str = "rule",
    confidence: float = 1.0,
) -> DataFrame:
    """Bring matching rows to the findings shape."""
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        "run_id",
        "dataset_id",
        F.lit(kind).alias("kind"),
        F.lit(detector).alias("detector"),
        F.lit(issue).alias("issue_type"),
        F.lit(dimension).alias("dimension"),
        (F.lit(None).cast("string") if column is None else column).alias("column"),
        (F.lit(None).cast("array<string>") if columns is None else columns).alias("columns"),
        F.lit(scope).alias("scope"),
        severity.cast("double").alias("severity"),
        F.lit(confidence).alias("confidence"),
        F.create_map(*pairs).alias("metrics"),
        description.alias("description"),
    )


def _over(
    rows: DataFrame,
    value: Column,
    limit: float,
    detector: str,
    issue: str,
    dimension: str,
    words: str,
    severity: Column | None = None,
    **extra: Column,
) -> DataFrame:
    """One finding per column whose value exceeds a limit."""
    return finding(
        rows.where(value > limit),
        detector,
        issue,
        dimension,
        value if severity is None else severity,
        F.concat(F.col("column"), F.lit(" " + words + " "), F.format_string("%.4f", value.cast("double"))),
        {"observed_value": value, "threshold": F.lit(limit), **extra},
        F.col("column"),
    )


def missing(c: Context) -> DataFrame:
    """Null share above the limit."""
    return _over(
        c.columns, F.col("null_ratio"), c.limits.missing,
        "MissingValuesDetector", "missing_values", "completeness", "has missing share",
    )


def constant(c: Context) -> DataFrame:
    """One value only (by exact distinct count), or below 1: mode share at the limit."""
    t = c.limits.constant
    if t < 1.0:
        observed = F.coalesce(F.col("categorical.mode_ratio"), F.lit(0.0))
        hit = observed >= t
    else:
        observed = F.col("distinct_count")
        hit = (observed > 0) & (observed <= t)
    return finding(
        c.columns.where(hit), "ConstantColumnDetector", "constant_column", "uniqueness",
        F.lit(1.0), F.concat(F.col("column"), F.lit(" is constant")),
        {"observed_value": observed, "threshold": F.lit(t)}, F.col("column"),
    )


def duplicates(c: Context) -> DataFrame:
    """Share of repeated rows above the limit."""
    ratio = F.col("duplicate_row_ratio")
    return finding(
        c.dataset.where(ratio > c.limits.duplicate), "DuplicateRowsDetector", "duplicate_rows",
        "uniqueness", ratio, F.format_string("%.2f%% of rows repeat another row", ratio * 100),
        {"observed_value": ratio, "threshold": F.lit(c.limits.duplicate)}, scope="dataset",
    )


def skewness(c: Context) -> DataFrame:
    """Absolute skewness above the limit; severity is a tenth of it, at most 1."""
    size = F.abs(F.col("numeric.skewness"))
    return _over(
        c.columns, size, c.limits.skewness, "SkewnessDetector", "high_skewness", "validity",
        "is skewed by", F.least(size / 10, F.lit(1.0)),
    )


def correlation(c: Context) -> DataFrame:
    """Pairs of different columns with absolute correlation above the limit."""
    size = F.abs(F.col("value"))
    hit = c.correlations.where((F.col("col1") != F.col("col2")) & (size > c.limits.correlation))
    return finding(
        hit, "CorrelationDetector", "high_correlation", "consistency", size,
        F.format_string("%s and %s are correlated (%.2f)", F.col("col1"), F.col("col2"), F.col("value")),
        {"observed_value": F.col("value"), "threshold": F.lit(c.limits.correlation)},
        columns=F.array("col1", "col2"), scope="cross_column",
    )


def imbalance(c: Context) -> DataFrame:
    """Top label above the limit. Booleans only on request (`boolean_imbalance`)."""
    found = _over(
        c.columns, F.col("categorical.mode_ratio"), c.limits.imbalance, "ImbalanceDetector",
        "imbalance", "validity", "is imbalanced, top share",
    )
    if not (c.limits.boolean_imbalance and c.data is not None):
        return found
    names = [n for n, t in c.data.dtypes if t == "boolean"]
    if not names:
        return found
    share = per_column(c.data, names, lambda n: {"t": f"avg({dbl(n)})"}).select(
        "column", F.greatest("t", 1 - F.col("t")).alias("share")
    )
    rows = c.columns.join(F.broadcast(share), "column")
    return found.unionByName(
        _over(
            rows, F.col("share"), c.limits.imbalance, "ImbalanceDetector", "imbalance",
            "validity", "is imbalanced, top share",
        )
    )


def drift(c: Context) -> DataFrame | None:
    """Mean or top-label share moved against a baseline profile of the same dataset."""
    if c.baseline is None:
        return None
    base = c.baseline.select(
        "dataset_id", "column", F.col("numeric.mean").alias("base_mean"),
        F.col("categorical.mode_ratio").alias("base_mode"),
    )
    moved = c.columns.join(base, ["dataset_id", "column"]).select(
        "run_id", "dataset_id", "column",
        F.inline(
            F.array(
                F.struct(
                    F.lit("mean").alias("metric"),
                    F.try_divide(
                        F.abs(F.col("numeric.mean") - F.col("base_mean")), F.abs("base_mean")
                    ).alias("shift"),
                ),
                F.struct(
                    F.lit("mode_ratio").alias("metric"),
                    F.abs(F.col("categorical.mode_ratio") - F.col("base_mode")).alias("shift"),
                ),
            )
        ),
    )
    return finding(
        moved.where(F.col("shift") > c.limits.drift), "DriftDetector", "data_drift", "integrity",
        F.least("shift", F.lit(1.0)),
        F.format_string("%s: %s shifted by %.4f from its baseline", F.col("column"), F.col("metric"), F.col("shift")),
        {"observed_shift": F.col("shift"), "threshold": F.lit(c.limits.drift), "metric": F.col("metric")},
        F.col("column"),
    )


def quasi_columns(c: Context) -> list[str]:
    """Columns whose name or class suggests a quasi-identifier, in name order."""
    named = semantic.name_has(QUASI_WORDS, F.col("column"), c.limits.whole_word_keywords)
    by_name = c.columns.where(named).select("column").collect()
    by_class = c.classes.where(F.col("predicted_class").isin(QUASI_WORDS)).select("column").collect()
    return sorted({r.column for r in [*by_name, *by_class]})


COMBO_SCHEMA = "columns array<string>, distinct_count bigint, row_count bigint, ratio double"


def _promising(
    data: DataFrame, names: list[str], combos: list[list[str]], at_least: float
) -> tuple[int, list[list[str]]]:
    """(rows, combinations that may hold `at_least` times as many different values)."""
    singles = {c: sketch_distinct(row_digest([c], data.schema)[0]) for c in names}
    found = one_row(data, {"": "count(1)"} | singles, batch=12)
    rows = found[""]
    if not rows:
        return 0, []
    slack = 6 * COMBO_SKETCH_ERROR
    most = {c: found[c] * (1 + slack) for c in names}
    combos = [k for k in combos if math.prod(most[c] for c in k) >= at_least * rows]
    if not combos:
        return rows, []
    digests = {str(i): sketch_distinct(row_digest(k, data.schema)[0]) for i, k in enumerate(combos)}
    sketch = one_row(data, digests, batch=6)
    floor = at_least * rows * (1 - slack)
    return rows, [k for i, k in enumerate(combos) if sketch[str(i)] >= floor]


def _packed(data: DataFrame, combos: list[list[str]]) -> DataFrame:
    """(h1, h2): for each row and combination 96 bits of a digest; h2 holds the combination's
    number above its 32."""
    slots = [
        "named_struct('h1', {1}, 'h2', ({2} & 4294967295L) | {0}L << 32)".format(i, *row_digest(k, data.schema))
        for i, k in enumerate(combos)
    ]
    return data.selectExpr(f"inline(array({', '.join(slots)}))")


def combination_uniqueness(
    df: DataFrame, names: list[str], at_least: float = 0.0
) -> DataFrame:
    """(columns, distinct_count, row_count, ratio) for every pair and triple of columns.

    With `at_least`, combinations that cannot reach it are dropped level by level: first
    those whose product of single-column counts is too small, then, of the rest, those
    whose sketch is. The survivors are counted exactly in one scan, by 96 bits of a digest
    and the combination's number, packed into two longs. Only the counts, one per
    combination, come back.
    """
    combos = [list(k) for r in (2, 3) for k in itertools.combinations(names, r)]
    with spread(df.select(*[col(c) for c in names])) as data:
        if at_least > 0:
            rows, combos = _promising(data, names, combos, at_least)
        else:
            rows = data.count()
        if not combos or not rows:
            return local_frame(df.sparkSession, [], COMBO_SCHEMA)
        counted = (
            _packed(data, combos)
            .distinct()
            .groupBy(F.shiftrightunsigned("h2", 32).cast("int").alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
    found = [(combos[r.slot], r.n, rows, r.n / rows) for r in counted]
    return local_frame(df.sparkSession, found, COMBO_SCHEMA)


def of_run(found: DataFrame, c: Context) -> DataFrame:
    """What a scan of the data found, labelled with the run that the data belong to."""
    runs = c.dataset.select("run_id", "dataset_id").distinct().take(2)
    if c.run is None and len(runs) > 1:
        raise ValueError("profiles of several runs: name the run that the data belong to")
    run = tuple(runs[0]) if c.run is None else c.run
    return found.withColumn("run_id", F.lit(run[0])).withColumn("dataset_id", F.lit(run[1]))


def quasi_identifiers(c: Context) -> DataFrame | None:
    """Pairs and triples of quasi-identifying columns that single out most rows."""
    if c.data is None:
        return None
    names = quasi_columns(c)
    if len(names) < 2:
        return None
    found = combination_uniqueness(c.data, names, c.limits.quasi_id).where(
        F.col("ratio") > c.limits.quasi_id
    )
    return finding(
        of_run(found, c), "QuasiIdentifierDetector", "quasi_identifier_risk",
        "privacy", F.col("ratio"),
        F.format_string(
            "%s together single out %.2f%% of rows", F.concat_ws(", ", "columns"), F.col("ratio") * 100
        ),
        {"uniqueness_ratio": F.col("ratio"), "threshold": F.lit(c.limits.quasi_id)},
        columns=F.col("columns"), scope="cross_column",
    )


def bound_for(name: Column, whole_word: bool = False) -> tuple[Column, Column, Column]:
    """(word, lowest, highest) for a column name; the longest matching word wins."""
    word = F.lit(None).cast("string")
    low = high = F.lit(None).cast("double")
    for w, lo, hi in sorted(BOUNDS, key=lambda b: len(b[0])):
        hit = semantic.name_has([w], name, whole_word)
        word = F.when(hit, F.lit(w)).otherwise(word)
        low = F.when(hit, F.lit(lo)).otherwise(low)
        high = F.when(hit, F.lit(hi).cast("double")).otherwise(high)
    return word, low, high


def semantic_bounds(c: Context) -> DataFrame:
    """Lowest or highest value outside what the column name allows."""
    word, low, high = bound_for(F.col("column"), c.limits.whole_word_keywords)
    rows = c.columns.where(F.col("numeric").isNotNull()).select(
        "run_id", "dataset_id", "column", word.alias("word"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("min").alias("end"), F.col("numeric.min").alias("observed"), low.alias("bound"),
                    (F.col("numeric.min") < low).alias("bad"),
                ),
                F.struct(
                    F.lit("max").alias("end"), F.col("numeric.max").alias("observed"), high.alias("bound"),
                    (F.col("numeric.max") > high).alias("bad"),
                ),
            )
        ),
    )
    return finding(
        rows.where("bad"), "SemanticBoundaryDetector", "semantic_violation", "validity", F.lit(1.0),
        F.format_string("%s (%s): %s passes the bound %s", F.col("column"), F.col("word"), F.col("end"), F.col("bound").cast("string")),
        {"observed": F.col("observed"), "boundary": F.col("bound"), "semantic": F.col("word"), "end": F.col("end")},
        F.col("column"),
    )


def pattern(c: Context) -> DataFrame | None:
    """Columns tagged with the class whose values match its shape too rarely."""
    if c.data is None:
        return None
    tagged = c.columns.where(F.array_contains("semantic_tags", c.pattern_class)).select("column")
    names = [r.column for r in tagged.collect() if r.column in c.data.columns]
    if not names:
        return None
    share = per_column(
        dealt(c.data.select(*[col(n) for n in names])), names,
        lambda n: {
            "share": f"avg(CAST(CAST({q(n)} AS STRING) RLIKE {raw(c.pattern)} AS DOUBLE))"
        },
    )
    rows = c.columns.join(F.broadcast(share), "column").where(F.col("share") < c.limits.pattern)
    return finding(
        rows, "PatternDetector", "pattern_violation", "validity", 1.0 - F.col("share"),
        F.format_string("%s: only %.2f%% look like %s", F.col("column"), F.col("share") * 100, F.lit(c.pattern_class)),
        {"observed_value": F.col("share"), "threshold": F.lit(c.limits.pattern)}, F.col("column"),
    )


def value_range(c: Context) -> DataFrame | None:
    """Numeric columns reaching outside the configured range."""
    pieces = []
    for end, limit in (("min", c.limits.min_value), ("max", c.limits.max_value)):
        if limit is None:
            continue
        seen = F.col(f"numeric.{end}")
        hit = seen < limit if end == "min" else seen > limit
        pieces.append(
            finding(
                c.columns.where(hit), "RangeDetector", "range_violation", "validity", F.lit(1.0),
                F.format_string(f"%s: {end} %s passes the limit %s", F.col("column"), seen.cast("string"), F.lit(str(limit))),
                {"observed_value": seen, "threshold": F.lit(float(limit)), "end": F.lit(end)}, F.col("column"),
            )
        )
    if not pieces:
        return None
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def outliers(c: Context) -> DataFrame:
    """Outlier share above the limit, numeric and categorical alike."""
    return _over(
        c.columns, F.col("behavior.outlier_ratio"), c.limits.outlier_ratio, "OutlierDetector",
        "outliers", "validity", "has outlier share", logical_type=F.col("logical_type"),
    )


def zeros(c: Context) -> DataFrame:
    """Share of zeros above the limit."""
    return _over(
        c.columns, F.col("numeric.zero_ratio"), c.limits.zero_value, "ZeroValueDetector",
        "zero_value", "completeness", "has zero share",
    )


def rare(c: Context) -> DataFrame:
    """Any label below the rare share. The labels themselves are `rare_categories` rows."""
    n = F.col("categorical.rare_count")
    return finding(
        c.columns.where(n > 0), "RareCategoryDetector", "rare_category", "validity", F.lit(0.5),
        F.format_string("%s has %d rare labels", F.col("column"), n),
        {"rare_count": n, "threshold": F.lit(c.limits.rare_category)}, F.col("column"),
    )


def numeric_text(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, share) of non-null texts that are numbers."""
    return per_column(
        dealt(df.select(*[col(n) for n in names])), names,
        lambda n: {
            "share": f"avg(CASE WHEN {q(n)} IS NULL THEN NULL WHEN {q(n)} RLIKE {raw(PLAIN_NUMBER)} "
            f"OR {q(n)} RLIKE {raw(INFINITE)} THEN 1D ELSE 0D END)"
        },
    )


def types(c: Context) -> DataFrame:
    """Columns of unknown type, wrongly typed numbers, and text that holds numbers."""
    unknown = finding(
        c.columns.where(F.col("logical_type") == "unknown"), "TypeMismatchDetector",
        "unknown_logical_type", "integrity", F.lit(0.5),
        F.concat_ws(" ", "column", F.lit("has no known logical type:"), "dtype"),
        {"dtype": F.col("dtype")}, F.col("column"),
    )
    odd = c.columns.where(
        F.col("dtype").rlike("int|float|double|decimal")
        & ~F.col("dtype").rlike("<")
        & ~F.col("logical_type").isin("numeric", "boolean", "datetime", "unknown")
    )
    out = unknown.unionByName(
        finding(
            odd, "TypeMismatchDetector", "type_mismatch", "integrity", F.lit(0.8),
            F.concat_ws(" ", "column", F.lit("is stored as"), "dtype", F.lit("but read as"), "logical_type"),
            {"dtype": F.col("dtype")}, F.col("column"),
        )
    )
    names = columns_of(c.data, TEXTUAL) if c.data is not None else []
    if not names:
        return out
    rows = c.columns.join(F.broadcast(numeric_text(c.data, names)), "column").where(
        F.col("share") > NUMERIC_TEXT_SHARE
    )
    return out.unionByName(
        finding(
            rows, "TypeMismatchDetector", "type_mismatch", "integrity", F.lit(0.7),
            F.format_string("%s is text but %.0f%% of it is numeric", F.col("column"), F.col("share") * 100),
            {"valid_numeric_ratio": F.col("share")}, F.col("column"),
        )
    )


def anomalies(c: Context) -> DataFrame | None:
    """Share of rows an isolation forest flags."""
    if c.data is None:
        return None
    found = forest.anomaly_rows(c.data, key=c.key, cfg=c.config.profiling)
    return finding(
        of_run(found, c), "IsolationForest", "anomaly_score", "accuracy",
        F.col("anomaly_ratio"),
        F.format_string("%d of %d rows are anomalous", F.col("anomaly_count"), F.col("samples")),
        {"samples": F.col("samples"), "anomaly_count": F.col("anomaly_count")},
        scope="dataset", kind="model", confidence=0.8,
    )


def personal_data(c: Context) -> DataFrame:
    """Columns classified as personal data."""
    return finding(
        semantic.pii(c.classes, c.limits), "PIIDetector", "pii_detected", "privacy", F.col("confidence"),
        F.concat_ws(" ", "column", F.lit("holds"), "predicted_class"),
        {"pii_type": F.col("predicted_class"), "pii_score": F.col("confidence")},
        F.col("column"), kind="model", confidence=0.9,
    )


def bias(c: Context) -> DataFrame:
    """Sensitive columns (by name or class) with one dominant label."""
    labels = c.classes.select("run_id", "dataset_id", "column", "predicted_class")
    named = semantic.name_has(semantic.SENSITIVE, F.col("column"), c.limits.whole_word_keywords)
    rows = c.columns.join(labels, ["run_id", "dataset_id", "column"], "left").where(
        (named | F.coalesce(F.col("predicted_class").isin(semantic.SENSITIVE), F.lit(False)))
        & (F.col("categorical.mode_ratio") > c.limits.bias)
    )
    ratio = F.col("categorical.mode_ratio")
    return finding(
        rows, "BiasDetector", "potential_bias", "bias", ratio,
        F.format_string("%s is sensitive and %.2f%% one value", F.col("column"), ratio * 100),
        {"mode_ratio": ratio, "threshold": F.lit(c.limits.bias)}, F.col("column"),
        kind="model", confidence=0.8,
    )


Detector = Callable[[Context], DataFrame | None]

RULES: list[Detector] = [
    missing, constant, duplicates, skewness, correlation, imbalance, drift, quasi_identifiers,
    semantic_bounds, pattern, value_range, outliers, zeros, rare, types,
]
MODELS: list[Detector] = [anomalies, personal_data, bias]


class Registry:
    """The detectors of a run, in order; add your own with `rule` or `model`."""

    def __init__(self) -> None:
        self.rules = list(RULES)
        self.models = list(MODELS)

    def rule(self, detector: Detector) -> Detector:
        self.rules.append(detector)
        return detector

    def model(self, detector: Detector) -> Detector:
        self.models.append(detector)
        return detector


def detect(c: Context, registry: Registry | None = None) -> DataFrame:
    """All findings of all detectors, numbered within their run."""
    registry = registry or Registry()
    if c.data is not None:
        c.data = nan_to_null(c.data)
    chosen = list(registry.rules)
    if c.config.ml_enabled and c.limits.enable_ml:
        chosen += registry.models
    pieces = []
    for place, detector in enumerate(chosen):
        found = detector(c)
        if found is not None:
            pieces.append(found.select(*FINDING_COLUMNS).withColumn("place", F.lit(place)))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    # one dataset's findings are bounded by its schema
    order = Window.partitionBy("run_id", "dataset_id").orderBy(
        "place", F.coalesce("column", F.concat_ws(",", "columns")), "issue_type", "description"
    )
    return out.withColumn("seq", F.row_number().over(order).cast("long")).drop("place")
