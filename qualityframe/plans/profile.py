"""Profile a table: every column, the whole, and the pairs.

Each step is a Spark aggregate whose result has one row per column or pair; those
rows become the profile tables that detection, scoring and planning read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Profiling
from ..functions.cells import TEXTUAL, col, columns_of, nan_to_null
from ..operators import categories, forest, numeric, passes, relations, semantic, structure, times
from ..operators.scale import local_frame, pin, spread, together

NUMERIC_STRUCT = ", ".join(f"`{f}`: double" for f in numeric.NUMERIC_FIELDS)

COLUMN_SCHEMA = f"""
run_id string, dataset_id string, `column` string, dtype string, logical_type string,
row_count bigint, null_count bigint, distinct_count bigint,
null_ratio double, unique_ratio double, duplicate_ratio double, bytes bigint,
`numeric` struct<{NUMERIC_STRUCT}>,
categorical struct<cardinality: bigint, entropy: double, mode: string, mode_ratio: double,
  dominance_ratio: double, rare_count: bigint>,
datetime struct<`min`: string, `max`: string, range_days: double, monotonic: boolean>,
`text` struct<avg_length: double, length_std: double, digit_ratio: double,
  whitespace_ratio: double, special_char_ratio: double>,
behavior struct<outlier_ratio: double, heavy_tail_score: double, multimodality_score: double,
  low_variance_indicator: double>,
semantic_tags array<string>
"""

DATASET_SCHEMA = """
run_id string, dataset_id string, row_count bigint, column_count bigint,
duplicate_row_ratio double, bytes bigint, total_null_ratio double,
type_distribution map<string,bigint>, correlation_density double, fingerprint string
"""

PAIRS_SCHEMA = "run_id string, dataset_id string, method string, col1 string, col2 string, value double"

MODEL_SCHEMA = """
run_id string, dataset_id string, model string, version string, target string,
predicted_class string, confidence double, anomaly_ratio double, mean_anomaly_score double
"""


@dataclass
class Profiles:
    """The profile tables of one run, all sized by the schema."""

    columns: DataFrame
    dataset: DataFrame
    correlations: DataFrame
    models: DataFrame
    config: Profiling = field(default_factory=Profiling)

    def classes(self) -> DataFrame:
        return self.models.where(F.col("model") == "semantic_classifier").select(
            "run_id", "dataset_id", F.col("target").alias("column"), "predicted_class", "confidence"
        )


PARTS = frozenset(
    {"labels", "distinct", "numbers", "dates", "prose", "pairs", "classes", "anomalies", "rows"}
)


WIDE = 64  # outlier tests of one scan


def _sizes(seen: dict[str, dict], df: DataFrame) -> dict[str, dict]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return {
        c: {
            "dtype": types[c],
            "row_count": s["rows"],
            "null_count": s["nulls"],
            "null_ratio": s["nulls"] / s["rows"] if s["rows"] else 0.0,
            "bytes": int(s["bytes"]),
        }
        for c, s in seen.items()
    }


def label_fields(s: dict, total: int) -> dict:
    """Label statistics from the value counts of a column with `total` values."""
    n = s["distinct_count"]
    entropy = max(math.log2(total) - s["nlogn"] / total, 0.0)
    imbalance = 1.0 - (entropy / math.log2(n) if n > 1 else entropy)
    share = -s["top"].less / total
    return {
        "distinct_count": n,
        "categorical": (n, entropy, s["top"].value, share, share, s["rare_count"]),
        "behavior": (s["rare_count"] / n, imbalance, share, imbalance),
    }


def _quartiles(df: DataFrame, seen: dict, spans: dict, inside: dict, live: list[str], cfg: Profiling) -> dict:
    """Exact quartiles from the bracket counts; columns without them are selected apart."""
    out, open_ = {}, {}
    for c in live:
        counts = sorted(inside.get(c, []), key=lambda r: (r[0], r[1] or 0.0))
        for p in numeric.QUARTILES:
            value = numeric.pick(counts, seen[c]["n"], p) if counts else None
            if value is None:
                open_.setdefault(c, []).append(p)
            else:
                out[c, p] = value
    if open_:
        out |= numeric.quantiles(df, open_, {c: seen[c]["n"] for c in open_}, exact=cfg.exact_quantiles)
    return out


def _values(
    df: DataFrame, seen: dict, shapes: dict, types: dict, close: list[str], cfg: Profiling, chosen: set, numbers: list[str]
) -> tuple[dict[str, dict], dict[str, str]]:
    """Everything that needs value counts or quartiles: ({column: fields}, types).

    One scan counts values, and one more tests for outliers.
    """
    texts = [c for c, t in types.items() if t == "categorical"] if "labels" in chosen else []
    counted = [c for c in structure.countable(df) if types.get(c) != "categorical"] if "distinct" in chosen else []
    exact = counted if cfg.exact_distinct else []
    columns = sorted({*texts, *exact, *close})
    live = [c for c in numbers if seen[c]["n"] and seen[c]["min"] != seen[c]["max"]] if "numbers" in chosen else []
    spans = {
        c: numeric.quartile_spans(seen[c]["sketch"])
        for c in live
        if cfg.exact_quantiles and numeric.fits_brackets(seen[c]["n"])
    }
    totals = {c: shapes[c]["n"] for c in (*texts, *close)}
    stats, inside = passes.value_look(df, columns, totals, spans, cfg)
    types = types | {c: categories.string_type(totals[c], shapes[c]["mean"], stats[c]["distinct_count"], cfg) for c in close}
    out: dict[str, dict] = {c: {} for c in types}
    for c in columns:
        if types[c] == "categorical":
            if "labels" in chosen and totals[c]:
                out[c] = label_fields(stats[c], totals[c])
        elif "distinct" in chosen:
            out[c] = {"distinct_count": stats[c]["distinct_count"]}
    if counted and not cfg.exact_distinct:
        for r in structure.distinct_counts(df, counted, exact=False).collect():
            out[r.column]["distinct_count"] = r.distinct_count
    if "numbers" in chosen and numbers:
        quart = _quartiles(df, seen, spans, inside, live, cfg)
        found = numeric.assembled(numbers, seen, passes.power_sums(df, seen, live), quart)
        for c, fields in found.items():
            out[c]["numeric"] = tuple(fields[f] for f in numeric.NUMERIC_FIELDS)
        for c, b in numeric.numeric_behavior(df, found, cfg, WIDE).items():
            out[c]["behavior"] = tuple(b.values())
    return out, types


def _text_types(seen: dict, df: DataFrame, cfg: Profiling) -> tuple[dict, dict, list[str]]:
    """(text shapes, logical types, text columns too close to a limit for the sketch)."""
    shapes = {
        c: {"n": seen[c]["text_n"], "mean": seen[c]["text_mean"], "approx": seen[c]["text_approx"]}
        for c in columns_of(df, TEXTUAL)
    }
    types, close = categories.sketched_types(df, cfg, shapes)
    return shapes, types, close


def _dates(df: DataFrame, seen: dict, names: list[str], order_by: str | None) -> dict[str, dict]:
    def ordered(c: str) -> bool | None:
        return times.monotonic(df, c, order_by).first().monotonic if order_by else None

    return {c: {"datetime": (*ends, ordered(c))} for c, ends in passes.date_stats(df, seen, names).items()}


def _pairs(df: DataFrame, seen: dict, names: list[str], cfg: Profiling, key: list[str] | None) -> list | None:
    if not names:
        return None
    middle = {c: seen[c]["sketch"] and numeric.near_median(seen[c]["sketch"]) for c in names if "sketch" in seen[c]}
    if cfg.sample_correlation:
        df, middle = structure.sample_rows(df, key or df.columns, cfg), {}
    found = relations.correlations(df, names, cfg.correlation_method, cfg, middle)
    return None if found is None else found.collect()


def _classes(df: DataFrame, seen: dict, cfg: Profiling) -> dict[str, tuple[str, float]]:
    if cfg.semantic_sample_size:
        return semantic.classify(df, cfg)
    return semantic.decided(df.columns, passes.class_shares(seen), cfg)


def profile(
    df: DataFrame,
    cfg: Config | Profiling = Profiling(),
    order_by: str | None = None,
    run_id: str = "run",
    dataset_id: str = "dataset",
    key: list[str] | None = None,
    parts: frozenset[str] | set[str] = PARTS,
) -> Profiles:
    """Profile every column, the dataset and, if enabled, correlations and models.

    A first scan looks at every column, a second counts values, a third tests for outliers;
    pairs and forests read the table on their own, at the same time. `parts` leaves steps out.
    """
    cfg = cfg.profiling if isinstance(cfg, Config) else cfg
    df = nan_to_null(df)
    spark = df.sparkSession
    ids = (run_id, dataset_id)
    chosen = set(parts)
    if not cfg.enable_correlation:
        chosen.discard("pairs")
    if not cfg.enable_ml:
        chosen -= {"classes", "anomalies"}

    def names_if(part: str, names: list[str]) -> list[str]:
        return names if part in chosen else []

    with spread(df) as data:
        seen = passes.first_look(data, {*chosen} - ({"classes"} if cfg.semantic_sample_size else set()))
        found = _sizes(seen, data)
        shapes, types, close = _text_types(seen, data, cfg)
        numbers = [c for c in found if types.get(c) == "numeric"]
        features = [c for c in numbers if c not in (key or [])]
        counts = {c: seen[c]["rows"] - seen[c]["nulls"] for c in features}
        dates = names_if("dates", [c for c in found if types.get(c) == "datetime"])
        (values, types), days, pairs, classes, anomalies, repeated = together(
            spark,
            lambda: _values(data, seen, shapes, types, close, cfg, chosen, numbers),
            lambda: _dates(data, seen, dates, order_by),
            lambda: _pairs(data, seen, names_if("pairs", numbers), cfg, key),
            lambda: _classes(data, seen, cfg) if "classes" in chosen else {},
            lambda: forest.anomaly_columns(data, features, key, cfg, counts)
            if "anomalies" in chosen and features
            else {},
            lambda: structure.row_look(data).first() if "rows" in chosen else None,
        )
        prose = passes.prose_stats(data, seen, names_if("prose", [c for c in found if types[c] == "text"]))
    for c in found:
        found[c]["logical_type"] = types[c]
        found[c] |= values.get(c, {}) | days.get(c, {})
        if c in prose:
            found[c]["text"] = prose[c]
    mark = repeated and structure.fingerprint_of(df.schema, repeated.row_count, repeated.row_xor, repeated.row_sum)
    share = repeated.duplicate_row_ratio if repeated else None
    return assemble(spark, ids, found, cfg, share, mark, pairs, classes, anomalies)


def assemble(
    spark: SparkSession,
    ids: tuple[str, str],
    found: dict[str, dict],
    cfg: Profiling,
    duplicate_row_ratio: float | None,
    fingerprint: str | None,
    pairs: list | None = None,
    classes: dict[str, tuple[str, float]] | None = None,
    anomalies: dict[str, tuple[float, float]] | None = None,
) -> Profiles:
    """The profile tables from the fields of each column."""
    classes, anomalies = classes or {}, anomalies or {}
    rows = next(iter(found.values()))["row_count"] if found else 0
    for fields in found.values():
        distinct = fields.get("distinct_count")
        if distinct is not None:
            fields["unique_ratio"] = distinct / rows if rows else 0.0
            fields["duplicate_ratio"] = (rows - distinct) / rows if rows else 0.0

    order = (
        "dtype logical_type row_count null_count distinct_count null_ratio unique_ratio "
        "duplicate_ratio bytes numeric categorical datetime text behavior"
    ).split()
    columns = local_frame(spark, [
            (*ids, c, *[f.get(n) for n in order], [classes[c][0]] if c in classes else [])
            for c, f in found.items()
        ],
        COLUMN_SCHEMA,
    )
    cells = rows * len(found)
    type_counts: dict[str, int] = {}
    for f in found.values():
        type_counts[f["dtype"]] = type_counts.get(f["dtype"], 0) + 1
    density = None
    if pairs is not None:
        off = [abs(r.value) for r in pairs if r.col1 != r.col2]
        density = sum(off) / len(off) if off else 0.0
    dataset = local_frame(spark, [
            (
                *ids, rows, len(found), duplicate_row_ratio,
                sum(f["bytes"] for f in found.values()),
                sum(f["null_count"] for f in found.values()) / cells if cells else 0.0,
                type_counts, density,
                fingerprint,
            )
        ],
        DATASET_SCHEMA,
    )
    correlations = local_frame(spark, [(*ids, cfg.correlation_method, r.col1, r.col2, r.value) for r in pairs or []], PAIRS_SCHEMA
    )
    models = local_frame(spark, [(*ids, "semantic_classifier", "1.1", c, k, s, None, None) for c, (k, s) in classes.items()]
        + [
            (*ids, "anomaly_amplifier", "1.0", c, None, None, a, m)
            for c, (a, m) in anomalies.items()
        ],
        MODEL_SCHEMA,
    )
    return Profiles(columns, dataset, correlations, models, cfg)


def rounded(frame: DataFrame, digits: int) -> DataFrame:
    """Round every double, nested ones included, for display."""

    def walk(c, t):
        name = t.typeName()
        if name == "double":
            return F.round(c, digits)
        if name == "struct":
            return F.when(
                c.isNotNull(),
                F.struct(*[walk(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]),
            )
        if name == "array" and t.elementType.typeName() == "double":
            return F.transform(c, lambda x: F.round(x, digits))
        return c

    return frame.select(*[walk(col(f.name), f.dataType).alias(f.name) for f in frame.schema.fields])


def risk_signals(profiles: Profiles) -> DataFrame:
    """Profile values as long rows (run_id, dataset_id, signal, subject, value)."""
    ids = [F.col("run_id"), F.col("dataset_id")]

    def long(frame: DataFrame, subject, **values) -> DataFrame:
        cells = [
            F.struct(F.lit(k).alias("signal"), v.cast("double").alias("value"))
            for k, v in values.items()
        ]
        return (
            frame.select(*ids, subject.alias("subject"), F.inline(F.array(*cells)))
            .where(F.col("value").isNotNull())
            .select("run_id", "dataset_id", "signal", "subject", "value")
        )

    whole = long(
        profiles.dataset,
        F.lit("dataset"),
        null_ratio=F.col("total_null_ratio"),
        duplicate_ratio=F.col("duplicate_row_ratio"),
        correlation_density=F.col("correlation_density"),
    )
    each = long(
        profiles.columns,
        F.col("column"),
        null_ratio=F.col("null_ratio"),
        unique_ratio=F.col("unique_ratio"),
        duplicate_ratio=F.col("duplicate_ratio"),
        identifier_likelihood=F.when(F.col("unique_ratio") == 1.0, F.lit(1.0)),
        outlier_ratio=F.col("behavior.outlier_ratio"),
        heavy_tail=F.col("behavior.heavy_tail_score"),
        multimodality=F.col("behavior.multimodality_score"),
        low_variance=F.col("behavior.low_variance_indicator"),
    )
    off = profiles.correlations.where(F.col("col1") != F.col("col2"))
    pair = long(off, F.concat_ws("__", "col1", "col2"), correlation=F.col("value"))
    return whole.unionByName(each).unionByName(pair)


def profile_delta(before: DataFrame, after: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(column, metric, before, after): columns dropped or added, ratios that moved."""

    def side(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(
            "column",
            F.lit(True).alias(f"{tag}_here"),
            F.col("null_ratio").alias(f"{tag}_null"),
            F.coalesce("behavior.outlier_ratio", F.lit(0.0)).alias(f"{tag}_out"),
        )

    def percent(c):
        return F.format_string("%.1f%%", c * 100)

    both = side(before, "b").join(side(after, "a"), "column", "full_outer")
    here = F.col("b_here").isNotNull() & F.col("a_here").isNotNull()
    cells = F.array(
        F.struct(
            F.lit("presence").alias("metric"),
            F.when(F.col("b_here").isNull(), "absent").otherwise("present").alias("before"),
            F.when(F.col("a_here").isNull(), "dropped").otherwise("added").alias("after"),
            (~here).alias("moved"),
        ),
        *[
            F.struct(
                F.lit(name).alias("metric"),
                percent(F.col(f"b_{c}")).alias("before"),
                percent(F.col(f"a_{c}")).alias("after"),
                (here & (F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")) > tolerance)).alias("moved"),
            )
            for name, c in (("null_ratio", "null"), ("outlier_ratio", "out"))
        ],
    )
    return (
        both.select("column", F.inline(cells)).where("moved").select(
            "column", "metric", "before", "after"
        )
    )


def save(profiles: Profiles, path: str) -> None:
    """Append the profile tables below a shared folder, for later comparison."""
    for name in ("columns", "dataset", "correlations", "models"):
        getattr(profiles, name).write.mode("append").parquet(f"{path}/{name}")


def load_profiles(spark, path: str, run_id: str) -> Profiles:
    """The saved profile of one run, pinned: it has one row per column or pair."""
    parts = [
        pin(spark.read.parquet(f"{path}/{n}").where(F.col("run_id") == run_id))
        for n in ("columns", "dataset", "correlations", "models")
    ]
    return Profiles(*parts)
