"""From findings to scores, breakdowns, verdicts and the factors behind them.

All tables carry run_id and dataset_id, so one job scores any number of datasets.
Scores are risks: high is bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["run_id", "dataset_id"]

# Verdict bounds, severity levels, share of the worst finding that
# counts for the whole, and how many factors are named.
PASS_BELOW, WARN_BELOW = 0.2, 0.5
LEVELS = [("CRITICAL", 0.7), ("HIGH", 0.4), ("MEDIUM", 0.2)]
WORST_SHARE = 0.8
NOTABLE = 0.1
TOP = {"issue": 5, "dimension": 3, "column": 5}


def normalize(findings: DataFrame) -> DataFrame:
    """One shape for rule and model findings; the first of several columns stands for all."""
    return findings.select(
        *RUN,
        "seq",
        F.col("detector").alias("detector_id"),
        F.col("issue_type").alias("rule_id"),
        "issue_type",
        "dimension",
        F.coalesce("column", F.try_element_at("columns", F.lit(1))).alias("column"),
        "severity",
        "confidence",
        "metrics",
    )


def score(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """final_score = severity * confidence * weight of the rule (1 by default)."""
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(table, F.col("rule_id")), F.lit(1.0))
    return (
        normalize(findings)
        .withColumn("weight", weight)
        .withColumn("final_score", F.col("severity") * F.col("confidence") * F.col("weight"))
    )


def global_score(scores: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The larger of the weighted mean and 0.8 of the worst score; 0 without findings."""
    out = scores.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("findings"),
        F.greatest(
            F.coalesce(F.try_divide(F.sum("final_score"), F.sum("weight")), F.lit(0.0)),
            F.lit(WORST_SHARE) * F.max("final_score"),
        ).alias("score"),
    )
    if runs is None:
        return out
    return (
        runs.select(*RUN)
        .distinct()
        .join(out, RUN, "left")
        .select(
            *RUN,
            F.coalesce("findings", F.lit(0)).alias("findings"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def breakdown(scores: DataFrame) -> DataFrame:
    """Mean score by issue, dimension and column: (run, kind, name, mean, n)."""
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(c).alias("name"))
            for k, c in (("issue", "issue_type"), ("dimension", "dimension"), ("column", "column"))
        ]
    )
    return (
        scores.select(*RUN, "final_score", F.inline(kinds))
        .where(F.col("name").isNotNull())
        .groupBy(*RUN, "kind", "name")
        .agg(F.avg("final_score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    )


def verdict(score_: Column) -> Column:
    return (
        F.when(score_ < PASS_BELOW, "PASS").when(score_ < WARN_BELOW, "WARN").otherwise("FAIL")
    )


def severity_level(score_: Column) -> Column:
    out = F
    for name, bound in LEVELS:
        out = out.when(score_ >= bound, name)
    return out.otherwise("LOW")


def decide(scores: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Verdict and severity level per run."""
    return global_score(scores, runs).select(
        *RUN,
        "findings",
        "score",
        verdict(F.col("score")).alias("decision"),
        severity_level(F.col("score")).alias("severity_level"),
    )


def top_factors(means: DataFrame) -> DataFrame:
    """Leading issues, dimensions and columns above 0.1; else the single leader.

    Ties go by name. `row_number <= k` is applied before the shuffle as well, so a
    run with many findings sends only its leaders.
    """
    place = F.row_number().over(
        Window.partitionBy(*RUN, "kind").orderBy(F.desc("mean_score"), "name")
    )
    limit = F.lit(0)
    for kind, k in TOP.items():
        limit = F.when(F.col("kind") == kind, k).otherwise(limit)
    return (
        means.withColumn("place", place)
        .where(F.col("place") <= max(TOP.values()))
        .where(
            (F.col("place") <= limit)
            & ((F.col("mean_score") > NOTABLE) | (F.col("place") == 1))
        )
    )


def _named(kind: str) -> Column:
    """Names of one kind in order of place."""
    hits = F.collect_list(
        F.when(F.col("kind") == kind, F.struct("place", "name"))
    )
    return F.transform(F.array_sort(hits), lambda x: x["name"])


def decisions(scores: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Verdicts with their leading factors and a sentence that states them."""
    factors = (
        top_factors(breakdown(scores))
        .groupBy(*RUN)
        .agg(
            _named("issue").alias("dominant_issues"),
            _named("dimension").alias("dominant_dimensions"),
            _named("column").alias("affected_columns"),
        )
    )
    none = F.array().cast("array<string>")
    lists = ("dominant_issues", "dominant_dimensions", "affected_columns")
    out = decide(scores, runs).join(factors, RUN, "left")
    for c in lists:
        out = out.withColumn(c, F.coalesce(c, none))

    def part(label: str, c: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f" {label}: "), F.concat_ws(", ", c), F.lit(".")))

    return out.withColumn(
        "explanation",
        F.concat_ws(
            "",
            F.format_string("%s at risk %.3f.", F.col("decision"), F.col("score")),
            part("Issues", "dominant_issues"),
            part("Dimensions", "dominant_dimensions"),
            part("Columns", "affected_columns"),
        ),
    )


def issue_map(scores: DataFrame) -> DataFrame:
    """Distinct columns per issue, DATASET where a finding has none.

    The list is bounded by the number of columns of the dataset.
    """
    return (
        scores.select(*RUN, "issue_type", F.coalesce("column", F.lit("DATASET")).alias("column"))
        .distinct()
        .groupBy(*RUN, "issue_type")
        .agg(F.sort_array(F.collect_list("column")).alias("columns"))
    )


def issue_metadata(scores: DataFrame) -> DataFrame:
    """Metrics per issue merged over its findings; the latest finding wins a key."""
    return (
        scores.select(*RUN, "issue_type", "seq", F.explode("metrics").alias("k", "v"))
        .groupBy(*RUN, "issue_type", "k")
        .agg(F.max_by("v", "seq").alias("v"))
        .groupBy(*RUN, "issue_type")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    )
