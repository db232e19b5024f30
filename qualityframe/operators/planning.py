"""From scored issues to one repair per column, governance and approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ADVISORY, AUTOMATIC, Config
from .detectors import bound_for
from .scoring import RUN

# Issue, drop the column above this mean score, otherwise do this.
# A cut-off of None means the second operation always.
RULES = [
    ("missing_values", 0.4, "impute"),
    ("duplicate_rows", None, "remove_duplicates"),
    ("constant_column", None, "drop_column"),
    ("outliers", 0.7, "clip"),
    ("high_skewness", 0.6, "log_transform"),
    ("high_correlation", None, "drop_column"),
    ("range_violation", 0.5, "clip"),
    ("zero_value", 0.4, "impute"),
    ("pattern_violation", 0.5, "flag_nulls"),
    ("data_drift", None, "warn"),
    ("quasi_identifier_risk", None, "mask_pii"),
    ("semantic_violation", 0.5, "clip"),
    ("imbalance", 0.9, "group_rare"),
    ("rare_category", None, "group_rare"),
    ("type_mismatch", None, "cast_type"),
    ("pii_detected", 0.8, "mask_pii"),
    ("anomaly_score", None, "remove_anomalies"),
    ("potential_bias", None, "warn"),
    ("unknown_logical_type", None, "warn"),
]
DATASET_OPERATIONS = ["remove_duplicates", "remove_anomalies"]

# Which operation wins on a column, and how each is shown.
PRIORITY = [
    "drop_column", "mask_pii", "cast_type", "clip", "log_transform", "impute", "flag_nulls",
    "group_rare",
]
ACTION_TYPES = {
    "drop_column": "DROP",
    "remove_duplicates": "DEDUPE",
    "impute": "IMPUTE",
    "clip": "CLIP",
    "log_transform": "TRANSFORM",
    "group_rare": "GROUP",
    "cast_type": "REPAIR",
    "mask_pii": "MASK",
    "remove_anomalies": "DROP",
    "flag_nulls": "FLAG",
    "warn": "WARN",
}

PLAN_COLUMNS = [
    *RUN, "seq", "action_id", "action_type", "operation", "column", "params", "reason",
    "requires_approval", "approved",
]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _override(op: Column, issue: Column, overrides: dict[str, str]) -> Column:
    """A configured action for the issue: an action type, an operation, or IGNORE."""
    by_type = {t: o for o, t in reversed(ACTION_TYPES.items())}
    named = {k: by_type.get(v.upper(), v.lower()) for k, v in overrides.items()}
    return F.coalesce(_lookup(named, issue), op)


def _params(cfg: Config) -> Column:
    """Options of the chosen operation as text."""
    issue, op = F.col("issue_type"), F.col("operation")
    limits = cfg.detection
    _, low, high = bound_for(F.col("column"), limits.whole_word_keywords)

    def given(v: float | None) -> Column:
        return F.lit(None if v is None else str(float(v))).cast("string")

    pairs = [
        ("strategy", F.when(op == "impute", F.lit("median"))),
        (
            "zeros_as_null",
            F.when(
                (op == "impute") & (issue == "zero_value") & F.lit(cfg.planning.zeros_as_null), "true"
            ),
        ),
        (
            "min",
            F.when((op == "clip") & (issue == "range_violation"), given(limits.min_value)).when(
                (op == "clip") & (issue == "semantic_violation"), low.cast("string")
            ),
        ),
        (
            "max",
            F.when((op == "clip") & (issue == "range_violation"), given(limits.max_value)).when(
                (op == "clip") & (issue == "semantic_violation"), high.cast("string")
            ),
        ),
        ("open_ended", F.when((op == "clip") & (issue == "semantic_violation"), "true")),
        ("target_type", F.when(op == "cast_type", "numeric")),
        ("pii_type", F.when(op == "mask_pii", F.try_element_at("metrics", F.lit("pii_type")))),
        (
            "pattern",
            F.when(
                (op == "flag_nulls") & F.lit(cfg.planning.flag_pattern_violations), "violations"
            ),
        ),
        (
            "threshold",
            F.when(op == "group_rare", F.lit(str(cfg.profiling.rare_category_threshold))),
        ),
    ]
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs]),
        lambda e: e["v"].isNotNull(),
    )
    return F.map_from_entries(entries)


def raw_actions(scores: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every action the issues call for: one per issue and column.

    The rule table has a row per issue type and becomes a lookup expression; the
    only shuffles group findings by run, issue and column.
    """
    cutoffs = F.lit(None).cast("double")
    below = F.lit(None).cast("string")
    for issue, cutoff, op in RULES:
        cutoffs = F.when(F.col("issue_type") == issue, F.lit(cutoff).cast("double")).otherwise(cutoffs)
        below = F.when(F.col("issue_type") == issue, op).otherwise(below)
    means = (
        scores.where(F.col("column").isNotNull())
        .groupBy(*RUN, "column")
        .agg(F.avg("final_score").alias("column_score"))
    )
    issues = scores.groupBy(*RUN, "issue_type", "column").agg(
        F.min("seq").alias("seq"), F.max_by("metrics", "seq").alias("metrics")
    )
    joined = issues.join(means, [*RUN, "column"], "left")
    labels = F.coalesce(F.try_element_at("metrics", F.lit("logical_type")), F.lit("")) == "categorical"
    plain = F.when((F.col("issue_type") == "outliers") & labels, "group_rare").otherwise(below)
    op = F.when(F.coalesce("column_score", F.lit(0.0)) > cutoffs, "drop_column").otherwise(plain)
    if cfg.planning.issue_overrides:
        op = _override(op, F.col("issue_type"), cfg.planning.issue_overrides)
    whole = F.col("operation").isin(DATASET_OPERATIONS)
    return (
        joined.withColumn("operation", op)
        .where(F.col("operation").isNotNull() & (F.col("operation") != "ignore"))
        .where(whole | F.col("column").isNotNull())
        .withColumn("params", _params(cfg))
        .select(
            *RUN,
            "seq",
            "issue_type",
            _lookup(ACTION_TYPES, F.col("operation")).alias("action_type"),
            "operation",
            F.when(~whole, F.col("column")).alias("column"),
            "column_score",
            "params",
            F.concat_ws(" ", "operation", F.when(~whole, F.col("column")), F.lit("for"), "issue_type").alias("reason"),
            (F.lit(cfg.mode != AUTOMATIC) & (F.col("operation") != "warn")).alias(
                "requires_approval"
            ),
        )
    )


def resolve_conflicts(actions: DataFrame) -> DataFrame:
    """One action per column (best by priority, then first), one per dataset operation.

    Dataset actions come first, then columns in order of their first issue.
    """
    rank = F.lit(len(PRIORITY))
    for i, op in enumerate(PRIORITY):
        rank = F.when(F.col("operation") == op, i).otherwise(rank)
    target = F.coalesce("column", F.concat(F.lit("\0"), "operation"))
    per_target = Window.partitionBy(*RUN, "target")
    kept = (
        actions.withColumn("target", target)
        .withColumn("place", F.row_number().over(per_target.orderBy(rank, "seq", "issue_type")))
        .withColumn("first", F.min("seq").over(per_target))
        .where(F.col("place") == 1)
    )
    order = Window.partitionBy(*RUN).orderBy(F.col("column").isNotNull(), "first", "target")
    return (
        kept.withColumn("seq", F.row_number().over(order).cast("long"))
        .drop("target", "place", "first")
    )


def govern(actions: DataFrame, decisions: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add BLOCK or ALLOW per run; advisory mode turns BLOCK into an advice to warn."""
    counted = actions.groupBy(*RUN).agg(F.max("seq").alias("last"))
    judged = decisions.join(counted, RUN, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    bad = (F.col("severity_level") == "CRITICAL") | (F.col("decision") == "FAIL")
    because = F.format_string("%s at risk %.3f", F.col("decision"), F.col("score"))
    if cfg.mode == ADVISORY:
        kind, reason = "WARN", F.concat(F.lit("[ADVICE] Would block: "), because)
    elif cfg.mode == AUTOMATIC:
        kind, reason = "BLOCK", F.concat(F.lit("Blocked: "), because)
    else:
        kind, reason = "BLOCK", F.concat(F.lit("Critical: "), because)
    extra = judged.where(bad | ((F.col("decision") == "PASS") & (F.col("last") == 0))).select(
        *RUN,
        (F.col("last") + 1).alias("seq"),
        F.when(bad, kind).otherwise("ALLOW").alias("action_type"),
        F.lit(None).cast("string").alias("operation"),
        F.lit(None).cast("string").alias("column"),
        F.create_map().cast("map<string,string>").alias("params"),
        F.when(bad, reason).otherwise("Data quality acceptable").alias("reason"),
        (bad & F.lit(cfg.mode not in (ADVISORY, AUTOMATIC))).alias("requires_approval"),
    )
    columns = [c for c in PLAN_COLUMNS if c not in ("action_id", "approved")]
    return (
        actions.select(*columns)
        .unionByName(extra.select(*columns))
        .withColumn("action_id", F.concat_ws("/", *RUN, F.col("seq").cast("string")))
        .withColumn("approved", F.lit(False))
        .select(*PLAN_COLUMNS)
    )


def make_plan(scores: DataFrame, decisions: DataFrame, cfg: Config = Config()) -> DataFrame:
    return govern(resolve_conflicts(raw_actions(scores, cfg)), decisions, cfg)


def approval_requests(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per run with an action that needs approval: status, summary, actions."""
    entry = F.struct("seq", F.col("action_type").alias("type"), "reason")
    grouped = plan.groupBy(*RUN).agg(
        F.max("requires_approval").alias("needed"),
        F.array_join(F.array_sort(F.collect_set("action_type")), ", ").alias("types"),
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(entry)),
                lambda a: F.struct(a["type"].alias("type"), a["reason"].alias("reason")),
            )
        ).alias("actions"),
    )
    return (
        grouped.where("needed")
        .join(decisions.select(*RUN, "decision", "score"), RUN)
        .select(
            *RUN,
            F.lit("PENDING_APPROVAL").alias("status"),
            F.format_string("%s (%.2f) -> %s", F.col("decision"), F.col("score"), F.col("types")).alias(
                "summary"
            ),
            "actions",
        )
    )


def approve(plan: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Keep and mark the approved actions; all of them when no list is given."""
    if approved is not None:
        plan = plan.join(approved.select("action_id").distinct(), "action_id", "left_semi")
    return plan.withColumn("approved", F.lit(True)).select(*PLAN_COLUMNS)


def run_summary(decisions: DataFrame, means: DataFrame, plan: DataFrame) -> DataFrame:
    """Report line per run: verdict, score, worst dimension, first columns, state."""
    worst = (
        means.where(F.col("kind") == "dimension")
        .groupBy(*RUN)
        .agg(F.max(F.struct("mean_score", "name")).alias("worst"))
    )
    state = plan.groupBy(*RUN).agg(
        F.max(F.col("action_type") == "BLOCK").alias("block"),
        F.max(F.col("requires_approval") & ~F.col("approved")).alias("wait"),
    )
    return (
        decisions.join(worst, RUN, "left")
        .join(state, RUN, "left")
        .select(
            *RUN,
            "decision",
            F.concat_ws(
                "\n",
                F.format_string("Quality decision: %s", F.col("decision")),
                F.format_string("Risk score: %.2f", F.col("score")),
                F.when(
                    F.col("worst").isNotNull(),
                    F.format_string(
                        "Worst dimension: %s (%.2f)", F.col("worst.name"), F.col("worst.mean_score")
                    ),
                ),
                F.when(
                    F.size("affected_columns") > 0,
                    F.concat(
                        F.lit("Affected columns: "),
                        F.array_join(F.slice("affected_columns", 1, 3), ", "),
                        F.when(F.size("affected_columns") > 3, "...").otherwise(""),
                    ),
                ),
                F.when(F.coalesce("wait", F.lit(False)), "Pending approval").when(
                    F.coalesce("block", F.lit(False)), "Pipeline blocked"
                ),
            ).alias("summary"),
        )
    )

