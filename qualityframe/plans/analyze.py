"""The whole job: read, profile, detect, score, plan, repair, record."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..functions.cells import nan_to_null
from ..operators import audit, detectors, planning, repair, scoring
from ..operators.scale import local_frame, materialize, pin, spread
from ..sources.readers import describe, load
from .profile import PARTS, Profiles, profile


@dataclass
class Result:
    """Tables of one run. `data` is the repaired table, still lazy."""

    data: DataFrame | None
    run_id: str
    config: Config
    profiles: Profiles | None = None
    findings: DataFrame | None = None
    scores: DataFrame | None = None
    decisions: DataFrame | None = None
    plan: DataFrame | None = None
    outcome: repair.Outcome | None = None
    approval: DataFrame | None = None
    events: list[dict] = field(default_factory=list)
    lineage: list[dict] = field(default_factory=list)
    error: str | None = None

    @property
    def decision(self) -> str:
        return self.decisions.first().decision

    def summary(self) -> str:
        if self.error:
            return f"Error: {self.error}"
        means = scoring.breakdown(self.scores)
        return planning.run_summary(self.decisions, means, self.plan).first().summary

    def save(self, path: str) -> None:
        """Append findings, decisions, plan, executed actions, the outcome of every
        action and the audit tables.

        One folder per table; tables of many runs share it, partitioned by run.
        """
        for name in ("findings", "decisions", "plan"):
            frame = getattr(self, name)
            if frame is not None:
                frame.write.mode("append").partitionBy("run_id").json(f"{path}/{name}")
        if self.findings is None:
            return
        spark = self.findings.sparkSession
        if self.outcome is not None and self.outcome.executed:
            done = [tuple(a[c] for c in planning.PLAN_COLUMNS) for a in self.outcome.executed]
            actions = local_frame(spark, done, self.plan.schema)
            actions.write.mode("append").partitionBy("run_id").json(f"{path}/actions")
        if self.outcome is not None and self.outcome.statuses():
            rows = [
                (self.run_id, a.get("action_id"), a.get("operation"), a.get("column"), status, error)
                for a, status, error in self.outcome.statuses()
            ]
            names = "run_id string, action_id string, operation string, `column` string, status string, error string"
            local_frame(spark, rows, names).write.mode("append").partitionBy("run_id").json(f"{path}/outcome")
        if self.events:
            audit.append_events(audit.event_frame(spark, self.events), f"{path}/trace_events")
        if self.lineage:
            audit.lineage_frame(spark, self.lineage).write.mode("append").json(
                f"{path}/lineage_nodes"
            )


# The reason codes of the audit tables that stand for an issue type.
REASONS = {
    "missing_values": "high_null_ratio",
    "constant_column": "low_cardinality",
    "imbalance": "low_cardinality",
    "rare_category": "low_cardinality",
    "outliers": "outlier_detected",
    "anomaly_score": "outlier_detected",
    "pattern_violation": "rule_violation",
    "range_violation": "rule_violation",
    "semantic_violation": "rule_violation",
    "type_mismatch": "rule_violation",
}
OTHER_REASON = "metric_threshold_exceeded"


class Recorder:
    """Collects the few audit rows of a run; off unless tracing is on.

    Given a result, it goes on where that run's trail ended.
    """

    def __init__(self, trace_id: str, cfg: Config, result: Result | None = None) -> None:
        self.trace_id, self.cfg = trace_id, cfg
        self.events: list[dict] = [] if result is None else result.events
        self.nodes: list[dict] = [] if result is None else result.lineage

    def event(
        self, name: str, event_type: str = "info", severity: str = "info", component: str = "trace",
        inputs=None, outputs=None, confidence: float | None = None, reasons: list[str] | None = None,
        evidence=None, **metadata,
    ) -> None:
        if not self.cfg.tracing:
            return
        self.events.append(
            {
                "event_id": str(uuid.uuid4()),
                "trace_id": self.trace_id,
                "parent_event_id": self.events[0]["event_id"] if self.events else None,
                "component": component,
                "event_type": event_type,
                "severity": severity,
                "name": name,
                "timestamp": datetime.now(UTC).replace(tzinfo=None),
                "inputs": inputs,
                "outputs": outputs,
                "metadata": metadata,
                "confidence": confidence,
                "reasons": reasons,
                "evidence": evidence,
            }
        )

    @contextmanager
    def stage(self, name: str, event_type: str):
        """One event when a step ends, with the seconds it took; an error is recorded."""
        begun, noted = time.perf_counter(), {}
        try:
            yield noted
        except Exception as error:
            self.event(name, "error", "error", error_message=str(error))
            raise
        self.event(name, event_type, seconds=round(time.perf_counter() - begun, 3), **noted)

    def findings(self, rows: list) -> None:
        """One failed rule check for each finding; a run's findings are bounded by its schema."""
        for r in rows:
            self.event(
                r.issue_type, "check", "warning", "rule", inputs={"column": r.column, "detector": r.detector},
                outputs={"passed": False, "severity": r.severity},
            )

    def decision(self, row, rows: list) -> None:
        """The verdict, how far its score is from the next verdict, and why."""
        margin = min(abs(row.score - edge) for edge in (scoring.PASS_BELOW, scoring.WARN_BELOW))
        codes = sorted({REASONS.get(r.issue_type, OTHER_REASON) for r in rows}) or [OTHER_REASON]
        self.event(
            "verdict", "decision", confidence=round(min(1.0, 0.5 + margin), 4), reasons=codes,
            evidence={"score": row.score, "issues": list(row.dominant_issues)}, decision=row.decision,
        )

    def proposals(self, plan: DataFrame) -> None:
        for a in plan.orderBy("seq").collect():  # one row per action
            self.event(
                a.operation or a.action_type, "proposal", component="fix",
                outputs={"column": a.column, "action_type": a.action_type},
                strategy=(a.params or {}).get("strategy") or a.action_type,
            )

    def outcome(self, outcome: repair.Outcome) -> None:
        for a, status, error in outcome.statuses():
            name = a.get("operation") or a.get("action_type")
            if status == "error":
                self.event(name, "error", "error", error_message=error, column=a.get("column"))
            else:
                severity = "warning" if status == "skipped" else "info"
                self.event(name, "execution", severity, status=status, column=a.get("column"))

    def node(self, operation: str, inputs, outputs) -> None:
        if self.cfg.lineage:
            self.nodes.append(
                {
                    "node_id": str(uuid.uuid4()),
                    "trace_id": self.trace_id,
                    "operation": operation,
                    "inputs": inputs,
                    "outputs": outputs,
                    "metadata": {},
                }
            )


def inspect(
    df: DataFrame,
    cfg: Config = Config(),
    baseline: Profiles | None = None,
    order_by: str | None = None,
    key: list[str] | None = None,
    dataset_id: str = "dataset",
    run_id: str = "run",
    registry: detectors.Registry | None = None,
    profiles: Profiles | None = None,
    parts: frozenset[str] | set[str] = PARTS,
) -> tuple[Profiles, DataFrame]:
    """Profile and detect over one shared copy of a small input."""
    with spread(nan_to_null(df)) as data:
        if profiles is None:
            profiles = profile(data, cfg, order_by, run_id, dataset_id, key, parts)
        context = detectors.Context(
            profiles.columns, profiles.dataset, profiles.correlations, profiles.classes(), data,
            None if baseline is None else baseline.columns, cfg, key, (run_id, dataset_id),
        )
        return profiles, pin(detectors.detect(context, registry))


def analyze(
    source: DataFrame | str,
    cfg: Config = Config(),
    baseline: Profiles | None = None,
    spark: SparkSession | None = None,
    order_by: str | None = None,
    key: list[str] | None = None,
    dataset_id: str = "dataset",
    run_id: str | None = None,
    registry: detectors.Registry | None = None,
    handlers: dict | None = None,
    profiles: Profiles | None = None,
    tags: list[str] | None = None,
    metadata: dict | None = None,
    **options,
) -> Result:
    """Run every step; only schema-sized tables come back to the driver.

    A source that cannot be read gives a result with `error` instead of raising. Tags and
    metadata of the run are kept in its first event, beside mode, dataset and configuration.
    """
    run_id = run_id or str(uuid.uuid4())
    log = Recorder(run_id, cfg)
    log.event(
        "analyze", "start", config_hash=cfg.hash(), mode=cfg.mode, dataset_id=dataset_id,
        tags=list(tags or []), properties=dict(metadata or {}),
    )
    try:
        df = source if isinstance(source, DataFrame) else load(spark, source, **options)
    except Exception as error:  # reported in the result
        log.event("read", "error", "error", error_message=str(error))
        return Result(None, run_id, cfg, events=log.events, error=str(error))
    df = nan_to_null(df)
    log.event("read", "data_ingress", columns=df.columns)
    origin = describe(source, **options) if isinstance(source, str) else {"kind": "frame"}
    log.node("read", origin, df.columns)

    with log.stage("profile and detect", "profiling") as noted:
        profiles, findings = inspect(
            df, cfg, baseline, order_by, key, dataset_id, run_id, registry, profiles
        )
        rows = findings.orderBy("seq").collect() if cfg.tracing else []
        noted |= {"columns": len(df.columns), "findings": len(rows)}
    log.findings(rows)
    with log.stage("score", "result"):
        scores = pin(scoring.score(findings, cfg.weights))
        decisions = pin(scoring.decisions(scores, profiles.dataset))
    log.decision(decisions.first(), rows)
    with log.stage("plan", "result"):
        plan = pin(planning.make_plan(scores, decisions, cfg))
    log.proposals(plan)
    result = Result(
        df, run_id, cfg, profiles, findings, scores, decisions, plan,
        events=log.events, lineage=log.nodes,
    )
    if plan.where("requires_approval").limit(1).count():
        result.approval = planning.approval_requests(plan, decisions)
        result.outcome = repair.Outcome(approval_requested=True)
        log.event("approval", "proposal", actions=plan.count())
        log.node("action_pending_approval", decisions.first().decision, "PENDING_APPROVAL")
        return result
    execute(result, plan, handlers, key, log)
    return result


def execute(
    result: Result,
    plan: DataFrame,
    handlers: dict | None = None,
    key: list[str] | None = None,
    log: Recorder | None = None,
) -> Result:
    """Apply a plan (for example after approval) to the run's table, without re-profiling.

    The run's audit trail goes on: each action, skip and error is an event.
    """
    cfg = result.config
    log = log or Recorder(result.run_id, cfg, result)
    result.data, result.outcome = repair.apply_plan(
        result.data, plan, handlers, key, cfg.profiling, cfg.planning.stop_on_block
    )
    log.outcome(result.outcome)
    log.event("execute", "execution", executed=len(result.outcome.executed))
    log.node("action_execution", plan.count(), len(result.outcome.executed))
    return result


def heal(
    df: DataFrame, cfg: Config, max_passes: int = 5, key: list[str] | None = None, **options
) -> tuple[DataFrame, list[str]]:
    """Analyze and repair until PASS, at most `max_passes` times; returns the verdicts too.

    Each pass is written out, so plans do not pile up and lost executors cost
    no earlier pass.
    """
    verdicts = []
    for _ in range(max_passes):
        result = analyze(df, cfg, key=key, **options)
        verdicts.append(result.decision)
        if result.decision == "PASS":
            return df, verdicts
        if result.outcome.approval_requested:
            break
        df = materialize(result.data)
    return df, verdicts
