"""Audit queries over a trace log with a hot trace and popular parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.config import HUMAN, Config
from qualityframe.operators import audit, planning
from qualityframe.operators.scale import scratch_path
from qualityframe.plans.analyze import analyze, execute

from .inputs import frame, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, oracle: str | None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def events(s, d) -> DataFrame:
    """The derived log in the event shape."""
    return frame(s, d, "trace").select(
        "event_id", "trace_id", "parent_event_id", "component", "event_type", "severity", "name",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "inputs", "outputs", "metadata",
        F.lit(None).cast("string").alias("execution_event_id"), "confidence",
        F.split("reason_text", ",").alias("reasons"), "evidence",
    )


LOG = f"log AS (SELECT * FROM {sql('trace')} AS t)"

add(
    "trace_by_id",
    lambda s, d: audit.by_trace(events(s, d), "trace-0").select("event_id", "name", "timestamp"),
    f'WITH {LOG} SELECT event_id, name, "timestamp" FROM log WHERE trace_id = \'trace-0\'',
)

PASSED = "CASE WHEN json_extract_string(outputs, '$.passed') = 'true' THEN 'PASSED' ELSE 'FAILED' END"
MESSAGE = f"""CASE
  WHEN component = 'rule' AND event_type = 'check' THEN
    'Rule ''' || name || ''': ' || {PASSED} || '. Checked ' || inputs || ' -> ' || outputs
  WHEN component = 'fix' AND event_type = 'proposal' THEN
    'Proposed Fix ''' || name || ''' using strategy ''' ||
    coalesce(json_extract_string(metadata, '$.strategy'), 'unknown') || '''. Details: ' || outputs
  WHEN component = 'trace' AND event_type = 'error' THEN
    'ERROR in ''' || name || ''': ' || coalesce(json_extract_string(metadata, '$.error_message'), 'No details provided')
  WHEN component = 'trace' AND event_type = 'decision' THEN
    'Decision ''' || name || ''' (Confidence: ' || printf('%.2f', confidence) || '). Reasons: ' ||
    coalesce(replace(reason_text, ',', ', '), 'None') || '. Evidence: ' || evidence
  ELSE '[' || upper(component) || '] ' || name || ' (' || event_type || ')' END"""
add(
    "trace_messages",
    lambda s, d: audit.messages(events(s, d)).select("trace_id", "event_id", "message"),
    f"WITH {LOG} SELECT trace_id, event_id, {MESSAGE} AS message FROM log",
)
add(
    "trace_issues",
    lambda s, d: audit.issues(events(s, d)),
    f"""WITH {LOG} SELECT trace_id, event_id, upper(severity) AS label, "timestamp", {MESSAGE} AS message
    FROM log WHERE severity IN ('critical', 'error', 'warning')""",
)
add(
    "trace_tree",
    lambda s, d: audit.tree(events(s, d)).select(
        "trace_id", "event_id", "depth",
        F.array_join(F.transform("path", lambda p: p["id"]), ">").alias("path"),
    ),
    f"""WITH RECURSIVE {LOG}, walk AS (
      SELECT trace_id, event_id, 0 AS depth, event_id AS path FROM log AS c
      WHERE parent_event_id IS NULL OR NOT EXISTS (SELECT 1 FROM log AS p
        WHERE p.event_id = c.parent_event_id AND p.trace_id = c.trace_id)
      UNION ALL
      SELECT c.trace_id, c.event_id, w.depth + 1, w.path || '>' || c.event_id
      FROM walk AS w JOIN log AS c ON c.parent_event_id = w.event_id AND c.trace_id = w.trace_id)
    SELECT trace_id, event_id, depth, path FROM walk""",
)
add(
    "trace_report",
    lambda s, d: audit.report(events(s, d)).drop("path"),
    f"""WITH RECURSIVE {LOG}, walk AS (
      SELECT trace_id, event_id, 0 AS depth FROM log AS c
      WHERE parent_event_id IS NULL OR NOT EXISTS (SELECT 1 FROM log AS p
        WHERE p.event_id = c.parent_event_id AND p.trace_id = c.trace_id)
      UNION ALL
      SELECT c.trace_id, c.event_id, w.depth + 1
      FROM walk AS w JOIN log AS c ON c.parent_event_id = w.event_id AND c.trace_id = w.trace_id),
    told AS (SELECT trace_id, event_id, {MESSAGE} AS message FROM log)
    SELECT l.trace_id, 1 AS section, severity = 'warning' AS late,
      '[' || upper(severity) || '] ' || message AS line
    FROM log AS l JOIN told AS t USING (trace_id, event_id) WHERE severity IN ('critical', 'error', 'warning')
    UNION ALL
    SELECT w.trace_id, 2, false,
      repeat('  ', depth) || '[' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '] ' || message
    FROM walk AS w JOIN log USING (trace_id, event_id) JOIN told USING (trace_id, event_id)""",
)
add(
    "trace_full_report",
    lambda s, d: audit.full_report(events(s, d)),
    f"""WITH RECURSIVE {LOG}, walk AS (
      SELECT trace_id, event_id, 0 AS depth FROM log AS c
      WHERE parent_event_id IS NULL OR NOT EXISTS (SELECT 1 FROM log AS p
        WHERE p.event_id = c.parent_event_id AND p.trace_id = c.trace_id)
      UNION ALL
      SELECT c.trace_id, c.event_id, w.depth + 1
      FROM walk AS w JOIN log AS c ON c.parent_event_id = w.event_id AND c.trace_id = w.trace_id),
    said AS (SELECT trace_id, arg_min(metadata, ("timestamp", event_id)) AS m FROM log WHERE event_type = 'start' GROUP BY trace_id),
    head AS (SELECT l.trace_id, min("timestamp") AS created, any_value(m) AS m,
        count(*) FILTER (severity IN ('critical', 'error', 'warning')) AS n_issues
      FROM log AS l LEFT JOIN said AS s ON s.trace_id = l.trace_id GROUP BY l.trace_id),
    told AS (SELECT trace_id, event_id, "timestamp", severity, {MESSAGE} AS message FROM log),
    stamped AS (SELECT *, '[' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '] ' || message AS line FROM told)
    SELECT trace_id, 0 AS section, 0 AS rank, 'Trace: ' || trace_id AS line FROM head
    UNION ALL SELECT trace_id, 0, 1, 'Created: ' || strftime(created, '%Y-%m-%dT%H:%M:%S.%f') FROM head
    UNION ALL SELECT trace_id, 0, 2, 'Mode: ' || coalesce(json_extract_string(m, '$.mode'), 'unknown') FROM head
    UNION ALL SELECT trace_id, 0, 3, 'Dataset: ' || json_extract_string(m, '$.dataset_id') FROM head
      WHERE json_extract_string(m, '$.dataset_id') IS NOT NULL
    UNION ALL SELECT trace_id, 0, 5, 'No issues' FROM head WHERE n_issues = 0
    UNION ALL SELECT trace_id, 1, (severity = 'warning')::INTEGER, '[' || upper(severity) || '] ' || line
    FROM stamped WHERE severity IN ('critical', 'error', 'warning')
    UNION ALL SELECT w.trace_id, 2, 0, repeat('  ', depth) || line FROM walk AS w JOIN stamped USING (trace_id, event_id)""",
)
add(
    "trace_decisions",
    lambda s, d: audit.decision_checks(events(s, d)),
    f"""WITH {LOG} SELECT trace_id, event_id, confidence,
      CASE WHEN reason_text IS NULL THEN 0 ELSE len(string_split(reason_text, ',')) END::INTEGER AS n_reasons,
      CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence outside 0 to 1'
           WHEN reason_text IS NULL THEN 'no reason given'
           WHEN reason_text = 'free text' THEN 'unknown reason code' ELSE 'ok' END AS status
    FROM log WHERE component = 'trace' AND event_type = 'decision'""",
)


def _truncated(s, d) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", F.split("text", " ").alias("words"))
    return audit.truncate_values(docs).select(
        "doc_id", "text", F.array_join("words", "|").alias("words")
    )


add(
    "truncate_values",
    _truncated,
    """WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS words FROM documents),
    c AS (SELECT doc_id, text, words,
      list_transform(list_slice(words, 1, 50), lambda x: CASE WHEN length(x) > 1000
        THEN substring(x, 1, 1000) || '... (truncated)' ELSE x END) AS head FROM w)
    SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || '... (truncated)' ELSE text END AS text,
      array_to_string(CASE WHEN len(words) > 50
        THEN list_append(head, '... (truncated ' || (len(words) - 50) || ' more items)') ELSE head END, '|') AS words
    FROM c""",
)


def _lineage(s, d) -> DataFrame:
    nodes = table(s, d, "events").select(
        F.col("event_id").cast("string").alias("node_id"),
        F.concat(F.lit("trace-"), (F.col("user_id") % 5).cast("string")).alias("trace_id"),
        F.concat(F.lit("detection_"), "event_type").alias("operation"),
        F.col("props").alias("inputs"), F.col("props").alias("outputs"), F.lit("{}").alias("metadata"),
    )
    return audit.lineage_by_trace(nodes, "trace-2")


add(
    "lineage_by_id",
    _lineage,
    """SELECT CAST(event_id AS VARCHAR) AS node_id, 'trace-2' AS trace_id, 'detection_' || event_type AS operation,
      props AS inputs, props AS outputs, '{}' AS metadata FROM events WHERE user_id % 5 = 2""",
)
add(
    "trace_search",
    lambda s, d: audit.search(events(s, d), query="ERROR").select("event_id", "trace_id", "name"),
    f"""WITH {LOG} SELECT event_id, trace_id, name FROM log
    WHERE name NOT LIKE '%.success' AND name NOT LIKE '%.failure'
      AND (contains(lower(name), 'error') OR contains(lower(metadata), 'error'))""",
)

CLS = """CASE WHEN regexp_matches(name, '^(COLUMN_PROFILING|PROFILE_)') THEN 'Profiling'
  WHEN regexp_matches(name, '^(CHECK_|RULE_|rule\\.)|DETECTION|DETECTOR') THEN 'Quality Checks'
  WHEN regexp_matches(name, '^(ML_|metric\\.)|MODEL') THEN 'ML Analysis'
  WHEN regexp_matches(name, '^fix\\.|REMEDIATION') THEN 'Remediation' END"""
IN_ORDER = 'PARTITION BY trace_id ORDER BY "timestamp", event_id'
add(
    "trace_groups",
    lambda s, d: audit.groups(events(s, d), per_chunk=1000),
    f"""WITH {LOG}, c AS (SELECT trace_id, event_id, "timestamp", {CLS} AS cls,
        sum(CASE WHEN event_type = 'ui' THEN 0 ELSE 1 END) OVER ({IN_ORDER}) AS anchor FROM log),
    e AS (SELECT *, first_value(cls IGNORE NULLS) OVER (PARTITION BY trace_id, anchor ORDER BY "timestamp", event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eff FROM c),
    b AS (SELECT *, CASE WHEN eff IS NULL OR lag(eff) OVER ({IN_ORDER}) IS DISTINCT FROM eff THEN 1 ELSE 0 END AS fresh FROM e),
    r AS (SELECT *, sum(fresh) OVER ({IN_ORDER}) AS run FROM b)
    SELECT trace_id, arg_min(event_id, {{'t': "timestamp", 'i': event_id}}) AS first_event,
      CASE WHEN count(*) > 1 THEN any_value(eff) END AS "group", count(*) AS n,
      min("timestamp") AS started, max("timestamp") AS ended
    FROM r GROUP BY trace_id, run""",
)


def _own_trail(s, d) -> DataFrame:
    """What a run with approval leaves in its own log, read by the log's own checks."""
    cfg = Config(mode=HUMAN, tracing=True, lineage=True).with_profiling(enable_ml=False)
    result = analyze(frame(s, d, "orders_after"), cfg, run_id="own")
    execute(result, planning.approve(result.plan))
    log = audit.event_frame(s, result.events)
    steps = log.groupBy("component", "event_type").agg(F.count(F.lit(1)).alias("n"))
    wanted = steps.where("component || '/' || event_type IN ('rule/check', 'fix/proposal', 'trace/decision')")
    found, planned = result.findings.count(), result.plan.count()
    return wanted.select(
        "component", "event_type",
        F.when(F.col("component") == "rule", F.col("n") == found)
        .when(F.col("component") == "fix", F.col("n") == planned)
        .otherwise(F.col("n") == 1).alias("complete"),
        F.lit(log.where("event_type = 'execution' AND name = 'execute'").count()).cast("bigint").alias("executions"),
        F.lit(audit.decision_checks(log).where("status <> 'ok'").count()).cast("bigint").alias("bad_decisions"),
    )


add(
    "trace_own_run",
    _own_trail,
    """SELECT component, event_type, true AS complete, 1::BIGINT AS executions, 0::BIGINT AS bad_decisions
    FROM (VALUES ('rule', 'check'), ('fix', 'proposal'), ('trace', 'decision')) AS v(component, event_type)
    WHERE (SELECT count(*) FROM orders) > 0""",
)


def _roundtrip(s, d) -> DataFrame:
    path = scratch_path(s, "trace")
    audit.append_events(events(s, d), path)
    return audit.read_events(s, path, "trace-3").select("event_id", "trace_id", "name", "timestamp")


add(
    "trace_roundtrip",
    _roundtrip,
    f'WITH {LOG} SELECT event_id, trace_id, name, "timestamp" FROM log WHERE trace_id = \'trace-3\'',
)
