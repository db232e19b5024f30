"""Scoring and planning over the findings of many runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.config import AUTOMATIC, HUMAN, Config
from qualityframe.operators import planning
from qualityframe.operators import scoring as S

from .inputs import frame, sql
from .profiling import union

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WEIGHTS = {"missing_values": 0.5, "pii_detected": 2.0}
AUTO = Config(mode=AUTOMATIC, tracing=True, weights=WEIGHTS).with_detection(
    min_value=0.0, max_value=100.0
)
HUMAN_MODE = Config(mode=HUMAN, tracing=True, weights=WEIGHTS)


def findings(spark, sf_dir) -> DataFrame:
    """The derived findings in the findings shape."""
    return frame(spark, sf_dir, "findings").select(
        "run_id", "dataset_id", "seq", "kind", "detector", "issue_type", "dimension",
        F.col("column_name").alias("column"),
        F.when(
            F.col("first_column").isNotNull(), F.array("first_column", F.lit("other"))
        ).alias("columns"),
        "severity", "confidence",
        F.create_map(
            F.lit("logical_type"), F.col("logical_type"), F.lit("pii_type"), F.lit("email")
        ).alias("metrics"),
    )


def scored(spark, sf_dir) -> DataFrame:
    return S.score(findings(spark, sf_dir), WEIGHTS)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


RUN = "run_id, dataset_id"
NORM = f"""norm AS (SELECT run_id, dataset_id, seq, detector AS detector_id, issue_type AS rule_id,
  issue_type, dimension, coalesce(column_name, first_column) AS col, severity, confidence, logical_type
  FROM {sql('findings')} AS f)"""
SCORES = NORM + """, scores AS (SELECT *,
  CASE issue_type WHEN 'missing_values' THEN 0.5 WHEN 'pii_detected' THEN 2.0 ELSE 1.0 END AS weight,
  severity * confidence * CASE issue_type WHEN 'missing_values' THEN 0.5 WHEN 'pii_detected' THEN 2.0
    ELSE 1.0 END AS final_score FROM norm)"""
GLOBAL = SCORES + f""", whole AS (SELECT {RUN}, count(*) AS findings,
  greatest(sum(final_score) / sum(weight), 0.8 * max(final_score)) AS score FROM scores GROUP BY {RUN})"""
DECIDED = GLOBAL + """, decided AS (SELECT *,
  CASE WHEN score < 0.2 THEN 'PASS' WHEN score < 0.5 THEN 'WARN' ELSE 'FAIL' END AS decision,
  CASE WHEN score >= 0.7 THEN 'CRITICAL' WHEN score >= 0.4 THEN 'HIGH' WHEN score >= 0.2 THEN 'MEDIUM'
    ELSE 'LOW' END AS severity_level FROM whole)"""
MEANS = "means AS (" + union(
    [
        f"SELECT {RUN}, '{k}' AS kind, {c} AS name, avg(final_score) AS mean_score, count(*) AS n "
        f"FROM scores WHERE {c} IS NOT NULL GROUP BY {RUN}, {c}"
        for k, c in (("issue", "issue_type"), ("dimension", "dimension"), ("column", "col"))
    ]
) + ")"
TOP = MEANS + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY {RUN}, kind
    ORDER BY mean_score DESC, name) AS place FROM means),
  top AS (SELECT * FROM placed WHERE (place <= CASE kind WHEN 'dimension' THEN 3 ELSE 5 END)
    AND (mean_score > 0.1 OR place = 1))"""


def add(name: str, run, oracle: str | None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


add(
    "norm_findings",
    lambda s, d: rounded(S.normalize(findings(s, d)).drop("metrics").withColumnRenamed("column", "col")),
    f"WITH {NORM} SELECT run_id, dataset_id, seq, detector_id, rule_id, issue_type, dimension, col, "
    "round(severity, 6) AS severity, round(confidence, 6) AS confidence FROM norm",
)
add(
    "scores",
    lambda s, d: rounded(
        scored(s, d).select("run_id", "dataset_id", "seq", "issue_type", "weight", "final_score")
    ),
    f"WITH {SCORES} SELECT run_id, dataset_id, seq, issue_type, CAST(weight AS DOUBLE) AS weight, "
    "round(final_score, 6) AS final_score FROM scores",
)
add(
    "score_global",
    lambda s, d: rounded(S.global_score(scored(s, d))),
    f"WITH {GLOBAL} SELECT run_id, dataset_id, findings, round(score, 6) AS score FROM whole",
)
add(
    "score_breakdown",
    lambda s, d: rounded(S.breakdown(scored(s, d))),
    f"WITH {SCORES}, {MEANS} SELECT run_id, dataset_id, kind, name, round(mean_score, 6) AS mean_score, n FROM means",
)
add(
    "decision",
    lambda s, d: rounded(S.decide(scored(s, d))),
    f"WITH {DECIDED} SELECT run_id, dataset_id, findings, round(score, 6) AS score, decision, severity_level FROM decided",
)
add(
    "top_factors",
    lambda s, d: rounded(
        S.top_factors(S.breakdown(scored(s, d))).select(
            "run_id", "dataset_id", "kind", "name", "mean_score", F.col("place").cast("long").alias("place")
        )
    ),
    f"WITH {SCORES}, {TOP} SELECT run_id, dataset_id, kind, name, round(mean_score, 6) AS mean_score, place FROM top",
)
add(
    "explanations",
    lambda s, d: S.decisions(scored(s, d)).select("run_id", "dataset_id", "explanation"),
    f"""WITH {DECIDED}, {TOP},
    lists AS (SELECT {RUN}, """
    + ", ".join(
        f"string_agg(name, ', ' ORDER BY place) FILTER (kind = '{k}') AS {k}s"
        for k in ("issue", "dimension", "column")
    )
    + f""" FROM top GROUP BY {RUN})
    SELECT d.run_id, d.dataset_id, d.decision || ' at risk ' || printf('%.3f', score) || '.'
      || coalesce(' Issues: ' || issues || '.', '') || coalesce(' Dimensions: ' || dimensions || '.', '')
      || coalesce(' Columns: ' || columns || '.', '') AS explanation
    FROM decided AS d LEFT JOIN lists AS l USING ({RUN})""",
)
add(
    "issue_map",
    lambda s, d: S.issue_map(scored(s, d)).withColumn("columns", F.array_join("columns", ",")),
    f"""WITH {SCORES} SELECT run_id, dataset_id, issue_type,
      string_agg(DISTINCT coalesce(col, 'DATASET'), ',' ORDER BY coalesce(col, 'DATASET')) AS columns
    FROM scores GROUP BY run_id, dataset_id, issue_type""",
)
add(
    "issue_metadata",
    lambda s, d: S.issue_metadata(scored(s, d)).select(
        "run_id", "dataset_id", "issue_type", F.col("metadata")["logical_type"].alias("latest_type")
    ),
    f"""WITH {SCORES} SELECT run_id, dataset_id, issue_type, arg_max(logical_type, seq) AS latest_type
    FROM scores GROUP BY run_id, dataset_id, issue_type""",
)

RULES = union(
    [
        f"SELECT '{issue}' AS issue_type, {'NULL' if cut is None else cut} AS cutoff, '{op}' AS below"
        for issue, cut, op in planning.RULES
    ]
)
TYPES = " ".join(f"WHEN '{op}' THEN '{t}'" for op, t in planning.ACTION_TYPES.items())
RAW = SCORES + f""", rules AS ({RULES}),
  colmeans AS (SELECT {RUN}, col, avg(final_score) AS column_score FROM scores WHERE col IS NOT NULL
    GROUP BY {RUN}, col),
  issues AS (SELECT {RUN}, issue_type, col, min(seq) AS seq, arg_max(logical_type, seq) AS lt
    FROM scores GROUP BY {RUN}, issue_type, col),
  chosen AS (SELECT i.run_id, i.dataset_id, i.seq, i.issue_type, i.col, m.column_score,
    CASE WHEN coalesce(m.column_score, 0) > r.cutoff THEN 'drop_column'
         WHEN i.issue_type = 'outliers' AND i.lt = 'categorical' THEN 'group_rare'
         ELSE r.below END AS operation
    FROM issues AS i JOIN rules AS r ON i.issue_type = r.issue_type
    LEFT JOIN colmeans AS m ON i.run_id = m.run_id AND i.dataset_id = m.dataset_id AND i.col = m.col),
  raw AS (SELECT run_id, dataset_id, seq, issue_type,
    CASE operation {TYPES} END AS action_type, operation,
    CASE WHEN operation IN ('remove_duplicates', 'remove_anomalies') THEN NULL ELSE col END AS col,
    column_score FROM chosen
    WHERE operation IN ('remove_duplicates', 'remove_anomalies') OR col IS NOT NULL)"""
add(
    "plan_raw",
    lambda s, d: rounded(
        planning.raw_actions(scored(s, d), AUTO)
        .drop("params", "reason", "requires_approval")
        .withColumnRenamed("column", "col")
    ),
    f"WITH {RAW} SELECT run_id, dataset_id, seq, issue_type, action_type, operation, col, "
    "round(column_score, 6) AS column_score FROM raw",
)
RANK = " ".join(f"WHEN '{op}' THEN {i}" for i, op in enumerate(planning.PRIORITY))
PLAN = RAW + f""", aimed AS (SELECT *, coalesce(col, chr(0) || operation) AS target FROM raw),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {RUN}, target
      ORDER BY CASE operation {RANK} ELSE 8 END, seq, issue_type) AS place,
    min(seq) OVER (PARTITION BY {RUN}, target) AS first_seq FROM aimed),
  plan_ AS (SELECT run_id, dataset_id, action_type, operation, col, issue_type,
    row_number() OVER (PARTITION BY {RUN} ORDER BY col IS NOT NULL, first_seq, target) AS seq
    FROM ranked WHERE place = 1)"""
add(
    "plan",
    lambda s, d: planning.resolve_conflicts(planning.raw_actions(scored(s, d), AUTO))
    .select("run_id", "dataset_id", "seq", "action_type", "operation", F.col("column").alias("col"), "issue_type"),
    f"WITH {PLAN} SELECT run_id, dataset_id, seq, action_type, operation, col, issue_type FROM plan_",
)
DECIDED_TAIL = DECIDED.removeprefix(SCORES).removeprefix(",")


def governed_sql(bad_type: str, reason: str, approval_repairs: str, approval_block: str) -> str:
    return PLAN + ", " + DECIDED_TAIL + f""",
  counted AS (SELECT {RUN}, max(seq) AS last_seq FROM plan_ GROUP BY {RUN}),
  judged AS (SELECT d.*, coalesce(c.last_seq, 0) AS last_seq FROM decided AS d LEFT JOIN counted AS c USING ({RUN})),
  governed AS (
    SELECT run_id, dataset_id, seq, action_type, operation, col,
      operation || coalesce(' ' || col, '') || ' for ' || issue_type AS reason,
      {approval_repairs} AS requires_approval FROM plan_
    UNION ALL
    SELECT run_id, dataset_id, last_seq + 1, CASE WHEN decision = 'FAIL' OR severity_level = 'CRITICAL'
        THEN '{bad_type}' ELSE 'ALLOW' END, NULL, NULL,
      CASE WHEN decision = 'FAIL' OR severity_level = 'CRITICAL'
        THEN '{reason}' || decision || ' at risk ' || printf('%.3f', score)
        ELSE 'Data quality acceptable' END,
      (decision = 'FAIL' OR severity_level = 'CRITICAL') AND {approval_block}
    FROM judged WHERE decision = 'FAIL' OR severity_level = 'CRITICAL' OR (decision = 'PASS' AND last_seq = 0))"""


def _governed(cfg: Config):
    def run(s, d):
        scores = scored(s, d)
        return planning.make_plan(scores, S.decide(scores), cfg)

    return run


GOVERNED_COLUMNS = "run_id, dataset_id, seq, action_type, operation, col, reason, requires_approval"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("column", "col").select(*GOVERNED_COLUMNS.split(", "))


add(
    "plan_governed",
    lambda s, d: _shown(_governed(AUTO)(s, d)),
    f"WITH {governed_sql('BLOCK', 'Blocked: ', 'false', 'false')} SELECT {GOVERNED_COLUMNS} FROM governed",
)
HUMAN_SQL = governed_sql("BLOCK", "Critical: ", "operation <> 'warn'", "true")
add(
    "plan_governed_human",
    lambda s, d: _shown(_governed(HUMAN_MODE)(s, d)),
    f"WITH {HUMAN_SQL} SELECT {GOVERNED_COLUMNS} FROM governed",
)
add(
    "plan_governed_advisory",
    lambda s, d: _shown(_governed(Config(weights=WEIGHTS))(s, d)),
    "WITH " + governed_sql("WARN", "[ADVICE] Would block: ", "operation <> 'warn'", "false")
    + f" SELECT {GOVERNED_COLUMNS} FROM governed",
)


def _approval(s, d) -> DataFrame:
    scores = scored(s, d)
    decided = S.decide(scores)
    return planning.approval_requests(planning.make_plan(scores, decided, HUMAN_MODE), decided)


add(
    "approval_payload",
    _approval,
    f"""WITH {HUMAN_SQL},
    types AS (SELECT {RUN}, string_agg(DISTINCT action_type, ', ' ORDER BY action_type) AS types,
      bool_or(requires_approval) AS needed,
      '[' || string_agg('{{"type":"' || action_type || '","reason":"' || reason || '"}}', ',' ORDER BY seq) || ']' AS actions
      FROM governed GROUP BY {RUN})
    SELECT t.run_id, t.dataset_id, 'PENDING_APPROVAL' AS status,
      d.decision || ' (' || printf('%.2f', d.score) || ') -> ' || types AS summary, actions
    FROM types AS t JOIN decided AS d USING ({RUN}) WHERE needed""",
)


def _approved(s, d) -> DataFrame:
    plan = _governed(HUMAN_MODE)(s, d)
    wanted = plan.where((F.col("seq") % 2 == 0) & F.col("requires_approval")).select("action_id")
    return planning.approve(plan, wanted).select("action_id", "action_type", "operation", "approved")


add(
    "plan_approved",
    _approved,
    f"""WITH {HUMAN_SQL} SELECT run_id || '/' || dataset_id || '/' || CAST(seq AS VARCHAR) AS action_id,
    action_type, operation, true AS approved FROM governed WHERE seq % 2 = 0 AND requires_approval""",
)


def _summary(s, d) -> DataFrame:
    scores = scored(s, d)
    decided = S.decisions(scores)
    return planning.run_summary(decided, S.breakdown(scores), planning.make_plan(scores, decided, AUTO))


GOVERNED = governed_sql("BLOCK", "Blocked: ", "false", "false")
add(
    "run_summary",
    _summary,
    f"""WITH {GOVERNED}, {TOP},
    worst AS (SELECT {RUN}, name, mean_score, row_number() OVER (PARTITION BY {RUN}
        ORDER BY mean_score DESC, name DESC) AS place FROM means WHERE kind = 'dimension'),
    cols AS (SELECT {RUN}, string_agg(name, ', ' ORDER BY place) FILTER (place <= 3)
        || CASE WHEN count(*) > 3 THEN '...' ELSE '' END AS names FROM top WHERE kind = 'column' GROUP BY {RUN}),
    blocked AS (SELECT {RUN}, bool_or(action_type = 'BLOCK') AS stop FROM governed GROUP BY {RUN})
    SELECT d.run_id, d.dataset_id, d.decision, 'Quality decision: ' || d.decision || chr(10)
      || 'Risk score: ' || printf('%.2f', d.score)
      || coalesce(chr(10) || 'Worst dimension: ' || w.name || ' (' || printf('%.2f', w.mean_score) || ')', '')
      || coalesce(chr(10) || 'Affected columns: ' || c.names, '')
      || CASE WHEN b.stop THEN chr(10) || 'Pipeline blocked' ELSE '' END AS summary
    FROM decided AS d LEFT JOIN (SELECT * FROM worst WHERE place = 1) AS w USING ({RUN})
    LEFT JOIN cols AS c USING ({RUN}) LEFT JOIN blocked AS b USING ({RUN})""",
)
