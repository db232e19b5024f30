"""Audit tables: queries over trace events and lineage nodes.

Events are plain rows (see EVENT_SCHEMA); structured fields are JSON text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import col
from ..sources.sinks import MICROSECONDS
from .scale import local_frame, lookup, materialize, range_bucket

EVENT_SCHEMA = """
event_id string, trace_id string, parent_event_id string, component string, event_type string,
severity string, name string, `timestamp` timestamp_ntz, inputs string, outputs string,
metadata string, execution_event_id string, confidence double, reasons array<string>,
evidence string
"""
LINEAGE_SCHEMA = """
node_id string, trace_id string, operation string, inputs string, outputs string,
metadata string
"""
EVENTS_PER_CHUNK = 1_000_000

# Reason codes, severity labels, size limits and their notices.
REASON_CODES = [
    "high_null_ratio", "low_cardinality", "outlier_detected", "rule_violation",
    "metric_threshold_exceeded", "critical_column",
]
SEVERITY_LABELS = {"critical": "CRITICAL", "error": "ERROR", "warning": "WARNING"}
MAX_TEXT, MAX_ITEMS = 1000, 50
CUT_TEXT = "... (truncated)"
CUT_ITEMS = "... (truncated %d more items)"


def event_frame(spark: SparkSession, events: list[dict]) -> DataFrame:
    """Event rows of a run as a table; dict fields become JSON."""
    names = [f.name for f in T.StructType.fromDDL(EVENT_SCHEMA).fields]
    texts = {"inputs", "outputs", "metadata", "evidence"}

    def cell(event: dict, name: str):
        v = event.get(name)
        if name in texts and v is not None and not isinstance(v, str):
            return json.dumps(v, default=str, ensure_ascii=False)
        return v

    return local_frame(spark, [tuple(cell(e, n) for n in names) for e in events], EVENT_SCHEMA)


def lineage_frame(spark: SparkSession, nodes: list[dict]) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(LINEAGE_SCHEMA).fields]
    texts = {"inputs", "outputs", "metadata"}
    rows = [
        tuple(
            json.dumps(n.get(k), default=str) if k in texts and n.get(k) is not None else n.get(k)
            for k in names
        )
        for n in nodes
    ]
    return local_frame(spark, rows, LINEAGE_SCHEMA)


def append_events(events: DataFrame, path: str) -> None:
    """Append JSON Lines; a batch becomes files of its own, so writers never clash."""
    events.write.mode("append").options(**MICROSECONDS).json(path)


def read_events(spark: SparkSession, path: str, trace_id: str | None = None) -> DataFrame:
    """Events read back; a corrupt line raises."""
    reader = spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").options(**MICROSECONDS)
    out = reader.json(path)
    return out if trace_id is None else by_trace(out, trace_id)


def by_trace(events: DataFrame, trace_id: str) -> DataFrame:
    """One trace in order of time; the filter reaches the scan."""
    return events.where(F.col("trace_id") == trace_id).orderBy("timestamp", "event_id")


def _text(c: str, otherwise: str) -> Column:
    return F.coalesce(col(c), F.lit(otherwise))


def messages(events: DataFrame) -> DataFrame:
    """Add `message`: wording by component and event type. Formats are fixed values."""
    name = F.col("name")
    passed = F.lower(F.get_json_object("outputs", "$.passed"))
    status = F.when(
        passed.isNotNull() & ~passed.isin("false", "0", "", "null"), "PASSED"
    ).otherwise("FAILED")
    error = F.get_json_object("metadata", "$.error_message")
    strategy = F.coalesce(F.get_json_object("metadata", "$.strategy"), F.lit("unknown"))
    reasons = F.coalesce(F.when(F.size("reasons") > 0, F.array_join("reasons", ", ")), F.lit("None"))

    def at(component: str, kind: str) -> Column:
        return (F.col("component") == component) & (F.col("event_type") == kind)

    message = (
        F.when(
            at("rule", "check"),
            F.format_string(
                "Rule '%s': %s. Checked %s -> %s", name, status, _text("inputs", "{}"), _text("outputs", "{}")
            ),
        )
        .when(
            at("fix", "proposal"),
            F.format_string(
                "Proposed Fix '%s' using strategy '%s'. Details: %s", name, strategy, _text("outputs", "{}")
            ),
        )
        .when(
            at("trace", "error"),
            F.format_string(
                "ERROR in '%s': %s", name, F.coalesce(F.nullif(error, F.lit("")), F.lit("No details provided"))
            ),
        )
        .when(
            at("trace", "decision"),
            F.format_string(
                "Decision '%s' (Confidence: %.2f). Reasons: %s. Evidence: %s",
                name, F.coalesce("confidence", F.lit(0.0)), reasons, _text("evidence", "{}"),
            ),
        )
        .otherwise(F.format_string("[%s] %s (%s)", F.upper("component"), name, F.col("event_type")))
    )
    return events.withColumn("message", message)


def issues(events: DataFrame) -> DataFrame:
    """Critical, error and warning events: non-warnings by time, then warnings by time."""
    label = F.lit(None).cast("string")
    for severity, text in SEVERITY_LABELS.items():
        label = F.when(F.col("severity") == severity, text).otherwise(label)
    return (
        messages(events.where(F.col("severity").isin(list(SEVERITY_LABELS))))
        .withColumn("late", F.col("severity") == "warning")
        .orderBy("trace_id", "late", "timestamp", "event_id")
        .select("trace_id", "event_id", label.alias("label"), "timestamp", "message")
    )


def tree(events: DataFrame) -> DataFrame:
    """(trace_id, event_id, depth, path): depth and ancestors of every event.

    An event whose parent is not in its trace is a root. Ancestor chains are
    shortened by half each round, so a tree of depth d takes log2(d) joins; popular
    parents are answered by broadcast. Events on a cycle have no root and drop out,
    as they would in a walk from the roots. Sorting by (trace_id, path) is the
    depth-first order.
    """
    nodes = materialize(
        events.select("trace_id", "event_id", "parent_event_id", "timestamp")
    )
    total = nodes.count()
    step = F.array(F.struct(F.col("timestamp").alias("at"), F.col("event_id").alias("id")))
    known = nodes.select("trace_id", F.col("event_id").alias("id"))
    children = nodes.where(F.col("parent_event_id").isNotNull())
    linked = lookup(
        children, known, {"trace_id": "trace_id", "parent_event_id": "id"}, total
    ).withColumn("up", F.col("found.id"))
    state = materialize(
        linked.drop("found")
        .unionByName(
            nodes.where(F.col("parent_event_id").isNull()).withColumn(
                "up", F.lit(None).cast("string")
            )
        )
        .select("trace_id", "event_id", "up", F.lit(0).alias("depth"), step.alias("path"))
        .withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    )
    left = state.where(F.col("up").isNotNull()).count()
    while left:
        jumped = lookup(
            state.where(F.col("up").isNotNull()),
            state.select(
                "trace_id", F.col("event_id").alias("id"), F.col("up").alias("above"),
                F.col("depth").alias("more"), F.col("path").alias("head"),
            ),
            {"trace_id": "trace_id", "up": "id"},
            total,
        )
        moved = jumped.select(
            "trace_id",
            "event_id",
            F.col("found.above").alias("up"),
            (F.col("depth") + F.col("found.more")).alias("depth"),
            F.concat("found.head", "path").alias("path"),
        )
        state = materialize(state.where(F.col("up").isNull()).unionByName(moved))
        still = state.where(F.col("up").isNotNull()).count()
        if still == left:  # only cycles are left
            break
        left = still
    return state.where(F.col("up").isNull()).drop("up")


def narrative(events: DataFrame) -> DataFrame:
    """Depth-first log lines, indented by depth, in order per trace."""
    placed = tree(events)
    return (
        messages(events)
        .join(placed, ["trace_id", "event_id"])
        .orderBy("trace_id", "path")
        .select(
            "trace_id",
            "event_id",
            "depth",
            F.concat(
                F.expr("repeat('  ', depth)"),
                F.lit("["),
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                F.lit("] "),
                "message",
            ).alias("line"),
            "path",
        )
    )


def report(events: DataFrame) -> DataFrame:
    """Issues, then the log, as (trace_id, section, rank, line) ordered lines."""
    listed = issues(events).select(
        "trace_id",
        F.lit(1).alias("section"),
        (F.col("label") == "WARNING").alias("late"),
        F.array(F.struct(F.col("timestamp").alias("at"), F.col("event_id").alias("id"))).alias("path"),
        F.concat(F.lit("["), "label", F.lit("] "), "message").alias("line"),
    )
    told = narrative(events).select(
        "trace_id", F.lit(2).alias("section"), F.lit(False).alias("late"), "path", "line"
    )
    return listed.unionByName(told).orderBy("trace_id", "section", "late", "path")


def heads(events: DataFrame) -> DataFrame:
    """One row for each trace: when it began, how many issues it has, and what its first
    start event says of the run (mode, dataset, tags); null where it says nothing.

    A trace is reduced to one row before the shuffle, however many events it has.
    """
    said = F.when(F.col("event_type") == "start", F.struct("timestamp", "event_id", "metadata"))
    first = F.min(said)["metadata"]
    return events.groupBy("trace_id").agg(
        F.min("timestamp").alias("created"),
        F.count_if(F.col("severity").isin(list(SEVERITY_LABELS))).alias("n_issues"),
        F.get_json_object(first, "$.mode").alias("mode"),
        F.get_json_object(first, "$.dataset_id").alias("dataset_id"),
        F.array_join(F.from_json(F.get_json_object(first, "$.tags"), "array<string>"), ", ").alias("tags"),
    )


def full_report(events: DataFrame) -> DataFrame:
    """`report` with a head for each trace, issues with their times, and a line where a
    trace has no issue: (trace_id, section, rank, line), ordered; rank orders the head."""

    def at(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    nowhere = F.array().cast("array<struct<at:timestamp_ntz,id:string>>")
    lines = [
        F.concat(F.lit("Trace: "), "trace_id"),
        F.concat(F.lit("Created: "), at("created")),
        F.concat(F.lit("Mode: "), _text("mode", "unknown")),
        F.concat(F.lit("Dataset: "), "dataset_id"),
        F.concat(F.lit("Tags: "), F.nullif("tags", F.lit(""))),
        F.when(F.col("n_issues") == 0, "No issues"),
    ]
    head = heads(events).select("trace_id", F.posexplode(F.array(*lines)).alias("rank", "line"))
    head = head.where(F.col("line").isNotNull()).select(
        "trace_id", F.lit(0).alias("section"), "rank", nowhere.alias("path"), "line"
    )
    listed = issues(events).select(
        "trace_id",
        F.lit(1).alias("section"),
        (F.col("label") == "WARNING").cast("int").alias("rank"),
        F.array(F.struct(F.col("timestamp").alias("at"), F.col("event_id").alias("id"))).alias("path"),
        F.concat(F.lit("["), "label", F.lit("] ["), at("timestamp"), F.lit("] "), "message").alias("line"),
    )
    told = narrative(events).select("trace_id", F.lit(2).alias("section"), F.lit(0).alias("rank"), "path", "line")
    every = head.unionByName(listed).unionByName(told)
    return every.orderBy("trace_id", "section", "rank", "path").drop("path")


def decision_checks(events: DataFrame) -> DataFrame:
    """Decision events with what is wrong with them, if anything."""
    rows = events.where((F.col("component") == "trace") & (F.col("event_type") == "decision"))
    problem = (
        F.when(
            F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0),
            "confidence outside 0 to 1",
        )
        .when(F.col("reasons").isNull() | (F.size("reasons") == 0), "no reason given")
        .when(
            ~F.forall("reasons", lambda r: r.isin(REASON_CODES)), "unknown reason code"
        )
        .otherwise("ok")
    )
    return rows.select(
        "trace_id", "event_id", "confidence", F.coalesce(F.size("reasons"), F.lit(0)).alias("n_reasons"),
        problem.alias("status"),
    )


def _cut(c: Column, t: T.DataType, items: int, text: int) -> Column:
    if isinstance(t, T.StringType):
        return F.when(
            F.char_length(c) > text, F.concat(F.left(c, F.lit(text)), F.lit(CUT_TEXT))
        ).otherwise(c)
    if isinstance(t, T.ArrayType):
        scalar = not isinstance(t.elementType, (T.StructType, T.ArrayType, T.MapType))
        head = F.slice(c, 1, items)
        if not scalar:  # a notice has no place among nested values
            return F.transform(head, lambda x: _cut(x, t.elementType, items, text))
        words = F.transform(head, lambda x: _cut(x.cast("string"), T.StringType(), items, text))
        notice = F.array(F.format_string(CUT_ITEMS, F.size(c) - items))
        return F.when(F.size(c) > items, F.concat(words, notice)).otherwise(words)
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _cut(v, t.valueType, items, text))
    if isinstance(t, T.StructType):
        return F.when(
            c.isNotNull(),
            F.struct(
                *[_cut(c.getField(f.name), f.dataType, items, text).alias(f.name) for f in t.fields]
            ),
        )
    return c


def truncate_values(df: DataFrame, items: int = MAX_ITEMS, text: int = MAX_TEXT) -> DataFrame:
    """Cut long texts and lists, nested ones too. Lists of scalars become lists of text."""
    return df.select(
        *[_cut(col(f.name), f.dataType, items, text).alias(f.name) for f in df.schema.fields]
    )


def search(
    events: DataFrame, event_type: str | None = None, query: str = "", newest_first: bool = False
) -> DataFrame:
    """Log search: no .success/.failure markers, by type, case-blind in name or metadata."""
    out = events.where(~F.col("name").endswith(".success") & ~F.col("name").endswith(".failure"))
    if event_type:
        out = out.where(F.lower("event_type") == event_type.lower())
    if query:
        q = query.lower()
        out = out.where(
            F.lower("name").contains(q) | F.coalesce(F.lower("metadata").contains(q), F.lit(False))
        )
    order = [F.desc("timestamp"), F.desc("event_id")] if newest_first else ["timestamp", "event_id"]
    return out.orderBy(*order)


def group_class(name: Column) -> Column:
    """The class of an event name, null when it has none. Patterns are fixed values."""
    return (
        F.when(name.rlike("^(COLUMN_PROFILING|PROFILE_)"), "Profiling")
        .when(name.rlike(r"^(CHECK_|RULE_|rule\.)|DETECTION|DETECTOR"), "Quality Checks")
        .when(name.rlike(r"^(ML_|metric\.)|MODEL"), "ML Analysis")
        .when(name.rlike(r"^fix\.|REMEDIATION"), "Remediation")
    )


def groups(events: DataFrame, per_chunk: int = EVENTS_PER_CHUNK) -> DataFrame:
    """Runs of consecutive events of one class, per trace, in time order.

    "ui" events join the run before them. Rows: (trace_id, first_event, group, n,
    started, ended); `group` is null for an event standing alone.

    Gaps and islands without one long window per trace: time is cut into chunks,
    each chunk is solved by itself, chunk summaries are carried forward along the
    trace (one row per chunk), and runs crossing a cut are joined when counting.
    """
    rows = events.select(
        "trace_id", "event_id", "timestamp",
        group_class(F.col("name")).alias("cls"),
        (F.col("event_type") == "ui").alias("ui"),
    )
    chunked = range_bucket(rows, ["timestamp", "event_id"], rows.count(), per_chunk)
    order = [F.col("timestamp"), F.col("event_id")]
    inside = Window.partitionBy("trace_id", "bucket").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an anchor is an event that is not "ui"; "ui" events take the class at their anchor,
    # or the first class seen since when the anchor has none
    anchored = chunked.withColumn("anchor", F.sum(F.when(F.col("ui"), 0).otherwise(1)).over(so_far))
    since = (
        Window.partitionBy("trace_id", "bucket", "anchor")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = anchored.withColumn("eff", F.first("cls", ignorenulls=True).over(since))
    ends = local.groupBy("trace_id", "bucket").agg(
        F.max("anchor").alias("anchors"), F.max_by("eff", F.struct(*order)).alias("out")
    )
    along = Window.partitionBy("trace_id").orderBy("bucket")
    until = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        ends.withColumn("leg", F.sum(F.when(F.col("anchors") > 0, 1).otherwise(0)).over(until))
        .withColumn(
            "out",
            F.first("out", ignorenulls=True).over(
                Window.partitionBy("trace_id", "leg")
                .orderBy("bucket")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("came", F.lag("out").over(along))
        .select("trace_id", "bucket", "came")
    )
    solved = local.join(carried, ["trace_id", "bucket"]).withColumn(
        "eff",
        F.when(F.col("anchor") == 0, F.coalesce("came", "eff")).otherwise(F.col("eff")),
    )
    before = F.when(F.row_number().over(inside) == 1, F.col("came")).otherwise(
        F.lag("eff").over(inside)
    )
    broken = F.when(
        F.col("eff").isNull() | before.isNull() | (F.col("eff") != before), 1
    ).otherwise(0)
    marked = solved.withColumn("new", broken).withColumn("run", F.sum("new").over(so_far))
    offsets = (
        marked.groupBy("trace_id", "bucket")
        .agg(F.sum("new").alias("made"))
        .withColumn(
            "skip",
            F.coalesce(
                F.sum("made").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("trace_id", "bucket", "skip")
    )
    runs = (
        marked.join(offsets, ["trace_id", "bucket"])
        .groupBy("trace_id", (F.col("run") + F.col("skip")).alias("run"))
        .agg(
            F.min_by("event_id", F.struct(*order)).alias("first_event"),
            F.first("eff", ignorenulls=True).alias("cls"),
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("started"),
            F.max("timestamp").alias("ended"),
        )
    )
    return runs.select(
        "trace_id", "first_event", F.when(F.col("n") > 1, F.col("cls")).alias("group"), "n",
        "started", "ended",
    )


def lineage_by_trace(nodes: DataFrame, trace_id: str) -> DataFrame:
    return nodes.where(F.col("trace_id") == trace_id)
