import datetime
import json

import pytest
from pyspark.sql import functions as F

from qualityframe.config import Config
from qualityframe.operators import audit
from qualityframe.operators.scale import local_frame, lookup
from qualityframe.plans.analyze import analyze
from qualityframe.sources import readers, sinks

T0 = datetime.datetime(2024, 1, 1)


def event(i, parent=None, trace="t", component="trace", kind="info", severity="info", name=None, **more):
    return {
        "event_id": str(i), "trace_id": trace, "parent_event_id": parent, "component": component,
        "event_type": kind, "severity": severity, "name": name or f"e{i}",
        "timestamp": T0 + datetime.timedelta(seconds=i, microseconds=i), **more,
    }


def test_csv_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("n;s;d\n1;x;2024-01-01\nNA;null;2024-01-02\n3;y;\n", encoding="utf-8")
    df = readers.load(spark, str(path), delimiter=";")
    assert df.dtypes == [("n", "bigint"), ("s", "string"), ("d", "date")]
    assert [r.n for r in df.collect()] == [1, None, 3]


def test_csv_whole_numbers_lose_no_digit(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text(
        "fits,wide,huge,mixed,plain\n"
        f"9223372036854775807,9007199254740993111,{'9' * 40},1.5,1\n"
        f"-9223372036854775808,9007199254740993112000,{'9' * 39},9007199254740993111,2.5\n"
    )
    df = readers.read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "fits": "bigint", "wide": "decimal(38,0)", "huge": "string", "mixed": "string", "plain": "double"
    }
    rows = df.collect()
    assert [r.fits for r in rows] == [2**63 - 1, -(2**63)]
    assert [int(r.wide) for r in rows] == [9007199254740993111, 9007199254740993112000]
    assert rows[1].mixed == "9007199254740993111"


def test_database_file_needs_a_query():
    with pytest.raises(readers.SourceError):
        readers.resolve("a.sqlite")
    assert readers.resolve("a.db", query="SELECT 1")["query"] == "SELECT 1"


def test_csv_small_table(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a,b\n1,3\n2,4\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(path)).collect()] == [(1, 3), (2, 4)]


def test_json_array_of_records(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert sorted(r.a for r in readers.load(spark, str(path)).collect()) == [1, 2]
    bad = tmp_path / "bad.json"
    bad.write_text("{oops")
    with pytest.raises(readers.SourceError):
        readers.load(spark, str(bad))


def test_nan_is_null_after_reading(spark, tmp_path):
    spark.createDataFrame([(float("nan"),)], "x double").write.parquet(str(tmp_path / "x.parquet"))
    assert readers.load(spark, str(tmp_path / "x.parquet")).first().x is None


def test_resolution():
    assert readers.resolve("s3://bucket/dir/file.csv") == {"kind": "csv", "path": "s3a://bucket/dir/file.csv"}
    assert readers.resolve("s3://bucket/dir")["kind"] == "parquet"
    assert readers.resolve("x.pq")["kind"] == "parquet"
    assert readers.resolve("lake.db", query="SELECT 2")["kind"] == "database"
    found = readers.resolve("snowflake://host/db", query="SELECT 1")
    assert (found["kind"], found["warehouse_type"]) == ("warehouse", "snowflake")
    for bad in ("https://host/a.csv", "a.xlsx", "a.unknown", "postgresql://h/db"):
        with pytest.raises(readers.SourceError):
            readers.resolve(bad)


def test_jdbc_options_without_connecting():
    got = readers.jdbc_options("postgresql://u:p@h:5432/db", "SELECT 1", ("id", 0, 100, 4))
    assert got["url"] == "jdbc:postgresql://h:5432/db" and got["numPartitions"] == "4"
    assert got["dbtable"] == "(SELECT 1) source"
    assert readers.credentials("postgresql://u:p@h/db") == {"user": "u", "password": "p"}
    assert "u:p" not in readers.describe("postgresql://u:p@h/db", query="SELECT 1")["url"]


def test_sinks_keep_microseconds(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 01:02:03.000004' AS t, 'a\"b,c' AS s, CAST(NULL AS DOUBLE) AS x")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c")).first()
    assert (back.t, back.s, back.x) == (datetime.datetime(2024, 1, 1, 1, 2, 3, 4), 'a"b,c', None)
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().t.endswith("03.000004")


def test_events_round_trip_and_corrupt_line(spark, tmp_path):
    path = str(tmp_path / "trace")
    odd = "line\nbreak ü"
    audit.append_events(audit.event_frame(spark, [event(1, name=odd, inputs={"a": 1}), event(2, trace="u")]), path)
    audit.append_events(audit.event_frame(spark, [event(3, "1")]), path)
    got = audit.read_events(spark, path, "t").collect()
    assert [r.name for r in got] == [odd, "e3"] and json.loads(got[0].inputs) == {"a": 1}
    assert got[0].timestamp == T0 + datetime.timedelta(seconds=1, microseconds=1)
    (tmp_path / "trace" / "broken.json").write_text('{"event_id": \n')
    with pytest.raises(Exception):
        audit.read_events(spark, path).collect()


def test_report_of_four_events(spark):
    rows = [
        event(1, name="run"),
        event(2, "1", component="rule", kind="check", severity="warning", name="Range Check",
              inputs={"limit": 0.2}, outputs={"passed": False}),
        event(3, "2", kind="decision", name="choose", confidence=0.95, reasons=["rule_violation"], evidence={}),
        event(4, "1", kind="error", severity="error", name="load", metadata={"error_message": "boom"}),
    ]
    events = audit.event_frame(spark, rows)
    lines = [(r.section, r.line) for r in audit.report(events).collect()]
    assert [line for s, line in lines if s == 1] == [
        "[ERROR] ERROR in 'load': boom",
        "[WARNING] Rule 'Range Check': FAILED. Checked {\"limit\": 0.2} -> {\"passed\": false}",
    ]
    told = [line for s, line in lines if s == 2]
    assert [len(line) - len(line.lstrip()) for line in told] == [0, 2, 4, 2]
    assert "Decision 'choose' (Confidence: 0.95). Reasons: rule_violation." in told[2]


def test_full_report_has_heads_times_and_a_line_without_issues(spark):
    start = {"mode": "strict", "dataset_id": "orders", "tags": ["nightly", "eu"]}
    rows = [
        event(1, name="run", kind="start", metadata=start), event(2, "1", kind="start", metadata={"mode": "late"}),
        event(3, "1", severity="warning", name="w"), event(4, "1", severity="critical", name="c"), event(5, trace="u"),
    ]
    got = [(r.trace_id, r.section, r.line) for r in audit.full_report(audit.event_frame(spark, rows)).collect()]
    assert [line for t, s, line in got if t == "t" and s == 0] == [
        "Trace: t", "Created: 2024-01-01T00:00:01.000001", "Mode: strict", "Dataset: orders", "Tags: nightly, eu",
    ]
    assert [line.split("] ")[:2] for t, s, line in got if t == "t" and s == 1] == [
        ["[CRITICAL", "[2024-01-01T00:00:04.000004"], ["[WARNING", "[2024-01-01T00:00:03.000003"],
    ]
    assert [line for t, s, line in got if t == "u" and s == 0][2:] == ["Mode: unknown", "No issues"]
    assert [s for t, s, _ in got] == sorted(s for t, s, _ in got if t == "t") + sorted(s for t, s, _ in got if t == "u")
    empty = audit.full_report(audit.event_frame(spark, []))
    assert empty.columns == ["trace_id", "section", "rank", "line"] and empty.isEmpty()


def test_a_run_keeps_its_tags_and_metadata(spark):
    cfg = Config(tracing=True).with_profiling(enable_ml=False)
    result = analyze(
        spark.range(20), cfg, dataset_id="ids", run_id="r", tags=["nightly"], metadata={"team": "ops", "name": "x", "inputs": 1}
    )
    log = audit.event_frame(spark, result.events)
    head = audit.heads(log).first()
    assert (head.trace_id, head.mode, head.dataset_id, head.tags) == ("r", cfg.mode, "ids", "nightly")
    assert json.loads(log.where("event_type = 'start'").first().metadata)["properties"] == {"team": "ops", "name": "x", "inputs": 1}
    assert audit.search(log, query="ops").count() == 1


def test_tree_of_a_long_chain_hot_parent_and_cycle(spark):
    chain = [event(i, str(i - 1) if i else None) for i in range(70)]
    brood = [event(1000 + i, "0") for i in range(200)]
    lost = [event(5000, "missing"), event(6000, "6001"), event(6001, "6000"), event(7000, "0", trace="other")]
    got = {r.event_id: r.depth for r in audit.tree(audit.event_frame(spark, chain + brood + lost)).collect()}
    assert got["69"] == 69 and got["1100"] == 1 and got["5000"] == 0 and got["7000"] == 0
    assert "6000" not in got and len(got) == 272


def test_lookup_with_hot_keys(spark):
    left = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1700).alias("k"), "id"
    )
    right = spark.range(1500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    got = lookup(left, right, {"k": "key"}, 5000).collect()
    assert len(got) == 5000
    for r in got:
        assert (r.found.v if r.found else None) == (r.k * 2 if r.k < 1500 else None)


def expected_groups(rows):
    """Plain walk over one trace."""
    out, i = [], 0
    classes = {"P": "Profiling", "C": "Quality Checks", "": None}
    while i < len(rows):
        cls = classes[rows[i][0]]
        j = i + 1
        while cls and j < len(rows) and (classes[rows[j][0]] == cls or rows[j][1]):
            j += 1
        n = j - i if cls else 1
        out.append((str(i), cls if n > 1 else None, n))
        i += n
    return out


@pytest.mark.parametrize("per_chunk", [7, 1_000_000])
def test_groups_match_a_plain_walk(spark, per_chunk):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["P", "P", "C", ""]), rng.random() < 0.4) for _ in range(300)]
    names = {"P": "PROFILE_x", "C": "CHECK_x", "": "other"}
    # all at one moment: chunks must still split the trace
    events = [
        event(0, trace="t", name=names[c], kind="ui" if ui else "info") | {"event_id": f"{i:04d}", "timestamp": T0}
        for i, (c, ui) in enumerate(rows)
    ]
    got = audit.groups(audit.event_frame(spark, events), per_chunk).collect()
    want = [(f"{int(a):04d}", b, c) for a, b, c in expected_groups(rows)]
    assert sorted((r.first_event, r.group, r.n) for r in got) == sorted(want)


def test_search(spark):
    rows = [event(1, name="CHECK.success"), event(2, name="Load File"), event(3, metadata={"path": "file.csv"}, kind="END")]
    events = audit.event_frame(spark, rows)
    assert [r.event_id for r in audit.search(events, query="FILE", newest_first=True).collect()] == ["3", "2"]
    assert [r.event_id for r in audit.search(events, event_type="end").collect()] == ["3"]


def test_decisions_are_checked(spark):
    rows = [
        event(1, kind="decision", confidence=0.5, reasons=["rule_violation"]),
        event(2, kind="decision", confidence=1.5, reasons=["rule_violation"]),
        event(3, kind="decision", confidence=0.5, reasons=[]),
        event(4, kind="decision", confidence=0.5, reasons=["because"]),
    ]
    got = {r.event_id: r.status for r in audit.decision_checks(audit.event_frame(spark, rows)).collect()}
    assert got["1"] == "ok" and len(set(got.values())) == 4


def test_truncation_is_nested(spark):
    df = spark.sql(
        "SELECT repeat('x', 1200) AS t, sequence(1, 60) AS a, named_struct('s', repeat('y', 1001), 'm', map('k', repeat('z', 1001))) AS n"
    )
    r = audit.truncate_values(df).first()
    assert r.t == "x" * 1000 + "... (truncated)"
    assert len(r.a) == 51 and r.a[-1] == "... (truncated 10 more items)"
    assert r.n.s.endswith("... (truncated)") and r.n.m["k"].endswith("... (truncated)")


def test_local_frame_handles_nested_values(spark):
    schema = "a struct<x: double, y: string>, m map<string,bigint>"
    assert local_frame(spark, [((1, None), {"k": 2}), (None, None)], schema).collect()[0].a.x == 1.0
