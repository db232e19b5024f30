import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualityframe import config as C
from qualityframe.operators import detectors, planning, scoring
from qualityframe.operators.scale import local_frame
from qualityframe.plans.analyze import analyze, execute, heal, inspect
from qualityframe.plans.profile import profile

LEAN = {"labels", "distinct", "numbers", "rows"}


def context(df, cfg=C.Config(), parts=LEAN, baseline=None, **options):
    p = profile(df, cfg, parts=parts)
    base = None if baseline is None else profile(baseline, cfg, parts=parts).columns
    return detectors.Context(
        p.columns, p.dataset, p.correlations, p.classes(), df, base, cfg, **options
    )


def issues(found):
    return {(r.issue_type, r.column) for r in found.collect()}


def test_drift_is_worded_as_shift(spark):
    base = spark.createDataFrame([(float(v),) for v in (10, 10, 11, 10, 11, 10)], "val double")
    now = base.withColumn("val", F.col("val") * 10)
    found = detectors.drift(context(now, baseline=base)).collect()
    assert len(found) == 1 and "shifted" in found[0].description and found[0].severity == 1.0


def test_no_baseline_no_drift(spark):
    assert detectors.drift(context(spark.range(3).withColumnRenamed("id", "x"))) is None


def test_quasi_identifiers(spark):
    df = spark.createDataFrame(
        [("12345", "M", 1980, 1), ("12346", "F", 1981, 1), ("12347", "M", 1982, 1), ("12348", "F", 1983, 1)],
        "zip_code string, gender string, birth_year int, other int",
    )
    found = detectors.quasi_identifiers(context(df)).collect()
    assert {tuple(r.columns) for r in found} >= {("birth_year", "zip_code")}
    assert all(r.severity == 1.0 for r in found)


def test_combinations_are_counted_exactly_with_a_hot_value(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, None).otherwise(F.col("id")).alias("zip"),
        (F.col("id") % 2).alias("sex"), (F.col("id") % 7).alias("race"),
    )
    got = {tuple(r.columns): r.distinct_count for r in detectors.combination_uniqueness(df, ["race", "sex", "zip"]).collect()}
    frame = df.toPandas()
    for names, n in got.items():
        assert n == len(frame[list(names)].drop_duplicates())


def test_semantic_bounds_and_longest_word(spark):
    df = spark.createDataFrame(
        [(25, 10.5, 50.0), (30, -1.0, 99.0), (-5, 5.0, 150.0), (200, 0.0, 1.0)],
        "age int, price double, percentage double",
    )
    found = detectors.semantic_bounds(context(df)).collect()
    assert sorted((r.column, r.metrics["end"]) for r in found) == [
        ("age", "max"), ("age", "min"), ("percentage", "max"), ("price", "min"),
    ]
    assert {r.metrics["semantic"] for r in found if r.column == "percentage"} == {"percentage"}


def test_pattern_of_tagged_columns_only(spark):
    df = spark.createDataFrame([("123", "123")] * 2 + [("abc", "456"), ("xyz", "789")], "bad string, ok string")
    p = profile(df, parts=set())
    tagged = p.columns.withColumn("semantic_tags", F.array(F.lit("code")))
    c = detectors.Context(tagged, p.dataset, p.correlations, p.classes(), df, pattern=r"^\d{3}$", pattern_class="code")
    found = detectors.pattern(c).collect()
    assert [(r.column, r.severity) for r in found] == [("bad", 0.5)]
    c.pattern_class = "email"
    assert detectors.pattern(c) is None


def test_constant_is_exact_and_ratio_form(spark):
    df = spark.range(20000).select(
        F.lit(1).alias("one"), F.when(F.col("id") == 0, 2).otherwise(1).alias("two"),
        F.when(F.col("id") == 0, "b").otherwise("a").alias("label"),
    )
    assert issues(detectors.constant(context(df))) == {("constant_column", "one")}
    near = C.Config().with_detection(constant=0.99)
    assert issues(detectors.constant(context(df, near))) == {("constant_column", "label")}


def test_booleans_are_imbalanced_on_request(spark):
    df = spark.range(100).select((F.col("id") == 0).alias("flag"))
    assert issues(detectors.imbalance(context(df))) == set()
    on = C.Config().with_detection(boolean_imbalance=True)
    assert issues(detectors.imbalance(context(df, on))) == {("imbalance", "flag")}


def test_unknown_type_and_numeric_text(spark):
    df = spark.sql("SELECT array(id) AS a, CAST(id AS STRING) AS n, concat('1d', id) AS t FROM range(10)")
    assert issues(detectors.types(context(df))) == {("unknown_logical_type", "a"), ("type_mismatch", "n")}


def test_own_detector_and_registry(spark):
    registry = detectors.Registry()

    @registry.rule
    def wide(c):
        return detectors.finding(
            c.dataset.where("column_count > 1"), "Wide", "too_wide", "validity", F.lit(0.3),
            F.lit("too wide"), {"columns": F.col("column_count")}, scope="dataset",
        )

    df = spark.range(30).select("id", (F.col("id") * 2).alias("x"))
    found = detectors.detect(context(df), registry)
    assert ("too_wide", None) in issues(found)


FINDING = (
    "run_id string, dataset_id string, seq bigint, kind string, detector string, issue_type string, "
    "dimension string, `column` string, columns array<string>, severity double, confidence double, "
    "metrics map<string,string>"
)


def findings(spark, *rows):
    full = [
        ("r", "d", i, "rule", "D", issue, dim, column, None, severity, 1.0, {})
        for i, (issue, dim, column, severity) in enumerate(rows, start=1)
    ]
    return local_frame(spark, full, FINDING)


@pytest.mark.parametrize(
    "severities,score,verdict",
    [((0.1, 0.9), 0.72, "FAIL"), ((0.1, 0.2), 0.16, "PASS")],
)
def test_global_score(spark, severities, score, verdict):
    rows = [("missing_values", "completeness", f"c{i}", s) for i, s in enumerate(severities)]
    row = scoring.decide(scoring.score(findings(spark, *rows))).first()
    assert row.score == pytest.approx(score) and row.decision == verdict


def test_no_findings_pass_with_zero(spark):
    runs = local_frame(spark, [("r", "d")], "run_id string, dataset_id string")
    row = scoring.decisions(scoring.score(findings(spark)), runs).first()
    assert (row.score, row.decision, row.dominant_issues) == (0.0, "PASS", [])
    plan = planning.make_plan(scoring.score(findings(spark)), scoring.decide(scoring.score(findings(spark)), runs))
    assert [r.action_type for r in plan.collect()] == ["ALLOW"]


def test_breakdown_and_weights(spark):
    scores = scoring.score(
        findings(spark, ("a", "completeness", "c1", 1.0), ("b", "validity", "c2", 0.0)), {"b": 2.0}
    )
    means = {(r.kind, r.name): r.mean_score for r in scoring.breakdown(scores).collect()}
    assert means["dimension", "completeness"] == 1.0 and means["dimension", "validity"] == 0.0
    assert scoring.global_score(scores).first().score == pytest.approx(0.8)


@pytest.mark.parametrize(
    "score,verdict,level",
    [(0.1, "PASS", "LOW"), (0.3, "WARN", "MEDIUM"), (0.6, "FAIL", "HIGH"), (0.8, "FAIL", "CRITICAL")],
)
def test_bounds(spark, score, verdict, level):
    row = spark.range(1).select(scoring.verdict(F.lit(score)), scoring.severity_level(F.lit(score))).first()
    assert tuple(row) == (verdict, level)


def plan_for(spark, cfg, *rows):
    scores = scoring.score(findings(spark, *rows))
    return planning.make_plan(scores, scoring.decide(scores), cfg).orderBy("seq").collect()


AUTO = C.Config(mode=C.AUTOMATIC, tracing=True)


def test_modes(spark):
    rows = [("missing_values", "completeness", "c", 1.0)]
    auto = plan_for(spark, AUTO, *rows)
    assert [(r.action_type, r.requires_approval) for r in auto] == [("DROP", False), ("BLOCK", False)]
    human = plan_for(spark, C.Config(mode=C.HUMAN, tracing=True), *rows)
    assert [(r.action_type, r.requires_approval) for r in human] == [("DROP", True), ("BLOCK", True)]
    advice = plan_for(spark, C.Config(), *rows)
    assert [(r.action_type, r.requires_approval) for r in advice] == [("DROP", True), ("WARN", False)]
    assert advice[1].reason.startswith("[ADVICE]")


def test_one_action_per_column(spark):
    got = plan_for(
        spark, AUTO, ("missing_values", "x", "a", 0.3), ("type_mismatch", "x", "a", 0.3),
        ("outliers", "x", "a", 0.1), ("data_drift", "x", "b", 0.1), ("duplicate_rows", "x", None, 0.3),
        ("duplicate_rows", "y", None, 0.1),
    )
    assert [(r.operation, r.column) for r in got] == [
        ("remove_duplicates", None), ("cast_type", "a"), ("warn", "b"),
    ]


def test_overrides(spark):
    from dataclasses import replace

    cfg = replace(AUTO, planning=C.Planning(issue_overrides={"missing_values": "WARN", "outliers": "ignore"}))
    got = plan_for(spark, cfg, ("missing_values", "x", "a", 0.3), ("outliers", "x", "b", 0.1))
    assert [(r.action_type, r.operation) for r in got] == [("WARN", "warn")]


def test_config_rules():
    for bad in ({"lineage": True}, {"mode": "automatic"}, {"mode": "human"}, {"mode": "other"}):
        with pytest.raises(C.ConfigError):
            C.Config(**bad)
    assert C.strict().mode == "automatic" and not C.fast().profiling.enable_ml
    assert C.strict().hash() == C.strict().hash() != C.advisory().hash()


def test_missing_column_is_dropped_when_automatic(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "a double, b int")
    cfg = AUTO.with_detection(missing=0.1).with_profiling(enable_ml=False)
    result = analyze(df, cfg)
    assert result.data.columns == ["b"] and result.outcome.blocked
    assert "FAIL" in result.summary()


def test_human_mode_waits_for_approval(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "a double, b int")
    cfg = C.Config(mode=C.HUMAN, tracing=True).with_detection(missing=0.1).with_profiling(enable_ml=False)
    result = analyze(df, cfg)
    assert result.outcome.approval_requested and result.data.columns == ["a", "b"]
    assert result.approval.first().status == "PENDING_APPROVAL"
    drops = result.plan.where("operation = 'drop_column'").select("action_id")
    execute(result, planning.approve(result.plan, drops))
    assert result.data.columns == ["b"]


def test_unreadable_source_is_reported(spark):
    result = analyze("/no/such/file.parquet", spark=spark)
    assert result.error and result.data is None and result.summary().startswith("Error")


def dirty(seed=42, n=100):
    """The table that trips every detector."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "col_missing": [1.0 if i % 2 else None for i in range(n)],
            "col_constant": 42,
            "col_skewed": rng.exponential(10, n),
            "col_corr1": range(n),
            "col_corr2": [i + 1e-5 for i in range(n)],
            "gender": ["M"] * 95 + ["F"] * 5,
            "col_email": [f"u{i}@x.com" for i in range(70)] + ["invalid-email"] * 30,
            "col_range": np.r_[500.0, rng.uniform(0, 50, n - 1)],
            "col_outliers": [10.0] * 98 + [9999.0, -8888.0],
            "col_zeros": [0] * 50 + [1] * 50,
            "col_rare": ["Common"] * 98 + ["Rare1", "Rare2"],
            "col_mixed": [str(i) for i in range(81)] + ["invalid"] * 19,
            "age": [25] * 98 + [-5, 150],
            "price": [10.0] * 99 + [-1.0],
            "zip_code": [str(10000 + i) for i in range(n)],
            "birth_year": [1980 + i % 40 for i in range(n)],
            "col_drift": 10.0,
            "col_anomaly1": np.r_[50.0, rng.normal(size=n - 1)],
            "col_anomaly2": np.r_[50.0, rng.normal(size=n - 1)],
        }
    )
    return pd.concat([frame, frame[:15]])


def test_every_detector_fires_and_the_table_heals(spark):
    cfg = C.Config(mode=C.AUTOMATIC, tracing=True, ml_enabled=True).with_detection(
        min_value=0.0, max_value=100.0, outlier_ratio=0.01, duplicate=0.05, rare_category=0.05
    )
    df = spark.createDataFrame(dirty())
    base = profile(df.withColumn("col_drift", F.lit(100.0)), cfg, parts=LEAN)
    result = analyze(df, cfg, baseline=base)
    seen = {r.issue_type for r in result.findings.select("issue_type").collect()}
    assert seen >= {
        "missing_values", "constant_column", "duplicate_rows", "high_skewness", "high_correlation",
        "imbalance", "outliers", "zero_value", "rare_category", "type_mismatch", "data_drift",
        "quasi_identifier_risk", "semantic_violation", "pii_detected", "potential_bias",
        "pattern_violation", "anomaly_score", "range_violation",
    }
    assert not result.outcome.errors
    healed, verdicts = heal(result.data, cfg, max_passes=5)
    assert verdicts[-1] == "PASS" and healed.count() > 0


def test_inspect_shares_the_scan(spark):
    found = inspect(spark.range(30).select("id", F.lit(1).alias("one")), parts=LEAN)[1]
    assert ("constant_column", "one") in issues(found)


def test_saved_results_hold_actions_and_audit_rows(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "a double, b int").write.parquet(path)
    cfg = C.Config(mode=C.AUTOMATIC, tracing=True, lineage=True).with_profiling(enable_ml=False)
    result = analyze(path, cfg, spark=spark, run_id="r1")
    result.save(str(tmp_path / "out"))
    actions = spark.read.json(str(tmp_path / "out" / "actions"))
    assert {(r.run_id, r.operation) for r in actions.collect()} == {("r1", "drop_column"), ("r1", None)}
    nodes = spark.read.json(str(tmp_path / "out" / "lineage_nodes")).where("operation = 'read'")
    assert '"kind": "parquet"' in nodes.first().inputs
    events = spark.read.json(str(tmp_path / "out" / "trace_events"))
    assert events.where("trace_id = 'r1'").count() == len(result.events)
    outcome = spark.read.json(str(tmp_path / "out" / "outcome"))
    assert {r.status for r in outcome.collect()} == {"executed"}


def test_skips_and_errors_are_recorded(spark, tmp_path):
    from qualityframe.operators import repair

    cfg = C.Config(mode=C.HUMAN, tracing=True).with_profiling(enable_ml=False)
    df = spark.createDataFrame([(None, "x"), (None, "y"), (1.0, "z")], "a double, s string")
    result = analyze(df, cfg, run_id="r2")
    before = len(result.events)
    lost = result.plan.limit(1).withColumns({"operation": F.lit("drop_column"), "column": F.lit("gone"), "action_type": F.lit("DROP"), "seq": F.lit(90).cast("long")})
    wrong = lost.withColumns({"operation": F.lit("clip"), "column": F.lit("s"), "seq": F.lit(91).cast("long")})
    plan = planning.approve(lost.unionByName(wrong))
    execute(result, plan)
    assert isinstance(result.outcome, repair.Outcome)
    tail = result.events[before:]
    assert [(e["event_type"], e["severity"]) for e in tail] == [("error", "error"), ("execution", "warning"), ("execution", "info")]
    result.save(str(tmp_path / "out"))
    saved = spark.read.json(str(tmp_path / "out" / "outcome")).collect()
    assert sorted(r.status for r in saved) == ["error", "skipped"]


def test_findings_carry_the_run_that_was_scanned(spark):
    df = spark.range(40).selectExpr("id", "cast(id AS string) AS zip_code", "id % 7 AS birth_year", "'F' AS gender")
    one = profile(df, run_id="one", dataset_id="d", parts=LEAN)
    two = profile(df, run_id="two", dataset_id="d", parts=LEAN)
    both = one.dataset.unionByName(two.dataset)
    context = detectors.Context(one.columns, both, one.correlations, one.classes(), df, run=("two", "d"))
    assert {r.run_id for r in detectors.quasi_identifiers(context).collect()} == {"two"}
    with pytest.raises(ValueError):
        detectors.quasi_identifiers(detectors.Context(one.columns, both, one.correlations, one.classes(), df))


def test_quasi_identifiers_are_pruned_by_single_columns(spark, monkeypatch):
    """Nulls count as a value; a product of exactly the wanted count must survive."""
    df = spark.range(1200).select(
        (F.col("id") % 40).alias("a"), F.when(F.col("id") % 30 > 0, F.col("id") % 30).alias("b"),
        (F.col("id") / 40).cast("int").alias("c"), (F.col("id") % 2).alias("d"), F.lit(1).alias("e"),
        F.lit(None).cast("string").alias("f"),
    )
    names = list("abcdef")
    every = {tuple(r.columns): r.ratio for r in detectors.combination_uniqueness(df, names).collect()}
    assert len(every) == 15 + 20 and every["a", "c"] == 1.0
    sketched = []
    one_row = detectors.one_row

    def seen(data, exprs, **options):
        sketched.append(len(exprs))
        return one_row(data, exprs, **options)

    monkeypatch.setattr(detectors, "one_row", seen)
    found = {tuple(r.columns): r.ratio for r in detectors.combination_uniqueness(df, names, 0.9).collect()}
    assert {k: v for k, v in found.items() if v >= 0.9} == {k: v for k, v in every.items() if v >= 0.9}
    assert sketched[0] == 7 and len(sketched) == 2 and sketched[1] < 20
    assert detectors.combination_uniqueness(df.limit(0), names, 0.9).count() == 0


def test_combinations_travel_as_two_longs(spark):
    """Two longs a row and combination cross the shuffle; the counts are those of plain SQL."""
    df = spark.range(300).selectExpr("id % 7 AS a", "CAST(id % 11 AS STRING) AS b", "IF(id % 5 = 0, NULL, id % 13) AS c")
    combos = [["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]
    packed = detectors._packed(df, combos)
    assert [t for _, t in packed.dtypes] == ["bigint", "bigint"]
    want = {tuple(k): df.select(*k).distinct().count() for k in combos}
    assert {tuple(r.columns): r.distinct_count for r in detectors.combination_uniqueness(df, ["a", "b", "c"]).collect()} == want
