import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualityframe.operators import repair, structure
from qualityframe.operators.planning import PLAN_COLUMNS
from qualityframe.operators.scale import local_frame


def plan(spark, *actions):
    rows = [
        ("r", "d", i, f"r/d/{i}", kind, op, column, params, "", approval, False)
        for i, (kind, op, column, params, approval) in enumerate(actions, start=1)
    ]
    types = "string string bigint string string string string map<string,string> string boolean boolean".split()
    return local_frame(spark, rows, ", ".join(f"`{c}` {t}" for c, t in zip(PLAN_COLUMNS, types)))


def values(df, c):
    return [r[c] for r in df.collect()]


def test_impute_keeps_whole_numbers_whole(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert sorted(values(repair.impute(df, "x"), "x")) == [1, 2, 3]
    half = repair.impute(spark.createDataFrame([(1,), (2,), (None,)], "x int"), "x")
    assert dict(half.dtypes)["x"] == "double" and sorted(values(half, "x")) == [1.0, 1.5, 2.0]


def test_impute_all_null_stays(spark):
    assert values(repair.impute(spark.createDataFrame([(None,)], "x double"), "x"), "x") == [None]


def test_impute_zeros_on_request(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (6.0,), (None,)], "x double")
    assert sorted(values(repair.impute(df, "x", zeros_as_null="true"), "x")) == [4.0, 5.0, 5.0, 6.0]


def test_clip_matches_pandas_fence_and_keeps_nulls(spark):
    data = [10.0, 12.0, 11.0, 13.0, 14.0, 9999.0, None]
    got = values(repair.clip(spark.createDataFrame([(v,) for v in data], "x double"), "x"), "x")
    s = pd.Series(data)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    want = s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert got[:6] == pytest.approx(list(want[:6])) and got[6] is None


def test_clip_open_ended(spark):
    df = spark.createDataFrame([(-5.0,), (10.0,), (1e9,)], "price double")
    assert values(repair.clip(df, "price", min=0, open_ended="true"), "price") == [0.0, 10.0, 1e9]


def test_log_of_negatives_is_zero(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (None,)], "x double")
    assert values(repair.log_transform(df, "x"), "x") == [0.0, 0.0, None]


def test_nested_nulls_are_told_apart(spark):
    """Duplicates are what removing duplicates removes, at every depth."""
    df = spark.sql("""SELECT * FROM VALUES
        (array(1, null), named_struct('x', 1, 'y', null), array(map('a', 1))),
        (array(null, 1), named_struct('x', 1, 'y', null), array(map('a', 1))),
        (array(1), named_struct('x', null, 'y', 1), array(map('a', 1))),
        (array(1), named_struct('x', null, 'y', 1), array(map('a', null))),
        (array(1), null, null),
        (array(), named_struct('x', null, 'y', null), array()),
        (null, named_struct('x', null, 'y', null), array(map('a', 1, 'b', 2))),
        (null, named_struct('x', null, 'y', null), array(map('b', 2, 'a', 1)))
        AS t(list, both, maps)""")
    left = repair.remove_duplicates(df)
    assert left.columns == df.columns and left.count() == 7
    seen = structure.duplicate_rows(df).first()
    assert seen.duplicate_row_ratio == pytest.approx(1 / 8)
    assert structure.duplicate_rows(df.select("list", "both")).first().duplicate_row_ratio == pytest.approx(2 / 8)
    assert structure.duplicate_rows(df.select("list")).first().duplicate_row_ratio == pytest.approx(3 / 8)


@pytest.mark.parametrize("threshold", [0.1, 0.0005])
def test_group_rare_at_any_threshold(spark, threshold):
    rows = [("a",)] * 1999 + [("b",)] + [(None,)]
    rare = threshold > 1 / 2000
    got = repair.group_rare(spark.createDataFrame(rows, "s string"), "s", threshold)
    counts = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert counts == {"a": 1999, ("OTHER" if rare else "b"): 1, None: 1}


def test_cast_mask_flag(spark):
    df = spark.createDataFrame([("1",), (" 7 ",), ("1d",), ("inf",), (None,)], "s string")
    assert values(repair.cast_type(df, "s", target_type="numeric"), "s") == [1.0, 7.0, None, float("inf"), None]
    assert set(values(repair.mask_pii(df, "s"), "s")) == {"[MASKED_SENSITIVE]"}
    assert values(repair.flag_nulls(df, "s"), "s_is_dirty") == [0, 0, 0, 0, 1]


def test_flag_pattern_violations_on_request(spark):
    df = spark.createDataFrame([("a@b.c",), ("nope",), (None,)], "s string")
    assert values(repair.flag_nulls(df, "s", pattern="violations"), "s_is_dirty") == [0, 1, 1]


def test_remove_duplicates_with_map(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert repair.remove_duplicates(df).count() == 1


def test_plan_skips_unapproved_and_stops_at_block(spark):
    df = spark.createDataFrame([(1, None, 5)] * 3, "a int, b double, c int")
    healed, outcome = repair.apply_plan(
        df,
        plan(
            spark,
            ("DEDUPE", "remove_duplicates", None, {}, False),
            ("DROP", "drop_column", "a", {}, True),
            ("FLAG", "flag_nulls", "b", {}, False),
            ("CLIP", "clip", "nowhere", {}, False),
            ("BLOCK", None, None, {}, False),
            ("DROP", "drop_column", "c", {}, False),
        ),
    )
    assert healed.columns == ["a", "b", "c", "b_is_dirty"] and healed.count() == 1
    assert outcome.blocked and outcome.approval_requested
    assert [a["column"] for a in outcome.skipped] == ["nowhere"]


def test_errors_do_not_stop_the_plan(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", None)], "s string, n double")
    healed, outcome = repair.apply_plan(
        df, plan(spark, ("CLIP", "clip", "s", {}, False), ("IMPUTE", "impute", "n", {"strategy": "mean"}, False))
    )
    assert len(outcome.errors) == 1 and values(healed, "n") == [1.0, 1.0]


def test_handlers_may_replace_the_table(spark):
    def upper(action, df):
        return df.withColumn("s", F.upper("s"))

    def broken(action, df):
        raise RuntimeError("no")

    df = spark.createDataFrame([("x",)], "s string")
    actions = plan(spark, ("WARN", "warn", "s", {}, False), ("LOG", None, None, {}, False))
    healed, outcome = repair.apply_plan(df, actions, {"WARN": upper, "LOG": broken})
    assert values(healed, "s") == ["X"] and outcome.errors[0][1] == "no"


def test_same_column_twice_applies_in_order(spark):
    df = spark.createDataFrame([(-1.0,), (None,)], "x double")
    healed, _ = repair.apply_plan(
        df,
        plan(
            spark,
            ("IMPUTE", "impute", "x", {"strategy": "mean"}, False),
            ("TRANSFORM", "log_transform", "x", {}, False),
        ),
    )
    assert values(healed, "x") == [0.0, 0.0]


def test_long_and_seldom_labels_stay_at_any_threshold(spark, monkeypatch):
    """Labels above one in ten rows are broadcast, rarer wanted ones are joined."""
    monkeypatch.setattr(repair, "BROADCAST_LABELS", 10)
    labels = ["hot"] * 400 + ["y" * 5000] * 60 + ["z"] * 30 + ["w"] * 9 + ["v"] + [None] * 20
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(labels)], "id long, label string, other string")
    for threshold in (0.3, 0.1, 0.05, 0.015, 0.001):
        total = sum(x is not None for x in labels)
        kept = {x for x in labels if x is not None and labels.count(x) / total >= threshold}
        got = {r.id: r.label for r in repair.group_rare(df.repartition(4), "label", threshold).collect()}
        assert got == {i: x if x is None or x in kept else "OTHER" for i, x in enumerate(labels)}
    assert repair.group_rare(df, "label", 0.001).columns == df.columns
