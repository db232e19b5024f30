import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualityframe.config import Profiling
from qualityframe.operators import categories, numeric, relations, semantic, structure, text, times
from qualityframe.operators.scale import running_total
from qualityframe.plans.profile import (
    load_profiles,
    profile,
    profile_delta,
    risk_signals,
    rounded,
    save,
)


def rows(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_numeric_with_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    found = rows(profile(df, parts={"numbers"}).columns)["x"]
    assert found.null_ratio == 0.2
    assert found.logical_type == "numeric"
    assert found.numeric.mean == 26.5
    assert (found.numeric.min, found.numeric.max) == (1.0, 100.0)


def test_categorical_with_null(spark):
    df = spark.createDataFrame([(v,) for v in "AAAAABBBCC"] + [(None,)], "s string")
    found = rows(profile(df, parts={"labels"}).columns)["s"]
    assert found.logical_type == "categorical"
    assert (found.categorical.cardinality, found.categorical.mode) == (3, "A")


def test_hundred_labels_are_text(spark):
    df = spark.createDataFrame([(f"val_{i}",) for i in range(100)], "s string")
    assert categories.infer_types(df) == {"s": "text"}


def test_types_of_other_columns(spark):
    df = spark.sql("SELECT true AS b, DATE'2024-01-01' AS d, array(1) AS a, CAST(NULL AS STRING) AS s")
    assert categories.infer_types(df) == {"b": "boolean", "d": "datetime", "a": "unknown", "s": "text"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    found = rows(profile(df, parts={"numbers"}).columns)["x"]
    assert found.null_count == 1 and found.numeric.mean == 2.0


def test_all_null_numbers_give_zeros(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    stats = numeric.numeric_stats(df)["x"]
    assert stats["n"] == 0 and stats["mean"] == 0.0 and stats["skewness"] == 0.0


@pytest.mark.parametrize("offset,width", [(0.0, 1.0), (1e9, 1e-2), (-5.0, 1e6)])
def test_moments_match_pandas(spark, offset, width):
    x = np.random.default_rng(7).exponential(1.0, 5000) * width + offset
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    s, want = numeric.numeric_stats(df)["x"], pd.Series(x)
    assert s["mean"] == pytest.approx(want.mean())
    assert s["std"] == pytest.approx(want.std(), rel=1e-6)
    assert s["skewness"] == pytest.approx(want.skew(), rel=1e-4)
    assert s["kurtosis"] == pytest.approx(want.kurt(), rel=1e-4)
    for p in (0.25, 0.5, 0.75):
        assert s[f"q{int(p * 100)}"] == pytest.approx(want.quantile(p), rel=1e-12)


def test_constant_column_is_flat(spark):
    df = spark.createDataFrame([(0.1,)] * 1000, "x double")
    s = numeric.numeric_stats(df)["x"]
    assert (s["std"], s["skewness"], s["kurtosis"], s["median"]) == (0.0, 0.0, 0.0, 0.1)


@pytest.mark.parametrize("limit", [100, 200_000])
def test_quantiles_are_exact_when_brackets_are_refined(spark, limit):
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(20000) < 0.34, 7.0, rng.normal(0, 100, 20000))
    frame = pd.DataFrame({"hot": hot, "few": rng.integers(0, 5, 20000).astype(float)})
    df = spark.createDataFrame(frame).repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = numeric.quantiles(df, {"hot": probs, "few": probs}, accuracy=50, limit=limit)
    for c in frame:
        for p in probs:
            assert found[c, p] == pytest.approx(frame[c].quantile(p), abs=1e-9), (c, p)


def test_outlier_rules(spark):
    near = [float(i % 10) for i in range(200)] + [60.0]
    df = spark.createDataFrame([(v,) for v in near], "x double")
    stats = numeric.numeric_stats(df)
    want = pd.Series(near)
    z = (want - want.mean()).abs() / want.std() > 3
    q1, q3 = want.quantile(0.25), want.quantile(0.75)
    fence = (want < q1 - 1.5 * (q3 - q1)) | (want > q3 + 1.5 * (q3 - q1))
    hit = z if abs(want.skew()) < 1 else fence
    assert numeric.numeric_behavior(df, stats)["x"]["outlier_ratio"] == pytest.approx(hit.mean())


def test_too_few_rows_have_no_behavior(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert numeric.numeric_behavior(df, numeric.numeric_stats(df)) == {}


def test_entropy_of_single_label_is_zero(spark):
    df = spark.createDataFrame([("a",)] * 5, "s string")
    row = categories.categorical_summary(categories.value_counts(df, ["s"])).first()
    assert row.entropy == 0.0 and row.imbalance == 1.0


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string")
    assert categories.categorical_summary(categories.value_counts(df, ["s"])).first().mode == "a"


def test_text_counts_are_unicode(spark):
    df = spark.createDataFrame([("é1 ü!",), ("a_b ٣",)], "s string")
    row = text.text_profile(df, ["s"]).first()
    assert row.digit_ratio == pytest.approx(2 / 10)
    assert row.whitespace_ratio == pytest.approx(2 / 10)
    assert row.special_char_ratio == pytest.approx(1 / 10)


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("ab", "c"), ("a", "bc"), ("ab", "c")], "x string, y string")
    assert structure.duplicate_rows(df).first().duplicate_rows == 1


def test_duplicates_with_map_and_long_text(spark):
    df = spark.sql(
        "SELECT map('a', 1, 'b', 2) AS m, repeat('x', 5000) AS t UNION ALL "
        "SELECT map('b', 2, 'a', 1), repeat('x', 5000)"
    )
    assert structure.duplicate_rows(df).first().duplicate_rows == 1


def test_distinct_of_long_texts(spark):
    df = spark.sql("SELECT concat(repeat('x', 5000), CAST(id % 3 AS STRING)) AS t FROM range(30)")
    assert structure.distinct_counts(df, ["t"], digest={"t"}).first().distinct_count == 3


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    print_of = lambda d: structure.fingerprint(d).first().fingerprint
    assert print_of(df) == print_of(df.repartition(7).orderBy(F.desc("id")))
    assert print_of(df) != print_of(df.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v"))))
    assert print_of(df) != print_of(df.unionByName(df.limit(1)))


def test_sample_has_exact_size_and_ignores_partitions(spark):
    cfg = Profiling(sampling_threshold=100, sample_size=50)
    df = spark.range(5000)
    first = {r.id for r in structure.sample_rows(df, ["id"], cfg).collect()}
    again = {r.id for r in structure.sample_rows(df.repartition(9), ["id"], cfg).collect()}
    assert len(first) == 50 and first == again
    assert structure.sample_rows(spark.range(100), ["id"], cfg).count() == 100


def test_running_total_over_buckets(spark):
    counts = spark.range(1000).select((F.col("id") * 3).alias("k"), (F.col("id") % 5 + 1).alias("n"))
    got = {r.k: r.before for r in running_total(counts, "k", "n", rows_per_bucket=70).collect()}
    want = 0
    for i in range(1000):
        assert got[i * 3] == want
        want += i % 5 + 1


def test_monotonic_with_hot_order_value_and_text_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"),
        F.expr("timestamp_seconds(id)").alias("t"),
        F.format_string("%06d", "id").alias("name"),
    )
    assert times.monotonic(df, "t", "k", rows_per_bucket=100).first().monotonic
    assert times.monotonic(df, "t", "name", rows_per_bucket=100).first().monotonic
    broken = df.withColumn("t", F.when(F.col("k") == 2500, F.expr("timestamp_seconds(1)")).otherwise(F.col("t")))
    assert not times.monotonic(broken, "t", "k", rows_per_bucket=100).first().monotonic


def correlation_table(n=400):
    rng = np.random.default_rng(5)
    a = rng.normal(size=n)
    return pd.DataFrame(
        {
            "a": a,
            "b": np.where(rng.random(n) < 0.35, 0.0, np.round(a * 2 + rng.normal(size=n), 1)),
            "c": rng.integers(0, 4, n).astype(float),
            "k": np.full(n, 0.1),
        }
    )


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_match_pandas_with_nulls(spark, method):
    frame = correlation_table()
    frame.loc[::7, "a"] = np.nan
    frame.loc[::5, "c"] = np.nan
    df = spark.createDataFrame(frame).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame.columns]
    )
    want = frame.corr(method=method)
    got = {(r.col1, r.col2): r.value for r in relations.METHODS[method](df, list("abck")).collect()}
    assert ("k", "k") not in got and ("a", "k") not in got
    for i, x in enumerate("abc"):
        for y in "abc"[i:]:
            assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)


@pytest.mark.parametrize("strip", [40, 100_000])
def test_kendall_matches_brute_force(spark, strip):
    frame = correlation_table(300)
    df = spark.createDataFrame(frame)
    got = {(r.col1, r.col2): r.value for r in relations.kendall(df, ["a", "b", "c"], rows_per_strip=strip).collect()}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        u, v = frame[x].to_numpy(), frame[y].to_numpy()
        sx, sy = np.sign(u[:, None] - u), np.sign(v[:, None] - v)
        want = (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())
        assert got[x, y] == pytest.approx(want, abs=1e-12)


def test_correlation_needs_two_columns(spark):
    assert relations.correlations(spark.range(5), ["id"]) is None


def test_correlation_summary(spark):
    pairs = spark.createDataFrame([("a", "a", 1.0), ("a", "b", -0.8), ("a", "c", 0.1), ("b", "c", 0.3)], "col1 string, col2 string, value double")
    highest, density = relations.correlation_summary(pairs)
    assert rows(highest)["c"].max_abs_correlation == 0.3
    assert density.first().correlation_density == pytest.approx(0.4)


def test_classes(spark):
    df = spark.createDataFrame(
        [("a@b.co", "US", "01/02/2001", "123-45-6789", "10.0.0.1", "deadbeef-01", 12345678)] * 3,
        "contact string, land string, seen string, tax string, machine string, token string, num long",
    )
    got = {c: k for c, (k, _) in semantic.classify(df).items()}
    assert got == {
        "contact": "email", "land": "country_code", "seen": "date_of_birth", "tax": "phone",
        "machine": "ip_address", "token": "identifier", "num": "phone",
    }


def test_class_by_name_breaks_tie(spark):
    df = spark.createDataFrame([("123-45-6789",)] * 3, "ssn string")
    assert semantic.classify(df)["ssn"] == ("ssn", pytest.approx(1.0))


def test_dates_are_classified_by_their_text(spark):
    """2020-01-01 fits three patterns, the first one wins; a time of day fits none."""
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2020-01-01 00:00:00' AS a, DATE'2020-01-01' AS birthday, "
        "TIMESTAMP_NTZ'2020-01-01 01:00:00' AS c"
    )
    got = {c: k for c, (k, _) in semantic.classify(df).items()}
    assert got == {"a": "phone", "birthday": "date_of_birth"}
    text = pd.Series(pd.to_datetime(["2020-01-01"])).astype(str)
    assert list(text) == ["2020-01-01"]


def test_signals_and_rounding(spark):
    df = spark.createDataFrame([(i, i / 3) for i in range(30)], "key long, x double")
    found = profile(df, parts={"numbers", "distinct", "pairs", "rows"})
    signals = {(r.signal, r.subject): r.value for r in risk_signals(found).collect()}
    assert signals["identifier_likelihood", "key"] == 1.0
    assert signals["correlation", "key__x"] == pytest.approx(1.0)
    assert rows(rounded(found.columns, 4))["x"].numeric.mean == 4.8333


def test_profile_delta(spark):
    before = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, gone string")
    after = spark.createDataFrame([(1.0, 1), (None, 2)], "x double, new int")
    parts = {"numbers"}
    got = {
        (r.column, r.metric): (r.before, r.after)
        for r in profile_delta(profile(before, parts=parts).columns, profile(after, parts=parts).columns).collect()
    }
    assert got == {
        ("gone", "presence"): ("present", "dropped"),
        ("new", "presence"): ("absent", "added"),
        ("x", "null_ratio"): ("0.0%", "50.0%"),
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    found = profile(df, parts={"numbers", "labels", "distinct", "rows", "pairs"})
    assert found.dataset.first().row_count == 0
    assert rows(found.columns)["x"].null_ratio == 0.0


def test_saved_profiles_come_back_by_run(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    for run in ("one", "two"):
        save(profile(df, run_id=run, parts={"numbers", "labels"}), str(tmp_path / "kept"))
    back = load_profiles(spark, str(tmp_path / "kept"), "two")
    assert {r.run_id for r in back.columns.collect()} == {"two"}
    assert rows(back.columns)["x"].numeric.mean == 1.5
