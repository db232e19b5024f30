import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from qualityframe.config import Profiling
from qualityframe.operators import categories, numeric, passes, scale, semantic, structure, text, times
from qualityframe.plans.profile import PARTS, profile, rounded


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        rows.append(
            (
                i,
                1e9 + rng.gauss(0, 1) if i > 1500 else -5.0,
                None if i % 7 == 0 else rng.choice([0.0, 1.5, rng.random() * 100]),
                None,
                rng.choice(["red", "green", None, "blue" if i % 900 else "rare"]),
                f"line {rng.random()} of some text, number {i}!" * (1 + i % 3),
                f"user{i}@mail.example.org",
                dt.date(2020, 1, 1) + dt.timedelta(days=i % 400),
                dt.datetime(2021, 5, 1, 12, 0, 0, i % 2 * 250000) + dt.timedelta(seconds=i),
                i % 3 == 0,
            )
        )
    kind = (
        "id long, far double, part double, nothing double, colour string, prose string, email string, "
        "day date, at timestamp, flag boolean"
    )
    return spark.createDataFrame(rows, kind).repartition(5)


def test_first_look_equals_the_single_operators(mixed):
    seen = passes.first_look(mixed, set(PARTS))
    base = structure.base_stats(mixed, ["id", "far", "part", "nothing"])
    for c, s in base.items():
        assert {k: seen[c][k] for k in s} == pytest.approx(s)
    nulls = {r.column: r.null_count for r in structure.null_ratio(mixed).collect()}
    assert {c: s["nulls"] for c, s in seen.items()} == nulls
    assert semantic.decided(mixed.columns, passes.class_shares(seen)) == semantic.classify(mixed)
    for df in (mixed, mixed.unionAll(mixed.where("id % 3 = 0")), mixed.limit(0)):
        look = structure.row_look(df).first()
        mark = structure.fingerprint_of(df.schema, look.row_count, look.row_xor, look.row_sum)
        assert mark == structure.fingerprint(df).first().fingerprint
        assert look.duplicate_row_ratio == structure.duplicate_rows(df).first().duplicate_row_ratio
    ends = {r.column: tuple(r)[1:] for r in times.datetime_stats(mixed, ["day", "at"]).collect()}
    assert passes.date_stats(mixed, seen, ["day", "at"]) == ends
    prose = {r.column: pytest.approx(tuple(r)[1:]) for r in text.text_stats(mixed, ["colour", "prose"]).collect()}
    assert "digits" not in seen["colour"]  # looked like a label, so it is read again
    assert passes.prose_stats(mixed, seen, ["colour", "prose"]) == prose


def test_pilot_far_from_the_mean_is_measured_again(mixed):
    seen = passes.first_look(mixed, {"numbers"})
    exact = numeric.numeric_stats(mixed, ["far"])["far"]
    far = mixed.select("far").where("far > 0")
    shifted = passes.first_look(far, {"numbers"})
    shifted["far"] |= {f"p{k}": float(sum((r.far + 5.0) ** k for r in far.collect())) for k in (1, 2, 3, 4)}
    sums = passes.power_sums(far, shifted, ["far"])["far"]
    assert abs(sums[0] / shifted["far"]["n"]) < 1e-3
    ours = numeric.assembled(["far"], seen, passes.power_sums(mixed, seen, ["far"]), {("far", p): 0.0 for p in numeric.QUARTILES})
    for k in ("mean", "std", "skewness", "kurtosis"):
        assert ours["far"][k] == pytest.approx(exact[k], rel=1e-9)


def test_value_look_equals_the_single_operators(mixed):
    names = structure.countable(mixed)
    total = mixed.where("colour IS NOT NULL").count()
    seen = passes.first_look(mixed, {"numbers"})
    spans = {c: numeric.quartile_spans(seen[c]["sketch"]) for c in ("id", "far", "part")}
    stats, inside = passes.value_look(mixed, names, {"colour": total}, spans)
    exact = {r.column: r.distinct_count for r in structure.distinct_counts(mixed, names).collect()}
    assert {c: s["distinct_count"] for c, s in stats.items()} == exact
    label = categories.categorical_summary(categories.value_counts(mixed, ["colour"])).first()
    assert (stats["colour"]["top"].value, stats["colour"]["rare_count"]) == (label.mode, label.rare_count)
    want = numeric.quantiles(mixed, {c: list(numeric.QUARTILES) for c in spans})
    for (c, p), value in want.items():
        counts = sorted(inside[c], key=lambda r: (r[0], r[1] or 0.0))
        assert numeric.pick(counts, seen[c]["n"], p) == value


def test_chunks_of_columns_change_nothing(mixed, monkeypatch):
    def taken():
        p = profile(mixed, parts=PARTS - {"anomalies"})
        tables = (p.columns.orderBy("column"), p.dataset, p.models.orderBy("target"))
        return [[str(r) for r in rounded(t, 8).collect()] for t in tables]

    whole = taken()
    for name, size in (("AGGREGATES_AT_ONCE", 5), ("SKETCHES_AT_ONCE", 1), ("CELLS_AT_ONCE", 2)):
        monkeypatch.setattr(passes, name, size)
    assert taken() == whole


def test_forty_columns_are_read_at_most_six_times(spark, tmp_path, monkeypatch):
    """Cells read from the file, over the cells it holds; nothing is cached."""
    monkeypatch.setattr(scale, "SPREAD_BYTES", 0)
    numbers = [(F.rand(i) * 1000).alias(f"n{i:02}") for i in range(20)]
    texts = [F.concat(F.lit(f"v{i} "), (F.rand(50 + i) * 10 ** (i % 4 + 1)).cast("int")).alias(f"t{i:02}") for i in range(20)]
    path = str(tmp_path / "wide")
    spark.range(3000).select(*numbers, *texts).coalesce(1).write.parquet(path)
    monkeypatch.setattr(scale, "JOBS_AT_ONCE", 1)
    settings = {"spark.sql.maxMetadataStringLength": "100000", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        store = spark._jsparkSession.sharedState().statusStore()
        done = store.executionsCount()
        profile(spark.read.parquet(path), Profiling(), parts=PARTS - {"anomalies"})
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        plans = store.executionsList(done, store.executionsCount() - done)
        texts = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
        lines = [x for t in texts if "Limit" not in t for x in t.splitlines()]  # the pilot reads few rows
    finally:
        for name in settings:
            spark.conf.unset(name)
    scans = [x.removeprefix("ReadSchema: struct<").rstrip(">") for x in lines if x.startswith("ReadSchema: struct<")]
    read = sum(len(x.split(",")) for x in scans if x)
    assert 3 * 40 < read <= 6 * 40


def test_sketches_read_values_computed_before_them(spark):
    df = spark.createDataFrame([(float(i), f"t{i % 7}") for i in range(100)], "x double, t string")
    wanted = {"n": ("xxhash64(t)", passes.sketch_distinct), "q": ("x * 2", lambda x: f"max({x})")}
    found = passes.scans(df, (wanted, 2), ({"rows": "count(1)"}, 5))
    assert found == {"n": 7, "q": 198.0, "rows": 100}
