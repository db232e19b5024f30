import datetime as dt
import random

import pytest

from qualityframe.config import Profiling
from qualityframe.plans import incremental
from qualityframe.plans.profile import PARTS, profile, rounded

KIND = (
    "id long, price decimal(9,2), ratio double, label string, prose string, day date, at timestamp, "
    "flag boolean, nothing double, nested array<int>"
)


def batch(spark, start, rows):
    rng = random.Random(start)
    out = []
    for i in range(start, start + rows):
        out.append(
            (
                i % 90, None if i % 11 == 0 else f"{rng.randint(-500, 9999) / 100:.2f}",
                float("nan") if i % 13 == 0 else rng.gauss(5, 2), rng.choice(["a", "b", None, "c" * 70]),
                f"text {rng.random()} é " * rng.randint(1, 60), dt.date(2020, 1, 1) + dt.timedelta(days=i),
                dt.datetime(2021, 1, 1, 0, 0, 0, i), i % 3 == 0, None, [i % 4],
            )
        )
    df = spark.createDataFrame(out, KIND.replace("decimal(9,2)", "string"))
    return df.withColumn("price", df.price.cast("decimal(9,2)"))


def tables(p):
    return [[str(r) for r in rounded(t, 8).orderBy(*t.columns[:3]).collect()] for t in (p.columns, p.dataset)]


def whole(spark, folder):
    return profile(spark.read.parquet(folder), parts=PARTS - {"anomalies", "pairs", "classes"})


def test_growing_table_equals_a_fresh_profile(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "states")
    with_sums = []
    for start, rows in ((0, 300), (300, 40), (0, 300)):  # the third batch repeats the first
        batch(spark, start, rows).repartition(2).write.mode("append").parquet(folder)
        assert incremental.update(spark, folder, store) == 2
        assert incremental.update(spark, folder, store) == 0
        ours = incremental.stored_profile(spark, folder, store)
        assert tables(ours) == tables(whole(spark, folder))
        with_sums.append(ours.dataset.first().duplicate_row_ratio)
    assert with_sums[0] == 0 and with_sums[2] > 0.4


def test_no_scan_of_known_files_and_vanished_ones_are_ignored(spark, tmp_path):
    folder, store = tmp_path / "data", str(tmp_path / "states")
    for start in (0, 100, 200):
        batch(spark, start, 100).coalesce(1).write.parquet(str(folder / f"batch={start}"))
    incremental.update(spark, str(folder), store)
    gone = next((folder / "batch=100").glob("*.parquet"))
    gone.unlink()
    assert incremental.update(spark, str(folder), store) == 0
    ours = incremental.stored_profile(spark, str(folder), store)
    assert tables(ours) == tables(whole(spark, str(folder)))
    assert ours.dataset.first().row_count == 200
    # other thresholds need no new scan: the states hold what was counted, not verdicts
    kept = next((folder / "batch=200").glob("*.parquet"))
    data = kept.read_bytes()
    kept.write_bytes(b"not parquet")
    kept.write_bytes(data)
    assert incremental.update(spark, str(folder), store) == 1  # rewritten: read again


def test_empty_files_and_missing_states(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "states")
    batch(spark, 0, 10).limit(0).write.parquet(folder)
    with pytest.raises(ValueError):
        incremental.stored_profile(spark, folder, store)
    incremental.update(spark, folder, store)
    ours = incremental.stored_profile(spark, folder, store, Profiling())
    assert {r.row_count for r in ours.columns.collect()} == {0}


def test_states_written_twice_count_once_without_grouping(spark, tmp_path, monkeypatch):
    folder, store = str(tmp_path / "data"), str(tmp_path / "states")
    batch(spark, 0, 60).repartition(2).write.parquet(folder)
    read = incremental._read
    with monkeypatch.context() as m:
        m.setattr(incremental, "_read", lambda s, path: None if path.endswith(("known", "done")) else read(s, path))
        assert [incremental.update(spark, folder, store) for _ in range(2)] == [2, 2]  # neither sees the other
    assert tables(incremental.stored_profile(spark, folder, store)) == tables(whole(spark, folder))
    seen = []
    kept = incremental._kept
    monkeypatch.setattr(incremental, "_kept", lambda *a: seen.append(kept(*a)) or seen[-1])
    incremental.stored_profile(spark, folder, store)
    assert len(seen) == 3
    for rows in seen:  # no row of a state is sorted, grouped or moved before the states are merged
        above = rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
        assert "Join LeftSemi" in above and "Aggregate" not in above.split("Join LeftSemi")[0]
