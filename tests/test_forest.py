import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from qualityframe.operators import forest


def planted(spark, n=1500):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"key": range(n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    frame.loc[:4, ["x", "y"]] = 50.0
    return spark.createDataFrame(frame)


def test_planted_outliers_rank_on_top(spark):
    scored = forest.score_rows(planted(spark), ["x", "y"], ["key"])
    top = [r.key for r in scored.orderBy(F.desc("anomaly_score")).limit(5).collect()]
    assert sorted(top) == [0, 1, 2, 3, 4]
    assert scored.where("key < 5 and is_anomaly").count() == 5


def test_scores_do_not_depend_on_partitions(spark):
    df = planted(spark, 600)
    one = {r.key: r.anomaly_score for r in forest.score_rows(df.repartition(2), ["x", "y"], ["key"]).collect()}
    two = {r.key: r.anomaly_score for r in forest.score_rows(df.repartition(7), ["x", "y"], ["key"]).collect()}
    assert one == two


def test_scores_without_a_key_do_not_depend_on_partitions_or_size_switch(spark, monkeypatch):
    """Also with many copies of a row, and with the table dealt out or left as it is."""
    from qualityframe.config import Profiling
    from qualityframe.operators import scale

    cfg = Profiling(anomaly_tree_rows=32)
    rows = planted(spark, 900).unionByName(planted(spark, 40).withColumn("x", F.lit(1.5)).withColumn("y", F.lit(0.5)))
    many = rows.unionByName(rows.where("x = 1.5"))
    found, shares = [], []
    for parts, small in ((2, 64 << 20), (7, 64 << 20), (3, 0)):
        monkeypatch.setattr(scale, "SPREAD_BYTES", small)
        scored = forest.score_rows(many.repartition(parts), ["x", "y"], trees=10, cfg=cfg)
        found.append(sorted((r.x, r.y, r.anomaly_score) for r in scored.collect()))
        shares.append(forest.anomaly_columns(many.repartition(parts), ["x", "y"], cfg=cfg))
    assert found[0] == found[1] == found[2]
    assert shares[0] == shares[1] == shares[2]


def test_copies_are_drawn_in_proportion(spark):
    rows = spark.createDataFrame([(1.0,)] * 4000 + [(float(k),) for k in range(2, 4002)], "x double")
    drawn = forest._drawn(rows, F.lit(forest.HASH_SPAN // 10), 42).collect()
    assert sum(r.x == 1.0 for r in drawn) in (400, 399)
    assert 320 < sum(r.x != 1.0 for r in drawn) < 480
    assert len({r.h for r in drawn}) == len(drawn)


def test_keyless_draw_groups_few_rows(spark, monkeypatch):
    """A pool of 100 from 60,000 rows: a third are one content, a third each occur 20 times."""
    monkeypatch.setattr(forest, "OFTEN", 50)
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0.5)
        .when(F.col("id") % 3 == 1, (F.col("id") / 3).cast("int") % 1000 + 10)
        .otherwise(F.col("id") + 10_000)
        .cast("double")
        .alias("x")
    )
    cut = F.lit(int(forest.HASH_SPAN * 100 / 60_000))
    drawn = []
    for parts in (3, 11):
        rows = df.repartition(parts)
        some, kept = forest._few_contents(rows, F.lit(0), [60_000], 100, 42)
        assert 0 < kept[0] < 0.06
        # contents that reach the shuffle, once a task that holds them
        sent = some.groupBy(F.spark_partition_id(), "x").count().count()
        assert sent < 10 * 100 + parts * 2 * forest.OFTEN
        pool = forest._pool(rows, F.lit(0), [60_000], cut, 100, 42).collect()
        drawn.append(sorted((r.x, r.h) for r in pool))
    assert drawn[0] == drawn[1]
    often = sum(x == 0.5 for x, _ in drawn[0])
    assert often in (33, 34) and 70 < len(drawn[0]) < 140


def test_many_draws_are_unbiased(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 500).otherwise(F.col("id")).cast("double").alias("x"))
    cut = F.lit(int(forest.HASH_SPAN * 200 / 20_000))
    copied, every = 0, 0
    for seed in range(6):
        pool = forest._pool(df, F.lit(0), [20_000], cut, 200, seed).collect()
        copied += sum(r.x < 500 for r in pool)
        every += len(pool)
    assert 1000 < every < 1400 and 0.42 < copied / every < 0.58


def test_hand_computed_tree():
    """One split at 2.0: the value alone ends after one step, the three others after
    one step and the mean depth of three."""
    tree = {
        "feature": [0, -1, -1], "cut": [2.0, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1],
        "length": [0.0, 1 + forest.mean_depth(3), 1.0],
    }
    row = type("Row", (), tree)
    scores = forest.Forest([row, row], 4).score(np.array([[1.0], [2.0], [9.0]]))
    c3, c4 = 2 * (np.log(2) + 0.5772156649015329) - 4 / 3, 2 * (np.log(3) + 0.5772156649015329) - 6 / 4
    assert np.allclose(scores, [2 ** (-(1 + c3) / c4), 2 ** (-(1 + c3) / c4), 2 ** (-1 / c4)])


def test_rows_with_missing_features_are_not_flagged(spark):
    df = planted(spark).withColumn("x", F.when(F.col("key") == 0, None).otherwise(F.col("x")))
    row = forest.score_rows(df, ["x", "y"], ["key"]).where("key = 0").first()
    assert row.anomaly_score is None and row.is_anomaly is False


def test_too_few_rows(spark):
    assert forest.score_rows(planted(spark).limit(19), ["x", "y"], ["key"]) is None
    assert forest.anomaly_columns(planted(spark).limit(19), ["x"], ["key"]) == {}


def test_column_forest_equals_direct_scores(spark):
    x = np.sort(np.random.default_rng(2).exponential(size=256)).tolist()
    trees = [forest._grow_sorted(x, np.random.default_rng(i), 8) for i in range(30)]
    cuts, scores = forest._steps(trees, 256)
    for v in (x[0], x[100], x[255], 99.0):
        paths = [lengths[int(np.searchsorted(c, v, side="left"))] for c, lengths in trees]
        want = 2 ** (-np.mean(paths) / forest.mean_depth(256))
        assert abs(scores[np.searchsorted(cuts, v, side="left")] - want) < 1e-12
    assert scores[-1] > scores[len(scores) // 4]


def test_contamination_sets_the_share(spark):
    from qualityframe.config import Profiling

    cfg = Profiling(anomaly_contamination=0.05)
    found = forest.anomaly_rows(planted(spark), ["x", "y"], ["key"], cfg).first()
    assert 0.03 < found.anomaly_ratio < 0.07
