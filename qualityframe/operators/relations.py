"""Pairs of numeric columns: Pearson, Spearman, Kendall, and summaries of them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profiling
from ..functions.cells import NUMERIC, as_double, columns_of, dbl
from .scale import HOT_SHARE, local_frame, materialize, one_row, running_total

PAIR_SCHEMA = "col1 string, col2 string, value double"
NOISE = 1e-13


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(sorted(names), 2))


def _frame(spark, rows: list[tuple[str, str, float | None]]) -> DataFrame:
    kept = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    return local_frame(spark, sorted(kept), PAIR_SCHEMA)


def _co_moments(df: DataFrame, names: list[str], middle: dict[str, float | None] | None = None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over rows where both columns are present.

    One scan for any number of columns: each task folds its Arrow batches into
    matrix products of the shifted values and their presence masks, and emits one
    row per pair. Values are shifted by a middle value of the column: it lies within
    one deviation of the mean, so sums keep their digits, and it is itself a value,
    so a constant column gives exact zeros. `middle` saves the scan that finds it.
    """
    middle = middle or one_row(df, {c: f"percentile_approx({dbl(c)}, 0.5D, 100)" for c in names})
    shift = np.array([middle[c] if middle[c] is not None else 0.0 for c in names])
    width = len(names)
    upper = np.triu_indices(width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((width, width))
        s, q, xy = np.zeros_like(n), np.zeros_like(n), np.zeros_like(n)
        for batch in batches:
            x = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            )
            here = ~np.isnan(x)
            x = np.where(here, x - shift, 0.0)
            m = here.astype(float)
            n += m.T @ m
            s += x.T @ m  # s[i, j]: sum of i over rows where j is present
            q += (x * x).T @ m
            xy += x.T @ x
        i, j = upper
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            + [pa.array(v) for v in (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], xy[i, j])],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    numbers = df.selectExpr(*[f"{dbl(c)} AS c{k}" for k, c in enumerate(names)])
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    return (
        numbers.mapInArrow(fold, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
        .groupBy("i", "j")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def pearson(
    df: DataFrame, names: list[str] | None = None, middle: dict[str, float | None] | None = None
) -> DataFrame:
    """(col1, col2, value) for col1 <= col2, pairwise complete; undefined cells dropped.

    One scan whatever the number of pairs, where built-in `corr` aggregates would
    need a scan per batch of pairs (and raise on a constant column in ANSI mode).
    """
    names = sorted(names or columns_of(df, NUMERIC))
    listed = F.array(*[F.lit(c) for c in names])

    def spread_of(square: str, plain: str):
        v = F.col(square) - F.col(plain) ** 2 / F.col("n")
        return F.when(v > F.col(square) * NOISE, v)

    vx, vy = spread_of("sxx", "sx"), spread_of("syy", "sy")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return (
        _co_moments(df, names, middle)
        .where(F.col("n") > 1)
        .select(
            F.get(listed, F.col("i")).alias("col1"),
            F.get(listed, F.col("j")).alias("col2"),
            F.when(F.col("i") == F.col("j"), vx / vx)
            .otherwise(cov / F.sqrt(vx * vy))
            .alias("value"),
        )
        .where(F.col("value").isNotNull())
    )


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct value pairs with their count; repeated rows collapse before the shuffle."""
    return (
        df.select(as_double(a).alias("a"), as_double(b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _attach(rows: DataFrame, pairs: DataFrame, side: str, total: int, distinct: int) -> DataFrame:
    """Add the mean rank of `side`, centred at 0.

    Values holding over a thousandth of the rows (at most a thousand values) are
    looked up by broadcast. The others meet their rank in a shuffled join; rows
    already answered go there under a hash of the pair, so no task gets them all.
    """
    counts = pairs.groupBy(side).agg(F.sum("n").alias("w"))
    ranks = running_total(counts, side, "w", at_most=distinct).select(
        F.col(side).alias("key"),
        "w",
        (F.col("before") + (F.col("w") - F.lit(float(total))) / 2).alias("r"),
    )
    edge = total / HOT_SHARE
    hot = ranks.where(F.col("w") > edge).select(F.col("key").alias("hot"), F.col("r").alias("hot_r"))
    cold = ranks.where(F.col("w") <= edge).select("key", F.col("r").alias("cold_r"))
    looked = rows.join(F.broadcast(hot), F.col(side) == F.col("hot"), "left").withColumn(
        "meet",
        F.when(F.col("hot_r").isNull(), F.col(side)).otherwise(
            F.xxhash64("a", "b").cast("double")
        ),
    )
    return (
        looked.join(cold, F.col("meet") == F.col("key"), "left")
        .withColumn(f"r{side}", F.coalesce("hot_r", "cold_r"))
        .drop("hot", "hot_r", "meet", "key", "cold_r")
    )


def spearman(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pearson of mean ranks; ranks are taken over the rows complete in the pair."""
    names = sorted(names or columns_of(df, NUMERIC))
    rows: list[tuple] = []
    for a, b in _pairs(names):
        pairs = materialize(_pair_counts(df, a, b))
        total, distinct = pairs.agg(F.sum("n"), F.count(F.lit(1))).first()
        if not total or total < 2:
            continue
        ranked = pairs
        for side in "ab":
            ranked = _attach(ranked, pairs, side, total, distinct)
        w = F.col("n").cast("double")
        # centred ranks have mean zero, so plain sums of products are enough
        got = ranked.agg(
            F.sum(w * F.col("ra") * F.col("rb")).alias("xy"),
            F.sum(w * F.col("ra") * F.col("ra")).alias("xx"),
            F.sum(w * F.col("rb") * F.col("rb")).alias("yy"),
        ).first()
        if got.xx and got.yy:
            rows.append((a, b, got.xy / math.sqrt(got.xx * got.yy)))
    return _frame(df.sparkSession, rows + _self_pairs(df, names))


def _self_pairs(df: DataFrame, names: list[str]) -> list[tuple]:
    """The diagonal: 1 for every column that varies."""
    ends = one_row(
        df,
        {f"{c}\0{k}": f"{f}({dbl(c)})" for c in names for k, f in (("lo", "min"), ("hi", "max"))},
    )
    return [(c, c, 1.0) for c in names if ends[f"{c}\0lo"] != ends[f"{c}\0hi"]]


def _concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of sign(dx) * sign(dy), weighted; n log n by merging halves."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order].astype(float)
    _, ranks = np.unique(y, return_inverse=True)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    total = 0.0
    step = 1
    # at each level, blocks of `step` x-groups meet their right neighbour block
    while step < len(starts):
        block = group // step
        pair, right = block // 2, block % 2 == 1
        by = np.lexsort((ranks, pair))
        p, r, k, ww = pair[by], right[by], ranks[by], w[by]
        left_w = np.where(r, 0.0, ww)
        cum = np.cumsum(left_w)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        sizes = np.diff(np.r_[first, len(p)])
        base = np.repeat(cum[first] - left_w[first], sizes)
        whole = np.repeat(cum[np.r_[first[1:] - 1, len(p) - 1]], sizes)
        tie = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (k[1:] != k[:-1])])
        tie_sizes = np.diff(np.r_[tie, len(p)])
        below = np.repeat(cum[tie] - left_w[tie], tie_sizes) - base
        up_to = np.repeat(cum[np.r_[tie[1:] - 1, len(p) - 1]], tie_sizes)
        total += float(np.sum(np.where(r, ww * (below - (whole - up_to)), 0.0)))
        step *= 2
    return total


def _edges(counts: DataFrame, key: str, buckets: int) -> list[float]:
    """Cut points of about equal weight; a value heavier than a bucket gets its own."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(
        F.percentile_approx(key, probs, 20 * buckets).alias("c")
    ).first()["c"]
    out = set(cuts)
    out.update(math.nextafter(c, math.inf) for c in cuts if cuts.count(c) > 1)
    return sorted(out)


def kendall(
    df: DataFrame,
    names: list[str] | None = None,
    rows_per_strip: int = 500_000,
    max_buckets: int = 2048,
) -> DataFrame:
    """Tau-b without visiting pairs of rows, on all rows.

    Both columns are cut into ordered buckets. Pairs in different buckets of both
    columns are settled by the grid of bucket counts (at most `max_buckets`^2
    numbers); pairs sharing a bucket are counted inside that strip by merging, one
    task per strip. A single very frequent value is a strip of its own and ties
    with itself, so it needs no work.
    """
    names = sorted(names or columns_of(df, NUMERIC))
    rows: list[tuple] = []
    for a, b in _pairs(names):
        rows.append((a, b, _tau_b(df, a, b, rows_per_strip, max_buckets)))
    return _frame(df.sparkSession, rows + _self_pairs(df, names))


def _tau_b(df: DataFrame, a: str, b: str, rows_per_strip: int, max_buckets: int) -> float | None:
    pairs = materialize(_pair_counts(df, a, b))
    total, distinct = pairs.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total or total < 2:
        return None
    both = total * (total - 1) / 2

    def tied(side: str) -> float:
        w = F.col("w").cast("double")
        return (
            pairs.groupBy(side).agg(F.sum("n").alias("w")).agg(F.sum(w * (w - 1) / 2)).first()[0]
        )

    free = (both - tied("a")) * (both - tied("b"))
    if free <= 0:
        return None
    buckets = min(max(math.ceil(distinct / rows_per_strip), 1), max_buckets)
    cuts = {s: _edges(pairs, s, buckets) for s in "ab"}
    if not cuts["a"] and not cuts["b"]:  # small enough for one strip

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(
                {"s": [_concordance(*(pdf[c].to_numpy() for c in ("a", "b", "n")))]}
            )

        one = pairs.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(whole, "s double").first()
        return one.s / math.sqrt(free)
    placed = pairs
    for s in "ab":
        splits = [-math.inf, *cuts[s], math.inf]
        placed = Bucketizer(splits=splits, inputCol=s, outputCol=f"d{s}").transform(placed)
        placed = placed.withColumn(f"b{s}", F.col(f"d{s}").cast("int")).drop(f"d{s}")
    cells = placed.groupBy("ba", "bb").agg(F.sum("n").alias("n")).toArrow()  # the grid
    grid = np.zeros((len(cuts["a"]) + 1, len(cuts["b"]) + 1))
    grid[cells["ba"].to_numpy(), cells["bb"].to_numpy()] = cells["n"].to_numpy()
    before = np.zeros_like(grid)
    before[1:] = np.cumsum(grid, axis=0)[:-1]
    left = np.zeros_like(grid)
    left[:, 1:] = np.cumsum(before, axis=1)[:, :-1]
    right = before.sum(axis=1, keepdims=True) - left - before
    score = float(np.sum(grid * (left - right)))

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        by_a = pdf["side"].iat[0] == "a"
        x, y, w = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy()
        got = _concordance(x, y, w)
        if by_a:  # pairs inside one cell belong to both strips: take them out once
            for _, cell in pdf.groupby("other"):
                if len(cell) > 1:
                    got -= _concordance(
                        cell["a"].to_numpy(), cell["b"].to_numpy(), cell["n"].to_numpy()
                    )
        return pd.DataFrame({"s": [got]})

    strips = []
    for s, other in (("a", "bb"), ("b", "ba")):
        lone = (
            placed.groupBy(f"b{s}")
            .agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
            .where(F.col("lo") < F.col("hi"))
            .select(f"b{s}")
        )
        strips.append(
            placed.join(F.broadcast(lone), f"b{s}").select(  # at most max_buckets rows
                F.lit(s).alias("side"), F.col(f"b{s}").alias("strip"), F.col(other).alias("other"),
                "a", "b", "n",
            )
        )
    inside = (
        strips[0].unionByName(strips[1]).groupBy("side", "strip").applyInPandas(strip, "s double")
    )
    # a strip with one value of its own column was left out: all its pairs are ties
    score += inside.agg(F.sum("s")).first()[0] or 0.0
    return score / math.sqrt(free)


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlations(
    df: DataFrame,
    names: list[str] | None = None,
    method: str = "pearson",
    cfg: Profiling = Profiling(),
    middle: dict[str, float | None] | None = None,
) -> DataFrame | None:
    """Upper triangle with diagonal; None below the minimum number of columns."""
    names = sorted(names or columns_of(df, NUMERIC))
    if len(names) < cfg.min_numeric_cols_for_correlation:
        return None
    return pearson(df, names, middle) if method == "pearson" else METHODS[method](df, names)


def correlation_summary(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Highest absolute correlation per column, and the mean over all pairs."""
    off = pairs.where(F.col("col1") != F.col("col2")).withColumn("size", F.abs("value"))
    highest = (
        off.select(F.explode(F.array("col1", "col2")).alias("column"), "size")
        .groupBy("column")
        .agg(F.max("size").alias("max_abs_correlation"))
    )
    density = off.agg(F.coalesce(F.avg("size"), F.lit(0.0)).alias("correlation_density"))
    return highest, density
