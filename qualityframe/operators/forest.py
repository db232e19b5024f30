"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

As published, a tree grows from a small sub-sample (`anomaly_tree_rows`), whatever the
size of the table; every row is scored. A hash of the caller's key, or of the content and
the number of a copy, picks a bounded pool; each tree takes its sample from the pool and
is grown on an executor. The draw, and so every score, is the same for any partitioning.
The finished trees (a few thousand numbers) ship with an Arrow function that scores every
row in place.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Profiling
from ..functions.cells import NUMERIC, as_double, col, columns_of, dbl, q
from .scale import dealt, local_frame, materialize, one_row, spread

TABLE_TREES = 100
HASH_SPAN = 1 << 30
SPARE = 8  # contents kept per row of the pool, before they are counted
OFTEN = 10_000  # a content with over one in so many rows is counted in any case
TRACKED = 1 << 17  # items of the sketch; it misses none above 3.5 / TRACKED of the rows

TREE_SCHEMA = (
    "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, "
    "length array<double>"
)


def mean_depth(n: int) -> float:
    """c(n): average path length of an unsuccessful search in a binary tree of n."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, height: int) -> tuple[list, ...]:
    feature, cut, left, right, length = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        here = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = here
        for table, empty in ((feature, -1), (cut, 0.0), (left, -1), (right, -1)):
            table.append(empty)
        length.append(depth + mean_depth(len(rows)))
        if depth >= height or len(rows) <= 1:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        f = int(usable[int(rng.random() * len(usable))])
        at = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] <= at
        if goes_left.all():  # the draw hit the top value
            at = float(low[f])
            goes_left = x[rows, f] <= at
        feature[here], cut[here] = f, at
        todo.append((rows[~goes_left], depth + 1, here, True))
        todo.append((rows[goes_left], depth + 1, here, False))
    return feature, cut, left, right, length


def _grow_sorted(x: list[float], rng: np.random.Generator, height: int) -> tuple[list, list]:
    """A one-feature tree on sorted values: its cuts and leaf path lengths, left to right."""
    cuts, lengths = [], []
    draws = iter(rng.random(4 * len(x) + 4).tolist())

    def split(first: int, last: int, depth: int) -> None:
        low, high = x[first], x[last - 1]
        if depth >= height or last - first <= 1 or low == high:
            lengths.append(depth + mean_depth(last - first))
            return
        at = low + (high - low) * next(draws)
        middle = bisect_right(x, at, first, last)
        if middle == last:  # the draw hit the top value
            at = low
            middle = bisect_right(x, at, first, last)
        split(first, middle, depth + 1)
        cuts.append(at)
        split(middle, last, depth + 1)

    split(0, len(x), 0)
    return cuts, lengths


def _hash(key: list[Column], *salt: int) -> Column:
    """A hash in [0, HASH_SPAN) of the row key."""
    return F.pmod(F.xxhash64(*[F.lit(s) for s in salt], *key), F.lit(HASH_SPAN))


def _trees(pool: DataFrame, width: int, trees: int, seed: int, tree_rows: int) -> list:
    """Grow `trees` trees from pool rows (h, x), each on its own small sample."""
    size = pool.count()
    psi = min(tree_rows, size)
    share = min(4.0 * psi / max(size, 1), 1.0)
    cut = int(share * HASH_SPAN)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = pool.select(
        "h",
        "x",
        F.explode(
            F.filter(numbers, lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "h"), F.lit(HASH_SPAN)) < cut)
        ).alias("tree"),
    )
    height = max(math.ceil(math.log2(max(psi, 2))), 1)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        order = pd.util.hash_array(pdf["h"].to_numpy() + np.int64(tree) * 1_000_003)
        rows = pdf.assign(o=order, x=pdf["x"].map(tuple)).sort_values(["o", "h", "x"]).head(psi)
        x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, width)
        f, c, lt, rt, ln = _grow(x, np.random.default_rng([seed, tree]), height)
        return pd.DataFrame(
            {"tree": [tree], "feature": [f], "cut": [c], "left": [lt], "right": [rt], "length": [ln]}
        )

    return drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()


class Forest:
    """Grown trees as flat arrays, small enough to ship with a task."""

    def __init__(self, rows: list, psi: int) -> None:
        self.trees = [
            (
                np.array(r.feature, dtype=np.int32),
                np.array(r.cut),
                np.array(r.left, dtype=np.int32),
                np.array(r.right, dtype=np.int32),
                np.array(r.length),
            )
            for r in rows
        ]
        self.scale = mean_depth(psi) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-E[path] / c(psi)) per row, in (0, 1); near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int32)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += length[at]
        return np.exp2(-total / (len(self.trees) * self.scale))


def _drawn(rows: DataFrame, cut: Column, seed: int) -> DataFrame:
    """(h, *columns): rows without a key, a share cut / HASH_SPAN of them.

    Equal rows are counted first, so a frequent one costs one row per task. Of n copies
    the share of n is drawn, rounded up or down by the content's hash; the copies drawn
    get hashes of their own.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    exact = F.col("__n") * (cut / HASH_SPAN) - _hash([F.col(c) for c in names], seed) / HASH_SPAN
    return _numbered(counted.withColumn("__exact", exact), names, seed)


def _numbered(counted: DataFrame, names: list[str], seed: int) -> DataFrame:
    """(h, *names): each row as often as __exact, rounded up, says."""
    content = [F.col(c) for c in names]
    copies = counted.withColumn("__draws", F.ceil("__exact").cast("int")).where("__draws >= 1")
    numbered = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__draws"))))
    return numbered.select(_hash([*content, F.col("__copy")], seed).alias("h"), *content)


def _few_contents(rows: DataFrame, slot: Column, totals: list[int], pool_rows: int, seed: int) -> tuple[DataFrame, list[float]]:
    """(rows with __often and __slot, share of contents kept per slot).

    A hash of the content keeps about `SPARE` times the pool, and every content that may
    hold more than one in `OFTEN` rows stays (a sketch lists them all, and more), so that
    few rows are grouped. Both depend on contents and totals only.
    """
    content = [F.col(c) for c in rows.columns]
    marked = rows.withColumns({"__slot": slot, "__g": F.xxhash64(F.lit(seed + 1), *content)})
    top = F.expr(f"approx_top_k(__g, {2 * OFTEN}, {TRACKED})").alias("top")
    looks = materialize(marked.groupBy("__slot").agg(F.approx_count_distinct("__g", 0.03).alias("d"), top))
    distinct = {r["__slot"]: r.d for r in looks.select("__slot", "d").collect()}
    kept = [
        min(1.0, SPARE * pool_rows / max(distinct.get(i, 0), 1)) if n > SPARE * pool_rows else 1.0
        for i, n in enumerate(totals)
    ]
    total = F.get(F.array(*[F.lit(n) for n in totals]), F.col("__slot"))
    listed = looks.select("__slot", F.inline("top")).where(F.col("count") * (2 * OFTEN) >= total)
    listed = listed.select("__slot", F.col("item").alias("__g"), F.lit(True).alias("__often"))
    cut = F.get(F.array(*[F.lit(int(k * HASH_SPAN)) for k in kept]), F.col("__slot"))
    # at most 2 * OFTEN hashes per slot
    joined = marked.join(F.broadcast(listed), ["__slot", "__g"], "left")
    low = F.pmod(F.col("__g"), F.lit(HASH_SPAN)) < cut
    return joined.withColumn("__low", low).where("__low OR __often").drop("__g", "__often"), kept


def _pool(
    rows: DataFrame, slot: Column, totals: list[int], cut: Column, pool_rows: int, seed: int
) -> DataFrame:
    """`_drawn` without a shuffle of the table: of a content kept with chance p, n copies
    give n / p times the share; one that holds over one in `OFTEN` rows is always kept."""
    if all(n <= SPARE * pool_rows for n in totals):
        return _drawn(rows, cut, seed)
    names = rows.columns
    some, kept = _few_contents(rows, slot, totals, pool_rows, seed)
    counted = some.groupBy(*names, "__slot", "__low").agg(F.count(F.lit(1)).alias("__n"))
    total = F.get(F.array(*[F.lit(n) for n in totals]), F.col("__slot"))
    often = F.col("__n") * OFTEN > total
    chance = F.when(often, F.lit(1.0)).otherwise(F.get(F.array(*[F.lit(k) for k in kept]), F.col("__slot")))
    share = F.col("__n") * (cut / HASH_SPAN) / chance
    exact = F.when(often | F.col("__low"), share - _hash([F.col(c) for c in names], seed) / HASH_SPAN)
    return _numbered(counted.withColumn("__exact", exact), names, seed)


def fit(
    df: DataFrame,
    names: list[str],
    key: list[str] | None,
    seed: int,
    rows: int,
    trees: int,
    tree_rows: int = Profiling.anomaly_tree_rows,
) -> Forest:
    """A forest over complete rows. The pool holds about 2 * tree_rows * trees rows."""
    pool_rows = 2 * tree_rows * trees
    cut = HASH_SPAN if rows <= pool_rows else int(HASH_SPAN * pool_rows / rows)
    complete = df.where(F.greatest(*[col(c).isNull().cast("int") for c in names], F.lit(0)) == 0)
    x = F.array(*[as_double(c) for c in names]).alias("x")
    if key:
        pool = complete.select(_hash([col(k) for k in key], seed).alias("h"), x).where(F.col("h") < cut)
    else:
        pool = _pool(complete.select(x), F.lit(0), [rows], F.lit(cut), pool_rows, seed)
    pool = pool.persist()
    try:
        grown = _trees(pool, len(names), trees, seed, tree_rows)
        psi = min(tree_rows, pool.count())
    finally:
        pool.unpersist()
    return Forest(grown, psi)


def _scorer(forest: Forest):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            whole = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if whole.any():
                out[whole] = forest.score(x[whole])
            yield pd.Series(out)

    return score


def anomaly_threshold(scored: DataFrame, contamination: str | float) -> float:
    if contamination == "auto":
        return 0.5
    cut = scored.agg(F.percentile_approx("anomaly_score", 1.0 - float(contamination), 10000))
    return cut.first()[0]


def score_rows(
    df: DataFrame,
    names: list[str] | None = None,
    key: list[str] | None = None,
    trees: int = TABLE_TREES,
    cfg: Profiling = Profiling(),
) -> DataFrame | None:
    """All rows with `anomaly_score` and `is_anomaly`; None below the minimum rows.

    Rows with a missing feature are not scored and never flagged.
    """
    names = names or [c for c in columns_of(df, NUMERIC) if c not in (key or [])]
    if not names:
        return None
    df = dealt(df)
    missing = F.greatest(*[col(c).isNull().cast("int") for c in names], F.lit(0))
    rows, complete = df.agg(F.count(F.lit(1)), F.count_if(missing == 0)).first()
    if rows < cfg.min_rows_anomaly_detection or complete < 2:
        return None
    forest = fit(df, names, key, cfg.global_seed, complete, trees, cfg.anomaly_tree_rows)
    raw = _scorer(forest)(F.struct(*[as_double(c).alias(f"f{i}") for i, c in enumerate(names)]))
    scored = df.withColumn("anomaly_score", F.nanvl(raw, F.lit(None).cast("double")))
    edge = anomaly_threshold(scored, cfg.anomaly_contamination)
    return scored.withColumn(
        "is_anomaly", F.coalesce(F.col("anomaly_score") > edge, F.lit(False))
    )


def anomaly_rows(
    df: DataFrame,
    names: list[str] | None = None,
    key: list[str] | None = None,
    cfg: Profiling = Profiling(),
) -> DataFrame:
    """One row: rows scored, rows flagged and their share of all rows."""
    schema = "samples bigint, anomaly_count bigint, anomaly_ratio double"
    scored = score_rows(df, names, key, cfg=cfg)
    if scored is None:
        return local_frame(df.sparkSession, [], schema)
    return scored.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_ratio"),
    )


def _steps(trees: list[tuple[list, list]], psi: int) -> tuple[np.ndarray, np.ndarray]:
    """A one-feature forest as a step function: breakpoints and the score of each step."""
    inner = [(np.array(c), np.array(n)) for c, n in trees]
    cuts = np.unique(np.concatenate([c for c, _ in inner]))
    total = np.zeros(len(cuts) + 1)
    for c, lengths in inner:
        # step i ends at cuts[i]; a value equal to a cut goes left
        total[:-1] += lengths[np.searchsorted(c, cuts, side="left")]
        total[-1] += lengths[-1]
    return cuts, np.exp2(-total / (len(inner) * (mean_depth(psi) or 1.0)))


def anomaly_columns(
    df: DataFrame,
    names: list[str] | None = None,
    key: list[str] | None = None,
    cfg: Profiling = Profiling(),
    counts: dict[str, int] | None = None,
) -> dict[str, tuple[float, float]]:
    """{column: (anomaly share, mean decision score)} from one forest per column.

    Two scans for all columns: one draws every column's pool, one scores. With one
    feature a forest is a step function, so scoring is a binary search.
    """
    names = names or [c for c in columns_of(df, NUMERIC) if c not in (key or [])]
    keep = [*names, *[k for k in (key or []) if k not in names]]
    with spread(df.select(*[col(c) for c in keep])) as narrow:
        return _anomaly_columns(narrow, names, key, cfg, counts)


def _anomaly_columns(df, names, key, cfg, counts=None) -> dict[str, tuple[float, float]]:
    trees, seed, tree_rows = cfg.anomaly_n_estimators, cfg.global_seed, cfg.anomaly_tree_rows
    if counts is None:
        counts = one_row(df, {c: f"count({q(c)})" for c in names}) if names else {}
    ready = [c for c in names if counts[c] >= cfg.min_rows_anomaly_detection]
    if not ready:
        return {}
    pool_rows = 2 * tree_rows * trees
    cuts = [min(int(HASH_SPAN * pool_rows / counts[c]), HASH_SPAN) for c in ready]
    slots = [
        F.struct(F.lit(i).alias("slot"), as_double(c).alias("v"), F.lit(cut).alias("cut"))
        for i, (c, cut) in enumerate(zip(ready, cuts))
    ]
    if key:
        hashed = df.withColumn("__h", _hash([col(k) for k in key], seed)).where(F.col("__h") < max(cuts))
        pool = hashed.select(F.col("__h").alias("h"), F.inline(F.array(*slots)))
        pool = pool.where((F.col("h") < F.col("cut")) & F.col("v").isNotNull())
    else:
        cells = df.select(F.inline(F.array(*slots))).where(F.col("v").isNotNull())
        pool = _pool(cells, F.col("slot"), [counts[c] for c in ready], F.col("cut"), pool_rows, seed)
    # per column at most about `pool_rows` rows; each (column, tree) draws its own sample
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    share = [min(4.0 * tree_rows / min(counts[c], pool_rows), 1.0) for c in ready]
    limits = F.array(*[F.lit(int(s * HASH_SPAN)) for s in share])
    drawn = pool.select(
        "h", "slot", "v", F.get(limits, F.col("slot")).alias("lim")
    ).select(
        "h", "slot", "v",
        F.explode(
            F.filter(
                numbers,
                lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "slot", "h"), F.lit(HASH_SPAN))
                < F.col("lim"),
            )
        ).alias("tree"),
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, tree = int(pdf["slot"].iat[0]), int(pdf["tree"].iat[0])
        order = pd.util.hash_array(pdf["h"].to_numpy() + np.int64(tree) * 1_000_003)
        x = pdf.assign(o=order).sort_values(["o", "h", "v"]).head(tree_rows)["v"]
        height = max(math.ceil(math.log2(max(len(x), 2))), 1)
        rng = np.random.default_rng([seed, slot, tree])
        cuts, lengths = _grow_sorted(sorted(x.tolist()), rng, height)
        return pd.DataFrame({"slot": [slot], "tree": [tree], "cut": [cuts], "length": [lengths]})

    grown = (
        drawn.groupBy("slot", "tree")
        .applyInPandas(grow, "slot int, tree int, cut array<double>, length array<double>")
        .collect()
    )
    tables = []
    for i, c in enumerate(ready):
        mine = sorted((r for r in grown if r.slot == i), key=lambda r: r.tree)
        tables.append(_steps([(r.cut, r.length) for r in mine], min(tree_rows, counts[c])))
    auto = cfg.anomaly_contamination == "auto"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i, (edges, _) in enumerate(tables):
                v = batch.iloc[:, i].to_numpy(dtype=float)
                v = v[~np.isnan(v)]
                steps, n = np.unique(np.searchsorted(edges, v, side="left"), return_counts=True)
                for s, k in zip(steps.tolist(), n.tolist()):
                    found[i, s] = found.get((i, s), 0) + k
        yield pd.DataFrame(
            [(i, s, k) for (i, s), k in found.items()], columns=["slot", "step", "n"]
        ).astype("int64")

    numbers_only = df.selectExpr(*[f"{dbl(c)} AS f{i}" for i, c in enumerate(ready)])
    steps = (
        numbers_only.mapInPandas(score, "slot bigint, step bigint, n bigint")
        .groupBy("slot", "step")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most trees * tree_rows steps per column
    )
    steps = steps.sort_by([("slot", "ascending"), ("step", "ascending")])  # sums in a fixed order
    slot, step, hits = (steps[k].to_numpy() for k in ("slot", "step", "n"))
    out = {}
    for i, c in enumerate(ready):
        here = slot == i
        s, n = tables[i][1][step[here]], hits[here].astype(float)
        edge = 0.5
        if not auto:
            order = np.argsort(s)
            passed = np.cumsum(n[order]) / n.sum()
            at = np.searchsorted(passed, 1.0 - float(cfg.anomaly_contamination))
            edge = s[order][min(int(at), len(s) - 1)]
        out[c] = (float(n[s > edge].sum() / n.sum()), float(edge - np.average(s, weights=n)))
    return out


def anomaly_column_frame(
    df: DataFrame,
    names: list[str] | None = None,
    key: list[str] | None = None,
    cfg: Profiling = Profiling(),
) -> DataFrame:
    found = anomaly_columns(df, names, key, cfg)
    rows = [(c, a, m) for c, (a, m) in sorted(found.items())]
    out = local_frame(df.sparkSession, rows, "column string, anomaly_ratio double, mean_anomaly_score double"
    )
    return out.select(
        "column",
        F.round("anomaly_ratio", cfg.rounding).alias("anomaly_ratio"),
        F.round("mean_anomaly_score", cfg.rounding).alias("mean_anomaly_score"),
    )
