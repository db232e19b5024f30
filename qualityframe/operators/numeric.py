"""Numeric columns: exact quantiles, moments, outliers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profiling
from ..functions.cells import NUMERIC, col, columns_of, dbl, number, q
from .scale import local_frame, one_row, spread
from .structure import base_stats

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 2000
MAX_BRACKET_ROWS = 50_000

NUMERIC_FIELDS = (
    "mean median std variance min max q25 q50 q75 iqr skewness kurtosis "
    "bimodality zero_ratio cv"
).split()


def positions(n: int, p: float) -> tuple[int, int, float]:
    k = p * (n - 1)
    low = math.floor(k)
    return low, math.ceil(k), k - low


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def segment(x: str, spans: list[tuple[float, float]]) -> str:
    """0 below the first span, 1 inside it, 2 between it and the next, and so on."""
    cases = "".join(
        f" WHEN {x} < {number(lo)} THEN {2 * i} WHEN {x} <= {number(hi)} THEN {2 * i + 1}"
        for i, (lo, hi) in enumerate(spans)
    )
    return f"CASE{cases} ELSE {2 * len(spans)} END"


def _sketch(x: str, points: list[float], accuracy: int) -> str:
    listed = ", ".join(number(p) for p in points)
    return f"percentile_approx({x}, array({listed}), {accuracy})"


def _bracket(df: DataFrame, wanted: dict, counts: dict, margin: float, accuracy: int) -> dict:
    """Sketch values on both sides of each quantile: {(column, p): (low, high)}."""
    exprs, keys = {}, {}
    for c, probs in wanted.items():
        points = sorted({min(max(p + s * margin, 0.0), 1.0) for p in probs for s in (-1, 1)})
        keys[c] = points
        exprs[c] = _sketch(dbl(c), points, accuracy)
    found = one_row(df, exprs, batch=4)
    out = {}
    for c, probs in wanted.items():
        at = dict(zip(keys[c], found[c]))
        for p in probs:
            out[c, p] = (at[min(max(p - margin, 0.0), 1.0)], at[min(max(p + margin, 0.0), 1.0)])
    return out


def bracket_points() -> list[float]:
    margin = 2.0 / ACCURACY
    return sorted({min(max(p + s * margin, 0.0), 1.0) for p in QUARTILES for s in (-1, 1)})


def bracket_sketch(x: str) -> str:
    """A sketch, as SQL, of the values on both sides of each quartile."""
    return _sketch(x, bracket_points(), ACCURACY)


def quartile_spans(sketch: list[float]) -> list[tuple[float, float]]:
    """Merged brackets around the quartiles, from the values of `bracket_sketch`."""
    at = dict(zip(bracket_points(), sketch))
    margin = 2.0 / ACCURACY
    return _merged([(at[p - margin], at[p + margin]) for p in QUARTILES])


def near_median(sketch: list[float]) -> float:
    """A value of the column next to its median, from the values of `bracket_sketch`."""
    return sketch[len(sketch) // 2]


def fits_brackets(n: int) -> bool:
    """Do the brackets of so many values hold few enough to list?"""
    return n * 4 * 2.0 / ACCURACY <= MAX_BRACKET_ROWS


def pick(counts: list[tuple[int, float | None, int]], n: int, p: float) -> float | None:
    """A quantile from sorted counts of segments and bracket values; None if it lies outside."""
    low, high, part_way = positions(n, p)
    ends = np.cumsum([c for _, _, c in counts])
    at = [counts[int(np.searchsorted(ends, k, side="right"))] for k in (low, high)]
    if any(place % 2 == 0 for place, _, _ in at):
        return None
    a, b = float(at[0][1]), float(at[1][1])
    return a if a == b else a + (b - a) * part_way


def _narrow(df: DataFrame, spans: dict, counts: dict, accuracy: int, limit: int) -> dict:
    """Sketch again inside brackets that still hold too many rows."""
    while True:
        probe = {}
        for i, ((c, _), (lo, hi)) in enumerate(spans.items()):
            probe[i, "below"] = f"count_if({dbl(c)} < {number(lo)})"
            probe[i, "in"] = f"count_if({dbl(c)} BETWEEN {number(lo)} AND {number(hi)})"
        sizes = one_row(df, {f"{i}{k}": e for (i, k), e in probe.items()})
        todo = {}
        for i, ((c, p), (lo, hi)) in enumerate(spans.items()):
            inside = sizes[f"{i}in"]
            if inside > limit and lo < hi:
                first, last, _ = positions(counts[c], p)
                first, last = first - sizes[f"{i}below"], last - sizes[f"{i}below"]
                if 0 <= first and last < inside:
                    todo[c, p] = (lo, hi, first / inside, last / inside)
        if not todo:
            return spans
        margin = 2.0 / accuracy
        exprs = {
            f"{c}\0{p}": _sketch(
                f"CASE WHEN {dbl(c)} BETWEEN {number(lo)} AND {number(hi)} THEN {dbl(c)} END",
                [max(a - margin, 0.0), min(b + margin, 1.0)],
                accuracy,
            )
            for (c, p), (lo, hi, a, b) in todo.items()
        }
        found = one_row(df, exprs, batch=8)
        moved = False
        for (c, p), (lo, hi, _, _) in todo.items():
            span = tuple(found[f"{c}\0{p}"])
            moved = moved or span != (lo, hi)
            spans[c, p] = span
        if not moved:
            return spans


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    counts: dict[str, int] | None = None,
    exact: bool = True,
    accuracy: int = ACCURACY,
    limit: int = MAX_BRACKET_ROWS,
) -> dict[tuple[str, float], float]:
    """Quantiles with linear interpolation; None for columns without values.

    Exact by select, not by sort: a mergeable sketch brackets each quantile, rows
    outside the brackets are only counted, and the few values inside are grouped.
    Memory is bounded by the sketch and by `limit`, whatever the number of rows.
    """
    if counts is None:
        counts = one_row(df, {c: f"count({q(c)})" for c in wanted})
    result = {(c, p): None for c, ps in wanted.items() for p in ps}
    open_ = {c: list(ps) for c, ps in wanted.items() if counts[c]}
    if not open_:
        return result
    if not exact:
        exprs = {c: _sketch(dbl(c), ps, 10000) for c, ps in open_.items()}
        found = one_row(df, exprs, batch=8)
        return result | {(c, p): v for c, ps in open_.items() for p, v in zip(ps, found[c])}
    margin = 2.0 / accuracy
    while open_:
        spans = _bracket(df, open_, counts, margin, accuracy)
        if max(counts[c] for c in open_) * 4 * margin > limit:
            spans = _narrow(df, spans, counts, accuracy, limit)
        columns = list(open_)
        for start in range(0, len(columns), 8):
            part = columns[start : start + 8]
            merged = {c: _merged([spans[c, p] for p in open_[c]]) for c in part}
            slots = []
            for i, c in enumerate(part):
                seg = segment(dbl(c), merged[c])
                slots.append(
                    f"CASE WHEN {q(c)} IS NOT NULL THEN named_struct('slot', {i}, 'seg', {seg}, "
                    f"'v', CASE WHEN ({seg}) % 2 = 1 THEN {dbl(c)} END) END"
                )
            rows = (
                df.selectExpr(f"explode(array({', '.join(slots)})) AS s")
                .where(F.col("s").isNotNull())
                .groupBy("s.slot", "s.seg", "s.v")
                .agg(F.count(F.lit(1)).alias("n"))
                .orderBy("slot", "seg", "v")
                .toArrow()  # brackets hold at most `limit` rows each
            )
            slot, seg_, value, n_ = (
                rows[k].to_numpy() for k in ("slot", "seg", "v", "n")
            )
            for i, c in enumerate(part):
                here = slot == i
                mine_seg, mine, ends = seg_[here], value[here], np.cumsum(n_[here])
                missed = []
                for p in open_[c]:
                    low, high, part_way = positions(counts[c], p)
                    i_low = int(np.searchsorted(ends, low, side="right"))
                    i_high = int(np.searchsorted(ends, high, side="right"))
                    if mine_seg[i_low] % 2 == 0 or mine_seg[i_high] % 2 == 0:
                        missed.append(p)
                        continue
                    a, b = float(mine[i_low]), float(mine[i_high])
                    result[c, p] = a if a == b else a + (b - a) * part_way
                open_[c] = missed
        open_ = {c: ps for c, ps in open_.items() if ps}
        margin *= 8  # a bracket missed its rank: take a wider one
    return result


def _moments(n: int, s1: float, s2: float, s3: float, s4: float, flat: bool) -> dict:
    """Bias-corrected moments from power sums about a point near the mean."""
    out = {"std": None, "variance": None, "skewness": None, "kurtosis": None}
    if n == 0:
        return out
    if flat:
        if n >= 2:
            out["std"] = out["variance"] = 0.0
        out["skewness"] = 0.0 if n >= 3 else None
        out["kurtosis"] = 0.0 if n >= 4 else None
        return out
    shift = s1 / n
    m2 = s2 / n - shift**2
    m3 = s3 / n - 3 * shift * s2 / n + 2 * shift**3
    m4 = s4 / n - 4 * shift * s3 / n + 6 * shift**2 * s2 / n - 3 * shift**4
    if n >= 2:
        out["variance"] = m2 * n / (n - 1)
        out["std"] = math.sqrt(max(out["variance"], 0.0))
    if n >= 3:
        g1 = m3 / m2**1.5 if m2 > 0 else 0.0
        out["skewness"] = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    if n >= 4:
        g2 = m4 / m2**2 - 3 if m2 > 0 else -3.0
        out["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        if m2 <= 0:
            out["kurtosis"] = 0.0
    return out


def bimodality(n: int, skew: float | None, kurt: float | None) -> float:
    """Sarle's coefficient with both the constant 3 and the finite-sample term."""
    if n <= 3 or skew is None or kurt is None:
        return 0.0
    below = kurt + 3 + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    return min((skew**2 + 1) / below, 1.0) if below != 0 else 0.0


def numeric_stats(
    df: DataFrame,
    names: list[str] | None = None,
    cfg: Profiling = Profiling(),
    base: dict[str, dict] | None = None,
) -> dict[str, dict]:
    """All numeric statistics, {column: {field: value}}, in three or four scans.

    Power sums are taken about the measured mean, which keeps their digits and
    costs a fraction of the built-in skewness and kurtosis. `base` saves the first
    scan where counts, means and ends are known.
    """
    if names is None:
        names = columns_of(df, NUMERIC)
    if not names:
        return {}
    with spread(df.select(*[col(c) for c in names])) as narrow:
        return _numeric_stats(narrow, names, cfg, base)


def _numeric_stats(
    df: DataFrame, names: list[str], cfg: Profiling, base: dict[str, dict] | None = None
) -> dict[str, dict]:
    stats = base_stats(df, names) if base is None else base
    live = [c for c in names if stats[c]["n"] and stats[c]["min"] != stats[c]["max"]]
    exprs = {}
    for c in live:
        d = f"({dbl(c)} - {number(stats[c]['mean'])})"
        for i in (1, 2, 3, 4):
            exprs[f"{c}\0{i}"] = f"sum({' * '.join([d] * i)})"
    sums = one_row(df, exprs, batch=16) if exprs else {}
    quart = quantiles(
        df,
        {c: list(QUARTILES) for c in live},
        {c: stats[c]["n"] for c in live},
        exact=cfg.exact_quantiles,
    )
    return assembled(names, stats, {c: [sums[f"{c}\0{i}"] for i in (1, 2, 3, 4)] for c in live}, quart)


def assembled(names: list[str], stats: dict[str, dict], sums: dict[str, list], quart: dict) -> dict[str, dict]:
    """The numeric fields of each column from base statistics, power sums and quartiles."""
    out = {}
    for c in names:
        s = stats[c]
        n = s["n"]
        if n == 0:
            out[c] = {"n": 0} | {f: 0.0 for f in NUMERIC_FIELDS}
            continue
        flat = s["min"] == s["max"]
        m = _moments(n, *([0.0] * 4 if flat else sums[c]), flat)
        mean = s["min"] if flat else s["mean"]
        q25, q50, q75 = [s["min"] if flat else quart[c, p] for p in QUARTILES]
        out[c] = {
            "n": n,
            "mean": mean,
            "median": q50,
            "min": s["min"],
            "max": s["max"],
            "q25": q25,
            "q50": q50,
            "q75": q75,
            "iqr": q75 - q25,
            "bimodality": bimodality(n, m["skewness"], m["kurtosis"]),
            "zero_ratio": s["zeros"] / n,
            "cv": m["std"] / mean if mean and m["std"] is not None else 0.0,
            **m,
        }
    return out


def _round_all(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def numeric_profile(
    df: DataFrame, names: list[str] | None = None, cfg: Profiling = Profiling()
) -> DataFrame:
    """One row per numeric column."""
    stats = numeric_stats(df, names, cfg)
    fields = ["n", *NUMERIC_FIELDS]
    schema = "column string, n bigint, " + ", ".join(f"`{f}` double" for f in NUMERIC_FIELDS)
    rows = [(c, *[s[f] for f in fields]) for c, s in sorted(stats.items())]
    return _round_all(local_frame(df.sparkSession, rows, schema), cfg.rounding)


def outlier_condition(x: str, s: dict, cfg: Profiling) -> str | None:
    """Rows outside three deviations (near-symmetric) or the IQR fence (skewed)."""
    if abs(s["skewness"] or 0.0) < 1.0:
        if not s["std"]:
            return None
        return f"abs({x} - {number(s['mean'])}) / {number(s['std'])} > 3"
    if not s["iqr"]:
        return None
    reach = cfg.outlier_iqr_multiplier * s["iqr"]
    return f"{x} < {number(s['q25'] - reach)} OR {x} > {number(s['q75'] + reach)}"


def numeric_behavior(
    df: DataFrame, stats: dict[str, dict], cfg: Profiling = Profiling(), batch: int = 16
) -> dict[str, dict]:
    """Outlier share, tail weight, modality and variance indicators per column."""
    ready = {c: s for c, s in stats.items() if s["n"] >= cfg.min_rows_numeric_behavior}
    tests = {c: outlier_condition(dbl(c), s, cfg) for c, s in ready.items()}
    exprs = {c: f"count_if({t})" for c, t in tests.items() if t is not None}
    hits = one_row(df, exprs, batch) if exprs else {}
    return {c: behavior_of(s, hits.get(c, 0)) for c, s in ready.items()}


def behavior_of(s: dict, outliers: int) -> dict[str, float]:
    """The behaviour of a column from its statistics and its number of outliers."""
    reach = s["max"] - s["min"]
    return {
        "outlier_ratio": outliers / s["n"],
        "heavy_tail_score": abs(s["kurtosis"]) if s["kurtosis"] is not None else 0.0,
        "multimodality_score": s["bimodality"],
        "low_variance_indicator": s["variance"] / reach if reach else 0.0,
    }


BEHAVIOR_SCHEMA = (
    "column string, outlier_ratio double, heavy_tail_score double, "
    "multimodality_score double, low_variance_indicator double"
)


def behavior_frame(spark, found: dict[str, dict], cfg: Profiling) -> DataFrame:
    rows = [(c, *b.values()) for c, b in sorted(found.items())]
    return _round_all(local_frame(spark, rows, BEHAVIOR_SCHEMA), cfg.rounding)


def outlier_ratio(
    df: DataFrame, names: list[str] | None = None, cfg: Profiling = Profiling()
) -> DataFrame:
    """Numeric behaviour as rows."""
    names = columns_of(df, NUMERIC) if names is None else names
    with spread(df.select(*[col(c) for c in names])) as narrow:
        found = numeric_behavior(narrow, _numeric_stats(narrow, names, cfg), cfg)
    return behavior_frame(df.sparkSession, found, cfg)
