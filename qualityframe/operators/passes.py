"""The statistics of all columns from shared scans.

Every statistic is an aggregate that merges by addition, so a column is read once per
pass, not once per statistic:

1. `first_look`: sizes, nulls, ends, power sums about a pilot value, text shapes, class
   shares and date ranges; quantile and distinct sketches beside them,
   since a scan with sketches leaves generated code.
2. `value_look`: one cell per column and value, grouped and then summed up per column:
   distinct counts and label statistics; the values inside quantile brackets beside them.

A scan takes as many columns as generated code can hold and reads only those; scans are
submitted together. Numbers cross the shuffle as they are, long texts that need only be
counted as SHA-256; a hot value is one row per task.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Profiling
from ..functions.cells import (
    BOOLEAN,
    DATETIME,
    NOT_DIGITS,
    NOT_SPACES,
    NOT_SPECIAL,
    NUMERIC,
    TEXTUAL,
    characters_left,
    col,
    dbl,
    kind,
    number,
    q,
    short_key,
    sketch_distinct,
)
from . import numeric, semantic, structure
from .scale import local_frame, together
from .text import text_stats
from .times import DAY_MICROS, iso, micros

AGGREGATES_AT_ONCE = 80
SKETCHES_AT_ONCE = 12
CELLS_AT_ONCE = 16
PILOT_ROWS = 1000
FEW = 0.05  # distinct share of the pilot rows below which a short text looks like a label
FAR = 8.0  # standard deviations between pilot and mean that cost too many digits


def scans(df: DataFrame, *wanted: tuple[dict, int]) -> dict:
    """Global aggregates as SQL, {name: value}; each group in scans of so many.

    The aggregates of a group may also be (expression, function of its name): sketches run
    outside generated code, so what they read is computed inside it, in a step before.
    """

    def run(part: list) -> dict:
        given = [f"{e[0]} AS x{i}" for i, (_, e) in enumerate(part) if not isinstance(e, str)]
        source = df.selectExpr(*given) if given else df
        exprs = [e if isinstance(e, str) else e[1](f"x{i}") for i, (_, e) in enumerate(part)]
        row = source.selectExpr(*[f"{e} AS y{i}" for i, e in enumerate(exprs)]).first()
        return dict(zip([name for name, _ in part], row))

    parts = []
    for exprs, width in wanted:
        items = list(exprs.items())
        parts += [items[i : i + width] for i in range(0, len(items), width)]
    out: dict = {}
    for found in together(df.sparkSession, *[partial(run, part) for part in parts]) if parts else []:
        out |= found
    return out


def pilots(df: DataFrame, numbers: list[str], texts: list[str]) -> tuple[dict[str, float], set[str]]:
    """From a few rows: a value near the bulk of each numeric column, and the text columns
    that look like labels."""
    if not numbers and not texts:
        return {}, set()
    exprs = [f"avg({dbl(c)}) AS m{i}" for i, c in enumerate(numbers)]
    for i, c in enumerate(texts):
        exprs.append(f"count(DISTINCT {q(c)}) <= {FEW} * count({q(c)}) AND avg(char_length({q(c)})) < 50 AS t{i}")
    row = df.select(*[col(c) for c in [*numbers, *texts]]).limit(PILOT_ROWS).selectExpr(*exprs).first()
    means = row[: len(numbers)]
    near = {c: v if v is not None and math.isfinite(v) else 0.0 for c, v in zip(numbers, means)}
    return near, {c for c, few in zip(texts, row[len(numbers) :]) if few}


def _is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def _look_exprs(f: T.StructField, pilot: float | None, prose: bool, parts: set) -> tuple[dict, dict]:
    """The plain aggregates and the sketches of a column."""
    c, k = q(f.name), kind(f.dataType)
    plain = {"nulls": f"count_if({c} IS NULL)", "bytes": structure.byte_size(f)}
    sketches = {}
    if k == TEXTUAL:
        size = f"char_length({c})"
        plain |= {"text_n": f"count({c})", "text_mean": f"avg({size})"}
        sketches["text_approx"] = (f"if({c} IS NULL, NULL, xxhash64({c}))", sketch_distinct)
        if prose:
            plain |= {"text_std": f"stddev({size})", "text_sum": f"sum({size})"}
            for name, removed in (("digits", NOT_DIGITS), ("spaces", NOT_SPACES), ("special", NOT_SPECIAL)):
                plain[name] = f"sum({characters_left(f.name, removed)})"
    elif k == NUMERIC and "numbers" in parts:
        x = dbl(f.name)
        d = f"({x} - {number(pilot)})"
        plain |= structure.base_exprs(f.name)
        plain |= {f"p{i}": f"sum({' * '.join([d] * i)})" for i in (1, 2, 3, 4)}
        sketches["sketch"] = (x, numeric.bracket_sketch)
    elif k == DATETIME:
        t = micros(f.name, f.dataType)
        plain |= {"low": f"min({t})", "high": f"max({t})"}
    if "classes" in parts:
        for label, pattern, _ in semantic.CLASSES:
            share = semantic.share(f, label, pattern)
            if share is not None:
                plain[f"class_{label}"] = share
    return plain, sketches


def first_look(df: DataFrame, parts: set[str]) -> dict[str, dict]:
    """{column: statistics}. `parts`: numbers, prose and classes; sizes, text shapes and date
    ranges are always there."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    numbers = [f.name for f in fields if kind(f.dataType) == NUMERIC] if "numbers" in parts else []
    texts = [f.name for f in fields if kind(f.dataType) == TEXTUAL] if "prose" in parts else []
    pilot, labels = pilots(df, numbers, texts)
    plain: dict = {("", "rows"): "count(1)"}
    sketches = {}
    for f in fields:
        a, b = _look_exprs(f, pilot.get(f.name), f.name in texts and f.name not in labels, parts)
        plain |= {(f.name, k): e for k, e in a.items()}
        sketches |= {(f.name, k): e for k, e in b.items()}
    found = scans(df, (plain, AGGREGATES_AT_ONCE), (sketches, SKETCHES_AT_ONCE))
    out: dict[str, dict] = {f.name: {"rows": found["", "rows"]} for f in fields}
    for (c, k), v in found.items():
        if c:
            out[c][k] = v
    return out


def class_shares(seen: dict[str, dict]) -> dict[str, float]:
    """{column NUL class: share of values}, where the type can spell the class."""
    return {
        f"{c}\0{label}": s[f"class_{label}"]
        for c, s in seen.items()
        for label, _, _ in semantic.CLASSES
        if f"class_{label}" in s
    }


def prose_stats(df: DataFrame, seen: dict[str, dict], names: list[str]) -> dict[str, tuple]:
    """{column: mean and spread of the length, shares of three kinds of characters}.

    Columns that looked like labels at first are read again.
    """
    out = {}
    for c in names:
        s = seen[c]
        if "digits" in s and s["text_n"]:
            shares = [s[k] / s["text_sum"] if s["text_sum"] else 0.0 for k in ("digits", "spaces", "special")]
            out[c] = (s["text_mean"], s["text_std"], *shares)
        elif "digits" in s:
            out[c] = (0.0,) * 5
    again = [c for c in names if c not in out]
    found = text_stats(df, again).collect() if again else []
    return out | {r.column: tuple(r)[1:] for r in found}


def date_stats(df: DataFrame, seen: dict[str, dict], names: list[str]) -> dict[str, tuple]:
    """{column: (min, max, days between)}, the ends in ISO 8601."""
    out: dict[str, tuple] = {}
    by_type: dict[str, list[str]] = {}
    for c in names:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for columns in by_type.values():
        t = df.schema[columns[0]].dataType
        rows = [(c, seen[c]["low"], seen[c]["high"]) for c in columns]
        ends = local_frame(df.sparkSession, rows, "c string, low bigint, high bigint")

        def text(end: str) -> str:
            if isinstance(t, T.DateType):
                value = f"date_from_unix_date(CAST({end} DIV {DAY_MICROS}L AS INT))"
            elif isinstance(t, T.TimestampNTZType):
                value = f"timestampadd(MICROSECOND, {end}, TIMESTAMP_NTZ '1970-01-01 00:00:00')"
            else:
                value = f"timestamp_micros({end})"
            return f"coalesce({iso(value, t)}, '')"

        days = f"coalesce((high - low) / {DAY_MICROS}D, 0D)"
        for r in ends.selectExpr("c", f"{text('low')} AS low", f"{text('high')} AS high", f"{days} AS days").collect():
            out[r.c] = (r.low, r.high, r.days)
    return out


def power_sums(df: DataFrame, seen: dict[str, dict], names: list[str]) -> dict[str, list[float]]:
    """Four power sums per column; about the mean again where the pilot was too far off."""
    out, again = {}, {}
    for c in names:
        s = seen[c]
        p = [s[f"p{k}"] for k in (1, 2, 3, 4)]
        shift = p[0] / s["n"]
        spread = max(p[1] / s["n"] - shift**2, 0.0) ** 0.5
        if abs(shift) <= FAR * spread:
            out[c] = p
        else:
            d = f"({dbl(c)} - {number(s['mean'])})"
            again |= {f"{c}\0{k}": f"sum({' * '.join([d] * k)})" for k in (1, 2, 3, 4)}
    found = scans(df, (again, AGGREGATES_AT_ONCE))
    return out | {c: [found[f"{c}\0{k}"] for k in (1, 2, 3, 4)] for c in names if c not in out}


KEY = {"l": "BIGINT", "d": "DOUBLE", "s": "STRING"}


def _cell(slot: int, given: dict[str, str]) -> str:
    """A cell as SQL: its slot, and its value in the field of its type."""
    fields = ", ".join(f"'{k}', {given.get(k, f'CAST(NULL AS {t})')}" for k, t in KEY.items())
    return f"named_struct('slot', {slot}, {fields})"


def value_cell(slot: int, f: T.StructField, label: bool, limit: int = 64) -> str:
    """The value of a column; a text that is no label travels as SHA-256 beyond `limit`."""
    c, k = q(f.name), kind(f.dataType)
    if k == TEXTUAL:
        return _cell(slot, {"s": f"CAST({c} AS STRING)" if label else short_key(f.name, limit)})
    if k == DATETIME:
        return _cell(slot, {"l": micros(f.name, f.dataType)})
    if k == BOOLEAN or isinstance(f.dataType, T.IntegralType):
        return _cell(slot, {"l": f"CAST({c} AS BIGINT)"})
    if isinstance(f.dataType, T.DecimalType):
        return _cell(slot, {"s": f"CAST({c} AS STRING)"})
    return _cell(slot, {"d": dbl(f.name)})


def counted(df: DataFrame, cells: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, slot, l, d, s, n): how often each cell occurs; empty cells are left out."""
    melted = df.selectExpr(*by, f"inline(array({', '.join(cells)}))")
    some = melted.where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")
    return some.groupBy(*by, "slot", *KEY).agg(F.count(F.lit(1)).alias("n"))


def chunks(names: list[str]) -> list[list[str]]:
    return [names[i : i + CELLS_AT_ONCE] for i in range(0, len(names), CELLS_AT_ONCE)]


def label_stats(counts: DataFrame, totals: list[int], cfg: Profiling) -> DataFrame:
    """One row a slot from `counted`; the slots with a total are compared as labels."""
    total = f"get(array({', '.join(f'{t}L' for t in totals)}), slot)"
    n = "CAST(n AS DOUBLE)"
    return counts.groupBy("slot").agg(
        F.expr("count(1)").alias("distinct_count"),
        F.expr(f"sum({n} * log2({n}))").alias("nlogn"),
        F.expr(f"min(CASE WHEN {total} > 0 THEN named_struct('less', -n, 'value', s) END)").alias("top"),
        F.expr(f"count_if({total} > 0 AND n / {total} < {cfg.rare_category_threshold!r}D)").alias("rare_count"),
    )


def value_look(
    df: DataFrame,
    columns: list[str],
    totals: dict[str, int],
    spans: dict[str, list[tuple[float, float]]],
    cfg: Profiling = Profiling(),
) -> tuple[dict[str, dict], dict[str, list]]:
    """({column: value statistics}, {column: bracket counts}).

    `totals` are the non-null counts of the columns whose values are labels. `spans` are
    merged quantile brackets; the counts are (segment, value, n).
    """
    fields = {f.name: f for f in df.schema.fields}
    stats = {c: {"distinct_count": 0, "nlogn": 0.0, "top": None, "rare_count": 0} for c in columns}
    inside: dict[str, list] = {c: [] for c in spans}

    def values(some: list[str]) -> None:
        cells = [value_cell(i, fields[c], c in totals) for i, c in enumerate(some)]
        for r in label_stats(counted(df, cells), [totals.get(c, 0) for c in some], cfg).collect():
            stats[some[r.slot]] = {k: r[k] for k in ("distinct_count", "nlogn", "top", "rare_count")}

    def brackets(some: list[str]) -> None:
        cells = []
        for i, c in enumerate(some):
            segment = numeric.segment(dbl(c), spans[c])
            at = f"CASE WHEN {q(c)} IS NOT NULL THEN CAST({segment} AS BIGINT) END"
            cells.append(_cell(i, {"l": at, "d": f"CASE WHEN ({segment}) % 2 = 1 THEN {dbl(c)} END"}))
        for r in counted(df, cells).select("slot", "l", "d", "n").collect():  # a bounded number each
            inside[some[r.slot]].append((r.l, r.d, r.n))

    steps = [partial(values, some) for some in chunks(columns)]
    steps += [partial(brackets, some) for some in chunks(list(spans))]
    if steps:
        together(df.sparkSession, *steps)
    return stats, inside
