"""Repairs: table in, table out, lazily; statistics come from batched scans first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Profiling
from ..functions.cells import NUMERIC, TEXTUAL, col, dbl, holds_map, kind, parse_number, row_digest
from . import categories, forest, numeric
from .detectors import EMAIL_SHAPE
from .scale import materialize, one_row, spread

FENCE = 1.5
BROADCAST_LABELS = 100_000


@dataclass
class Outcome:
    """What a plan did to a table."""

    executed: list = field(default_factory=list)
    skipped: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    approval_requested: bool = False
    blocked: bool = False

    def statuses(self) -> list[tuple[dict, str, str | None]]:
        """(action, executed, skipped or error, message) of every action that was tried."""
        failed = {id(a): message for a, message in self.errors}
        missed = {id(a) for a in self.skipped}
        out = [(a, "error", m) for a, m in self.errors]
        out += [(a, "skipped", None) for a in self.skipped]
        out += [(a, "executed", None) for a in self.executed if id(a) not in failed and id(a) not in missed]
        return out


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows. Spark cannot group by maps, so rows that hold one at any depth are
    told apart by their 128-bit digest, as the duplicate count does."""
    if not any(holds_map(f.dataType) for f in df.schema.fields):
        return df.dropDuplicates()
    first, second = (F.expr(h) for h in row_digest(df.columns, df.schema))
    marked = df.withColumn("__first", first).withColumn("__second", second)
    return marked.dropDuplicates(["__first", "__second"]).drop("__first", "__second")


def _typed(value: float, data_type: T.DataType) -> tuple[Column, T.DataType]:
    """A literal and the type the column needs to hold it."""
    if isinstance(data_type, T.IntegralType):
        if float(value).is_integer():
            return F.lit(int(value)).cast(data_type), data_type
        return F.lit(float(value)), T.DoubleType()
    return F.lit(float(value)).cast(data_type), data_type


def _mode(df: DataFrame, name: str) -> object:
    """Most frequent value, the smallest on a tie; partial counts per task."""
    top = (
        df.where(col(name).isNotNull())
        .groupBy(col(name).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.min(F.struct((-F.col("n")).alias("less"), "v")).alias("top"))
        .first()
        .top
    )
    return None if top is None else top.v


def _needs(actions: list[dict], types: dict[str, T.DataType]) -> tuple[dict, list[str]]:
    """Quantiles and means wanted by a batch of column actions."""
    wanted: dict[str, list[float]] = {}
    means: list[str] = []
    for a in actions:
        c, p = a["column"], a["params"]
        if kind(types[c]) != NUMERIC:
            continue
        if a["operation"] == "impute":
            strategy = p.get("strategy", "median")
            if strategy == "median":
                wanted.setdefault(c, []).append(0.5)
            elif strategy == "mean":
                means.append(c)
        elif a["operation"] == "clip" and not p.get("open_ended"):
            if p.get("min") is None or p.get("max") is None:
                wanted.setdefault(c, []).extend([0.25, 0.75])
    return wanted, means


def _bounds(p: dict, quart: dict, c: str) -> tuple[float | None, float | None]:
    low = float(p["min"]) if p.get("min") is not None else None
    high = float(p["max"]) if p.get("max") is not None else None
    if p.get("open_ended") or (low is not None and high is not None):
        return low, high
    q1, q3 = quart.get((c, 0.25)), quart.get((c, 0.75))
    if q1 is None or q3 is None:
        return low, high
    reach = FENCE * (q3 - q1)
    return (q1 - reach if low is None else low), (q3 + reach if high is None else high)


def _repaired(df: DataFrame, a: dict, t: T.DataType, quart: dict, means: dict) -> dict[str, Column]:
    """New columns of one action: usually the column itself under its own name."""
    c, op, p = a["column"], a["operation"], a["params"]
    x = col(c)
    if op == "impute":
        strategy = p.get("strategy", "median")
        if strategy == "mode":
            fill = _mode(df, c)
            return {c: F.coalesce(x, F.lit(fill).cast(t))} if fill is not None else {}
        if kind(t) != NUMERIC:
            raise TypeError(f"{strategy} of a {t.simpleString()} column")
        fill = quart.get((c, 0.5)) if strategy == "median" else means.get(c)
        if fill is None:
            return {}
        value, new = _typed(fill, t)
        kept = F.when(x != 0, x) if p.get("zeros_as_null") else x
        return {c: F.coalesce(kept.cast(new), value)}
    if op == "clip":
        if kind(t) != NUMERIC:
            raise TypeError(f"clip of a {t.simpleString()} column")
        low, high = _bounds(p, quart, c)
        ends = [_typed(v, t) for v in (low, high) if v is not None]
        new = T.DoubleType() if any(isinstance(e[1], T.DoubleType) for e in ends) else t
        out = x.cast(new)
        if high is not None:
            out = F.least(out, F.lit(high).cast(new))
        if low is not None:
            out = F.greatest(out, F.lit(low).cast(new))
        return {c: F.when(x.isNotNull(), out)}
    if op == "log_transform":
        if kind(t) != NUMERIC:
            raise TypeError(f"logarithm of a {t.simpleString()} column")
        return {c: F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))}
    if op == "group_rare":
        text = x.cast("string")  # `with_frequent` has marked the labels that stay
        return {c: F.when(text.isNull() | col(_kept(c)), text).otherwise("OTHER")}
    if op == "cast_type":
        if p.get("target_type") != "numeric":
            return {c: x.cast("string")}
        return {c: parse_number(x) if kind(t) == TEXTUAL else x.try_cast("double")}
    if op == "mask_pii":
        label = (p.get("pii_type") or "SENSITIVE").upper()
        return {c: F.lit(f"[MASKED_{label}]")}
    if op == "flag_nulls":
        dirty = x.isNull()
        if p.get("pattern") == "violations":
            dirty = dirty | ~x.cast("string").rlike(EMAIL_SHAPE)
        return {f"{c}_is_dirty": dirty.cast("int")}
    raise ValueError(f"unknown operation {op}")


def _kept(name: str) -> str:
    return f"__kept {name}"


def _marks(text: Column) -> dict[str, Column]:
    """Two hashes that stand for a label of any length."""
    return {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit("second"), text)}


def with_frequent(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """For each column add whether its label is at or above the share.

    All columns are counted in one scan. Labels travel as 16 bytes, whatever their length.
    Those with at least one in `BROADCAST_LABELS` rows are so few that they are broadcast;
    wanted rarer ones are joined, and none of them is hot, since rows whose label is known
    by then are dealt out under a number of their own.
    """
    if not thresholds:
        return df
    names = list(thresholds)
    counts = categories.value_counts(df.select(*[col(c) for c in names]), names)
    share = 1 / BROADCAST_LABELS
    for name, threshold in thresholds.items():
        wanted = counts.where((F.col("column") == name) & (F.col("share") >= threshold))
        labels = wanted.select("share", *[v.alias(k) for k, v in _marks(F.col("value")).items()])
        often = labels.where(F.col("share") >= share).select("__h1", "__h2", F.lit(True).alias("__often"))
        df = df.withColumns(_marks(col(name).cast("string"))).join(F.broadcast(often), ["__h1", "__h2"], "left")
        found = F.coalesce("__often", F.lit(False))
        if threshold < share:
            seldom = labels.where(F.col("share") < share).select(
                "__h1", "__h2", F.lit(0).cast("long").alias("__own"), F.lit(True).alias("__seldom")
            )
            own = F.when(found, 1 + F.monotonically_increasing_id()).otherwise(F.lit(0))
            df = df.withColumn("__own", own.cast("long")).join(seldom, ["__h1", "__h2", "__own"], "left")
            found = found | F.coalesce("__seldom", F.lit(False))
        df = df.withColumn(_kept(name), found).drop("__h1", "__h2", "__often", "__own", "__seldom")
    return df


def repair_columns(
    df: DataFrame, actions: list[dict], cfg: Profiling = Profiling(), outcome: Outcome | None = None
) -> DataFrame:
    """Apply one action per column in a single projection.

    Statistics for all columns are read together before it: the projection itself
    adds no scan and no shuffle.
    """
    outcome = outcome or Outcome()
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [a for a in actions if a["column"] in types]
    outcome.skipped += [a for a in actions if a["column"] not in types]
    wanted, mean_of = _needs(present, types)
    quart, means = {}, {}
    if wanted or mean_of:
        names = sorted({*wanted, *mean_of})
        source = df.select(
            *[
                F.when(~F.isnan(col(c)), col(c)).alias(c)
                if isinstance(types[c], (T.FloatType, T.DoubleType))
                else col(c)
                for c in names
            ]
        )
        for a in present:  # zeros count as missing where the plan says so
            if a["params"].get("zeros_as_null") and a["column"] in names:
                c = a["column"]
                source = source.withColumn(c, F.when(col(c) != 0, col(c)))
        with spread(source) as narrow:
            if wanted:
                quart = numeric.quantiles(narrow, wanted, exact=cfg.exact_quantiles)
            if mean_of:
                means = one_row(narrow, {c: f"avg({dbl(c)})" for c in mean_of})
    rare = [a for a in present if a["operation"] == "group_rare"]
    names = df.columns
    df = with_frequent(df, {a["column"]: float(a["params"].get("threshold") or 0.01) for a in rare})
    dropped, new = set(), {}
    for a in present:
        if a["operation"] == "drop_column":
            dropped.add(a["column"])
            continue
        try:
            new |= _repaired(df, a, types[a["column"]], quart, means)
        except (TypeError, ValueError) as error:
            outcome.errors.append((a, str(error)))
    kept = [new.get(c, col(c)).alias(c) for c in names if c not in dropped]
    added = [v.alias(c) for c, v in new.items() if c not in types]
    return df.select(*kept, *added)


def _one(operation: str):
    def run(df: DataFrame, name: str, **params) -> DataFrame:
        given = {k: str(v) for k, v in params.items() if v is not None}
        outcome = Outcome()
        action = {"operation": operation, "column": name, "params": given}
        out = repair_columns(df, [action], outcome=outcome)
        if outcome.errors:
            raise TypeError(outcome.errors[0][1])
        return out

    run.__name__ = operation
    return run


impute = _one("impute")
clip = _one("clip")
log_transform = _one("log_transform")
cast_type = _one("cast_type")
mask_pii = _one("mask_pii")
flag_nulls = _one("flag_nulls")


def group_rare(df: DataFrame, name: str, threshold: float = 0.01) -> DataFrame:
    """Labels below the share become OTHER; nulls stay."""
    return _one("group_rare")(df, name, threshold=threshold)


def remove_anomalies(
    df: DataFrame,
    names: list[str] | None = None,
    key: list[str] | None = None,
    cfg: Profiling = Profiling(),
) -> DataFrame:
    """Rows the forest does not flag."""
    scored = forest.score_rows(df, names, key, cfg=cfg)
    if scored is None:
        return df
    return scored.where(~F.col("is_anomaly")).drop("anomaly_score", "is_anomaly")


Handler = Callable[[dict, DataFrame], DataFrame | None]
NOT_REPAIRS = {"BLOCK", "ALLOW", "WARN", "LOG", "REQUEST_APPROVAL"}


def apply_plan(
    df: DataFrame,
    plan: DataFrame,
    handlers: dict[str, Handler] | None = None,
    key: list[str] | None = None,
    cfg: Profiling = Profiling(),
    stop_on_block: bool = True,
) -> tuple[DataFrame, Outcome]:
    """Fold a plan over a table.

    Unapproved actions that need approval are skipped; repairs listed before a
    BLOCK still apply. Consecutive column repairs become one projection. A handler
    for an action type runs first and may return a new table; its errors, like
    those of repairs, are recorded and do not stop the fold.
    """
    outcome = Outcome()
    handlers = handlers or {}
    waiting: list[dict] = []

    def flush() -> None:
        nonlocal df, waiting
        if waiting:
            df = repair_columns(df, waiting, cfg, outcome)
            waiting = []

    for row in plan.orderBy("seq").collect():  # one row per action
        action = row.asDict(recursive=True)
        action["params"] = action.get("params") or {}
        if action["requires_approval"] and not action["approved"]:
            outcome.approval_requested = True
            continue
        handler = handlers.get(action["action_type"])
        if handler:
            flush()
            try:
                changed = handler(action, df)
                df = df if changed is None else changed
            except Exception as error:  # a user's handler must not lose the run
                outcome.errors.append((action, str(error)))
        op = action["operation"]
        if action["action_type"] not in NOT_REPAIRS:
            if op == "remove_duplicates":
                flush()
                df = materialize(remove_duplicates(df))
            elif op == "remove_anomalies":
                flush()
                df = materialize(remove_anomalies(df, key=key, cfg=cfg))
            else:
                if any(a["column"] == action["column"] for a in waiting):
                    flush()
                waiting.append(action)
        outcome.executed.append(action)
        if action["action_type"] == "BLOCK":
            outcome.blocked = True
            if stop_on_block:
                break
    flush()
    return df, outcome
