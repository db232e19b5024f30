"""Profiles of a growing table: each file is read once, its state is kept, states are merged.

The state of a file is three tables below a shared folder: `facts` (one row a column: rows,
nulls, bytes, sums over texts, ends of dates), `values` (how often each value of a column
occurs) and `rows` (how often each row digest does). All three merge by addition, so the
profile of any set of files is exact, quartiles, distinct counts and outliers included, and
thresholds may change without a new scan. A file is known by path, size, time and the
table's schema: new and rewritten files are read, the states of vanished ones are ignored.
Each update gives its states names of their own, and a fourth table, `known`, written last,
says which one stands for a file; so states cut short or written twice need no grouping.

Numbers are kept as they are, texts up to `LONGEST` bytes too, longer ones as SHA-256. Pairs
of columns and models need the rows themselves and stay with `profile`.

Defined cases: an empty folder has no columns to profile and raises; a column that is null
everywhere has rows and nulls only; files without rows add nothing.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Profiling
from ..functions.cells import (
    DATETIME,
    NOT_DIGITS,
    NOT_SPACES,
    NOT_SPECIAL,
    NUMERIC,
    TEXTUAL,
    UNKNOWN,
    characters_left,
    kind,
    nan_to_null,
    q,
    row_digest,
    safe_ratio,
    word,
)
from ..operators import categories, numeric, passes, structure
from ..operators.scale import local_frame, materialize, running_total
from ..operators.times import micros
from .profile import Profiles, assemble, label_fields

LONGEST = 1024
FACTS = {
    "rows": "bigint", "nulls": "bigint", "bytes": "bigint", "text_n": "bigint", "text_sum": "bigint",
    "text_squares": "double", "digits": "bigint", "spaces": "bigint", "special": "bigint",
    "low": "bigint", "high": "bigint",
}


def _part(path: str, size: str, time: str, schema: T.StructType) -> F.Column:
    """The name of a file's state; a scheme and its slashes are written in several ways."""
    where = F.regexp_replace(F.col(path), "^[a-z0-9]+:/+", "/")
    shape = hashlib.sha256(schema.simpleString().encode()).hexdigest()
    return F.sha2(F.concat_ws("|", where, F.col(size), F.unix_micros(time), F.lit(shape)), 256)


def _state(part: F.Column, run: str) -> F.Column:
    """The name of the state of a file as one update wrote it."""
    return F.md5(F.concat(part, F.lit(run)))


def _listing(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(path, part) of the files of a folder; no data are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    found = files.load(folder).select("path", "length", "modificationTime")
    return found.select("path", _part("path", "length", "modificationTime", schema).alias("part"))


def _fact_exprs(f: T.StructField) -> dict[str, str]:
    c, k = q(f.name), kind(f.dataType)
    out = {"rows": "count(1)", "nulls": f"count_if({c} IS NULL)", "bytes": structure.byte_size(f)}
    if k == TEXTUAL:
        size = f"char_length({c})"
        out |= {"text_n": f"count({c})", "text_sum": f"sum({size})", "text_squares": f"sum(CAST({size} AS DOUBLE) * {size})"}
        for name, removed in (("digits", NOT_DIGITS), ("spaces", NOT_SPACES), ("special", NOT_SPECIAL)):
            out[name] = f"sum({characters_left(f.name, removed)})"
    elif k == DATETIME:
        t = micros(f.name, f.dataType)
        out |= {"low": f"min({t})", "high": f"max({t})"}
    return out


def _facts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(part, column, facts) of a few columns, one scan."""
    aggs, rows = [], []
    for i, f in enumerate(fields):
        given = _fact_exprs(f)
        aggs += [F.expr(e).alias(f"{k}{i}") for k, e in given.items()]
        cells = ", ".join(f"'{k}', CAST({f'{k}{i}' if k in given else 'NULL'} AS {t})" for k, t in FACTS.items())
        rows.append(f"named_struct('column', {word(f.name)}, {cells})")
    return df.groupBy("part").agg(*aggs).selectExpr("part", f"inline(array({', '.join(rows)}))")


def _values(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(part, column, l, d, s, n) of a few columns, one scan."""
    cells = [passes.value_cell(i, f, False, LONGEST) for i, f in enumerate(fields)]
    names = F.array(*[F.lit(f.name) for f in fields])
    counts = passes.counted(df, cells, ("part",))
    return counts.select("part", F.get(names, F.col("slot")).alias("column"), *passes.KEY, "n")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing has been kept yet
        return None


def update(spark: SparkSession, folder: str, store: str) -> int:
    """Read the files of `folder` that `store` has no state of; returns how many there were."""
    table = spark.read.parquet(folder)
    files = _listing(spark, folder, table.schema)
    known = _read(spark, f"{store}/known")
    new = files if known is None else files.join(known, "part", "left_anti")
    paths = [r.path for r in new.select("path").collect()]
    if not paths:
        return 0
    source = spark.read.schema(table.schema).option("basePath", folder).parquet(*paths)
    named = source.select("*", F.col("_metadata").alias("__file"))
    size, time = (F.col(f"__file.{k}").alias(f"__{k}") for k in ("file_size", "file_modification_time"))
    named = named.select(*table.columns, F.col("__file.file_path").alias("__path"), size, time)
    part = _part("__path", "__file_size", "__file_modification_time", table.schema)
    run = uuid.uuid4().hex
    rows = nan_to_null(named.select(*table.columns, _state(part, run).alias("part")))
    fields = sorted(table.schema.fields, key=lambda f: f.name)
    countable = [f for f in fields if kind(f.dataType) != UNKNOWN]
    facts = [_facts(rows, some) for some in passes.chunks(fields)]
    values = [_values(rows, some) for some in passes.chunks(countable)]
    h1, h2 = row_digest(table.columns, table.schema)
    digests = rows.selectExpr("part", f"{h1} AS h1", f"{h2} AS h2").groupBy("part", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    _union(facts).write.mode("append").parquet(f"{store}/facts")
    if values:
        _union(values).write.mode("append").parquet(f"{store}/values")
    digests.write.mode("append").parquet(f"{store}/rows")
    # last: a file whose state is cut short by a failure is not known, and is read again
    new.select("part", _state(F.col("part"), run).alias("state")).write.mode("append").parquet(f"{store}/known")
    return len(paths)


def _states(spark: SparkSession, store: str, files: DataFrame) -> DataFrame:
    """The states (part) of the given files, one a file; raises if nothing has been kept."""
    known = _read(spark, f"{store}/known")
    if known is None:
        raise ValueError(f"no states in {store}: call update first")
    one = known.groupBy("part").agg(F.min("state").alias("state"))
    return files.select("part").join(one, "part").select(F.col("state").alias("part"))


def _kept(spark: SparkSession, store: str, name: str, parts: DataFrame) -> DataFrame | None:
    """The rows of the given states."""
    found = _read(spark, f"{store}/{name}")
    return None if found is None else found.join(parts, "part", "left_semi")


def _numbers(values: DataFrame, names: list[str], cfg: Profiling) -> tuple[dict, dict]:
    """Numeric statistics and behaviour from value counts: ({column: fields}, {column: fields})."""
    x = F.coalesce("d", F.col("l").cast("double"), F.col("s").cast("double"))
    some = values.where(F.col("column").isin(names)).select("column", x.alias("x"), "n")
    counts = materialize(some.groupBy("column", "x").agg(F.sum("n").alias("n")))
    base = counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("total"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum(F.when(F.col("x") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.count(F.lit(1)).alias("distinct"),
    )
    stats: dict[str, dict] = {c: {"n": 0} for c in names}
    for r in base.orderBy("column").collect():
        stats[r["column"]] = r.asDict() | {"mean": r.total / r.n}
    live = [c for c in names if stats[c]["n"] and stats[c]["min"] != stats[c]["max"]]
    if not live:
        found = numeric.assembled(names, stats, {}, {})
        return found, numeric.numeric_behavior(counts, found, cfg)
    means = local_frame(counts.sparkSession, [(c, stats[c]["mean"]) for c in live], "column string, mean double")
    d = F.col("x") - F.col("mean")
    powers = counts.join(F.broadcast(means), "column").groupBy("column").agg(
        *[F.sum(F.pow(d, F.lit(float(k))) * F.col("n")).alias(f"p{k}") for k in (1, 2, 3, 4)]
    )
    sums = {r["column"]: [r[f"p{k}"] for k in (1, 2, 3, 4)] for r in powers.collect()}
    found = numeric.assembled(names, stats, sums, _quartiles(counts, stats, live))
    ready = {c: s for c, s in found.items() if s["n"] >= cfg.min_rows_numeric_behavior}
    tests = {c: numeric.outlier_condition("x", s, cfg) for c, s in ready.items()}
    cases = " ".join(f"WHEN `column` = {word(c)} THEN {t}" for c, t in tests.items() if t is not None)
    hits = {}
    if cases:
        out = counts.groupBy("column").agg(F.expr(f"sum(CASE WHEN CASE {cases} ELSE false END THEN n ELSE 0 END)").alias("out"))
        hits = {r["column"]: r.out for r in out.collect()}
    return found, {c: numeric.behavior_of(s, hits.get(c, 0)) for c, s in ready.items()}


def _quartiles(counts: DataFrame, stats: dict, live: list[str]) -> dict[tuple[str, float], float]:
    """Exact quartiles from value counts: a running total over (column, value) gives the
    ranks that each value covers, and the wanted ranks meet theirs by a small join."""
    start, wanted = 0, []
    for c in sorted(stats):
        n = stats[c]["n"]
        if c in live:
            for p in numeric.QUARTILES:
                low, high, _ = numeric.positions(n, p)
                wanted += [(c, p, end, start + k) for end, k in (("low", low), ("high", high))]
        start += n
    keyed = counts.select(F.struct("column", "x").alias("key"), "n")
    distinct = sum(s.get("distinct", 0) for s in stats.values())
    ranked = running_total(keyed, "key", "n", at_most=distinct).select("key.column", "key.x", "n", "before")
    ranks = local_frame(counts.sparkSession, wanted, "column string, p double, end string, rank bigint")
    hit = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    found = {(r["column"], r.p, r.end): r.x for r in ranked.join(F.broadcast(ranks), "column").where(hit).collect()}
    out = {}
    for c in live:
        for p in numeric.QUARTILES:
            a, b = found[c, p, "low"], found[c, p, "high"]
            out[c, p] = a if a == b else a + (b - a) * numeric.positions(stats[c]["n"], p)[2]
    return out


def _prose(s: dict) -> tuple:
    n, total = s["text_n"], s["text_sum"]
    if not n:
        return (0.0,) * 5
    spread = math.sqrt(max(s["text_squares"] - total * total / n, 0.0) / (n - 1)) if n > 1 else None
    return (total / n, spread, *[s[k] / total if total else 0.0 for k in ("digits", "spaces", "special")])


def stored_profile(
    spark: SparkSession,
    folder: str,
    store: str,
    cfg: Config | Profiling = Profiling(),
    run_id: str = "run",
    dataset_id: str = "dataset",
) -> Profiles:
    """The profile of all files now in `folder`, from their kept states alone."""
    cfg = cfg.profiling if isinstance(cfg, Config) else cfg
    empty = spark.read.parquet(folder).limit(0)
    schema = empty.schema
    parts = _states(spark, store, _listing(spark, folder, schema))
    facts = _kept(spark, store, "facts", parts)
    merged = facts.groupBy("column").agg(
        *[F.sum(k).alias(k) for k in FACTS if k not in ("low", "high")], F.min("low").alias("low"), F.max("high").alias("high")
    )
    none = dict.fromkeys(FACTS) | dict.fromkeys(("rows", "nulls", "bytes", "text_n"), 0)
    seen = {f.name: dict(none) for f in schema.fields} | {r["column"]: r.asDict() for r in merged.collect()}
    fields = {f.name: f for f in schema.fields}
    found = {
        c: {
            "dtype": fields[c].dataType.simpleString(), "row_count": s["rows"], "null_count": s["nulls"],
            "null_ratio": s["nulls"] / s["rows"] if s["rows"] else 0.0, "bytes": s["bytes"],
        }
        for c, s in sorted(seen.items())
    }
    kept = _kept(spark, store, "values", parts)
    columns = structure.countable(empty)
    stats: dict[str, dict] = {}
    if kept is not None:
        values = materialize(kept.groupBy("column", *passes.KEY).agg(F.sum("n").alias("n")))
        slots = local_frame(spark, [(c, i) for i, c in enumerate(columns)], "column string, slot int")
        totals = [seen[c]["rows"] - seen[c]["nulls"] if kind(fields[c].dataType) == TEXTUAL else 0 for c in columns]
        rows = passes.label_stats(values.join(F.broadcast(slots), "column"), totals, cfg).collect()
        stats = {columns[r.slot]: r.asDict() for r in rows}
    types, close = categories.sketched_types(
        empty, cfg, {c: {"n": 0, "mean": 0.0, "approx": 0} for c in fields if kind(fields[c].dataType) == TEXTUAL}
    )
    for c in columns:
        s, n = stats.get(c), seen[c]["rows"] - seen[c]["nulls"]
        if kind(fields[c].dataType) == TEXTUAL:
            types[c] = categories.string_type(n, seen[c]["text_sum"] / n if n else 0.0, s["distinct_count"] if s else 0, cfg)
        found[c]["distinct_count"] = s["distinct_count"] if s else 0
        if types[c] == "categorical" and s:
            found[c] |= label_fields(s, n)
        elif types[c] == "text":
            found[c]["text"] = _prose(seen[c])
    numbers = [c for c in columns if kind(fields[c].dataType) == NUMERIC]
    if numbers and kept is not None:
        numeric_stats, behavior = _numbers(values, numbers, cfg)
        for c, fields_ in numeric_stats.items():
            found[c]["numeric"] = tuple(fields_[f] for f in numeric.NUMERIC_FIELDS)
        for c, b in behavior.items():
            found[c]["behavior"] = tuple(b.values())
    dates = [c for c in columns if types[c] == "datetime"]
    for c, ends in passes.date_stats(empty, seen, dates).items():
        found[c]["datetime"] = (*ends, None)
    for c in found:
        found[c]["logical_type"] = types[c]
    digests = _kept(spark, store, "rows", parts).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    look = structure.row_sums(digests).first()
    mark = structure.fingerprint_of(schema, look.row_count, look.row_xor, look.row_sum)
    return assemble(spark, (run_id, dataset_id), found, cfg, look.duplicate_row_ratio, mark)
