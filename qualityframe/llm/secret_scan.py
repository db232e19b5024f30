"""Secret scans: fixed patterns plus sliding-window entropy, as DataFrame expressions.

Method. Candidate strings are long runs of key characters. In each class of characters
(hex digits, key characters) a window slides over the run; counts of the window's
characters and the sum of c * log2(c) are carried from step to step, so a step adds
one character, removes one, and reads off the Shannon entropy. The span of a run is
from its first to its last window at or over the class's entropy. Runs that an
allow-list pattern covers are suppressed; the fixed patterns are never suppressed.

Defined cases: a null or empty text has no span; positions are code points, ends are
exclusive; repeated rows each get a row; other columns pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import word
from . import spans
from .common import apart, whole

# Kinds of secrets in the order in which their spans are listed, the
# pattern of each, the group whose length counts, and the least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
}
ENTROPY = "entropy"


@dataclass(frozen=True)
class Class:
    """A class of characters, the window that slides over it and its least entropy."""

    pattern: str
    alphabet: str
    window: int
    bits: float


DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    Class(r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])", DIGITS + "abcdefABCDEF", 20, 3.2),
    Class(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", DIGITS + LETTERS + LETTERS.upper() + "+/_=-", 24, 4.0),
)
#: Runs that look random but are not secret: plain numbers, UUIDs, letters only in one
#: case, words joined by dashes or slashes, alphabets, documentation examples.
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[/_=+-]*([A-Za-z]?[a-z]*|[0-9]{1,4})([/_=+-]+([A-Za-z]?[a-z]*|[0-9]{1,4}))*$",
    r"(?i)abcdefghij|0123456789|example|placeholder|xxxxxx",
)


def base(text: str) -> dict[str, Column]:
    """Spans of each fixed kind, matches that are too short dropped."""

    def long_enough(pattern: str, group: int, least: int) -> Column:
        return F.filter(spans.matches(text, pattern, group), lambda s: F.length(s["part"]) >= least)

    return {kind: long_enough(*rule) for kind, rule in BASE.items()}


def random_runs(text: str, kind: Class, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans (start, end, bits) in runs of one class where a window reaches its entropy."""
    w, size = kind.window, len(kind.alphabet)
    # c * log2(c) for every count a window can hold
    terms = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(w + 2)) + ")"
    letters = word(kind.alphabet)
    come = f"instr({letters}, element_at(r.chars, i)) - 1"
    gone = f"if(i > {w}, instr({letters}, element_at(r.chars, i - {w})) - 1, -1)"
    # an entering character turns count c into c + 1, a leaving one c into c - 1
    step = f"""aggregate(
        sequence(1, size(r.chars)),
        named_struct('n', array_repeat(0, {size}), 'sum', 0D, 'first', -1, 'last', -1, 'most', 0D),
        (a, i) -> aggregate(
            array({gone}, {come}),
            named_struct('n', a.n, 'sum', a.sum, 'leaves', true),
            (b, k) -> if(k < 0, named_struct('n', b.n, 'sum', b.sum, 'leaves', false), named_struct(
                'n', transform(b.n, (c, j) -> if(j = k, if(b.leaves, c - 1, c + 1), c)),
                'sum', b.sum - element_at({terms}, element_at(b.n, k + 1) + 1)
                    + element_at({terms}, element_at(b.n, k + 1) + if(b.leaves, 0, 2)),
                'leaves', false)),
            b -> named_struct(
                'n', b.n, 'sum', b.sum,
                'first', if(a.first < 0 AND i >= {w} AND {math.log2(w)!r}D - b.sum / {w} >= {kind.bits}D, i - {w}, a.first),
                'last', if(i >= {w} AND {math.log2(w)!r}D - b.sum / {w} >= {kind.bits}D, i, a.last),
                'most', if(i >= {w}, greatest(a.most, {math.log2(w)!r}D - b.sum / {w}), a.most))),
        a -> named_struct('start', r.start + a.first, 'end', r.start + a.last, 'first', a.first, 'bits', a.most))"""
    refused = " OR ".join(f"s.match RLIKE {word(p)}" for p in allowed) or "false"
    runs = f"transform(filter(__runs, s -> NOT ({refused})), s -> named_struct('start', s.start, 'chars', split(s.match, '')))"
    found = f"filter(transform({runs}, r -> {step}), s -> s.first >= 0)"
    return F.expr(found.replace("__runs", f"`{text}`"))


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows of `docs` with __base and __all, arrays of (start, rank, end, kind).

    __all is sorted by start and then by kind; __base likewise, without entropy spans.
    """
    out = docs.withColumn("__text", whole(text))
    fixed = base("__text")
    for kind, found in fixed.items():
        out = out.withColumn(f"__{kind}", found)
    for i, kind in enumerate(CLASSES):
        out = out.withColumn(f"__runs{i}", spans.matches("__text", kind.pattern))
        out = out.withColumn(f"__random{i}", random_runs(f"__runs{i}", kind, allowed))
    listed = F.concat(*[spans.named(F.col(f"__{k}"), k, r) for r, k in enumerate(fixed)])
    random = F.concat(*[spans.named(F.col(f"__random{i}"), ENTROPY, len(fixed)) for i in range(len(CLASSES))])
    counts = F.create_map(*[x for k in fixed for x in (F.lit(k), F.size(f"__{k}").cast("long"))])
    out = out.withColumn("__base", F.array_sort(listed)).withColumn("__n", counts)
    out = out.withColumn("__all", F.array_sort(F.array_distinct(F.concat("__base", random))))
    return out.select(*docs.columns, "__base", "__all", "__n")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced; a null text stays null. Other columns
    keep their values, whatever their names."""

    def step(rows: DataFrame) -> DataFrame:
        found = scan(rows, text)
        clean = F.when(F.size("__all") > 0, spans.masked(text, "__all", mark)).otherwise(F.col(text))
        return found.withColumn("__clean", clean).select(
            *[F.col("__clean").alias(c) if c == text else F.col(c) for c in rows.columns]
        )

    return apart(docs, step, text)


def op2(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.col("__n")[k].alias(f"n_{k}") for k in BASE],
        F.sha2(spans.written(F.col("__base")), 256).alias("base_sha256"),
        spans.written(F.col("__all")).alias("spans"),
    )
