"""Where patterns match in a text, as DataFrame expressions.

`split` gives the text between the matches and `regexp_extract_all` the matches; their
lengths in code points add up to positions. Matches are leftmost and do not overlap.

An expression that appends to an array copies it, so running sums are taken over chunks of
matches and then over the chunks: a text of n matches costs n * CHUNK + (n / CHUNK) ** 2
copied values, and replacing n spans reads the text once for each chunk, not for each span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import word

CHUNK = 128
SPAN = "struct<start:int,end:int,match:string,part:string,gap:string>"


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body`, in which `name` is `value`, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _chunks(size: str) -> str:
    """SQL for the numbers from 0 of the chunks of an array; one that is empty has one."""
    return f"sequence(0, greatest({size} - 1, 0) div {CHUNK})"


def matches(text: str, pattern: str, part: int = 0) -> Column:
    """Array of (start, end, match, part, gap) for a pattern that never matches nothing.

    `text` is a column name, `part` the group to return beside the match, and gap the
    text since the match before. Texts without a match cost one search.
    """
    regex, t = word(pattern), f"`{text}`"
    parts = f"regexp_extract_all({t}, {regex}, {part})"
    pairs = f"""filter(zip_with(zip_with(regexp_extract_all({t}, {regex}, 0), {parts}, (m, p) -> named_struct('m', m, 'p', p)),
        split({t}, {regex}, -1), (x, g) -> named_struct('m', x.m, 'p', x.p, 'g', g)), x -> x.m IS NOT NULL)"""
    chunks = f"transform({_chunks('size(a)')}, c -> slice(a, c * {CHUNK} + 1, {CHUNK}))"
    widths = "transform(b, c -> aggregate(c, 0, (w, x) -> w + length(x.g) + length(x.m)))"
    before = "aggregate(d.widths, array(0), (w, x) -> array_append(w, element_at(w, -1) + x))"
    inside = f"""aggregate(c,
        named_struct('at', get(e.before, i), 'out', cast(array() AS array<{SPAN}>)),
        (a, x) -> named_struct(
            'at', a.at + length(x.g) + length(x.m),
            'out', array_append(a.out, named_struct(
                'start', a.at + length(x.g), 'end', a.at + length(x.g) + length(x.m),
                'match', x.m, 'part', x.p, 'gap', x.g))),
        a -> a.out)"""
    found = _let(pairs, "a", _let(chunks, "b", _let(f"named_struct('chunks', b, 'widths', {widths})", "d", _let(
        f"named_struct('chunks', d.chunks, 'before', {before})", "e", f"flatten(transform(e.chunks, (c, i) -> {inside}))"))))
    return F.expr(f"CASE WHEN {t} RLIKE {regex} THEN {found} ELSE cast(array() AS array<{SPAN}>) END")


def named(spans: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank, end, kind), which sort by start and then by kind."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(text: str, spans: str, mark: str) -> Column:
    """The text with each span replaced; `spans` is a column sorted by start.

    Overlapping spans become one mark.
    """
    t, all_ = f"`{text}`", f"`{spans}`"
    chunks = f"transform({_chunks(f'size({all_})')}, c -> slice({all_}, c * {CHUNK} + 1, {CHUNK}))"
    # where the text up to the spans of the chunks before is done; the last is the end of all
    done = "aggregate(b, array(0), (w, c) -> array_append(w, greatest(element_at(w, -1), coalesce(array_max(transform(c, s -> s.end)), 0))))"
    inside = f"""aggregate(c,
        named_struct('at', 0, 'out', ''),
        (a, s) -> CASE
            WHEN s.end - p.first <= a.at THEN a
            WHEN s.start - p.first < a.at THEN named_struct('at', s.end - p.first, 'out', a.out)
            ELSE named_struct('at', s.end - p.first, 'out',
                concat(a.out, substring(p.text, a.at + 1, s.start - p.first - a.at), {word(mark)})) END,
        a -> a.out)"""
    piece = "named_struct('first', get(d.done, i), 'text', substring({t}, get(d.done, i) + 1, get(d.done, i + 1) - get(d.done, i)))"
    parts = f"transform(d.chunks, (c, i) -> {_let(piece.format(t=t), 'p', inside)})"
    whole = f"concat(array_join({parts}, ''), substring({t}, element_at(d.done, -1) + 1))"
    return F.expr(_let(chunks, "b", _let(f"named_struct('chunks', b, 'done', {done})", "d", whole)))
