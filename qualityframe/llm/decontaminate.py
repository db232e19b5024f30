"""Benchmark decontamination: spaced-seed hashing with verified overlaps.

Method. A text becomes hashes of its words. At every position a few fixed masks read
some of the next words and ignore the others, so a substituted word at an ignored
position does not hide a match. Seeds of documents meet equal seeds of benchmark items;
a meeting names a diagonal (item, offset), and along it a window of `window` words slides
over the item: the pair counts if one window has `share` of its words equal.

A window of n words tolerates t = n - ceil(share * n) substitutions. Two masks of five
words leave no window of 12 or 13 words with two substitutions without a seed. For any
other window its words are dealt to t + 2 groups and each mask reads two of them: t
substitutions leave two groups whole, so one mask reads equal words only. Windows without
a tolerated substitution (up to four words) are one seed. Documents are read with the
masks of the item lengths that the benchmark holds, no others.

Two bitmaps of fixed size keep the seeds of clean documents out of the shuffle: words
of the benchmark and seeds of the benchmark. They have false positives only, which the
join removes; a benchmark that fills them costs time, not matches. A diagonal carries the
words beside its item, not the document.

Defined cases: words are runs of letters and digits, lower-cased; null and empty texts
and items without a word match nothing; items shorter than the window are compared over
all their words, so an item of one word is found wherever that word stands; equal items
are reported each; repeated documents get the same rows, joined by distinct.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, stored, whole

MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
WINDOW = 13
SHARE = 0.8
WORD_BITS = 17
SEED_BITS = 20
#: Every word is tested, so one bit must do; few seeds are, and a second bit is cheap.
WORD_SHIFTS, SEED_SHIFTS = (0,), (0, 26)


def masks_for(n: int, share: float = SHARE) -> tuple[tuple[int, ...], ...]:
    """Masks of which one reads equal words only, in any tolerated window of n words."""
    gone = n - math.ceil(share * n)
    if n in (12, 13) and gone <= 2:
        return MASKS
    if gone <= 0:
        return (tuple(range(n)),)
    groups = [range(g, n, gone + 2) for g in range(gone + 2)]
    read = {tuple(sorted([*x, *y])) for x, y in combinations(groups, 2)}
    return tuple(sorted({tuple(o - m[0] for o in m) for m in read if m}))


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+", -1), "")


def _seed(at: str, mask: tuple[int, ...]) -> str:
    """Hash of the words that a mask reads at position i, its offsets included."""
    known = " AND ".join(f"element_at({at}, i + {o}) IS NOT NULL" for o in mask)
    read = ", ".join(f"element_at({at}, i + {o})" for o in mask)
    return f"if({known}, xxhash64('{mask}', {read}), NULL)"


def seeds(hashes: str, masks: tuple[tuple[int, ...], ...]) -> str:
    """SQL: array of (at, seed) for all masks at all positions; nulls give no seed."""
    span = 1 + max(m[-1] for m in masks)
    if any(m[-1] + 1 != span for m in masks):  # one search of the positions for each span
        spans = sorted({m[-1] for m in masks})
        return f"concat({', '.join(seeds(hashes, tuple(m for m in masks if m[-1] == s)) for s in spans)})"
    common = sorted(set.intersection(*map(set, masks)))
    open_ = " AND ".join(f"element_at({hashes}, i + {o}) IS NOT NULL" for o in common)
    places = f"filter(if(size({hashes}) >= {span}, sequence(1, size({hashes}) - {span - 1}), cast(array() AS array<int>)), i -> {open_})"
    each = [
        f"filter(transform({places}, i -> named_struct('at', i, 'seed', {_seed(hashes, m)})), s -> s.seed IS NOT NULL)"
        for m in masks
    ]
    return f"concat({', '.join(each)})"


def _spot(value: str, bits: int, shift: int) -> tuple[str, str]:
    """The long of a bitmap that holds a bit of a value, and the bit, as SQL."""
    part = f"shiftright({value}, {shift})" if shift else value
    return f"cast(shiftright({part} & {(1 << bits) - 1}L, 6) AS int)", f"cast({part} & 63L AS int)"


def bitmap(values: DataFrame, column: str, bits: int, shifts: tuple[int, ...]) -> str:
    """SQL for an array of 2 ** bits bits as longs, with the bits of all values set, one
    bit of a value for each shift.

    At most 2 ** bits / 64 rows come to the driver, whatever the input.
    """
    held = values.where(F.col(column).isNotNull())
    spots = ", ".join(f"struct({at} AS at, shiftleft(1L, {bit}) AS bit)" for at, bit in (_spot(f"`{column}`", bits, k) for k in shifts))
    lane = held.selectExpr(f"inline(array({spots}))")
    lanes = [0] * ((1 << bits) // 64)
    for at, lane_bits in lane.groupBy("at").agg(F.bit_or("bit")).collect():
        lanes[at] = lane_bits
    return f"cast(split('{','.join(map(str, lanes))}', ',') AS array<bigint>)"


def in_bitmap(lanes: str, value: str, bits: int, shifts: tuple[int, ...]) -> str:
    spots = (_spot(value, bits, k) for k in shifts)
    return " AND ".join(f"getbit(get({lanes}, {at}), {bit}) = 1" for at, bit in spots)


def prepared(items: DataFrame, key: str, text: str, window: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(row, key, words as hashes) of the benchmark, and its seeds (seed, row, at, n), each
    item by the masks of its own window; n is the number of words. Both are stored."""
    hashed = items.select(F.col(key).alias("item"), words(text).alias("w"))
    hashed = hashed.select("item", F.expr("transform(w, x -> xxhash64(x))").alias("item_words")).distinct()
    hashed = stored(hashed.withColumn("item_row", F.monotonically_increasing_id()), "benchmark")
    n = f"least(size(item_words), {window})"
    by_length = " ".join(f"WHEN {k} THEN {seeds('item_words', masks_for(k, share))}" for k in range(1, window + 1))
    found = hashed.where("size(item_words) > 0").select(
        "item_row", F.size("item_words").alias("n"), F.expr(f"inline(CASE {n} {by_length} END)")
    )
    return hashed, stored(found.select("seed", "item_row", F.col("at").alias("item_at"), "n").distinct(), "seeds")


def candidates(
    docs: DataFrame, hashed: DataFrame, found: DataFrame, key: str, text: str, window: int, share: float
) -> DataFrame:
    """(row, key, text hash, words as hashes, seeds) of documents that may match."""
    vocabulary = bitmap(hashed.select(F.explode("item_words").alias("h")), "h", WORD_BITS, WORD_SHIFTS)
    known = bitmap(found, "seed", SEED_BITS, SEED_SHIFTS)
    lengths = [r.n for r in found.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()]  # at most `window`
    masks = tuple(sorted({m for n in lengths for m in masks_for(n, share)})) or MASKS
    read = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(whole(text)).alias("text_hash"),
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"),
    )
    marked = read.withColumn("k", F.expr(f"transform(h, x -> if({in_bitmap(vocabulary, 'x', WORD_BITS, WORD_SHIFTS)}, x, NULL))"))
    seeded = marked.withColumn("seeds", F.expr(f"filter({seeds('k', masks)}, s -> {in_bitmap(known, 's.seed', SEED_BITS, SEED_SHIFTS)})"))
    # a generator, as a filter would be pushed down and would repeat all of the above
    some = F.expr("explode(if(size(seeds) > 0, array(named_struct('h', h, 'seeds', seeds)), array()))")
    few = seeded.select("key", "text_hash", some.alias("x")).select("key", "text_hash", "x.*")
    return stored(few.withColumn("row", F.monotonically_increasing_id()), "candidates")


def diagonals(few: DataFrame, found: DataFrame) -> DataFrame:
    """(row, key, text hash, item row, offset, beside): each diagonal once, with the words of
    the document that lie beside the item; the first of them is word 1 + max(offset, 0)."""
    hits = few.select("row", F.expr("inline(seeds)")).join(found, "seed")
    lines = hits.select("row", "item_row", "n", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    beside = "slice(h, greatest(offset, 0) + 1, n + least(offset, 0))"
    return lines.join(few.drop("seeds"), "row").select("row", "key", "text_hash", "item_row", "offset", F.expr(beside).alias("beside"))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """(key, text_hash, item, equal_words, window_words): documents that hold an item.

    equal_words is the best window of the best diagonal.
    """
    hashed, found = prepared(items, item_key, item_text, window, share)
    few = candidates(docs, hashed, found, key, text, window, share)
    beside = diagonals(few, found).join(hashed, "item_row")
    # along the diagonal: equal words, then a running count over the last `span` of them
    equal = "transform(item_words, (x, i) -> if(coalesce(get(beside, i + least(offset, 0)) = x, false), 1, 0))"
    now = "a.now + e - if(a.i > span, element_at(equal, a.i - span), 0)"
    best = f"""aggregate(equal, named_struct('i', 1, 'now', 0, 'best', 0),
        (a, e) -> named_struct('i', a.i + 1, 'now', {now}, 'best', greatest(a.best, {now})),
        a -> a.best)"""
    scored = (
        beside.withColumn("span", F.least(F.size("item_words"), F.lit(window)))
        .withColumn("equal", F.expr(equal))
        .withColumn("best", F.expr(best))
        .where(F.col("best") >= F.ceil(F.col("span") * F.lit(share)))
    )
    pairs = scored.groupBy("row", "item").agg(
        F.first("key").alias("key"),
        F.first("text_hash").alias("text_hash"),
        F.max("best").alias("equal_words"),
        F.max("span").alias("window_words"),
    )
    return pairs.select("key", "text_hash", "item", "equal_words", "window_words")


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; other columns may have any name."""

    def step(rows: DataFrame) -> DataFrame:
        leaks = overlaps(rows, items, key, text).select("key", "text_hash").distinct().toDF("__key", "__text_hash")
        same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(whole(text)) == F.col("__text_hash"))
        return rows.join(stored(leaks, "leaks"), same, "left_anti")

    return apart(docs, step, key, text)


def op6(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    found = overlaps(docs, items).select(
        F.col("key").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("equal_words").cast("long").alias("equal_words"),
        F.col("window_words").cast("long").alias("window_words"),
    )
    return found.distinct()


OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM i),
m AS (SELECT doc_id, item_id, n, dw.p - iw.p AS o, iw.p AS p FROM dw JOIN iw USING (x)),
c AS (SELECT doc_id, item_id, least(n, {WINDOW}) AS n, count(*) OVER (
    PARTITION BY doc_id, item_id, o ORDER BY p RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS e FROM m)
SELECT doc_id, item_id, max(e)::BIGINT AS equal_words, max(n)::BIGINT AS window_words FROM c
GROUP BY doc_id, item_id HAVING max(e) >= ceil({SHARE} * max(n))
"""
