"""Near duplicates among embeddings: spherical-cap filters from random product codes.

Method. Unit vectors are turned by random rotations and cut into blocks. Under each rotation
a block has its own random code; a filter direction is one codeword of every block, so a few
hundred codewords give as many directions as there are vectors. A vector is list-decoded to
all directions whose inner product with it reaches `height`. Vectors meet in the caps they
share; `height` is the one at which 99.5 % of made pairs with a cosine of exactly 0.95 share
a cap, and closer pairs share one more often. Several rotations even out vectors whose
length sits in one block, which under a single one would need four times the caps.

Caps are joined on rows of an id and a 128-bit sign sketch. Pairs whose sketches differ in
no more bits than a pair at 0.95 does but once in a million are candidates, thinned to a
spanning forest as they are found. Vectors travel only then, once for each group of
candidates that hang together, where every pair is verified by its cosine in doubles.
A group of more than `CROWD` vectors is verified cap by cap instead, each pair in the first
cap it shares, if that compares fewer pairs; caps and groups beyond `CROWD` are compared
block against block. Links leave a task as counts and a spanning forest, not as pairs.

Equal vectors are one class from the start, so copies never meet in pairs; they count as
links of each other. Work on one group grows with the square of its different vectors.

Defined cases: a vector that is null, empty, zero, holds a null or non-finite entry, or has
another length than the commonest (ties to the longer) links with nothing and is its own
component; a null id keeps its row, counts as a link, is ignored by the smallest id, and is
not `kept`; repeated rows each get a row; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import acos, ceil, comb, pi, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import forest, in_blocks, star_components
from .whitening import CELLS_AT_ONCE, dimension, matrix, slices as cut_batches

COSINE = 0.95
FOUND = 0.995
PAIRS = 2000
ROTATIONS = 32
CODEWORDS = 1024
LEAST_FILTERS = 64
SIGNS = 128
MISSED = 1e-6
CROWD = 1024
ROWS_AT_ONCE = 1 << 15
PAIRS_AT_ONCE = 1 << 20
SEED = 13


# ---- the filters --------------------------------------------------------------------


@dataclass(frozen=True)
class Filters:
    """Rotations, each with one code for each block of dimensions, and the caps' height."""

    turns: list[np.ndarray]
    codes: list[list[np.ndarray]]
    height: float

    def decoded(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every direction whose inner product reaches the height."""
        size = max(prod(len(c) for c in code) for code in self.codes)
        found = [listed(units @ turn, code, self.height) for turn, code in zip(self.turns, self.codes)]
        rows = np.concatenate([row for row, _ in found])
        return rows, np.concatenate([code + k * size for k, (_, code) in enumerate(found)])


def listed(turned: np.ndarray, code: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
    """List decoding: a partial direction is kept while the best codewords of the blocks
    to come could still lift it to the height."""
    edges = np.cumsum([0, *(c.shape[1] for c in code)])
    products = [turned[:, a:b] @ c.T for a, b, c in zip(edges, edges[1:], code)]
    ahead = np.zeros((len(products) + 1, len(turned)))
    for k in range(len(products) - 1, -1, -1):
        ahead[k] = ahead[k + 1] + products[k].max(axis=1, initial=-1)
    row, word, reached = np.arange(len(turned)), np.zeros(len(turned), np.int64), np.zeros(len(turned))
    for k, block in enumerate(products):
        step = max(1, CELLS_AT_ONCE // block.shape[1])
        parts = []
        for start in range(0, max(1, len(row)), step):
            at = slice(start, start + step)
            least = height - reached[at] - ahead[k + 1][row[at]]
            i, j = np.nonzero(block[row[at]] >= least[:, None])
            parts.append((row[at][i], word[at][i] * block.shape[1] + j, reached[at][i] + block[row[at][i], j]))
        row, word, reached = (np.concatenate(p) for p in zip(*parts))
    return row, word


def codes(size: int, filters: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One code a block; their product has at least `filters` directions."""
    blocks = min(2, size)
    while blocks < size and filters > CODEWORDS**blocks:
        blocks += 1
    words = ceil(filters ** (1 / blocks))
    out = []
    for part in np.array_split(np.arange(size), blocks):
        code = rng.standard_normal((words, len(part)))
        out.append(code * (sqrt(len(part) / size) / np.linalg.norm(code, axis=1, keepdims=True)))
    return out


def made_pairs(size: int, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and partners at exactly that cosine."""
    a = rng.standard_normal((PAIRS, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if size == 1:
        return a, a
    b = rng.standard_normal((PAIRS, size))
    b -= a * (a * b).sum(axis=1, keepdims=True)
    return a, cosine * a + sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@cache
def fitted(size: int, vectors: int, cosine: float = COSINE, found: float = FOUND) -> Filters:
    """About one filter a vector, at the greatest height that finds that share of pairs.

    The rotation makes any pair at that cosine as good as a random one, so the height
    depends on the dimension and the number of filters, never on the data.
    """
    rng = np.random.default_rng(SEED)
    turns = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(ROTATIONS)]
    words = [codes(size, max(LEAST_FILTERS, vectors // ROTATIONS), rng) for _ in turns]
    a, b = made_pairs(size, cosine, rng)

    def share(height: float) -> float:
        caps = Filters(turns, words, height)
        (i, x), (j, y) = caps.decoded(a), caps.decoded(b)
        both = np.intersect1d(i * (1 << 40) + x, j * (1 << 40) + y) >> 40
        return len(np.unique(both)) / len(a)

    high = low = 0.9
    while share(low) < found:
        high, low = low, low - 0.05
    for _ in range(6):
        middle = (low + high) / 2
        low, high = (middle, high) if share(middle) >= found else (low, middle)
    return Filters(turns, words, low)


def most_different(cosine: float) -> int:
    """The bits of two sketches that a pair at that cosine exceeds with a chance below `MISSED`."""
    p = acos(cosine) / pi
    left = 1.0
    for k in range(SIGNS + 1):
        left -= comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
        if left < MISSED:
            return k
    return SIGNS


@cache
def planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((size, SIGNS))


def units(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in doubles; safe for huge and tiny entries."""
    values = values.astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True, initial=0)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


# ---- classes of equal vectors -------------------------------------------------------


def marked(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """key and x, the bytes of a usable vector, else null."""
    single = "float" in df.schema[vector].dataType.simpleString()
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, width):
            at, values = matrix(batch.column(1), width)
            some = values.any(axis=1)
            out: list[bytes | None] = [None] * batch.num_rows
            # adding zero makes one of the two zeros
            for i, row in zip(at[some].tolist(), (values[some] + 0.0).astype(kind)):
                out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "x"])

    read = df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return read.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, x binary")


def digest() -> Column:
    """128 bits of the SHA-256 of a vector's bytes."""
    return F.unhex(F.substring(F.sha2("x", 256), 1, 32))


def rows_of(packed: list[bytes], width: int) -> np.ndarray:
    """The vectors of a list of their bytes, as doubles."""
    kind = np.float32 if packed and len(packed[0]) == 4 * width else np.float64
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), width).astype(np.float64)


def lists(classes: DataFrame, width: int, caps: Filters) -> DataFrame:
    """cls, its sketch s0 and s1, and `found`, its filters in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, width):
            rows = units(rows_of(batch.column(1).to_pylist(), width))
            signs = np.packbits(rows @ planes(width) > 0, axis=1).view(np.int64)
            row, code = caps.decoded(rows)
            order = np.lexsort((code, row))
            ends = np.searchsorted(row[order], np.arange(len(rows) + 1))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order]))
            made = [pa.array(np.ascontiguousarray(signs[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, found], ["cls", "s0", "s1", "found"])

    return classes.select("cls", "x").mapInArrow(run, "cls long, s0 long, s1 long, found array<long>")


# ---- candidates and links -----------------------------------------------------------


def streamed(width: int, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], at_once: int):
    """A step for rows sorted by their first `width` columns that hands whole groups on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < at_once:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(rows, bool)  # the last group may go on
            for k in range(width):
                column = table.column(k).to_numpy()
                same &= column == column[-1]
            cut = int(same.argmax())
            if cut:
                yield from solve(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: links of a spanning forest; `ids` are sorted."""
    root = forest(len(ids), i, j)
    node = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[node]], ids[node]


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """(a, b), a < b: pairs of a bucket with similar sketches, thinned to a forest a task."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, cls, s0, s1 = (table.column(k).to_numpy() for k in range(4))
        ids, place = np.unique(cls, return_inverse=True)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        active, step, pending = np.arange(len(cls)), 1, 0
        while True:
            active = active[active + step < len(cls)]
            active = active[bucket[active + step] == bucket[active]]
            if not len(active):
                break
            other = active + step
            bits = np.bitwise_count((s0[active] ^ s0[other]).view(np.uint64)).astype(np.int64)
            bits += np.bitwise_count((s1[active] ^ s1[other]).view(np.uint64))
            hit = bits <= most
            near.append((place[active[hit]], place[other[hit]]))
            pending += int(hit.sum())
            if pending >= PAIRS_AT_ONCE:
                root = forest(len(ids), *(np.concatenate([p[k] for p in near]) for k in (0, 1)))
                node = np.flatnonzero(root != np.arange(len(ids)))
                near, pending = [(root[node], node)], 0
            step += 1
        if near:
            a, b = spanning(ids, *(np.concatenate([p[k] for p in near]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = rows.select("bucket", "cls", "s0", "s1").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(streamed(1, solve, ROWS_AT_ONCE), "a long, b long").distinct()


def members(links: DataFrame) -> DataFrame:
    """(cls, root) of every class that has a link."""
    stars = stored(star_components(links).select(F.col("node").alias("cls"), "root"), "members")
    return stars.unionByName(stars.select(F.col("root").alias("cls"), "root").distinct())


def groups_to_verify(inside: DataFrame, found: DataFrame, crowd: int) -> DataFrame:
    """cls with root, f, i, j: the groups in which its pairs are compared. f is a filter, or
    -1 where all pairs of a root are; i and j are the blocks that a group compares."""
    sizes = inside.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > crowd), "crowds")
    whole = F.lit(-1).cast("long").alias("f")
    if large.isEmpty():
        one_block = [F.lit(0).cast("long").alias(c) for c in ("i", "j")]
        return inside.select("cls", "root", whole, *one_block, F.lit(True).alias("first"))
    small = inside.join(large, "root", "left_anti").select("cls", "root", whole)
    caps = inside.join(large, "root").join(found, "cls").select("root", "n", "cls", F.explode("found").alias("f"))
    caps = stored(caps, "crowd-caps")
    work = caps.groupBy("root", "n", "f").count().groupBy("root", "n").agg(F.sum(F.col("count") * F.col("count")).alias("w"))
    by_cap = stored(work.where("w < n * n").select("root"), "by-cap")
    parts = caps.join(by_cap, "root", "left_semi").select("cls", "root", "f")
    bulk = inside.join(large.join(by_cap, "root", "left_anti"), "root", "left_semi").select("cls", "root", whole)
    rows = small.unionByName(parts).unionByName(bulk)
    blocks = rows.groupBy("root", "f").agg(F.ceil(F.count(F.lit(1)) / crowd).alias("blocks")).where("blocks > 1")
    split = rows.join(blocks, ["root", "f"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    met = split.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return met.select("cls", "root", "f", "i", "j", (F.col("block") == F.col("i")).alias("first"))


def verified(rows: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, b, n): spanning links a < b, and with b null the links n of class a in a group."""

    def group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        f, i, j = (int(table.column(k)[0].as_py()) for k in (1, 2, 3))
        unit = units(rows_of(table.column("x").to_pylist(), width))
        first = np.asarray(table.column("first").to_numpy(zero_copy_only=False), bool)
        if i == j:
            a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
        else:  # two blocks: pairs across only
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            a, b = np.nonzero(unit[left] @ unit[right].T >= cosine)
            a, b = left[a], right[b]
        if f >= 0 and len(a):  # a pair counts in the first cap it shares
            caps = [set(c) for c in table.column("found").to_pylist()]
            own = np.array([min(caps[p] & caps[q]) == f for p, q in zip(a.tolist(), b.tolist())])
            a, b = a[own], b[own]
        total = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
        order = np.argsort(cls)
        place = np.argsort(order)
        low, high = spanning(cls[order], place[a], place[b])
        some = np.flatnonzero(total)
        return low, high, cls[some], total[some].astype(np.int64)

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([table.column(k).to_numpy() for k in range(4)])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        out = [group(table.slice(s, e - s)) for s, e in zip(starts, np.r_[starts[1:], table.num_rows])]
        low, high, cls, total = (np.concatenate([p[k] for p in out]) for k in range(4))
        links = [pa.array(low), pa.array(high), pa.nulls(len(low), pa.int64())]
        counts = [pa.array(cls), pa.nulls(len(cls), pa.int64()), pa.array(total)]
        for columns in (links, counts):
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    keys = ["root", "f", "i", "j"]
    ordered = rows.select(*keys, "cls", "copies", "first", "found", "x").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(streamed(4, solve, 2 * CROWD), "a long, b long, n long")


def linked(classes: DataFrame, width: int, cosine: float = COSINE, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(cls, n): how many other vectors each class links with; (a, b): spanning links."""
    caps = fitted(width, classes.count(), cosine)
    sketched = stored(lists(classes, width, caps), "cap-lists")
    each = sketched.select(F.explode("found").alias("bucket"), "cls", "s0", "s1")
    inside = stored(members(candidates(in_blocks(each, "cls", crowd), most_different(cosine))), "candidate-groups")
    found = sketched.select("cls", "found")
    rows = groups_to_verify(inside, found, crowd)
    rows = rows.join(classes.select("cls", "copies", "x"), "cls")
    lists_of = rows.where("f >= 0").join(found, "cls")
    rows = rows.where("f < 0").withColumn("found", F.lit(None).cast("array<long>")).unionByName(lists_of)
    out = stored(verified(rows, width, cosine), "verified")
    counts = out.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    return counts, out.where("b IS NOT NULL").select("a", "b").distinct()


def components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, crowd: int = CROWD) -> DataFrame:
    """(key, n_links, component_id) of every row."""
    width = max(1, dimension(df, vector))
    marks = marked(df, key, vector, width)
    same = marks.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
    numbered = same.withColumn("digest", digest()).withColumn("cls", F.monotonically_increasing_id())
    classes = stored(numbered, "vector-classes")
    counts, links = linked(classes, width, cosine, crowd)
    stars = star_components(links).select(F.col("node").alias("cls"), "root")
    facts = classes.select("cls", "copies", "least", "digest").join(counts, "cls", "left").join(stars, "cls", "left")
    facts = facts.where("copies > 1 OR n IS NOT NULL").withColumn("root", F.coalesce("root", "cls"))
    facts = stored(facts, "class-facts")
    least = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    named = facts.join(least, "root").select(
        F.col("digest"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    named = stored(named, "named-classes")
    # a class with over a thousandth of the rows is answered by broadcast; there are at most a thousand
    most = df.count() // 1000
    hot = F.broadcast(named.where(F.col("copies") > most).drop("copies"))
    cold = named.where(F.col("copies") <= most).drop("copies")
    rows = marks.select("key", digest().alias("digest"))
    often = rows.join(hot, "digest")
    seldom = rows.join(hot, "digest", "left_anti").join(cold, "digest", "left")
    out = often.unionByName(seldom).withColumns(
        {
            "component_id": F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id")),
            "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
        }
    )
    return out.select(F.col("key").alias(key), "n_links", "component_id")


def op13(vectors: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return components(vectors).withColumn("kept", kept)
