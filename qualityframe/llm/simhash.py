"""Near duplicates: SimHash fingerprints linked through a Gray-order hierarchical index.

Method. A document's fingerprint is the bitwise majority of the hashes of its word
shingles. Equal fingerprints collapse to one class first, so copies never meet in
pairs. Fingerprints at most `most` bits apart agree on at least one of `most + 1`
blocks of bits; rows meet by block value, and a bucket that holds too many distinct
fingerprints is split again by blocks of the bits that are still free. Inside a bucket
the fingerprints are sorted by Gray rank, runs of them form nodes that store the bits
all their members share, runs of nodes form upper nodes, and pairs of nodes are
followed downwards only while the differences accumulated over shared bits stay within
`most`. A bucket returns a spanning forest of its links, never all pairs. Links are
turned into components by alternating star contraction.

`groups` links 64-bit fingerprints of three-word shingles at two bits or fewer.
`similar_groups` has those links, and adds those of texts whose five-word shingles have a
Jaccard similarity of 0.8 or more. Candidates for these have equal least hashes in one of
24 bands of five, which finds a pair at 0.8 with a chance of 0.9999 wherever the texts
differ. What candidates join is a cluster; in it the similarity of pairs still apart is
counted on the shingles themselves, and only links that join something are written.

Defined cases: a null or empty text has fingerprint zero, which links like any other;
a text of fewer words than a shingle is one shingle; repeated rows each get a row; a
null id stays null and is ignored by the smallest id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import apart, by_batch, discard, only_kept, stored, whole, without

BITS = 64
WORDS = 3
MOST = 2
LARGEST = 2048
FAN = 16
ROWS_AT_ONCE = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), ROWS_AT_ONCE):
        part = np.ascontiguousarray(hashes[start : start + ROWS_AT_ONCE])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # eight counters travel in one word; 255 additions cannot overflow a byte
        lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(part), 255), axis=0)
        ones += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of UTF-8 text: ASCII case folded, words split at ASCII white space."""
    found = data.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(words))))
    count = max(1, len(found) - words + 1)
    return majority(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, count))


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, also: tuple[str, ...] = ()) -> DataFrame:
    """The columns `also`, and __fp, the fingerprint of the text as a signed long."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [fingerprint(t, words) for t in batch.column(len(also)).to_pylist()]
        made = pa.array(np.array(codes, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*also, "__fp"])

    kept = docs.select(*also)
    read = docs.select(*also, whole(text).cast("binary").alias("__data"))
    return by_batch(read, step, T.StructType([*kept.schema.fields, T.StructField("__fp", T.LongType())]))


def gray_rank(name: str) -> Column:
    """Position of a 64-bit code in the Gray sequence: prefix parity from the top bit."""
    out = F.col(name)
    for shift in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, shift))
    return out


def _split(mask: int, parts: int, bits: int) -> list[int]:
    """`mask` plus each of `parts` nearly equal runs of the bits it leaves free."""
    free = [b for b in range(bits) if not mask >> b & 1]
    return [mask | sum(1 << b for b in run.tolist()) for run in np.array_split(free, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def buckets(
    codes: DataFrame, most: int = MOST, largest: int = LARGEST, bits: int = BITS, within: tuple[str, ...] = ()
) -> DataFrame:
    """`codes` (fp and any columns) with a bucket: every pair of codes within `most` bits
    and with equal columns `within` shares one.

    Large buckets are split until all bits are used, so distinct codes end in buckets of
    at most 2 ** free bits; no bucket is cut short.
    """
    kept = codes.columns

    def dealt(frame: DataFrame, children: dict[int, list[int]]) -> DataFrame:
        if len(children) == 1:
            masks = F.array(*[F.lit(_signed(m)) for m in next(iter(children.values()))])
        else:
            pairs = [x for k, v in children.items() for x in (F.lit(_signed(k)), F.array(*[F.lit(_signed(m)) for m in v]))]
            masks = F.element_at(F.create_map(*pairs), F.col("mask"))
        out = frame.select(*kept, F.explode(masks).alias("mask"))
        return out.withColumn("bucket", F.xxhash64(*within, "mask", F.col("fp").bitwiseAND(F.col("mask"))))

    masks = _split(0, most + 1, bits)
    rows, done = dealt(codes, {0: masks}), []
    while True:
        sizes = rows.groupBy("bucket").count().where(F.col("count") > largest).select("bucket")
        large = stored(sizes, "large-buckets")
        if large.isEmpty():
            break
        done.append(rows.join(large, "bucket", "left_anti"))
        children = {m: _split(m, most + 1, bits) for m in masks}
        rows = dealt(rows.join(large, "bucket", "left_semi"), children)
        masks = sorted({m for v in children.values() for m in v})
        if 2 ** max(bits - m.bit_count() for m in masks) <= largest:
            break
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("bucket", *kept)


def _expand(a, b, seen, far, size: int):
    """All pairs of children of the node pairs (a, b); `size` nodes exist below."""
    step = np.arange(FAN)
    left = np.repeat(a[:, None] * FAN + step, FAN, axis=1).ravel()
    right = np.tile(b[:, None] * FAN + step, (1, FAN)).ravel()
    ok = (left < size) & (right < size) & ((np.repeat(a, FAN * FAN) != np.repeat(b, FAN * FAN)) | (left <= right))
    return left[ok], right[ok], np.repeat(seen, FAN * FAN)[ok], np.repeat(far, FAN * FAN)[ok]


def tree_pairs(codes: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of codes within `most` bits; codes are in Gray order."""
    levels = [(codes, codes)]
    while len(levels[-1][0]) > FAN:
        low, high = levels[-1]
        starts = np.arange(0, len(low), FAN)
        levels.append((np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)))
    a, b = np.triu_indices(len(levels[-1][0]))
    seen, far = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint8)
    for depth in range(len(levels) - 1, -1, -1):
        low, high = levels[depth]
        shared = ~(low ^ high)
        both = shared[a] & shared[b]
        far = far + np.bitwise_count((low[a] ^ low[b]) & both & ~seen)
        ok = far <= most
        a, b, seen, far = a[ok], b[ok], both[ok], far[ok]
        if depth:
            a, b, seen, far = _expand(a, b, seen, far, len(levels[depth - 1][0]))
    ok = a < b
    return a[ok], b[ok]


def near_pairs(keys: np.ndarray, codes: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `most` bits inside each bucket; rows come sorted by bucket."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []
    for shift in range(1, int(min(FAN, sizes.max()))):
        i = np.flatnonzero(keys[shift:] == keys[:-shift])
        i = i[np.bitwise_count(codes[i] ^ codes[i + shift]) <= most]
        found.append((i, i + shift))
    for start, size in zip(starts[sizes > FAN], sizes[sizes > FAN]):
        i, j = tree_pairs(codes[start : start + size], most)
        found.append((i + start, j + start))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `size` nodes the smallest node it is linked with, over any path."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def bucket_links(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b), a < b: links of each bucket, thinned to a spanning forest."""

    def solve(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        i, j = near_pairs(keys, codes.view(np.uint64), most)
        root = forest(len(codes), i, j) if len(i) else np.arange(len(codes))
        node = np.flatnonzero(root != np.arange(len(codes)))
        x, y = codes[node], codes[root[node]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            codes = np.r_[codes, batch.column(1).to_numpy()]
            if len(keys) >= ROWS_AT_ONCE // 2:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if cut:
                    yield solve(keys[:cut], codes[:cut])
                    keys, codes = keys[cut:], codes[cut:]
        if len(keys):
            yield solve(keys, codes)

    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", gray_rank("fp"))
    return ordered.mapInArrow(run, "a long, b long").distinct()


def star_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have a link.

    Alternates large stars (larger neighbours move to the smallest one) and small stars
    (smaller neighbours do), so the number of rounds grows with the logarithm of the
    size. Each round is stored; the one before it is deleted.
    """

    def large(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").where(F.col("b") > F.col("a"))
        return moved.select(F.col("m").alias("a"), "b").where("a != b").distinct()

    def small(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = edges.join(least, "b")
        up = moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
        own = moved.select(F.col("m").alias("a"), "b")
        return up.unionByName(own).where("a != b").distinct()

    edges, mark = stored(links, "links"), None
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        new = stored(small(large(edges)), "stars")
        sign = new.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first()  # has anything moved?
        discard(edges)
        edges = new
        if sign == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = sign


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """(key, fp, root, component): root names the group, component is its smallest key."""
    marks = stored(fingerprints(docs, text, words, (key,)).toDF("key", "fp"), "fingerprints")
    classes = marks.groupBy("fp").agg(F.min("key").alias("first"))
    links = bucket_links(buckets(classes.select("fp"), most), most)
    return _named(marks, classes, links).withColumnRenamed("key", key)


def _named(marks: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, fp, root, component) from rows (key, fp), classes (fp, first) and links."""
    stars = star_components(links).withColumnRenamed("node", "fp")
    rooted = classes.join(stars, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(rooted.join(least, "root").select("fp", "root", "component"), "components")
    return marks.join(named, "fp").select("key", "fp", "root", "component")


# Near duplicates by similarity -------------------------------------------------------

SIMILAR_WORDS = 5
SIMILARITY = 0.8
BANDS, DEPTH = 24, 5
SIGNS = BANDS * DEPTH
SHINGLES_AT_ONCE = 1 << 12
LEAST_CHANCE = 5.0
CROWD = 1024
CLUSTER_BYTES = 32 << 20  # of shingles, in a cluster or block
SHINGLES_HELD = 1 << 20  # by a worker, between pairs
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
SEEDS = np.array([xxh64_intdigest(b"least hash", seed=k) | 1 for k in range(SIGNS)], np.uint64)


class WordHashes(dict):
    """Hashes of words seen by this worker; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = xxh64_intdigest(word)
        if len(word) <= 32:
            self[word] = value
        return value


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of runs of words; fewer words are one run."""
    if len(hashes) == 0:
        return hashes
    size = max(1, len(hashes) - words + 1)
    out = np.zeros(size, np.uint64)
    for k in range(min(words, len(hashes))):
        out = (out ^ hashes[k : k + size]) * MIX[0]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def text_shingles(data: bytes) -> np.ndarray:
    """The sorted distinct five-word shingles of a text, as hashes."""
    found = data.lower().split()
    known = only_kept("simhash words", WordHashes)
    return shingles(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), SIMILAR_WORDS)


def least_hashes(runs: np.ndarray) -> np.ndarray:
    """For each of SIGNS hash functions the least value over the shingles."""
    out = np.full(SIGNS, np.iinfo(np.uint64).max)
    for start in range(0, len(runs), SHINGLES_AT_ONCE):
        part = runs[start : start + SHINGLES_AT_ONCE]
        np.minimum(out, (part[None, :] * SEEDS[:, None]).min(axis=1), out=out)
    out = (out ^ (out >> np.uint64(32))) * MIX[1]
    return out ^ (out >> np.uint64(32))


def signature(data: bytes) -> tuple[int, int, bytes, list[int]]:
    """(hash of the shingle set, its size, a byte of each least hash, codes of BANDS)."""
    runs = text_shingles(data)
    least = least_hashes(runs)
    codes = np.zeros(BANDS, np.uint64)
    for k in range(DEPTH):
        codes = (codes ^ least[k::DEPTH]) * MIX[0]
        codes ^= codes >> np.uint64(32)
    return xxh64_intdigest(runs.tobytes()), len(runs), least.astype(np.uint8).tobytes(), codes.view(np.int64)


def signatures(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The columns `also`, the text as __data, its fingerprint __code, and __fp, a hash of its
    shingles, with their number __size, __sketch, the codes __bands, and __row, a number of
    the row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(also)).to_pylist()
        fp, sizes, sketches, bands = zip(*[signature(t) for t in texts])
        marks, prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, [fingerprint(t) for t in texts]))
        starts = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * BANDS)
        codes = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(bands)))
        made = [prints, marks, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), codes]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*also, *(f.name for f in added.fields)])

    left = docs.select(*also)
    read = docs.select(*also, whole(text).cast("binary").alias("__data"))
    added = T._parse_datatype_string("__data binary, __code long, __fp long, __size long, __sketch binary, __bands array<long>")
    rows = by_batch(read, step, T.StructType([*left.schema.fields, *added.fields]))
    return rows.withColumn("__row", F.monotonically_increasing_id())


def least_equal(similarity: float) -> int:
    """Equal bytes of two sketches that a pair of that similarity falls short of with a
    chance under one in a million: LEAST_CHANCE deviations below the mean."""
    return int(SIGNS * similarity - LEAST_CHANCE * (SIGNS * similarity * (1 - similarity)) ** 0.5)


def in_blocks(rows: DataFrame, key: str, largest: int, load: Column | None = None) -> DataFrame:
    """`rows` with buckets of more than `largest` rows, or of `load` above one, dealt to blocks
    by a hash of `key`; each pair of blocks is a bucket of its own, so any two rows of a
    bucket still meet."""
    size = F.count(F.lit(1)) / largest
    sizes = rows.groupBy("bucket").agg(F.ceil(size if load is None else F.greatest(size, load)).alias("__blocks"))
    large = stored(sizes.where("__blocks > 1"), "crowded")
    if large.isEmpty():
        return rows
    block = F.pmod(F.xxhash64(F.lit(0), key), F.col("__blocks"))
    crowded = rows.join(large, "bucket").withColumn("__block", block)
    dealt = crowded.withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    pair = F.xxhash64("bucket", F.least("__block", "__with"), F.greatest("__block", "__with"))
    parted = dealt.withColumn("bucket", pair).select(*rows.columns)
    return rows.join(large, "bucket", "left_anti").select(*rows.columns).unionByName(parted)


def one_text_each(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(fp, data) for the classes `ids`, stored: of rows with one fp, and so the same
    shingles, the first is read. The texts cross one shuffle."""
    first = texts.select("fp", "__row").join(ids, "fp", "left_semi").groupBy("fp").agg(F.min("__row").alias("__row"))
    chosen = texts.join(first.select("__row"), "__row", "left_semi")
    return stored(chosen.select("fp", F.col("__data").alias("data")), "texts")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few MB: rows here hold two whole texts."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles have at least the Jaccard similarity, counted out;
    stored. `texts` has one row a class, fp and data."""
    right = pairs.join(texts.withColumnsRenamed({"fp": "b", "data": "y"}), "b")
    both = right.join(texts.withColumnsRenamed({"fp": "a", "data": "x"}), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def of(fp: int, data: pa.Scalar) -> np.ndarray:
            nonlocal size
            if fp not in held:
                if size >= SHINGLES_HELD:
                    held.clear()
                    size = 0
                held[fp] = text_shingles(data.as_py())
                size += len(held[fp])
            return held[fp]

        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            good = []
            for k in range(batch.num_rows):
                x, y = of(a[k], batch.column(2)[k]), of(b[k], batch.column(3)[k])
                all_ = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((all_[1:] == all_[:-1]).sum())
                good.append(shared >= similarity * (len(all_) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with small_batches(pairs.sparkSession):
        return stored(both.mapInArrow(run, "a long, b long"), "verified-links")


def by_bucket(rows: DataFrame, solve: Callable[[list[pa.Array]], tuple[list, list]], least: int) -> DataFrame:
    """(a, b) that `solve` finds in the columns of whole buckets, at least `least` rows at once
    but for the last; the first column is the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            sides = solve(pa.Table.from_batches(parts).combine_chunks().columns)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sides], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            ended = cut > 0 or (held and held[-1].column(0)[-1].as_py() != keys[0])
            if ended and sum(p.num_rows for p in held) + cut >= least:
                yield found([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield found(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each bucket starts and ends; rows come sorted by bucket."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]))


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNS)


def _allowed(i: int, roots: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, similarity: float, limit: int) -> np.ndarray:
    """Rows after `i` with another root, whose sizes and sketches allow the similarity."""
    j = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
    small, big = np.minimum(sizes[j], sizes[i]), np.maximum(sizes[j], sizes[i])
    j = j[small >= similarity * big - 1e-9]
    return j[(sketch[j] == sketch[i]).sum(axis=1) >= limit]


def bucket_candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: what joins the candidates of each bucket, a spanning forest of the pairs
    with different roots whose sizes and sketches allow the similarity."""
    limit = least_equal(similarity)

    def solve(columns: list[pa.Array]) -> tuple[list, list]:
        keys, ids, roots, sizes = (c.to_numpy() for c in columns[:4])
        sketch = _sketches(columns[4])
        left, right = [], []
        for start, end in _runs(keys):
            found = [_allowed(i, roots[:end], sizes[:end], sketch[:end], similarity, limit) for i in range(start, end - 1)]
            i = np.repeat(np.arange(end - start - 1), [len(j) for j in found])
            if len(i):
                root = forest(end - start, i, np.concatenate(found) - start)
                node = np.flatnonzero(root != np.arange(end - start))
                x, y = ids[start + node], ids[start + root[node]]
                left += np.minimum(x, y).tolist()
                right += np.maximum(x, y).tolist()
        return left, right

    return by_bucket(rows.select("bucket", "id", "root", "size", "sketch"), solve, ROWS_AT_ONCE // 4).distinct()


def cluster_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: links of each bucket by their similarity, counted out, that join rows
    which the roots and earlier links leave apart; `data` is the text of a row."""
    limit = least_equal(similarity)

    def linked(ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, data: pa.Array) -> Iterator[tuple[int, int]]:
        sets = [text_shingles(t.as_py()) for t in data]
        known, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        marked = np.zeros(len(known), bool)
        roots = roots.copy()
        for i in range(len(ids) - 1):
            others = _allowed(i, roots, sizes, sketch, similarity, limit)
            own = ranks[ends[i] - sizes[i] : ends[i]]
            marked[own] = True
            for j in others.tolist():
                if roots[j] == roots[i]:
                    continue
                shared = int(np.count_nonzero(marked[ranks[ends[j] - sizes[j] : ends[j]]]))
                if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])
                    roots[roots == roots[j]] = roots[i]
            marked[own] = False

    def solve(columns: list[pa.Array]) -> tuple[list, list]:
        keys, ids, roots, sizes = (c.to_numpy() for c in columns[:4])
        sketch = _sketches(columns[4])
        found = [x for a, b in _runs(keys) for x in linked(ids[a:b], roots[a:b], sizes[a:b], sketch[a:b], columns[5][a:b])]
        return [a for a, _ in found], [b for _, b in found]

    with small_batches(rows.sparkSession):
        return stored(by_bucket(rows.select("bucket", "id", "root", "size", "sketch", "data"), solve, 1).distinct(), "cluster-links")


def print_links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b), a < b: what joins the rows of `signatures` (fp for __fp) whose fingerprints
    `groups` links; the smallest fp of each group is a."""
    codes = stored(classes.select(F.col("__code").alias("code"), "fp").distinct(), "prints")
    alone = codes.select(F.col("code").alias("fp")).distinct()
    stars = star_components(bucket_links(buckets(alone, most), most))
    rooted = codes.join(stars.withColumnRenamed("node", "code"), "code", "left").select("fp", F.coalesce("root", "code").alias("root"))
    rooted = stored(rooted.distinct(), "print-groups")
    least = rooted.groupBy("root").agg(F.min("fp").alias("a"))
    return rooted.join(least, "root").where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def similar_links(
    classes: DataFrame, similarity: float = SIMILARITY, largest: int = CROWD, known: DataFrame | None = None
) -> DataFrame:
    """(a, b): links that join rows of `signatures` (fp for __fp) of at least a similarity,
    with the links `known`, stored.

    Classes with an equal code in one of the bands are candidates; what links is the exact
    similarity. First each class is held against the smallest one it shares a bucket with,
    which joins large groups by few comparisons. Then candidates still apart are gathered
    to clusters and compared inside them, a bucket or cluster of more than `largest` classes
    or CLUSTER_BYTES block against block.
    """
    texts = classes.select("fp", "__row", "__data")
    alone = classes.select("fp", "__size", "__sketch", "__bands").dropDuplicates(["fp"])
    each = alone.select(F.col("fp").alias("id"), F.posexplode("__bands").alias("band", "code"))
    rows = each.select(F.xxhash64("band", "code").alias("bucket"), "id")
    shared = rows.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = stored(rows.join(shared, "bucket"), "similar-buckets")
    leaders = met.where("id != first").groupBy("id").agg(F.min("first").alias("a")).select("a", F.col("id").alias("b"))
    if known is not None:
        leaders = leaders.join(known, ["a", "b"], "left_anti")
    some = one_text_each(texts, met.select(F.col("id").alias("fp")).distinct())
    links = verified(stored(leaders, "leaders"), some, similarity)
    if known is not None:
        links = stored(links.unionByName(known), "first-links")
    roots = stored(star_components(links), "first-stars").select(F.col("node").alias("id"), "root")
    rooted = stored(met.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), "rooted")
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    sketches = alone.select(F.col("fp").alias("id"), F.col("__size").alias("size"), F.col("__sketch").alias("sketch"))
    left = stored(rooted.join(apart, "bucket", "left_semi").join(sketches, "id"), "apart")
    clusters = star_components(bucket_candidates(in_blocks(left, "id", largest), similarity))
    inside = clusters.select(F.col("root").alias("bucket"), F.col("node").alias("id"))
    inside = inside.unionByName(inside.select("bucket", F.col("bucket").alias("id")).distinct())
    members = stored(inside.join(left.drop("bucket").dropDuplicates(["id"]), "id"), "clusters")
    dealt = in_blocks(members, "id", largest, F.sum("size") * 8 / CLUSTER_BYTES)
    with_text = dealt.join(some.withColumnRenamed("fp", "id"), "id")
    return links.unionByName(cluster_links(with_text, similarity))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, fp, root, component) as `groups` has them, for texts that it groups or whose
    five-word shingles are similar; fp is the hash of those shingles."""
    marks = stored(signatures(docs, text, (key,)).withColumnsRenamed({key: "key", "__fp": "fp"}), "signatures")
    classes = marks.groupBy("fp").agg(F.min("key").alias("first"))
    known = stored(print_links(marks), "print-links")
    return _named(marks, classes, similar_links(marks, similarity, known=known)).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates: of each group of similar texts the one with
    the smallest key.

    A row without a key stays only if its whole group has none. Of rows that share key
    and group one stays. Other columns may have any name.
    """
    return apart(docs, lambda rows: _keep_one(rows, key, text, similarity), key, text)


def _keep_one(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    found = stored(similar_groups(docs, key, text, similarity), "near-duplicates")
    gone = stored(found.where(F.col(key) != F.col("component")).select(key).distinct(), "dropped")
    odd = stored(found.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).select(key), "unclear")
    if odd.isEmpty():
        return without(docs, gone, key)
    # keys of several rows, or none: the row's own fingerprint decides
    plain = without(without(docs.where(F.col(key).isNotNull()), gone, key), odd, key)
    unclear = docs.join(odd.select(F.col(key).alias("__odd")), F.col(key).eqNullSafe(F.col("__odd")), "left_semi")
    marked = signatures(unclear, text, tuple(docs.columns))
    named = found.select(*[F.col(c).alias(f"__{c}") for c in ("fp", "root", "component")]).distinct()
    stays = marked.join(named, "__fp").where(F.col(key).eqNullSafe(F.col("__component")))
    return plain.unionByName(stays.dropDuplicates(["__root"]).select(*docs.columns))


def op9(docs: DataFrame) -> DataFrame:
    return groups(docs).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
