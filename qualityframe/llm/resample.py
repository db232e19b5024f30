"""Importance resampling towards a target: hashed n-gram gains, Gumbel scores, top draw.

Method. A text is UTF-8 bytes with A-Z folded to lower case; every run of separators
(ASCII bytes other than letters and digits) collapses to one space. Over that line an
overlapped regex scan, with look-arounds at both ends that demand a space or the end of
the line, emits the span of every run of `orders` consecutive words; the CRC-32 of a
span's bytes modulo `buckets` is its bucket. Whole texts are scanned once: their buckets
are stored, two bytes each, and both the counts and the weights are read from there.

A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), with s of S features
of the corpus and t of T of the target in it. A document weighs the sum of the gains of its
features; a Gumbel term drawn from a hash of its id turns the highest scores into a sample
without replacement that is importance weighted.

Ranks come from one range shuffle of (score, id): each range is sorted by its own task and
starts at the number of rows in the ranges before it. Equal scores and even equal rows are
told apart by a row tag, so no range depends on one key. Counts are summed inside a task
before they are shuffled; the driver sees `buckets` gains and one total a range.

Defined cases: a null or empty text has no words, weight 0, and is never drawn unless
`least_words` is 0; a null id hashes like the empty string and sorts before all others;
repeated rows are drawn each by itself; ties go to the smaller id, then to fewer features,
then to any order; an empty corpus gives no rows, an empty target counts zero everywhere;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, discard, stored, whole

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
FOLD = bytes(b if b in WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


@cache
def pattern(words: int) -> regex.Pattern:
    """Runs of so many words in a line with single spaces, from boundary to boundary."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (words - 1))


def collapsed(data: bytes) -> bytes:
    """The words of a text, folded, with one space between them."""
    return b" ".join(data.translate(FOLD).split())


def spans(line: bytes, orders: Iterable[int] = (1,)) -> Iterator[tuple[int, int]]:
    """Start and end of every n-gram of a collapsed line, by order, then by start."""
    for words in orders:
        for found in pattern(words).finditer(line, overlapped=True):
            yield found.span()


def hashed(line: bytes, orders: Iterable[int], buckets: int) -> np.ndarray:
    """The bucket of every n-gram of a collapsed line."""
    scans = (pattern(words).finditer(line, overlapped=True) for words in orders)
    codes = [crc32(found[0]) for scan in scans for found in scan]
    return np.array(codes, np.uint32) % np.uint32(buckets)


def features(
    docs: DataFrame, text: str = "text", also: tuple[str, ...] = (), orders: tuple[int, ...] = (1,), buckets: int = BUCKETS
) -> DataFrame:
    """The columns `also`, n_words, n_features and `found`, the packed buckets of a text."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, sizes, packed = [], [], []
        for data in batch.column(len(also)).to_pylist():
            line = collapsed(data)
            found = hashed(line, orders, buckets)
            words.append(line.count(b" ") + 1 if line else 0)
            sizes.append(len(found))
            packed.append(found.astype(kind).tobytes())
        made = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
        names = [*(f"c{i}" for i in range(len(also))), "n_words", "n_features", "found"]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    read = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(also)], whole(text).cast("binary").alias("data"))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(also))
    return by_batch(read, step, f"{kinds}n_words long, n_features long, found binary")


def unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of packed ones, and how many each row has."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // kind().itemsize for r in rows], np.int64)


def counts(found: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, name): how many features each bucket holds, summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0), buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held.astype(np.int32), "n": total[held]})

    parts = found.select("found").mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket; corpus and target are tables of `features`."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(corpus, "s", buckets), "bucket", "left").join(counts(target, "t", buckets), "bucket", "left")
    filled = stored(both.na.fill(0).withColumns({c: F.col(c).cast("double") for c in ("s", "t")}), "bucket-counts")
    totals = filled.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = filled.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()
    discard(filled)
    return [gain for _, gain in sorted(rows)]


def weighed(found: DataFrame, gain: list[int], buckets: int = BUCKETS) -> DataFrame:
    """A table of `features` with `weight`, the sum of its gains, in place of `found`."""
    worth = np.array(gain, np.int64)
    names = [c for c in found.columns if c != "found"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, sizes = unpacked(batch.column(len(names)), buckets)
        ends = np.concatenate(([0], np.cumsum(worth[codes])))
        last = np.cumsum(sizes)
        weight = ends[last] - ends[last - sizes]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight)], [*names, "weight"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "found")
    return by_batch(found.select(*names, "found"), step, f"{kinds}, weight long")


def gumbel(key: str, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable that depends on the id and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """`scored` with `place`: 1, 2, 3... in the given order, over all rows.

    One range shuffle; a range starts behind all rows of the ranges before it.
    """
    tagged = scored.withColumn("__tag", F.monotonically_increasing_id())
    order = [*order, F.col("__tag")]
    dealt = tagged.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tag")
    # the id of a row is its range in the upper bits and its place inside in the lower 33
    parts = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    sizes = sorted(parts.groupBy(part.alias("p")).count().collect())
    starts, seen = {}, 0
    for p, n in sizes:
        starts[p], seen = seen, seen + n
    offset = parts.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__part long, __off long")
    placed = parts.withColumn("__part", part).join(F.broadcast(offset), "__part")
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("place", F.col("__off") + inside + 1).drop("__part", "__off", "__at")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    orders: tuple[int, ...] = (1,),
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row a document: key, n_words, n_features, weight, score, and rank where drawn.

    Of the documents with `least_words` words or more, `percent` in a hundred are drawn.
    """
    corpus = stored(features(docs, text, (key,), orders, buckets), "features")
    gain = gains(corpus, features(target, "text", (), orders, buckets), buckets)
    scored = weighed(corpus, gain, buckets).withColumn("score", F.col("weight") + gumbel("c0", seed))
    scored = stored(scored, "scored")
    discard(corpus)
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("c0").asc_nulls_first(), F.col("n_features").asc()]
    placed = ranked(scored.where(able), order)
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    out = placed.withColumn("rank", rank).drop("place").unionByName(rest)
    return out.withColumnRenamed("c0", key)


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents drawn, whole rows; rows that share a drawn id come together."""
    chosen = resampled(docs, target, key, text, **options).where("rank IS NOT NULL")
    ids = chosen.select(F.col(key).alias("__drawn")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids["__drawn"]), "left_semi")


def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC-32 is taken once per different word, from a table of its 256 remainders.
OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
item_words AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
),
flat AS (SELECT r, unnest(ws) AS w FROM doc_words),
vocabulary AS (SELECT w FROM flat UNION SELECT w FROM item_words),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
      lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table
),
s AS (SELECT bucket, count(*) AS n FROM flat JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item_words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
gain AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS g
  FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM flat JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((
      ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (r)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank
FROM placed
"""
