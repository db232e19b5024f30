"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. A text becomes the set of hashed words, word pairs and pairs that skip one
word. One pass per epoch over the training rows updates per-coordinate learning rates;
the L1 term keeps a coordinate at zero until its evidence exceeds it, so the model is a
short list of (feature, weight) that every task can hold.

The fit takes at most `rows` labelled rows, those with the smallest hash of their id;
that bound is a parameter. Scoring covers every document and its whole text. Labels,
language, source and id never enter a score.

Defined cases: a null or empty text scores by the bias alone; without labelled rows
every score is 0.5; several labels for one id count as toxic if any is; ids without a
text train nothing; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import apart, by_batch, kept, table, whole

WORD = re.compile(r"\w+")
BITS = 18
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CACHED_WORDS = 300_000


@dataclass(frozen=True)
class Fit:
    """How the model is fitted; `rows` bounds the labelled sample.

    `l1` is multiplied by the root of the number of rows, as noise in the sums of
    gradients grows with it.
    """

    rows: int = 12_000
    epochs: int = 8
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.14
    l2: float = 0.1
    threshold: float = 0.7


class WordHashes(dict):
    """Hashes of words seen by this worker; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxh64_intdigest(word)
        if len(word) <= 32:
            self[word] = value
        return value


def features(text: str) -> np.ndarray:
    """Feature numbers of a text, repeats included: words, pairs, skip pairs."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(kept("word hashes", WordHashes).__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    turned = h * PAIR
    far = h * SKIP
    return np.concatenate(
        [turned >> shift, ((h[1:] ^ (turned[:-1] >> np.uint64(7))) * PAIR) >> shift, ((h[2:] ^ (far[:-2] >> np.uint64(9))) * SKIP) >> shift]
    ).astype(np.int32)


def train(rows: list[tuple[int, np.ndarray]], fit: Fit) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over (label, features)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    at_bias = np.array([size])
    sparse = fit.l1 * np.sqrt(len(rows))

    def weights(i: np.ndarray) -> np.ndarray:
        """Closed form of the proximal step; the bias carries no L1."""
        l1 = np.where(i == size, 0.0, sparse)
        rate = (fit.beta + np.sqrt(n[i])) / fit.alpha + fit.l2
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / rate)

    for _ in range(fit.epochs):
        for label, found in rows:
            i = np.concatenate([found, at_bias])
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / fit.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def training_rows(labels: DataFrame, fit: Fit, key: str = "doc_id") -> DataFrame:
    """At most fit.rows of (key, label), smallest key hash first."""
    one = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key)
    named = one.agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return named.orderBy(F.xxhash64(key), key).limit(fit.rows)


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Fit on a bounded sample. Texts become features on the executors; one task sees
    at most fit.rows sets of numbers and returns the weights that are not zero."""
    kind = docs.schema[key].dataType.simpleString()
    sample = training_rows(labels, fit, key)
    # fit.rows bounds the broadcast side
    read = docs.select(key, whole(text).alias("t")).join(F.broadcast(sample), key)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(features(t)) for t in batch.column(1).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "label", "found"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.values.to_numpy() for x in batch.column(2)))
        rows.sort(key=lambda r: (xxh64_intdigest(str(r[0])), len(r[2])))
        if not rows:
            return
        w, bias = train([(label, found) for _, label, found in rows], fit)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[w[at], bias])], ["feature", "weight"]
        )

    sets = by_batch(read.select(key, "t", "label"), step, f"key {kind}, label int, found array<int>")
    model = sets.repartition(1).mapInArrow(solve, "feature int, weight double").toArrow()
    weights, bias = np.zeros(1 << BITS), 0.0
    for at, w in zip(model["feature"].to_pylist(), model["weight"].to_pylist()):
        if at < 0:
            bias = w
        else:
            weights[at] = w
    return weights, bias


def probability(text: str, weights: np.ndarray, bias: float) -> float:
    found = features(text)
    hit = np.unique(found[weights[found] != 0])
    return float(1 / (1 + np.exp(-np.clip(bias + weights[hit].sum(), -35, 35))))


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """The rows of `docs` with __score; weights are 2 ** BITS numbers at most."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float64), bias))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, b = shared.value
        found = [probability(t, w, b) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*names, "__score"])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return by_batch(docs.select(*names, whole(text).alias("__text")), step, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op5(spark: SparkSession, sf_dir: str, fit: Fit = Fit()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = learn(docs, labels, fit)
    scored = score(docs.select("doc_id", "text"), *model).drop("text")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= fit.threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id") -> DataFrame:
    """The documents scored below the threshold, by a model of the labels not held out.

    A null or empty text is scored like any other; repeated rows share their fate; other
    columns may have any name.
    """

    def step(rows: DataFrame) -> DataFrame:
        model = learn(rows, labels.where(~held_out(key)), fit, key)
        return score(rows, *model).where(F.col("__score") < fit.threshold).drop("__score")

    return apart(docs, step, key, "text")
