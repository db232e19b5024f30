"""Quality rules: repetition counts and language-specific perplexity bands.

Method. A document's perplexity is per symbol of its words, by a modified Kneser-Ney model of
words after words (`word_model`), which grows with the documents. The spelling of a word, with
which that model ends, has a model of its own: words are read as sequences of symbol classes
with a start and an end: a letter or an ASCII mark is one class, any other character a few
(`coded`), and different words have different sequences. Spark counts all class 4-grams of all
documents by language; from these counts each language gets a modified Kneser-Ney model (three
discounts per order from counts of counts, lower orders by continuation counts, interpolation
down to the uniform distribution). It is stored as a file of sorted 64-bit hashes with log
probabilities and back-off weights, and looked up by binary search. The bands of a language lie
beyond the quartiles of its documents that pass the base rules, each text counted once: three
quartile distances away, and LEAST_BITS at least.

The model of spelling cannot grow beyond CLASSES ** ORDER entries, whatever the corpus, so one
task may build a language's from its counts, and a worker may hold them.

Defined cases: a null text has no words; a null language is a language of its own; a text
without words has no perplexity and fails the base rules; repeated rows each get a row;
an empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import scratch_path
from . import files, word_model
from .common import kept, stored, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BITS, ORDER = 6, 4
CLASSES = 1 << BITS
START, END, DIGIT, LETTER, OTHER = 0, 1, 2, 3, 29
PARTS = 5  # bits of a code point in one class from OTHER on
LONGER = [(1 << 10, 61, 2), (1 << 15, 62, 3), (1 << 25, 63, 5)]  # below, first class, classes after it
MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
WORDS_AT_ONCE = 200_000
CACHED_WORDS = 300_000
LEAST_WORDS, MOST_REPEATED = 50, 50
BIN = 1000
SPREAD, LEAST_BITS = 3.0, 0.11


def coded(codes: np.ndarray) -> np.ndarray:
    """The symbol classes of code points, one after another; no two characters share a code.

    A letter of a-z, an ASCII mark and the line feed are one class, a digit is two: DIGIT and
    its value. Any other character is a class that says how many follow, and these hold PARTS
    bits of its code point each.
    """
    codes = codes.astype(np.int64)
    width, lead = np.ones(len(codes), np.int64), np.full(len(codes), END)
    letter, digit = (codes >= 97) & (codes <= 122), (codes >= 48) & (codes <= 57)
    mark = np.isin(codes, MARKS)
    lead[letter] = LETTER + codes[letter] - 97
    lead[mark] = OTHER + np.searchsorted(MARKS, codes[mark])
    lead[digit], width[digit] = DIGIT, 2
    rest = ~(letter | digit | mark | (codes == 10))
    for below, first, after in LONGER:
        here = rest & (codes < below)
        lead[here], width[here] = first, 1 + after
        rest &= ~here
    ends = np.cumsum(width)
    left = np.repeat(ends, width) - 1 - np.arange(ends[-1] if len(ends) else 0)
    value = np.repeat(np.where(digit, codes - 48, codes), width)
    out = OTHER + (value >> np.minimum(PARTS * left, 62) & (1 << PARTS) - 1)
    out[ends - width] = lead
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class 4-gram ending at each symbol, where each word starts); words end in END."""
    text = ("\n".join(words) + "\n").lower()
    symbols = coded(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    ends = np.flatnonzero(symbols == END)
    starts = np.r_[0, ends[:-1] + 1]
    inside = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.r_[starts, len(symbols)]))
    out = symbols.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(symbols)
        before[k:] = symbols[:-k]
        out |= np.where(inside >= k, before, START) << BITS * k
    return out, starts


def hashed(order: int, gram: np.ndarray, context: bool = False) -> np.ndarray:
    """64-bit hash of an n-gram or, apart from those, of a context."""
    x = gram.astype(np.uint64) | np.uint64(order << 60 | (1 << 59 if context else 0))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more."""
    return word_model.taken([(counts == k).sum() for k in (1, 2, 3, 4)])


def kneser_ney(top: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log2 values) from distinct 4-grams and how often they occur."""
    levels = {ORDER: (top, counts)}
    for order in range(ORDER - 1, 0, -1):
        below = levels[order + 1][0] & ((1 << BITS * order) - 1)
        levels[order] = np.unique(below, return_counts=True)  # distinct symbols before it
    keys, values = [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for order in range(1, ORDER + 1):
        gram, c = levels[order]
        context, at = np.unique(gram >> BITS, return_inverse=True)
        total = np.bincount(at, c)
        cut = discounts(c)[np.minimum(c, 3)]
        spare = np.bincount(at, cut) / total
        if lower is None:
            base = np.full(len(gram), 1 / CLASSES)
        else:
            base = lower[1][np.searchsorted(lower[0], gram & ((1 << BITS * (order - 1)) - 1))]
        p = (c - cut) / total[at] + spare[at] * base
        keys += [hashed(order, gram), hashed(order, context, True)]
        values += [np.log2(p), np.log2(np.maximum(spare, 1e-12))]
        lower = (gram, p)
    key, value = np.concatenate(keys), np.concatenate(values)
    by = np.argsort(key)
    return key[by], value[by]


class Model:
    """Sorted hash arrays of one language and the words it has scored."""

    def __init__(self, data: bytes):
        arrays = np.load(io.BytesIO(data))
        self.key, self.value = arrays["key"], arrays["value"]
        self.words: dict[str, float] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of hashes; nan where there is none."""
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.value[at], np.nan)

    def log2(self, order: int, gram: np.ndarray) -> np.ndarray:
        """Log2 probability of n-grams; what was never counted backs off to the order below."""
        part = gram & ((1 << BITS * order) - 1)
        out = self.find(hashed(order, part))
        unseen = np.flatnonzero(np.isnan(out))
        if len(unseen):
            back = np.nan_to_num(self.find(hashed(order, part[unseen] >> BITS, True)))
            out[unseen] = back + (self.log2(order - 1, part[unseen]) if order > 1 else -float(BITS))
        return out

    def bits(self, words: list[str]) -> np.ndarray:
        """Minus log2 probability of each word."""
        gram, starts = grams(words)
        return -np.add.reduceat(self.log2(ORDER, gram), starts)

    def spelled(self, words: list[str]) -> np.ndarray:
        """`bits` of words of which some were seen before; they are kept up to a fixed number."""
        known = self.words
        new = list({w for w in words if w not in known})
        for start in range(0, len(new), WORDS_AT_ONCE):
            part = new[start : start + WORDS_AT_ONCE]
            known.update(zip(part, self.bits(part).tolist()))
        out = np.fromiter(map(known.__getitem__, words), float, len(words))
        if len(known) > CACHED_WORDS:
            known.clear()
        return out

    def score(self, words: list[str]) -> float:
        """Bits of the spelling of a document's words."""
        return float(self.spelled(words).sum())


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): class 4-grams of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}

        def flush(name: str | None, words: Counter) -> pa.RecordBatch:
            gram, starts = grams(list(words))
            often = np.fromiter(words.values(), np.int64, len(words))
            weight = np.repeat(often, np.diff(np.r_[starts, len(gram)]))
            found, at = np.unique(gram, return_inverse=True)
            n = np.bincount(at, weight).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = held.setdefault(name, Counter())
                words.update(WORD.findall(body))
                if len(words) >= WORDS_AT_ONCE:
                    yield flush(name, held.pop(name))
        for name, words in held.items():
            if words:
                yield flush(name, words)

    read = docs.select(F.col(lang).alias("lang"), whole(text).alias("t"))
    found = read.mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str | None, str], int]:
    """(file of each language's model of spelling, symbols counted); one row for each language
    reaches the driver."""
    folder = scratch_path(docs.sparkSession, "language-models")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        value = kneser_ney(table["gram"].to_numpy(), table["n"].to_numpy())
        out = io.BytesIO()
        np.savez(out, key=value[0], value=value[1])
        path = files.write(folder, f"model-{'' if name is None else name.encode().hex()}", out.getvalue())
        return pa.table({"lang": pa.array([name], pa.string()), "path": [path], "n": [pc.sum(table["n"]).as_py()]})

    counts = count_grams(docs, text, lang)
    found = counts.groupBy("lang").applyInArrow(build, "lang string, path string, n long").collect()
    return {r.lang: r.path for r in found}, sum(r.n for r in found)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


RULES = "key {kind}, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each document: the base counts, and bits per symbol (null without words)."""
    models, symbols = fit(docs, text, lang)
    read = word_model.readable(docs, key, text, lang)
    found = word_model.fit(read, symbols)
    names = [f.split()[0] for f in RULES.split(", ")]

    def beside(rows: pa.RecordBatch) -> tuple[pa.Array, ...]:
        lines = pa.array([repeated_lines(body) for body in rows.column(1).to_pylist()], pa.int64())
        symbols = pc.count_substring_regex(rows.column(1), SYMBOL.pattern).cast(pa.int64())
        return rows.column(2), rows.column(3), symbols, lines

    def spelled(name: str | None) -> Callable[[list[str]], np.ndarray]:
        return lambda words: kept(models[name], lambda: Model(files.read(models[name]))).spelled(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packet in word_model.packets(batches, beside):
            keys, hashes, symbols, lines = map(pa.concat_arrays, zip(*packet.rows))
            total, repeated = word_model.bits(packet, found, spelled(packet.lang))
            per_symbol = pa.array(total / np.maximum(packet.sizes + packet.chars, 1), pa.float64(), mask=packet.sizes == 0)
            langs = pa.array([packet.lang] * packet.n_docs, pa.string())
            made = [pa.array(packet.sizes), pa.array(packet.chars), symbols, lines, pa.array(repeated)]
            yield pa.RecordBatch.from_arrays([keys, langs, hashes, *made, per_symbol], names)

    kind = docs.schema[key].dataType.simpleString()
    return read.select("lang", "t", "key", "text_hash").mapInArrow(run, RULES.format(kind=kind))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, lower, upper) in bits per symbol, from distinct texts that pass the base rules.

    Values are counted in bins, so what is sorted does not grow with the documents.
    """
    good = rows.where(~base_failed()).select("lang", "text_hash", F.round(F.col("bits") * BIN).cast("long").alias("bin")).distinct()
    sizes = good.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / BIN
    found = ranked.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    reach = F.greatest(SPREAD * (F.col("q3") - F.col("q1")), F.lit(LEAST_BITS))
    return found.select("lang", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The measures of each document with perplexity, the bands and the verdict."""
    rows = stored(measure(docs, key, text, lang), "measures")
    limits = stored(bands(rows), "bands").withColumnRenamed("lang", "__lang")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    inside = F.coalesce((F.col("bits") >= F.col("lower")) & (F.col("bits") <= F.col("upper")), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def op10(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang")).select(
        F.col("key").alias("doc_id"),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "lower").alias("lower_band"),
        F.pow(F.lit(2.0), "upper").alias("upper_band"),
    )
