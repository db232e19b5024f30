"""Words after words: a modified Kneser-Ney model that grows with the documents.

Method. The count of two words in a row is the number of different words that precede them, so
a passage that copies or near copies repeat counts as one. P(word | word before) takes one of
three discounts from each count, interpolates with the share of the different words that precede
the word, and that with its spelling, so that any word has a probability. Each text is scored by
the model of all other texts: what its own three words in a row add to counts is taken off
again; discounts stay. Before a text stands word 0, twice.

A model as large as the text fits in no worker. Tasks read documents in packets, and a packet
asks for the sums of its own keys only: sorted hashes go to slices of the hash range, slices add
up what all packets hold, and sums go back in the order of the keys, in one file for each packet.
First it asks how many different words precede each of its pairs, and how many packets hold the
pair; then for what each word needs, to which n packets with the same pair add 1 / n each. Hashes
have 44 bits (of 10^9 keys one in 17,000 meets another by chance), those of words before one pair
22: of n different words some n^2 / 2^23 are taken for others.

A packet is known by its keys. Documents that come in another order when they are read again
make other packets, which are not found: the job fails then, and gives no wrong result. So
what was shuffled is stored first.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import scratch_path
from . import files
from .common import stored, whole

PACKET = 3 << 18  # words, or some more
ROWS = 100
SLICE = 1 << 24  # symbols of text behind a slice
KEY_BITS, EARLIER_BITS = 44, 22
HASH_SEED = np.uint64(0x9E3779B97F4A7C15)
ASKED = "slice int, packet string, lang string, keys binary, sums array<binary>, earlier binary"
GIVEN = "slice int, packet string, lang string, stats array<double>, sums array<binary>"


@dataclass
class Fitted:
    """Folders with the sums of each packet, and counts of counts by language."""

    pairs: str
    pair_stats: dict[str | None, list[float]]
    words: str
    word_stats: dict[str | None, list[float]]


def taken(n: list[float]) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n = [max(1, int(k)) for k in n[:4]]
    y = n[0] / (n[0] + 2 * n[1])
    found = [0.0] + [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return np.array([min(max(d, 0.0 if k == 0 else 0.1), max(k - 0.1, 0.0)) for k, d in enumerate(found)])


def off(cut: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return cut[np.minimum(counts, 3).astype(np.int64)]


def different(x: np.ndarray) -> np.ndarray:
    """Sorted different integers."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def mixed(x: np.ndarray) -> np.ndarray:
    """Another order of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Values, compressed byte by byte of them; whole numbers as such."""
    if values.dtype == np.float64 and len(values) and 0 <= values.min() and values.max() < 1 << 32:
        whole_numbers = values.astype(np.uint32)
        values = whole_numbers if (whole_numbers == values).all() else values
    planes = [p.tobytes() for p in values.view(np.uint8).reshape(len(values), -1).T] if len(values) else []
    parts = [pa.compress(p, "zstd", asbytes=True) if any(p) else b"" for p in planes]
    head = np.array([len(values), *map(len, parts)], np.uint32)
    return bytes([values.dtype.num, len(head)]) + head.tobytes() + b"".join(parts)


def unpacked(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data, np.uint32, data[1], 2).tolist()
    kind = next(np.dtype(t) for t in (np.float64, np.uint32, np.uint64) if np.dtype(t).num == data[0])
    out, at = np.zeros((n, kind.itemsize), np.uint8), 2 + 4 * data[1]
    for i, size in enumerate(sizes):
        if size:
            out[:, i] = np.frombuffer(pa.decompress(data[at : at + size], n, "zstd", asbytes=True), np.uint8)
        at += size
    return out.view(kind).ravel()


class Packet:
    """Documents of one language, and the words that follow each other in them.

    Words are runs of anything but ASCII white space.
    """

    def __init__(self, lang: str | None):
        self.lang = lang
        self.texts: list[pa.Array] = []
        self.rows: list[tuple[pa.Array, ...]] = []
        self.size = 0

    def add(self, texts: pa.Array) -> None:
        self.texts.append(pc.ascii_split_whitespace(texts))
        self.size += len(self.texts[-1].flatten())

    def close(self) -> None:
        """Number the different words and, by their first word, the different pairs."""
        texts = pa.concat_arrays(self.texts)
        self.texts = []
        words, doc = texts.flatten(), pc.list_parent_indices(texts).to_numpy()
        real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
        words, doc = words.filter(real), doc[real.to_numpy(zero_copy_only=False)]
        self.n_docs, self.doc = len(texts), doc
        self.sizes = sizes = np.bincount(doc, minlength=self.n_docs)
        self.chars = np.bincount(doc, pc.utf8_length(words).to_numpy(), self.n_docs).astype(np.int64)
        coded = words.dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64) + 1
        self.spellings = coded.dictionary.to_pylist()
        start = (np.cumsum(sizes) - sizes)[sizes > 0]
        before = np.r_[0, word][: len(word)]
        before[start] = 0
        earlier = np.r_[0, before][: len(word)]
        earlier[start] = 0
        self.width = len(self.spellings) + 1
        self.pairs, self.pair = np.unique(before * self.width + word, return_inverse=True)
        self.earlier = earlier
        seed = np.uint64(int.from_bytes(hashlib.blake2b(repr(self.lang).encode(), digest_size=8).digest(), "little"))
        spelled = pd.util.hash_array(np.array(self.spellings, object), categorize=False)
        self.words = mixed(np.r_[np.uint64(1), spelled] ^ seed)
        first, second = np.divmod(self.pairs, self.width)
        cut = np.uint64(64 - KEY_BITS)
        self.word_keys = self.words >> cut
        self.pair_keys = mixed(self.words[first] * HASH_SEED + self.words[second]) >> cut
        self.name = hashlib.blake2b(self.pair_keys.tobytes(), digest_size=16).hexdigest()


def packets(batches: Iterator[pa.RecordBatch], extra: Callable | None = None) -> Iterator[Packet]:
    """Packets of batches (lang, text, ...); all languages are closed together.

    `extra` gives the columns to keep beside the words of a batch's rows.
    """
    held: dict[str | None, Packet] = {}

    def closed() -> Iterator[Packet]:
        for packet in held.values():
            packet.close()
            yield packet
        held.clear()

    for batch in batches:
        lang = batch.column(0)
        for name in lang.unique().to_pylist():
            part = batch.filter(pc.is_null(lang) if name is None else pc.equal(lang, name))
            for i in range(0, part.num_rows, ROWS):
                rows = part.slice(i, ROWS)
                packet = held.get(name) or held.setdefault(name, Packet(name))
                packet.add(rows.column(1))
                if extra:
                    packet.rows.append(extra(rows))
                if sum(p.size for p in held.values()) >= PACKET:
                    yield from closed()
    yield from closed()


def asked(packet: Packet, keys: np.ndarray, sums: list[np.ndarray], slices: int, earlier: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows in which a packet asks for the sums of its keys, one for each slice.

    `earlier` are the words before each key, one key after another, as many as `sums` say.
    """
    by = np.argsort(keys)
    if earlier is not None:
        n = sums[0].astype(np.int64)
        ends = np.r_[0, np.cumsum(n[by])]
        earlier = earlier[np.repeat((np.cumsum(n) - n)[by], n[by]) + np.arange(len(earlier)) - np.repeat(ends[:-1], n[by])]
    keys, sums = keys[by], [s[by] for s in sums]
    edges = np.array([(i << KEY_BITS) // slices for i in range(slices)] + [1 << KEY_BITS], np.uint64)
    at = np.searchsorted(keys, edges)
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if a < b]
    columns = [
        pa.array([i for i, _, _ in rows], pa.int32()),
        pa.array([packet.name] * len(rows), pa.string()),
        pa.array([packet.lang] * len(rows), pa.string()),
        pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
        pa.array([[packed(s[a:b]) for s in sums] for _, a, b in rows], pa.list_(pa.binary())),
        pa.array([None if earlier is None else packed(earlier[ends[a] : ends[b]]) for _, a, b in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ASKED.split(", ")])


def added(table: pa.Table) -> pa.Table:
    """One slice: the sums of each key over all packets, given to each packet that asked; and
    by language how many of the last sums are 1, 2, 3, 4, how many are over 2, and their sum.

    With words before the keys, the sums are how many packets hold a key, and how many
    different words precede it.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["packet"])
    keys = [np.cumsum(unpacked(r["keys"]), dtype=np.uint64) for r in rows]
    names = sorted({r["lang"] for r in rows}, key=repr)
    key, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    whose = np.repeat([names.index(r["lang"]) for r in rows], [len(k) for k in keys])[first]
    parts = [np.concatenate([unpacked(r["sums"][j]) for r in rows]) for j in range(len(rows[0]["sums"]))]
    if rows[0]["earlier"] is not None:
        words = np.concatenate([unpacked(r["earlier"]) for r in rows])
        found = different(np.repeat(at, parts[0].astype(np.int64)) << EARLIER_BITS | words)
        sums = [np.bincount(at, minlength=len(key)).astype(float), np.bincount(found >> EARLIER_BITS, minlength=len(key)).astype(float)]
    else:
        sums = [np.bincount(at, part, len(key)) for part in parts]
        sums[-1] = np.rint(sums[-1])
    slice_, out = rows[0]["slice"], []
    for i, name in enumerate(names):
        mine = sums[-1][whose == i]
        stats = [float((mine == k).sum()) for k in (1, 2, 3, 4)] + [float((mine > 2).sum()), float(mine.sum())]
        out.append({"slice": slice_, "packet": None, "lang": name, "stats": stats, "sums": None})
    ends = np.cumsum([len(k) for k in keys]).tolist()
    for r, end, k in zip(rows, ends, keys):
        own = at[end - len(k) : end]
        out.append({"slice": slice_, "packet": r["packet"], "lang": r["lang"], "stats": None, "sums": [packed(s[own]) for s in sums]})
    types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.binary())]
    return pa.Table.from_pylist(out, pa.schema(list(zip([c.split()[0] for c in GIVEN.split(", ")], types))))


def given(requests: DataFrame, label: str) -> tuple[str, dict[str | None, list[float]]]:
    """(folder with a file of sums for each packet, counts of counts by language)."""
    folder = scratch_path(requests.sparkSession, label)

    def put(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found: dict[str | None, np.ndarray] = {}
        if key[0].as_py() is None:
            for r in rows:
                found[r["lang"]] = found.get(r["lang"], 0) + np.array(r["stats"])
        else:
            parts = [r["sums"] for _, r in sorted({r["slice"]: r for r in rows}.items())]
            whole_sums = [packed(np.concatenate([unpacked(p) for p in part])) for part in zip(*parts)]
            out = io.BytesIO()
            np.savez(out, *[np.frombuffer(s, np.uint8) for s in whole_sums])
            files.write(folder, key[0].as_py(), out.getvalue(), same=True)
        made = [{"lang": name, "stats": s.tolist()} for name, s in found.items()]
        return pa.Table.from_pylist(made, pa.schema([("lang", pa.string()), ("stats", pa.list_(pa.float64()))]))

    sums = requests.groupBy("slice").applyInArrow(added, GIVEN)
    return folder, {r.lang: r.stats for r in sums.groupBy("packet").applyInArrow(put, "lang string, stats array<double>").collect()}


def looked_up(folder: str, name: str, keys: np.ndarray) -> list[np.ndarray]:
    """The sums of a packet, in the order of its keys."""
    arrays = np.load(io.BytesIO(files.read(f"{folder}/{name}")))
    by = np.argsort(keys)
    out = []
    for a in arrays.values():
        values = np.empty(len(keys))
        values[by] = unpacked(a.tobytes())
        out.append(values)
    return out


def readable(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, t, key, text_hash): documents that come in the same order every time."""
    read = docs.select(F.col(lang).alias("lang"), whole(text).alias("t"), F.col(key).alias("key"), F.xxhash64(whole(text)).alias("text_hash"))
    shuffled = re.search(r"\bExchange\b", read._jdf.queryExecution().executedPlan().toString())
    return stored(read, "documents") if shuffled else read


def fit(read: DataFrame, symbols: int) -> Fitted:
    """The sums of pairs and of words, for documents with so many symbols."""
    slices = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-symbols // SLICE))

    def ask(step: Callable[[Packet], tuple], label: str) -> tuple[str, dict]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for packet in packets(batches):
                if len(packet.pair):
                    keys, sums, *earlier = step(packet)
                    yield asked(packet, keys, sums, slices, *earlier)

        return given(read.select("lang", "t").mapInArrow(run, ASKED), label)

    def pair_parts(packet: Packet) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        threes = different(packet.pair * packet.width + packet.earlier)
        pair, earlier = np.divmod(threes, packet.width)
        words = (packet.words[earlier] & np.uint64((1 << EARLIER_BITS) - 1)).astype(np.uint32)
        return packet.pair_keys, [np.bincount(pair, minlength=len(packet.pairs)).astype(float)], words

    def word_parts(packet: Packet) -> tuple[np.ndarray, list[np.ndarray]]:
        held_by, n = looked_up(pairs, packet.name, packet.pair_keys)
        share, width = 1 / held_by, packet.width
        cut = off(taken(pair_stats[packet.lang]), n)
        before, after = np.divmod(packet.pairs, width)
        sums = [np.bincount(before, share * n, width), np.bincount(before, share * cut, width), np.bincount(after, share, width)]
        return packet.word_keys, sums

    pairs, pair_stats = ask(pair_parts, "word-pairs")
    read.sparkSession._jvm.System.gc()  # Spark deletes what was shuffled when nothing refers to it
    words, word_stats = ask(word_parts, "word-sums")
    read.sparkSession._jvm.System.gc()
    return Fitted(pairs, pair_stats, words, word_stats)


def own_threes(packet: Packet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of each text by their first word, how often each stands there, how many different
    words precede it there; for each word how often it and the two before it stand there)."""
    entry, at, often = np.unique(packet.doc * len(packet.pairs) + packet.pair, return_inverse=True, return_counts=True)
    three, same, n = np.unique(at * packet.width + packet.earlier, return_inverse=True, return_counts=True)
    return entry, often, np.bincount(three // packet.width, minlength=len(entry)), n[same]


def repeated_words(packet: Packet, n: np.ndarray) -> np.ndarray:
    """Words of each text inside 3-word windows that occur twice or more in it; `n` says how
    often the window that ends at a word does."""
    again = (n > 1) & (packet.earlier > 0)
    covered = again.copy()
    for k in (1, 2):
        covered[:-k] |= again[k:]
    return np.bincount(packet.doc, covered, packet.n_docs).astype(np.int64)


def bits(packet: Packet, found: Fitted, spelled: Callable[[list[str]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(minus log2 probability of the words of each text by the model of all other texts,
    words in repeated windows)."""
    if not len(packet.pair):
        return np.zeros(packet.n_docs), np.zeros(packet.n_docs, np.int64)
    width, n_pairs = packet.width, len(packet.pairs)
    entry, often, m, n = own_threes(packet)
    doc, pair = np.divmod(entry, n_pairs)
    all_before = looked_up(found.pairs, packet.name, packet.pair_keys)[1][pair]
    total, spare, kinds = looked_up(found.words, packet.name, packet.word_keys)
    cut, word_cut = taken(found.pair_stats[packet.lang]), taken(found.word_stats[packet.lang])
    n1, n2, _, _, more, all_kinds = found.word_stats[packet.lang]

    left = np.maximum(all_before - m, 0)
    before, after = packet.pairs[pair] // width, packet.pairs[pair] % width
    group = np.flatnonzero(np.r_[True, np.diff(doc * width + before) > 0])
    of = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(entry)]))
    rest = np.rint(total[before] - np.bincount(of, m)[of])
    loose = spare[before] - np.bincount(of, off(cut, all_before) - off(cut, left))[of]

    alone = (left == 0).astype(float)
    ends, at_end = np.unique(doc * width + after, return_inverse=True)
    kind = kinds[ends % width]
    kind_left = np.maximum(kind - np.bincount(at_end, alone), 0)
    freed = np.bincount(ends // width, off(word_cut, kind) - off(word_cut, kind_left), packet.n_docs)
    all_left = all_kinds - np.bincount(doc, alone, packet.n_docs)
    word_loose = word_cut[1] * n1 + word_cut[2] * n2 + word_cut[3] * more - freed
    known = all_left > 0
    floor = np.where(known, word_loose / np.maximum(all_left, 1), 1.0)[ends // width]
    part = np.where(known[ends // width], (kind_left - off(word_cut, kind_left)) / np.maximum(all_left, 1)[ends // width], 0.0)
    spelling = np.r_[0.0, np.exp2(-spelled(packet.spellings))]
    lower = part + floor * spelling[ends % width]

    high = np.where(rest > 0, (left - off(cut, left)) / np.maximum(rest, 1), 0.0)
    weight = np.where(rest > 0, np.maximum(loose, 0.0) / np.maximum(rest, 1), 1.0)
    p = high + weight * lower[at_end]
    total_bits = np.bincount(doc, -often * np.log2(np.maximum(p, 1e-300)), packet.n_docs)
    return total_bits, repeated_words(packet, n)
