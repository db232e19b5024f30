"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Method. Ids are counted over all documents and replaced by their rank, most frequent
first, so most take one byte. A value has one to four bytes; its length goes to two bits
of a control byte, four values to one, and control bytes and data bytes are kept apart.
numpy decodes by table: a control byte selects four lengths, their running sum is where
each value lies. Documents lie in ascending order of their key over ranges of keys, one
file for each range, and totals of the files give the position of each document.

Tokenizing. Where the vocabulary file drops white space and never joins across it, words are
tokenized by the library once per worker and kept, up to a fixed number: words below U+0100,
cut as the file states, by its model alone, others by all of it. The words of a few megabytes
of texts are found with numpy and numbered by Arrow, so each different one is looked up once
there, new ones many at a time. With any other file the library gets whole texts.

Defined cases: null and empty texts have the end id only; null keys come first; equal
keys are ordered by a hash of the text and then by row; repeated rows count each.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import scratch_path
from . import files
from .common import by_batch, discard, only_kept, stored, whole

END = 1
MAGIC = b"RANKVB01"
HEAD = "<8sQQQ"
FILE_BYTES = 16 << 20
CACHED_WORDS = 250_000
LETTERS = "a-zªµºß-öø-ÿ"
SIMPLE = re.compile(rb"(?:[!-~]|\xc2[\xaa\xb5\xba]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PIECES = re.compile(f" |'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ 0-9{LETTERS}]+")
BEYOND = re.compile("[^\\x00-\\xff]")
MARK, PART, WORDS_AT_ONCE = "\x01", "\n", 500
CACHED_LENGTH = 40
BYTES_AT_ONCE, ROWS_AT_ONCE = 2 << 20, 1000
END_BYTES = np.array([END], "<u4").tobytes()
SUFFIX = "</w>"


def among(chars: bytes) -> np.ndarray:
    """For each byte, whether it is one of these."""
    return np.isin(np.arange(256), list(chars))


WHITE, CLOSES = among(b" \t\n\r\x0b\x0c"), among(b".,;:!?")
OPENS = among(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: What follows 0xC3 in the small letters à-ö, ø-ÿ and ß.
LATIN_ENDS = among(b"".join(c.encode()[1:] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"))

# How a vocabulary file states that words are lower-cased and cut at white space.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLITS = [
    {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

#: Lengths of the four values that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + np.uint8(1)
VALUES_AT_ONCE = 1 << 18


def groups(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of documents with about VALUES_AT_ONCE values; one may hold more."""
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // VALUES_AT_ONCE)) + 1
    bounds = [0, *cuts.tolist(), len(counts)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def pack_all(values: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control bytes, data bytes) of each document; `values` holds theirs one after another,
    unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    size = np.ones(len(values), np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        size += values > most
    width = -(-counts // 4)
    last, control_last = np.cumsum(counts), np.cumsum(width)
    codes = np.zeros(4 * int(width.sum()), np.uint8)
    codes[np.arange(len(values)) + np.repeat(4 * (control_last - width) - (last - counts), counts)] = size - 1
    control = (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes()
    widest = int(size.max(initial=0))
    data = values.view(np.uint8).reshape(-1, 4)[:, :widest][np.arange(widest) < size[:, None]].tobytes()
    data_last = np.r_[0, np.cumsum(size, dtype=np.int64)][last]
    out, c, d = [], 0, 0
    for c_end, d_end in zip(control_last.tolist(), data_last.tolist()):
        out.append((control[c:c_end], data[d:d_end]))
        c, d = c_end, d_end
    return out


def unpack_all(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of documents whose streams lie one after another."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    spare = -counts % 4
    last = np.cumsum(counts + spare)
    real = np.ones(len(size), bool)
    for k in (1, 2, 3):
        real[last[spare >= k] - k] = False
    size = size[real]
    at = np.cumsum(size, dtype=np.int64) - size
    source = np.frombuffer(data, np.uint8)
    out = source[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= source[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of the values of one document."""
    return pack_all(values, np.array([len(values)]))[0]


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` values of a pair of streams."""
    return unpack_all(control, data, np.array([count]))


def cut_at_spaces(file: dict) -> bool:
    """Does this vocabulary file drop white space and never join across it?

    Only files that normalize and split exactly as the shortcuts below expect say yes; for
    all others whole texts go to the library.
    """
    parts = (file.get("normalizer") or {}).get("normalizers", [])
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = not any(t.get("lstrip") or t.get("rstrip") or not t["content"].startswith("<|") for t in file.get("added_tokens", []))
    return plain and parts == NORMALIZERS and splits == SPLITS and file["model"].get("end_of_word_suffix") == SUFFIX


def folded(text: bytes) -> tuple[bytes, bool]:
    """A text brought to fewer word forms where that leaves the ids as they are, and whether
    that was so.

    The vocabulary lower-cases. Below U+0100 nothing composes; a special token begins with `<|`.
    """
    body = text.decode("utf-8", "replace")
    if "<|" in body or (not body.isascii() and BEYOND.search(body)):
        return body.encode(), False
    return body.lower().encode(), True


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after another, and the number of words before the end of
    each text.

    Bytes are split at the six white characters of ASCII only. The vocabulary cuts between a
    letter or digit and other characters, so texts that are folded are cut before a closing
    mark after one.
    """
    forms = [folded(t) for t in texts]
    ends = np.cumsum([len(t) + 1 for t, _ in forms])
    data = np.frombuffer(b" ".join([b"", *[t for t, _ in forms], b""]), np.uint8)
    inside = ~WHITE[data]
    cut = CLOSES[data]
    at = np.flatnonzero(cut)
    latin = (data[at - 2] == 0xC3) & LATIN_ENDS[data[at - 1]]
    cut[at] = OPENS[data[at - 1]] | latin
    for (text, plain), end in zip(forms, ends.tolist()):
        if not plain:
            cut[end - len(text) : end] = False
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:])) + 1
    lasts = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
    offsets = np.r_[0, np.cumsum(lasts - starts + 1, dtype=np.int64)]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), np.searchsorted(starts, ends)


def slices(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls."""
    _, offsets, data = values.buffers()
    held, bounds = data.to_pybytes(), np.frombuffer(offsets, np.int64)[: len(values) + 1].tolist()
    return [held[a:b] for a, b in zip(bounds, bounds[1:])]


def parted(ids: list[int], mark: int) -> list[bytes]:
    """The ids between marks, as bytes."""
    found = np.array(ids, "<u4")
    ends = 4 * np.r_[np.flatnonzero(found == mark), len(found)]
    data = found.tobytes()
    return [data[a:b] for a, b in zip([0, *(ends + 4).tolist()], ends.tolist())]


class Tokens:
    """The library's tokenizer with the ids of words seen by this worker, as bytes.

    Words are kept in two generations: when the younger is full it becomes the older, and
    a word found in the older moves up, so frequent words stay.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = {}  # the bytes of the characters below U+0100, as the vocabulary spells them
        for c in range(0x100):
            spelled |= zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True)
        spelled[ord(PART)] = PART
        self.spelled = "".join([spelled.get(c, "\ufffe") for c in range(0x100)])
        # a piece of a word has ids whatever its bytes, and none has the id of a space
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        known = all(c in vocabulary and c + SUFFIX in vocabulary for c in pre_tokenizers.ByteLevel.alphabet())
        self.by_word = known and cut_at_spaces(json.loads(data))
        self.space = vocabulary.get(spelled[0x20] + SUFFIX)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(PART)
        mark = self.ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, the end id last."""
        if not self.by_word:
            return [np.array([*self.ids(t.decode("utf-8", "replace")), END], "<u4").tobytes() for t in texts]
        out: list[bytes] = []
        before = np.cumsum([0, *map(len, texts)]) // BYTES_AT_ONCE
        bounds = [0, *(np.flatnonzero(np.diff(before[:-1])) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:]):
            out += self._encode(texts[a:b]) if a < b else []
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        words, ends = words_of(texts)
        coded = words.dictionary_encode()
        found = self._find(slices(coded.dictionary))
        which = coded.indices.to_numpy()
        size = np.array([len(x) // 4 for x in found], np.int64)
        counts = size[which]
        last = np.cumsum(counts)
        at = np.repeat((np.cumsum(size) - size)[which] - (last - counts), counts) + np.arange(counts.sum())
        data = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        stops = 4 * np.r_[0, last][np.r_[0, ends]]
        return [data[a:b] + END_BYTES for a, b in zip(stops.tolist(), stops[1:].tolist())]

    def _find(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        found = list(map(self.known.get, words))
        rest = [i for i, x in enumerate(found) if x is None]
        new = self._look_up([words[i] for i in rest if words[i] not in self.older])
        for i in rest:
            w = words[i]
            found[i] = x = new[w] if w in new else self.older[w]
            if len(w) <= CACHED_LENGTH:
                self.known[w] = x
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        return found

    def _look_up(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words: those of letters and visible ASCII go to the model alone, others to the
        whole library; many at once but for special tokens and odd characters below U+0100.

        Below U+0100 nothing composes, and a special token begins with `<|`.
        """
        letters, mixed, beyond, out = [], [], [], {}
        for w in words:
            if w.isalpha():  # letters of ASCII
                letters.append(w)
            elif SIMPLE.fullmatch(w) and b"<|" not in w:
                mixed.append(w)
            elif self.mark is not None and MARK not in (text := w.decode()) and BEYOND.search(text):
                beyond.append(w)
            else:
                out[w] = np.array(self.ids(w.decode()), "<u4").tobytes()
        for step, some in ((self._letters, letters), (self._mixed, mixed), (self._beyond, beyond)):
            for start in range(0, len(some), WORDS_AT_ONCE):
                part = some[start : start + WORDS_AT_ONCE]
                out |= zip(part, step(part), strict=True)
        return out

    def _letters(self, words: list[bytes]) -> list[bytes]:
        return self._by_model(f"{PART} {PART}".encode().join(words).lower())

    def _mixed(self, words: list[bytes]) -> list[bytes]:
        """The words are cut here, as the file states, and the model gets the pieces."""
        return self._by_model(PART.join(PIECES.findall(b" ".join(words).decode().lower())).encode())

    def _by_model(self, pieces: bytes) -> list[bytes]:
        text = codecs.charmap_decode(pieces, "strict", self.spelled)[0]
        return parted(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.space)

    def _beyond(self, words: list[bytes]) -> list[bytes]:
        return parted(self.ids(f" {MARK} ".join([w.decode() for w in words])), self.mark)


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tie, ids): ids as bytes, the end id last; the file is read on the driver."""
    with open(path, encoding="utf-8") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    name = f"tokens {hashlib.sha256(data.encode()).hexdigest()}"
    kind = docs.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = only_kept(name, lambda: Tokens(shared.value)).encode(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["key", "tie", "ids"])

    read = docs.select(F.col(key).alias("key"), F.xxhash64(whole(text)).alias("tie"), whole(text).cast("binary").alias("t"))
    return by_batch(read, step, f"key {kind}, tie long, ids binary", ROWS_AT_ONCE)


def ranks(found: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents; at most one entry for each id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"))
            total = np.pad(total, (0, max(0, len(part) - len(total))))
            total[: len(part)] += part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    sums = found.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # bounded by the vocabulary
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def packed(found: DataFrame, by_rank: np.ndarray, kind: str) -> DataFrame:
    """(key, tie, n, control, data): the ids of each document as ranks, packed."""
    place = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    place[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = found.sparkSession.sparkContext.broadcast(place)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2).to_pylist()
        counts = np.array([len(x) // 4 for x in ids])
        streams = []
        for a, b in groups(counts):
            streams += pack_all(shared.value[np.frombuffer(b"".join(ids[a:b]), "<u4")], counts[a:b])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([c for c, _ in streams], pa.binary()), pa.array([d for _, d in streams], pa.binary())],
            ["key", "tie", "n", "control", "data"],
        )

    return by_batch(found, step, f"key {kind}, tie long, n long, control binary, data binary", ROWS_AT_ONCE)


def file_bytes(keys: list, counts: list[int], control: list[bytes], data: list[bytes]) -> bytes:
    """Head, keys and counts and data sizes of the documents, control bytes, data bytes.

    A key is a signed 64-bit number after a byte that is 0 if the key is null.
    """
    known = np.array([k is not None for k in keys], np.uint8)
    index = known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes()
    index += np.array(counts, "<u8").tobytes() + np.array([len(d) for d in data], "<u8").tobytes()
    streams = b"".join(control)
    return struct.pack(HEAD, MAGIC, len(keys), len(index), len(streams)) + index + streams + b"".join(data)


def documents(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ranks) of each document of a file."""
    magic, count, index, streams = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEAD)
    known = np.frombuffer(content, np.uint8, count, at)
    keys, sizes, lengths = (np.frombuffer(content, "<i8", count, at + count * (1 + 8 * k)) for k in range(3))
    control, data = at + index, at + index + streams
    for a, b in groups(sizes):
        width, length = int((-(-sizes[a:b] // 4)).sum()), int(lengths[a:b].sum())
        values = unpack_all(content[control : control + width], content[data : data + length], sizes[a:b])
        first = 0
        for i, last in zip(range(a, b), np.cumsum(sizes[a:b]).tolist()):
            yield (int(keys[i]) if known[i] else None), values[first:last]
            first = last
        control, data = control + width, data + length


def write(rows: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write files in ascending key order; returns the stored manifest (part, path, docs, n)."""
    ordered = rows.repartitionByRange(parts, "key", "tie", "row").sortWithinPartitions("key", "tie", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[list] = [[], [], [], []]
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            path = files.write(folder, f"ids-{part:06d}-{number:04d}", file_bytes(*held))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part << 32 | number], pa.int64()), "path": [path], "docs": [len(held[0])], "n": [sum(held[1])]})
            number, held, size = number + 1, [[], [], [], []], 0
            return out

        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3))):
                for column, value in zip(held, values):
                    column.append(value)
                size += len(values[3]) + len(values[2])
                if size >= 2 * FILE_BYTES:
                    yield close()
        if held[0]:
            yield close()

    return stored(ordered.select("key", "n", "control", "data").mapInArrow(run, "part long, path string, docs long, n long"), "manifest")


def read(manifest: DataFrame, table: str) -> DataFrame:
    """(key, start, n_tokens, ids): every document of the files, ids as bytes.

    `table` is the file with the ids in order of rank.
    """
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = only_kept(f"ranks {table}", lambda: np.frombuffer(files.read(table), "<u4"))
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for key, values in documents(files.read(path)):
                    held.append((key, first, len(values), by_rank[values].tobytes()))
                    first, size = first + len(values), size + len(values)
                    if size >= 4 * VALUES_AT_ONCE:
                        yield made(held)
                        held, size = [], 0
                yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        kinds = {"key": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds.values())], list(kinds))

    parts = max(1, min(manifest.count(), 10_000))
    return placed.repartition(parts, "path").mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, rank, pack, write and read back: (key, start, n_tokens, ids)."""
    spark = docs.sparkSession
    found = stored(tokenize(docs.withColumn(key, F.col(key).cast("long")), path, key, text), "token-ids")
    by_rank = ranks(found)
    rows = stored(packed(found, by_rank, "bigint").withColumn("row", F.monotonically_increasing_id()), "packed")
    discard(found)
    total = rows.agg(F.sum(F.octet_length("data") + F.octet_length("control"))).first()[0] or 0
    folder = scratch_path(spark, "token-files")
    table = files.write(folder, "ranks", by_rank.astype("<u4").tobytes())
    manifest = write(rows, folder, max(1, -(-total // FILE_BYTES)))
    discard(rows)
    return read(manifest, table)


def op8(docs: DataFrame, path: str) -> DataFrame:
    found = round_trip(docs.select("doc_id", "text"), path)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
