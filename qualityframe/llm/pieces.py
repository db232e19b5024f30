"""SentencePiece encoding and decoding: Aho-Corasick matches drive a single-pass Viterbi.

Method. All pieces of the vocabulary form one Aho-Corasick automaton. It reads a text
once; at each character the output links name every piece that ends there, longest
first, and each relaxes the best score of the position: best[start] + score(piece). A
character that no piece covers costs the unknown penalty and is written as byte pieces.
Following the choices back gives the segmentation with the highest sum of scores, as the
library computes it for a unigram model; ties go to the longer piece.

In a model of merges the scores are ranks, and their sum says nothing. There a piece may
relax a position only if it fits the piece before it, that is, if merging the two
together by rank gives the two again. Exactly one piece that ends at a position fits, so
the same pass finds what merging the whole text by rank would give.

Where no piece has a word mark after another character, no piece crosses from one word
into the next, so the best path of a text is the best paths of its words. Words seen by a
worker are kept, up to a fixed number; whole texts are encoded either way.

Defined cases: null and empty texts have no pieces; a text that itself holds the word
mark decodes to spaces, so it does not survive the round trip; repeated rows each get a
row; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, by_batch, kept, whole

# Fixed values of the model format: the word mark, and the kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
UNKNOWN_PENALTY = 10.0
CHUNK = re.compile(r" *[^ ]+| +")
CACHED_WORDS = 300_000
CACHED_LENGTH = 40
CACHED_PAIRS = 400_000


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 5:
            at += 4
            yield tag >> 3, data[at - 4 : at]
        elif tag & 7 == 2:
            size = varint()
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            raise ValueError("not a model file")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: for each id its text, score and kind, whether texts get a space in
    front, and how scores are meant."""

    text: tuple[str, ...]
    score: tuple[float, ...]
    kind: tuple[int, ...]
    prefix: bool
    model: int = UNIGRAM

    @classmethod
    def read(cls, data: bytes) -> Pieces:
        text, score, kind, prefix, model = [], [], [], True, UNIGRAM
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                text.append(piece.get(1, b"").decode())
                score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kind.append(piece.get(3, NORMAL))
            elif number == 2:
                model = dict(fields(value)).get(3, UNIGRAM)
                if model not in (UNIGRAM, MERGES):
                    raise ValueError("only unigram and merge models are supported")
            elif number == 3:
                rules = dict(fields(value))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                prefix = bool(rules.get(3, 1))
        return cls(tuple(text), tuple(score), tuple(kind), prefix, model)

    @cached_property
    def automaton(self):
        normal = [s for s, k in zip(self.score, self.kind) if k == NORMAL]
        out = ahocorasick.Automaton()
        for i, (text, score, kind) in enumerate(zip(self.text, self.score, self.kind)):
            if kind == USER:
                score = len(text.encode()) * max(normal) - 0.1
            if self.model == MERGES and len(self.merged(text)) > 1:
                continue  # merging never arrives at this piece
            if kind in (NORMAL, USER) and text:
                out.add_word(text, (len(text), i, score))
        out.make_automaton()
        return out

    @cached_property
    def single(self) -> frozenset[str]:
        return frozenset(t for t, k in zip(self.text, self.kind) if len(t) == 1 and k in (NORMAL, USER))

    @cached_property
    def unknown_score(self) -> float:
        return min(s for s, k in zip(self.score, self.kind) if k == NORMAL) - UNKNOWN_PENALTY

    @cached_property
    def byte_ids(self) -> list[int] | None:
        found = [i for i, k in enumerate(self.kind) if k == BYTE]
        return found if len(found) == 256 else None

    @cached_property
    def unknown_id(self) -> int:
        return self.kind.index(UNKNOWN)

    @cached_property
    def by_word(self) -> bool:
        """Does no piece cross from one word into the next?"""
        return all(MARK not in t.lstrip(MARK) for t, k in zip(self.text, self.kind) if k in (NORMAL, USER))

    @cached_property
    def spoken(self) -> list[bytes]:
        """What each id stands for, in bytes."""
        out = [t.replace(MARK, " ").encode() for t in self.text]
        for i, k in enumerate(self.kind):
            if k == BYTE:
                out[i] = bytes([int(self.text[i][3:-1], 16)])
            elif k == CONTROL:
                out[i] = b""
            elif k == UNKNOWN:
                out[i] = " ⁇ ".encode()
        return out

    @cached_property
    def rank(self) -> dict[str, float]:
        return {t: s for t, s, k in zip(self.text, self.score, self.kind) if k in (NORMAL, USER)}

    def merged(self, text: str) -> list[str]:
        """Neighbours joined, best score first and leftmost among equals; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.rank.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            most = max(joined)
            if most == -np.inf:
                break
            at = joined.index(most)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @cached_property
    def _pairs(self) -> dict[int, bool]:
        return {}

    def fits(self, left: int, right: int) -> bool:
        """Do two neighbouring pieces stay as they are when merged together?"""
        a, b = self.text[left], self.text[right]
        return self.merged(a + b) == [a, b]

    def by_rank(self, text: str) -> tuple[list[int], list[int]]:
        """For each end the start and id of the last piece of merging the text so far."""
        start, used, pairs, size = [0] * (len(text) + 1), [None] * (len(text) + 1), self._pairs, len(self.text)
        for i, c in enumerate(text):
            if c not in self.single:
                start[i + 1], used[i + 1] = i, -1
        if len(pairs) >= CACHED_PAIRS:
            pairs.clear()
        for end, (length, piece, _) in self.automaton.iter(text):
            if used[end + 1] is not None:
                continue
            at = end + 1 - length
            before = used[at] if at else -1
            if before >= 0:
                pair = before * size + piece
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.fits(before, piece)
                if not fits:
                    continue
            start[end + 1], used[end + 1] = at, piece
        return start, used

    def by_score(self, text: str) -> tuple[list[int], list[int]]:
        """For each end the start and id of the last piece of the best path so far."""
        size = len(text)
        best, start, used = [-np.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        odd = iter([i for i, c in enumerate(text) if c not in self.single] + [size])
        skip = next(odd)

        def unknown(at: int) -> None:
            value = best[at] + self.unknown_score
            if value > best[at + 1]:
                best[at + 1], start[at + 1], used[at + 1] = value, at, -1

        for end, (length, piece, score) in self.automaton.iter(text):
            while skip < end:  # every match that ends up to here has been seen
                unknown(skip)
                skip = next(odd)
            value = best[end + 1 - length] + score
            if value > best[end + 1]:
                best[end + 1], start[end + 1], used[end + 1] = value, end + 1 - length, piece
        while skip < size:
            unknown(skip)
            skip = next(odd)
        return start, used

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces are marks already."""
        start, used = (self.by_rank if self.model == MERGES else self.by_score)(text)
        out, end = [], len(text)
        while end:
            if used[end] >= 0:
                out.append(used[end])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start[end] : end].encode())]
            else:
                out.append(self.unknown_id)
            end = start[end]
        return out[::-1]

    @cached_property
    def _words(self) -> dict[str, bytes]:
        return {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        text = " " + text if self.prefix else text
        known, out = self._words, []
        for chunk in CHUNK.findall(text) if self.by_word else [text]:
            ids = known.get(chunk)
            if ids is None:
                ids = np.array(self.segment(chunk.replace(" ", MARK)), np.int32).tobytes()
                if len(chunk) <= CACHED_LENGTH:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for."""
        out = b"".join(map(self.spoken.__getitem__, ids.tolist())).decode(errors="replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of `docs` with __ids and __same, whether decoding gives the text back.

    The vocabulary file, read on the driver, is all that is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    names = docs.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = kept(f"pieces {path}", lambda: Pieces.read(shared.value))
        texts = batch.column(batch.num_columns - 1).to_pylist()
        found = [pieces.encode(t) for t in texts]
        same = [pieces.decode(ids) == t for ids, t in zip(found, texts)]
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(same)], [*names, "__ids", "__same"])

    added = [T.StructField("__ids", T.ArrayType(T.IntegerType())), T.StructField("__same", T.BooleanType())]
    return by_batch(docs.select(*names, whole(text).alias("__text")), step, T.StructType([*docs.schema.fields, *added]))


def decode(ids: DataFrame, path: str, column: str) -> DataFrame:
    """The rows with __text, the text that the ids of a column stand for; null gives null."""
    shared = ids.sparkSession.sparkContext.broadcast(model_bytes(path))
    at, names = ids.columns.index(column), ids.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = kept(f"pieces {path}", lambda: Pieces.read(shared.value))
        texts = [None if x is None else pieces.decode(np.array(x, np.int32)) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "__text"])

    return by_batch(ids, step, T.StructType([*ids.schema.fields, T.StructField("__text", T.StringType())]))


def with_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with piece_ids, which takes the place of a column of that name; other
    columns may have any name."""

    def step(rows: DataFrame) -> DataFrame:
        return encode(rows, path, text).withColumnRenamed("__ids", "piece_ids").drop("__same")

    return apart(docs.drop("piece_ids"), step, text)


def op1(docs: DataFrame, path: str) -> DataFrame:
    read = docs.select("doc_id", "text")
    return encode(read, path).select(
        "doc_id",
        F.size("__ids").cast("long").alias("n_pieces"),
        F.col("__same").alias("round_trip"),
        F.col("__ids").alias("piece_ids"),
    )
