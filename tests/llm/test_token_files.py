import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from qualityframe.llm import token_files
from qualityframe.llm.queries import WORDS
from tokenizers import Tokenizer

with open(WORDS, encoding="utf-8") as file:
    DATA = file.read()
KNOWN = token_files.Tokens(DATA)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_streams_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack(control, data, len(values)).tolist() == values


def test_file_round_trip():
    docs = [(None, []), (-3, [1, 2, 300]), (7, [70_000, 2**31])]
    streams = [token_files.pack(np.array(v, np.uint32)) for _, v in docs]
    made = token_files.file_bytes([k for k, _ in docs], [len(v) for _, v in docs], *map(list, zip(*streams)))
    assert [(k, v.tolist()) for k, v in token_files.documents(made)] == docs


def expected(rows, path=WORDS):
    tokenizer = Tokenizer.from_file(path)
    start, out = 0, []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_equals_the_library(spark):
    texts = ["Two words", "", None, "ÀÉ o'clock's <|endoftext|> x\x1cy\xa0z w", "é 12 中文 🙂", " \n ", "long " * 9000 + "y" * 3000]
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = expected(sorted(docs.collect()))
    assert sorted(map(tuple, token_files.op8(docs, WORDS).collect())) == want


ODD_TEXTS = ["Hello, World. two  words", "  lead", "tail  ", "", None, "O'Neil's. ÀB, ß! ªº².", "don't", "a\n\nb\tc", "É" * 50 + "."]


def test_other_vocabularies_equal_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        assert sorted(map(tuple, token_files.op8(docs, path).collect())) == expected(sorted(docs.collect()), path)


@given(st.lists(st.text(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]) | st.sampled_from("aB. ,'sS\x01")), max_size=6))
def test_words_equal_the_library(texts):
    got = KNOWN.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*KNOWN.ids(t), 1] for t in texts]


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 5)
    tokens = token_files.Tokens(DATA)
    for text in ["one two three four five six", "One, two; three. seven eight", "one two nine " + "z" * 60] * 2:
        assert np.frombuffer(tokens.encode([text.encode()])[0], "<u4").tolist() == [*KNOWN.ids(text), 1]


def test_sample_table_equals_the_library(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, token_files.op8(docs, WORDS).collect())) == expected(sorted(docs.collect()))


def test_odd_rows(odd_docs, no_docs):
    rows = token_files.op8(odd_docs, WORDS).collect()
    assert len(rows) == odd_docs.count()
    # nulls first, then ascending; positions follow without gaps
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    keys = [r.doc_id for r in rows]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    assert token_files.op8(no_docs, WORDS).count() == 0


def test_words_of_latin_letters_go_to_the_model_alone(monkeypatch):
    """The whole library is asked only for what the file's cuts do not cover here."""
    tokens = token_files.Tokens(DATA)
    asked = []
    monkeypatch.setattr(tokens, "ids", lambda text: asked.append(text) or KNOWN.ids(text))
    texts = ["Plain words, l'Été's (año) ÀÉß2x &&& 'LL don't.'s a<b |c", "µª ½ ÷ Ā", "<|endoftext|>x", "wörd,'ré x'S"]
    got = tokens.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*KNOWN.ids(t), 1] for t in texts]
    words = {w for text in asked for w in text.replace(token_files.MARK, " ").split()}
    assert words == {"½", "÷", "Ā", "<|endoftext|>x", "wörd,'ré"}


class Counted:
    """Stands for an object and counts the uses of it."""

    def __init__(self, of):
        self.of, self.uses = of, 0

    def __getattr__(self, name):
        self.uses += 1
        return getattr(self.of, name)


def test_new_words_are_looked_up_many_at_once():
    """One use of the model serves hundreds of new words, and a word is found once for many texts."""
    tokens = token_files.Tokens(DATA)
    tokens.model = model = Counted(tokens.model)
    texts = [" ".join(f"{chr(97 + i % 26) * (1 + i // 26)}x, wörd{i}'s" for i in range(1, 600))] * 3
    got = tokens.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*KNOWN.ids(t), 1] for t in texts]
    assert model.uses < 10


def test_ill_formed_bytes_and_small_groups_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "BYTES_AT_ONCE", 9)
    texts = [b"a\xff. b\xc3", b"", b"\xa9. \xc3\xa9. x", b"K\xe2\x84\xaa. Ab.", b"  ", b"a" * 90 + b". \xc3\x97. \xc3\x9f."]
    got = token_files.Tokens(DATA).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*KNOWN.ids(t.decode("utf-8", "replace")), 1] for t in texts]


def test_files_are_read_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "VALUES_AT_ONCE", 4)
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = token_files.op8(docs, WORDS)
    assert sorted(map(tuple, rows.collect())) == expected(sorted(docs.collect()))
