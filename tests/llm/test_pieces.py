import random

import pytest
import sentencepiece
from qualityframe.llm import pieces
from qualityframe.llm.queries import PIECES


@pytest.fixture(scope="module")
def data():
    return pieces.model_bytes(PIECES)


@pytest.fixture(scope="module")
def model(data):
    return pieces.Pieces.read(data)


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("  ethanoi\né𝔘中.,1<") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    return ["", " ", "   ", "▁mark", "<s> </s> <unk>", "a\n\nb\tc", "x" * 500, *made]


def test_merge_model_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts():
        assert model.encode(text).tolist() == library.encode(text), text
        if pieces.MARK not in text:
            assert model.decode(model.encode(text)) == text


def test_unigram_model_equals_the_library(data, model):
    """The same pieces and scores, marked as a unigram model in the file."""
    at = data.index(b"\x12\x06tok_v0\x18\x02") + 9
    library = sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x01" + data[at + 1 :])
    own = pieces.Pieces(model.text, model.score, model.kind, model.prefix, pieces.UNIGRAM)
    rng = random.Random(2)
    for _ in range(500):
        # known characters only: the library adds up in single precision
        text = "".join(rng.choice(" ethanoisré") for _ in range(rng.randint(1, 40)))
        assert own.encode(text).tolist() == library.encode(text), text


def test_best_score_by_brute_force(model):
    own = pieces.Pieces(model.text, model.score, model.kind, model.prefix, pieces.UNIGRAM)
    score = dict(zip(model.text, model.score))

    def best(text):
        options = [(score[text], [text])] if text in score else []
        for k in range(1, len(text)):
            if text[:k] in score:
                value, rest = best(text[k:])
                options.append((score[text[:k]] + value, [text[:k], *rest]))
        return max(options, key=lambda o: o[0])

    for word in ("▁the", "▁nation", "▁thanks", "▁inner"):
        ids = own.segment(word)
        assert sum(model.score[i] for i in ids) == best(word)[0]


def test_whole_texts_equal_words(model):
    """Keeping words changes nothing: a text without word chunks gives the same ids."""
    plain = pieces.Pieces(model.text, model.score, model.kind, model.prefix, model.model)
    plain.__dict__["by_word"] = False
    for text in texts()[:300]:
        assert plain.encode(text).tolist() == model.encode(text).tolist()


def test_operator(odd_docs, no_docs, model):
    out = pieces.encode(odd_docs, PIECES)
    assert out.columns == [*odd_docs.columns, "__ids", "__same"]
    for r in out.collect():
        assert r["__ids"] == model.encode(r.text or "").tolist()
        assert r["__same"]
    back = pieces.decode(out.select("row", "__ids"), PIECES, "__ids")
    want = {r.row: r.text or "" for r in odd_docs.collect()}
    assert {r.row: r["__text"] for r in back.collect()} == want
    assert pieces.op1(no_docs, PIECES).count() == 0
