import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from qualityframe.llm import files, perplexity, word_model

SCHEMA = "doc_id long, text string, lang string"


def threes(words):
    return {(a, b, c) for a, b, c in zip(["", "", *words], ["", *words], words)}


def plain_discounts(counts):
    n = [max(1, sum(c == k for c in counts)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return [min(max(x, 0.0 if k == 0 else 0.1), max(k - 0.1, 0.0)) for k, x in enumerate(d)]


class Plain:
    """The model of all texts but one, with dictionaries."""

    def __init__(self, every, own, spelling):
        self.spelling = spelling
        self.cut = plain_discounts(Counter((b, c) for _, b, c in every).values())
        pairs = {(b, c) for _, b, c in every}
        self.word_cut = plain_discounts(Counter(c for _, c in pairs).values())
        self.after = defaultdict(Counter)
        for _, b, c in every - own:
            self.after[b][c] += 1
        self.kinds = Counter(c for counts in self.after.values() for c in counts)

    def lower(self, word):
        n = sum(self.kinds.values())
        if not n:
            return self.spelling(word)
        loose = sum(self.word_cut[min(k, 3)] for k in self.kinds.values())
        return (self.kinds[word] - self.word_cut[min(self.kinds[word], 3)] + loose * self.spelling(word)) / n

    def p(self, before, word):
        counts = self.after.get(before)
        if not counts:
            return self.lower(word)
        loose = sum(self.cut[min(k, 3)] for k in counts.values())
        n = counts[word]
        return (n - self.cut[min(n, 3)] + loose * self.lower(word)) / sum(counts.values())


def spelling(path):
    model = perplexity.Model(files.read(path))
    return lambda word: 2 ** -model.bits([word])[0]


def test_perplexity_is_that_of_a_plain_model_of_all_other_texts(spark):
    rng = random.Random(4)
    usual = "the a of red old house tree ünder 12 runs #x".split()
    rows = [(k, " ".join(rng.choices(usual, k=rng.randint(1, 40))), rng.choice(["en", "de", None])) for k in range(60)]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(9)]
    rows += [(200, "word", "en"), (201, None, "en"), (202, "only text here only text", "fr"), rows[3]]
    rows += [(203, "\x1cthe\x85red old house \n the\x0b\x0ca \x00 of  ", "en"), (204, " red old ", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = defaultdict(list)
    for r in perplexity.op10(docs).collect():
        got[r.doc_id].append(r)
    assert Counter(k for k, _, _ in rows) == {k: len(v) for k, v in got.items()}

    models, _ = perplexity.fit(docs)
    every = defaultdict(set)
    for _, text, lang in rows:
        every[lang] |= threes(perplexity.WORD.findall(text or ""))
    for key, text, lang in rows:
        words = perplexity.WORD.findall(text or "")
        assert {r.n_words for r in got[key]} == {len(words)}
        if not words:
            assert got[key][0].perplexity is None
            continue
        spelled = spelling(models[lang])
        model = Plain(every[lang], threes(words), spelled)
        bits = -sum(np.log2(model.p(b, w)) for b, w in zip(["", *words], words))
        want = 2 ** (bits / (sum(map(len, words)) + len(words)))
        assert [r.perplexity for r in got[key]] == pytest.approx([want] * len(got[key]))


def test_plain_probabilities_add_up_to_one():
    texts = ["a b c a b d", "b c d a a b", "c a b c c"]
    every = set().union(*(threes(t.split()) for t in texts))
    model = Plain(every, threes(texts[1].split()), dict(zip("abcdx", [0.1, 0.2, 0.3, 0.15, 0.25])).get)
    for before in ["", *"abcdx"]:
        assert sum(model.p(before, w) for w in "abcdx") == pytest.approx(1)


def test_shuffled_words_score_worse(spark):
    rng = random.Random(5)
    parts = [" ".join("".join(rng.choices("aeioumnrst", k=5)) for _ in range(5)) for _ in range(40)]
    texts = [" ".join(rng.sample(parts, 20)) for _ in range(80)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    for k in range(10):
        words = texts[k].split()
        rng.shuffle(words)
        rows.append((1000 + k, " ".join(words), "en"))
    found = {r.doc_id: r for r in perplexity.op10(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(10):
        assert found[1000 + k].perplexity > 1.2 * found[k].perplexity
        assert not found[1000 + k].kept
    assert all(found[k].kept for k in range(80))


def test_what_is_counted_grows_with_the_documents(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(60)) for _ in range(200)]
    for some in (texts[:50], texts):
        docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(some)], SCHEMA).repartition(3)
        found = word_model.fit(word_model.readable(docs, "doc_id", "text", "lang"), 10_000)
        every = set().union(*(threes(t.split()) for t in some))
        counts = Counter((b, c) for _, b, c in every)
        assert found.pair_stats["en"][:4] == [sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]
        assert found.pair_stats["en"][5] == len(every)
        assert found.word_stats["en"][5] == len(counts)
