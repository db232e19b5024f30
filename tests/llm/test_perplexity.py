import re
from collections import Counter

import numpy as np
import pytest
from qualityframe.llm import perplexity
from qualityframe.llm.common import table


def model_of(words):
    gram, starts = perplexity.grams(list(words))
    weight = np.repeat(np.array(list(words.values())), np.diff(np.r_[starts, len(gram)]))
    top, at = np.unique(gram, return_inverse=True)
    return top, np.bincount(at, weight).astype(np.int64)


def test_probabilities_add_up_to_one():
    words = Counter("the theory then there thin hat hats that this other another 12 x".split())
    key, value = perplexity.kneser_ney(*model_of(words))
    assert (np.diff(key.astype(np.float64)) >= 0).all()
    found = dict(zip(key.tolist(), value.tolist()))

    def p(context, symbol):
        """Probability of a symbol after up to three, with back-off written out."""
        out = 1 / perplexity.CLASSES
        for order in range(1, perplexity.ORDER + 1):
            h = context & ((1 << perplexity.BITS * (order - 1)) - 1)
            seen = found.get(int(perplexity.hashed(order, np.array([h << perplexity.BITS | symbol]))[0]))
            back = found.get(int(perplexity.hashed(order, np.array([h]), True)[0]))
            out = 2**seen if seen is not None else out * (1 if back is None else 2**back)
        return out

    contexts = {g >> perplexity.BITS for g in model_of(words)[0].tolist()} | {123456}
    for context in list(contexts)[:25]:
        assert sum(p(context, s) for s in range(perplexity.CLASSES)) == pytest.approx(1)


def test_word_bits_equal_the_stored_values():
    import io

    words = Counter({"alpha": 3, "beta": 1, "alphabet": 2})
    key, value = perplexity.kneser_ney(*model_of(words))
    out = io.BytesIO()
    np.savez(out, key=key, value=value)
    model = perplexity.Model(out.getvalue())
    found = dict(zip(key.tolist(), value.tolist()))
    for word in words:
        gram, _ = perplexity.grams([word])
        want = -sum(found[int(h)] for h in perplexity.hashed(perplexity.ORDER, gram))
        assert model.bits([word])[0] == pytest.approx(want)
        assert model.score([word, word]) == pytest.approx(2 * want)
    assert model.bits(["zzzz"])[0] > model.bits(["beta"])[0]


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    often = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if often[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def check(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = perplexity.op10(df).collect()
    got = sorted(((r.doc_id, *(r[n] for n in names)) for r in rows), key=str)
    assert got == sorted(((r.doc_id, *measures(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_sample_table_equals_brute_force(spark, sample):
    rows = check(table(spark, sample, "documents"))
    passed = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.95 * len(passed)
    for r in passed:
        assert r.kept == (r.lower_band <= r.perplexity <= r.upper_band)


def test_counts_are_those_of_all_documents(spark, sample):
    docs = table(spark, sample, "documents")
    want = Counter()
    for r in docs.collect():
        for w, n in Counter(perplexity.WORD.findall(r.text)).items():
            for g in perplexity.grams([w])[0].tolist():
                want[r.lang, g] += n
    got = {(r.lang, r.gram): r.n for r in perplexity.count_grams(docs.repartition(5)).collect()}
    assert got == want


def test_noise_is_rejected_and_copies_do_not_move_the_bands(spark):
    import random

    rng = random.Random(8)
    usual = ["".join(rng.choice(["ba", "to", "mi", "re"]) for _ in range(3)) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(usual, k=80)), "en") for k in range(200)]
    rows += [(300 + k, rows[0][1], "en") for k in range(300)]
    rows.append((900, " ".join("".join(rng.choice("xqzjkv#7&") for _ in range(9)) for _ in range(80)), "en"))
    kept = {r.doc_id: r.kept for r in perplexity.op10(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(900)
    assert all(kept.values())


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert perplexity.op10(no_docs).count() == 0


def test_the_spread_of_a_language_sets_its_band(spark):
    rows = [(k, "en", k, 90, 0, 2.0 + 0.001 * (k % 101)) for k in range(1010)]
    made = spark.createDataFrame(rows, "key long, lang string, text_hash long, n_words long, n_repeat_words long, bits double")
    found = perplexity.bands(made).first()
    assert abs(found.lower - (2.025 - 3 * 0.05)) < 0.01 and abs(found.upper - (2.075 + 3 * 0.05)) < 0.01


def test_every_character_has_a_code_of_its_own():
    points = [*range(33, 127), *range(128, 3000), *range(0x4E00, 0x5000), *range(0x1F300, 0x1F700), 0x10FFFF]
    codes = {tuple(perplexity.coded(np.array([c])).tolist()) for c in points}
    assert len(codes) == len(points)
    assert not any(c[:k] in codes for c in codes for k in range(1, len(c)))
    assert all(perplexity.END < x < perplexity.CLASSES for c in codes for x in c)
    words = ["naïve", "42", "中文", "a#b", "x"]
    alone = [perplexity.grams([w])[0].tolist() for w in words]
    together, starts = perplexity.grams(words)
    assert together.tolist() == [g for one in alone for g in one]
    assert starts.tolist() == np.cumsum([0, *map(len, alone)])[:-1].tolist()
