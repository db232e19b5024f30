import math
import random
import re
from itertools import combinations

import pytest
from qualityframe.llm import decontaminate

WORD = re.compile(r"[^\W_]+")


def brute_force(docs, items):
    """(doc, item) -> most equal words in a window along any diagonal."""
    out = {}
    for doc, text in docs:
        d = WORD.findall((text or "").lower())
        for item, body in items:
            i = WORD.findall((body or "").lower())
            span = min(len(i), decontaminate.WINDOW)
            best = 0
            for offset in range(-len(i), len(d)):
                equal = [0 <= k + offset < len(d) and d[k + offset] == w for k, w in enumerate(i)]
                best = max([best, *(sum(equal[k : k + span]) for k in range(len(i) - span + 1))])
            if span and best >= decontaminate.SHARE * span:
                out[doc, item] = (best, span)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(30)]
    items += [(30, " ".join(["same"] * 20)), (31, "too short to hold a seed"), (32, None), (33, "")]
    docs = []
    for k in range(150):
        noise = [word() for _ in range(60)]
        if k < 90:
            leak = items[k % 30][1].split()
            for at in rng.sample(range(20), k // 15):  # none to five substitutions
                leak[at] = "changed"
            part = leak if k % 2 else leak[rng.randint(0, 6) :]
            noise[20:20] = [w.upper() + "," for w in part]
        docs.append((k, " ".join(noise)))
    docs += [(200, "same " * 40), (201, "same " * 500), (202, None), (203, ""), (203, ""), (204, items[0][1])]
    return docs, items


def test_equals_brute_force(spark, planted):
    docs, items = planted
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.equal_words, r.window_words) for r in decontaminate.op6(d, i).collect()}
    assert got == brute_force(docs, items)
    kept = {r.doc_id for r in decontaminate.drop_leaks(d, i).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got}


@pytest.mark.parametrize("share", [0.8, 0.6, 1.0])
def test_every_tolerated_window_holds_a_seed(share):
    for n in range(1, 21):
        masks = decontaminate.masks_for(n, share)
        for gone in combinations(range(n), n - math.ceil(share * n)):
            assert any(not {s + o for o in mask} & set(gone) for mask in masks for s in range(n - mask[-1])), (n, gone)


def test_short_items_equal_brute_force(spark):
    """Items of 1 to 14 words, whole, with substitutions, and cut by the ends of a text."""
    rng = random.Random(5)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(15)] + [(None, "no id here at all")]
    docs = [(900, "no id here at all")]
    for n, text in items[1:15]:
        for gone in range(4):
            for place in range(3):
                leak = text.split()
                for at in rng.sample(range(n), min(gone, n)):
                    leak[at] = "changed"
                noise = [f"n{rng.randrange(50)}" for _ in range(6)]
                whole = [noise + leak + noise, leak[1:] + noise, noise + leak[: max(1, n - 1)]][place]
                docs.append((len(docs), " ".join(whole)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.equal_words, r.window_words) for r in decontaminate.op6(d, i).collect()}
    want = brute_force(docs, items)
    assert got == want
    assert {k for _, k in want} == {None, *range(1, 15)}


def test_a_diagonal_carries_the_words_beside_its_item(spark):
    docs = spark.createDataFrame([(1, "x " * 5000 + "one two three four five six seven eight nine ten " + "y " * 5000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    hashed, found = decontaminate.prepared(items, "item_id", "text", decontaminate.WINDOW, decontaminate.SHARE)
    few = decontaminate.candidates(docs, hashed, found, "doc_id", "text", decontaminate.WINDOW, decontaminate.SHARE)
    rows = decontaminate.diagonals(few, found).collect()
    assert [(r.offset, len(r.beside)) for r in rows] == [(5000, 10)]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None, "x"), (2, "unrelated words " * 10, "y"), (2, "unrelated words " * 10, "y")], "item_id long, text string, key string")
    assert decontaminate.op6(odd_docs, items).count() == 0
    kept = decontaminate.drop_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert decontaminate.op6(no_docs, items).count() == 0
    assert decontaminate.op6(odd_docs, items.limit(0)).count() == 0


def test_null_id_with_a_leak_goes(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = spark.createDataFrame([(None, text), (None, "clean"), (1, text), (1, "clean too")], "doc_id long, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.drop_leaks(docs, items).collect()) == ["clean", "clean too"]
