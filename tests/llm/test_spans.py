import random
import re
import time

import pytest
from pyspark.sql import functions as F
from qualityframe.llm import spans

NUMBER = "[0-9]+"


def merged(text, found, mark):
    out, at = [], 0
    for start, end in sorted(found):
        if end > at:
            out += [text[at:start], mark] if start >= at else []
            at = end
    return "".join(out) + text[at:]


@pytest.mark.parametrize("n", [0, 1, 2, spans.CHUNK - 1, spans.CHUNK, spans.CHUNK + 1, 5 * spans.CHUNK + 7])
def test_matches_equal_re(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice(["", "x", "\U0001d518 ", "é\n"]) + " " + str(rng.randrange(10**6)) for _ in range(n)) + " end"
    df = spark.createDataFrame([(text,), ("",), ("no match",)], "t string").select(spans.matches("t", NUMBER).alias("m"))
    got, *none = [r.m for r in df.collect()]
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(NUMBER, text)]
    assert [(s.start, s.end, s.match) for s in got] == want
    ends = [0, *[e for _, e, _ in want]]
    assert [s.gap for s in got] == [text[a:s] for a, (s, _, _) in zip(ends, want)]
    assert none == [[], []]


@pytest.mark.parametrize("n", [0, 1, spans.CHUNK, 3 * spans.CHUNK + 5])
def test_masked_equals_a_walk(spark, n):
    """Spans that overlap, lie inside one another, touch, and reach over many chunks."""
    rng = random.Random(n)
    text = "".join(rng.choice("abé\U0001d518 ") for _ in range(3000))
    found = []
    for _ in range(n):
        start = rng.randrange(2990)
        found.append((start, start + rng.choice([1, 2, 5, 9])))
    if n > 1:
        found.append((100, 1500))
    found = sorted(set(found))
    df = spark.createDataFrame([(text, found)], "t string, s array<struct<start:int,end:int>>")
    assert df.select(spans.masked("t", "s", "[M]")).first()[0] == merged(text, found, "[M]")


def test_many_matches_in_one_text(spark):
    text = " ".join(str(k) for k in range(40_000))
    df = spark.createDataFrame([(text,)], "t string").withColumn("m", spans.matches("t", NUMBER)).cache()
    began = time.time()
    assert df.select(F.size("m")).first()[0] == 40_000
    assert df.select(spans.masked("t", "m", "#")).first()[0] == re.sub(NUMBER, "#", text)
    assert time.time() - began < 30  # 143 s when an array was appended to for each match
