import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from qualityframe.llm import resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, orders):
    found = words(text)
    return [" ".join(found[i : i + n]) for n in orders for i in range(len(found) - n + 1)]


def plain(docs, items, orders=(1,), buckets=10_000, percent=10, least_words=20):
    """(id, features, weight, score, rank) of every document, by the definition."""

    def held(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for x in texts for g in grams(x, orders))

    s, t = held(x for _, x in docs), held(items)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for key, text in docs:
        found = grams(text, orders)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in found)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(found), weight, score, len(words(text)) >= least_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = len(able) * percent // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return out + [(*r[:4], None) for r in rows if not r[4]]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x or 0) for x in r])


def test_spans_are_the_ngrams():
    line = resample.collapsed("  Über-GROSS,\t\x00naïve 42x... end ".encode())
    assert line.decode() == "Über gross naïve 42x end"
    for orders in ((1,), (1, 2), (2, 3), (5,), (6,)):
        got = [line[a:b].decode() for a, b in resample.spans(line, orders)]
        assert got == grams(line.decode(), orders)
    assert list(resample.spans(b"", (1, 2))) == []


def test_all_documents_equal_plain_python(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    items = spark.read.parquet(f"{sample}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    got = resample.op11(docs, items).collect()
    assert order(got) == order(want)
    assert sum(r.rank is not None for r in got) > 10


def test_longer_runs_other_buckets_and_whole_rows(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").limit(80)
    items = spark.read.parquet(f"{sample}/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    options = {"orders": (1, 2), "buckets": 70_000, "percent": 35, "least_words": 5}
    want = plain(texts, [r.text for r in items.collect()], **options)
    got = resample.resampled(docs, items, **options)
    assert order(got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == order(want)
    rows = resample.drawn(docs, items, **options)
    assert rows.columns == docs.columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r[0] for r in want if r[4])


def test_ranks_over_many_ranges_and_one_hot_row(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 700).alias("score"))
    got = resample.ranked(rows.repartition(7), [F.col("score").desc()]).collect()
    assert sorted(r.place for r in got) == list(range(1, 6001))
    by_place = [r.score for r in sorted(got, key=lambda r: r.place)]
    assert by_place == sorted(by_place, reverse=True)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([("i", "one two"), ("n", None)], "item_id string, text string")
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for target, held in ((items, ["one two", None]), (items.limit(0), [])):
        options = {"percent": 100, "least_words": 1}
        got = resample.resampled(odd_docs, target, **options)
        got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert order(got) == order(plain(texts, held, **options))
    assert resample.op11(no_docs, items).count() == 0
    assert resample.drawn(odd_docs, items, percent=100).count() >= 1


def test_sql_agrees(spark, sample):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sample}/{name}.parquet'")
    want = con.execute(resample.OP11_SQL).fetchall()
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    got = resample.op11(docs, spark.read.parquet(f"{sample}/benchmark.parquet"))
    assert order(got.collect()) == order(want)
