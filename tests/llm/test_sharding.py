import zlib

from qualityframe.llm import sharding


def jump(key, shards):
    key, at, ahead = key % 2**64, -1, 0
    while ahead < shards:
        at = ahead
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_shards_equal_brute_force(spark):
    keys = [0, 1, 2, -1, -5, 2**63 - 1, -(2**63), 10**12, *range(1000, 1300)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for shards in (1, 2, 24, 25):
        got = df.select("doc_id", sharding.jump("doc_id", shards).alias("s")).collect()
        assert [r.s for r in got] == [jump(k, shards) for k in keys]


def test_growth_moves_rows_only_to_the_new_shard(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    out = sharding.op7(docs)
    moved = out.where("shard <> grown_shard")
    assert [r.grown_shard for r in moved.select("grown_shard").distinct().collect()] == [24]
    assert 0.02 < moved.count() / 20_000 < 0.06
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and min(sizes) > 0.8 * 20_000 / 24


def check_slots(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_one_key_holds_most_rows(spark):
    docs = spark.range(5000).selectExpr("if(id % 3 = 0, id, 7) AS doc_id", "'x' AS text")
    rows = sharding.op7(docs).collect()
    assert len(rows) == 5000
    check_slots(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.op7(odd_docs).collect()
    texts = sorted((r.text or "").encode() for r in odd_docs.collect())
    assert sorted(r.size for r in rows) == sorted(len(t) + 8 for t in texts)
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32(t) for t in texts)
    assert {r.shard for r in rows if r.doc_id is None} == {jump(0, 24)}
    check_slots(rows)
    assert sharding.op7(no_docs).count() == 0


def test_written_shards(spark, odd_docs, tmp_path):
    sharding.write(odd_docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()
