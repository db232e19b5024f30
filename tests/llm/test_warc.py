import hashlib

from qualityframe.llm import warc
from qualityframe.operators.scale import scratch_path

BIG = "é" * 700


def pages(spark):
    rows = [
        (1, "http://a/\r\nX: y", BIG),
        (2, None, BIG),
        (3, "http://c", BIG),
        (3, "http://c", BIG),
        (4, "http://d", "short"),
        (5, "http://e", "short"),
        (6, "http://f", None),
        (7, "http://g", ""),
        (None, "http://h", BIG),
        (8, "http://i", "WARC/1.1\r\n\r\nnot a header\r\n\r\n" * 40_000),
    ]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, path string")


def expected(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html] = max(first.get(r.html, r.page_id), r.page_id)
    out = []
    for r in rows:
        payload = (r.html or "").encode()
        shared = len(payload) >= 1000 and sum(x.html == r.html for x in rows) > 1
        revisit = shared and r.page_id != first[r.html]
        kind = "revisit" if revisit else "response"
        out.append((r.page_id, len(payload), hashlib.sha1(payload).hexdigest(), kind, first[r.html] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = pages(spark)
    assert sorted(map(tuple, warc.op3(df).collect()), key=str) == expected(df.collect())


def test_manifest_finds_single_records(spark):
    df = pages(spark)
    manifest = warc.write(df, scratch_path(spark, "warc")).collect()
    html = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert len(manifest) == df.count()
    for place in manifest:
        found = warc.read_record(place.path, place.frame, place.offset)
        assert found["page_id"] == place.page_id
        if found["record_type"] == "response":
            assert found["payload"] == html[place.page_id]


def test_frames_are_independent():
    import zstandard

    packer = zstandard.ZstdCompressor()
    made = warc.bundle([(packer.compress(x), len(x)) for x in (b"one", b"two" * 100)])
    # any reader of the format skips the table and sees one stream of frames
    reader = zstandard.ZstdDecompressor().stream_reader(made, read_across_frames=True)
    assert reader.read() == b"one" + b"two" * 100


def test_no_pages(spark):
    assert warc.op3(pages(spark).limit(0)).count() == 0
