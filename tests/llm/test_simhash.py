import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from qualityframe.llm import simhash


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """Smallest id reachable over links, by search."""
    prints = sorted({p for _, p in rows})
    left, name = set(prints), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            one = todo.pop()
            group.append(one)
            near = {x for x in left if (x ^ one).bit_count() <= 2}
            left -= near
            todo += near
        ids = [k for k, p in rows if p in set(group) and k is not None]
        name.update(dict.fromkeys(group, min(ids) if ids else None))
    return name


def check(df):
    rows = [(r.doc_id, fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    name = components(rows)
    want = sorted(((k, f"{p:016x}", name[p]) for k, p in rows), key=str)
    assert sorted(map(tuple, simhash.op9(df).collect()), key=str) == want


def test_sample_table_equals_brute_force(spark, sample):
    check(spark.read.parquet(f"{sample}/documents.parquet"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.op9(no_docs).count() == 0


def near_codes():
    """Chains, stars and cliques of codes, and strangers."""
    rng = random.Random(4)
    out = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        code = rng.getrandbits(64)
        out |= {code ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(1200)}
    code = rng.getrandbits(64)
    for step in range(40):
        code ^= 0b11 << step
        out.add(code)
    return sorted(out)


def test_tree_finds_every_pair():
    codes = np.array(near_codes(), np.uint64)
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    codes = codes[np.argsort(rank)]
    i, j = simhash.tree_pairs(codes)
    want = {(a, b) for a in range(len(codes)) for b in (a + 1 + np.flatnonzero(np.bitwise_count(codes[a + 1 :] ^ codes[a]) <= 2)).tolist()}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("largest", [40, 2048])
def test_components_do_not_depend_on_bucket_size(spark, largest):
    codes = near_codes()
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    dealt = simhash.buckets(df, 2, largest)
    assert dealt.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= max(largest, 40)
    stars = simhash.star_components(simhash.bucket_links(dealt)).collect()
    root = {r.node: r.root for r in stars}
    got = {}
    for r in df.collect():
        got.setdefault(root.get(r.fp, r.fp), set()).add(r.fp % 2**64)
    name = components([(c, c) for c in codes])
    want = {}
    for c in codes:
        want.setdefault(name[c], set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(999)) for _ in range(300)) for _ in range(20)]
    rows = [(i, texts[i % 20]) for i in range(60)] + [(None, texts[0]), (None, "alone"), (None, "alone"), (70, "new"), (70, "new"), (70, texts[1]), (71, None), (72, "")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [*enumerate(texts), (None, "alone"), (70, "new"), (71, None)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_odd_rows_one_stays(odd_docs, no_docs):
    out = simhash.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "5", "6", "None"]
    assert simhash.keep_one(no_docs).count() == 0


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_similar_texts_group_and_others_do_not(spark):
    """Copies of a text with few words changed; the truth is Jaccard by brute force."""
    rng = random.Random(9)
    rows, texts = [], []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // 120)):
                copy[at] = "changed"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    near = [(a, b) for a in sets for b in range(4 * (a // 4), a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 100
    assert sum(found[a] == found[b] for a, b in near) >= 0.95 * len(near)
    assert all(c // 4 == i // 4 for i, c in found.items())  # nothing unrelated meets


def test_crowds_of_near_copies_are_split_and_still_meet(spark):
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(400)] = f"c{i}"
        rows.append((i, " ".join(copy)))
    marks = simhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), also=("doc_id",))
    links = simhash.similar_links(marks.withColumnRenamed("__fp", "fp"), largest=60)
    stars = simhash.star_components(links).collect()
    assert len(stars) >= 390 and len({r.root for r in stars}) == 1


def test_crowded_buckets_stay_whole(spark):
    rows = [(b, i) for b, size in ((7, 130), (8, 20), (9, 1)) for i in range(size)]
    dealt = simhash.in_blocks(spark.createDataFrame(rows, "bucket long, id long"), "id", 20)
    groups = {}
    for r in dealt.collect():
        groups.setdefault(r.bucket, []).append(r.id)
    assert groups[8] == list(range(20)) and groups[9] == [0]
    met = {(a, b) for g in (set(v) for k, v in groups.items() if k not in (8, 9)) for a in g for b in g}
    assert met == {(a, b) for a in range(130) for b in range(130)}
    assert max(map(len, groups.values())) < 130


def test_pairs_in_a_crowd_are_found(spark):
    """Texts of one template, all in crowded buckets; each has one near copy."""
    rng = random.Random(11)
    base, texts = [f"w{k}" for k in range(400)], []
    for i in range(150):
        one = list(base)
        for at in rng.sample(range(400), 25):
            one[at] = f"t{i}x{at}"
        texts.append(one)
        copy = list(one)
        for at in rng.sample(range(400), 6):
            copy[at] = f"c{i}x{at}"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingle_set(t) for i, t in rows}
    near = [i for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(near) > 100
    marks = simhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), also=("doc_id",)).withColumnRenamed("__fp", "fp")
    marks = marks.cache()
    name = {r.doc_id: r.fp for r in marks.collect()}

    def joined(largest):
        root = {r.node: r.root for r in simhash.star_components(simhash.similar_links(marks, largest=largest)).collect()}
        return {i for i in near if root.get(name[i], name[i]) == root.get(name[i + 1], name[i + 1])}

    assert joined(8) == joined(10_000)


def test_block_edits_are_found_and_links_are_exact(spark):
    """Copies with a block appended, cut or replaced, at 0.7 to 0.9; the truth is Jaccard."""
    rng = random.Random(12)
    rows, kinds = [], 3
    for i in range(240):
        base = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        extra = [f"x{rng.randrange(50_000)}" for _ in range(90)]
        k = rng.randrange(30, 90)
        copy = [base + extra[:k], base[: 300 - k], base[: 300 - k // 2] + extra[: k // 2]][i % kinds]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    near = {i for i in range(0, 480, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert 50 < len(near) < 200
    assert {i for i in range(0, 480, 2) if found[i] == found[i + 1]} == near


def test_fingerprints_of_the_operator_link_in_the_stage(spark):
    """Texts that operator 9 groups and whose five-word similarity is far below 0.8."""
    rng = random.Random(13)
    rows = [(i, "red dog ran far home " * 100 + " ".join(f"t{rng.randrange(10**6)}" for _ in range(15))) for i in range(12)]
    rows.append((50, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component for r in simhash.groups(docs).collect()}
    assert len(set(want.values())) == 2
    assert {r.doc_id: r.component for r in simhash.similar_groups(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 50]


def test_rows_of_a_bucket_grow_with_its_classes(spark):
    """Near copies, each pair of them a candidate and a link: what joins them is written."""
    rng = random.Random(14)
    base, n = [f"w{k}" for k in range(300)], 60
    rows = []
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(300)] = f"c{i}"
        rows.append((i, " ".join(copy)))
    marks = simhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    columns = {"__fp": "id", "__size": "size", "__sketch": "sketch", "__data": "data"}
    bucket = marks.select(F.lit(1).cast("long").alias("bucket"), F.col("__fp").alias("root"), *[F.col(a).alias(b) for a, b in columns.items()])
    for found in (simhash.bucket_candidates(bucket, 0.8), simhash.cluster_links(bucket, 0.8)):
        stars = simhash.star_components(found).collect()
        assert found.count() == n - 1 == len(stars)
        assert len({r.root for r in stars}) == 1
