import numpy as np
import pytest
from pyspark.sql import functions as F

from qualityframe.llm import cap_filters


def brute(rows, cosine=0.95):
    """{row number: (links, component)} over all pairs of usable vectors."""
    ids = list(range(len(rows)))
    good = [
        i
        for i, (_, v) in enumerate(rows)
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    width = max((len(rows[i][1]) for i in good), key=lambda w: (sum(len(rows[i][1]) == w for i in good), w), default=0)
    good = [i for i in good if len(rows[i][1]) == width]
    unit = np.array([rows[i][1] for i in good], np.float64).reshape(len(good), width)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True, initial=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    root = dict(zip(ids, ids))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(ids, 0)
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        a, b = good[a], good[b]
        links[a] += 1
        links[b] += 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = {}
    for i in ids:
        same = [rows[j][0] for j in ids if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (links[i], min(same, default=None))
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


def check(df, crowd=cap_filters.CROWD):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = [(rows[i][0], *v) for i, v in brute(rows).items()]
    got = cap_filters.components(df, crowd=crowd).collect()
    assert order(tuple(r) for r in got) == order(want)
    return got


def planted(spark, sample, copies=40, per=5):
    """The given vectors, exact copies and copies at cosines of about 0.93 to 0.999."""
    rng = np.random.default_rng(7)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sample}/embeddings.parquet").collect()]
    base = np.array([v for _, v in rows])
    out, number = list(rows), 1_000_000
    for i in range(copies):
        for far in rng.uniform(0.03, 0.4, per):
            noise = rng.standard_normal(base.shape[1])
            v = base[i] / np.linalg.norm(base[i]) + far * noise / np.linalg.norm(noise)
            out.append((number, [float(np.float32(c)) for c in v * rng.uniform(0.5, 2)]))
            number += 1
        out.append((number, rows[i][1]))
        number += 1
    return spark.createDataFrame(out, "vec_id long, embedding array<float>").repartition(6)


def test_list_decoding_finds_every_direction():
    rng = np.random.default_rng(2)
    for size, filters in ((8, 300), (7, 50), (1, 4), (2, 20)):
        x = cap_filters.units(rng.standard_normal((50, size)))
        code = cap_filters.codes(size, filters, rng)
        row, word = cap_filters.listed(x, code, 0.3)
        every = code[0]
        for c in code[1:]:
            every = np.concatenate([np.repeat(every, len(c), 0), np.tile(c, (len(every), 1))], axis=1)
        assert np.allclose(np.linalg.norm(every, axis=1), 1)
        assert sorted(zip(row, word)) == sorted(zip(*np.nonzero(x @ every.T >= 0.3)))


@pytest.mark.parametrize("size, vectors", [(64, 500), (64, 100_000), (16, 5000), (3, 500)])
def test_share_of_pairs_found(size, vectors):
    caps = cap_filters.fitted(size, vectors)
    for cosine, least in ((0.95, 0.985), (0.97, 0.995)):
        a, b = cap_filters.made_pairs(size, cosine, np.random.default_rng(99))
        (i, x), (j, y) = caps.decoded(a), caps.decoded(b)
        met = len(set((np.intersect1d(i * 2**40 + x, j * 2**40 + y) >> 40).tolist()))
        assert met >= least * len(a)


def test_equal_to_brute_force(spark, sample):
    df = planted(spark, sample)
    got = check(df)
    assert sum(r.n_links > 0 for r in got) > 100
    assert [f.name for f in cap_filters.op13(df).schema] == ["vec_id", "n_links", "component_id", "kept"]


def test_crowds_in_blocks_and_by_cap(spark, sample):
    """A tight crowd and a chain, larger than a block; copies hold a third of the rows."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    tight = [centre + 0.03 * rng.standard_normal(24) for _ in range(90)]
    steps = np.linspace(0, 5.5, 140)
    a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
    chain = [np.cos(t) * a + np.sin(t) * b for t in steps]
    rows = [[float(c) for c in v] for v in (*tight, *chain, *[tight[0]] * 60, *[centre * 3] * 60)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = check(df.repartition(5), crowd=16)
    assert max(r.n_links for r in got) >= 209
    assert len({r.component_id for r in got}) < 5


def test_groups_by_cap_where_that_compares_less(spark):
    """Every pair of a chain that shares a cap is in a group; blocks only where it is less."""
    inside = spark.range(60).selectExpr("id AS cls", "0L AS root")
    found = spark.range(60).selectExpr("id AS cls", "sequence(id div 4, id div 4 + 1) AS found")
    rows = cap_filters.groups_to_verify(inside, found, 16).collect()
    assert {r.f for r in rows} == set(range(16)) and all((r.i, r.j) == (0, 0) for r in rows)
    every = found.withColumn("found", F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    rows = cap_filters.groups_to_verify(inside, every, 16).collect()
    assert {r.f for r in rows} == {-1}
    sides = {}
    for r in rows:
        sides.setdefault((r.i, r.j), []).append((r.cls, r.first))
    met = set()
    for (i, j), group in sides.items():
        left = [c for c, first in group if first]
        right = left if i == j else [c for c, first in group if not first]
        new = {(min(x, y), max(x, y)) for x in left for y in right if x != y}
        assert not new & met
        met |= new
    assert len(met) == 60 * 59 // 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [1e300, 2e300, 3e300]),
        (4, [1e-300, 2e-300, 3e-300]), (5, [-1.0, -2.0, -3.0]), (None, [1.0, 2.0, 3.1]), (None, [0.0, 0.0, 1.0]),
        (6, None), (7, [0.0, 0.0, -0.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [None, 1.0, 1.0]),
        (11, []), (12, [1.0, 2.0]), (13, [0.0, -0.0, 2.0]),
    ]
    wide = [(*r, i, "k", 0.5, b"x") for i, r in enumerate(rows)]
    kind = "vec_id long, embedding array<double>, cls long, key string, n double, x binary"
    df = spark.createDataFrame(wide, kind)
    check(df)
    kept = {(r.vec_id, r.n_links, r.kept) for r in cap_filters.op13(df).collect()}
    assert (6, 0, True) in kept and (None, 1, False) in kept and (2, 5, False) in kept
    assert cap_filters.op13(df.limit(0)).count() == 0
    assert cap_filters.op13(df.where("vec_id = 6")).collect()[0].kept
