import hashlib
import re

from qualityframe.llm import personal_data
from qualityframe.llm.common import table

# The kinds and their patterns.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def check(df):
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    rows = personal_data.op4(df).collect()
    for r in rows:
        found = {k: [m for m in re.finditer(p, texts[r.doc_id]) if holds(k, m.group())] for k, p in KINDS.items()}
        written = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(ms) for ms in found.values()]
        assert r.spans.startswith(written)
    return {r.doc_id: r.spans for r in rows}


def test_sample_table_equals_brute_force(spark, sample):
    check(table(spark, sample, "documents"))


def test_edge_cases_equal_brute_force(spark):
    texts = [
        "a@b.c_d@e.f x@y z@w.v 𝔘 q@r.s",
        "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.1 1.1.1.256",
        "+1 (((( +44 20 7946 0958 and +1-2 +123456789012345678",
        "4111 1111 1111 1111-22 4111-1111-1111-1111 4111111111111112",
        "1" * 5000 + " " + "a" * 30_000 + " " + "a." * 5000 + "@b",
        "1.2" * 3000 + " " + "12 " * 4000,
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_patterns_are_learned_and_find_unseen_identifiers(spark):
    rows = [(k, f"note {k}z9 staffcode jo{k}@x.com and the +1 555 00001{k:02d} by the {k}k8") for k in range(10, 50)]
    rows += [(100, "our staffcode QX-9981, ok"), (101, "the 4711x is no identifier"), (102, "the the the")]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found[100] == "context:14:21"
    assert found[101] == ""
    assert not any("context" in found[k] for k in range(10, 50))


def test_entities_of_several_tokens_are_seeds_and_are_found(spark):
    rows = [(k, f"x hotline +1 (017) 555-77{k} y, passport number 4111 1111 1111 1111 z " + "a number of words " * 8) for k in range(10, 30)]
    rows += [(k, f"mail {chr(k + 67)}@x.org passport number {k}.1.1.7 the number") for k in range(30, 50)]
    rows += [(100, "hotline 555 01 99, or"), (101, "Passport  number: C01X 77 88 and 5 6"), (102, "a number 17 here"), (103, "mail box7")]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found[100] == "context:8:17"
    assert found[101] == "context:18:28"
    assert found[102] == ""
    assert found[103] == "context:5:9"


def scores(edges, rounds=3, seeds=5, confidence=0.8):
    """The graph scored with dicts: edges are {(pattern, value): seed}."""
    score = {e: float(s) for e, s in edges.items()}
    for _ in range(rounds):
        by = {}
        for (p, _), x in score.items():
            by.setdefault(p, []).append(x)
        sure = {p: sum(x) / (len(x) + 2) for p, x in by.items() if sum(edges[e] for e in edges if e[0] == p) >= seeds}
        best = {}
        for p, v in edges:
            if p in sure:
                best[v] = max(best.get(v, 0.0), sure[p])
        score = {e: max(float(s), best[e[1]] if best.get(e[1], 0.0) >= confidence else 0.0) for e, s in edges.items()}
    return sure


def test_pattern_scores_equal_plain_dicts(spark):
    import random

    rng = random.Random(4)
    edges = {(f"p{rng.randrange(8)}", f"v{rng.randrange(60)}"): rng.random() < 0.6 for _ in range(250)}
    made = spark.createDataFrame([(*e, s) for e, s in edges.items()], "pattern string, value string, seed boolean")
    got = {r.pattern: r.confidence for r in personal_data.pattern_scores(made, personal_data.Trust()).collect()}
    want = scores(edges)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_entities_enter_the_graph_whole(spark, sample):
    docs = table(spark, sample, "documents")
    seen = personal_data.occurrences(personal_data.scan(docs)).where("seed").select("value").distinct().collect()
    for kind, pattern in KINDS.items():
        assert any(re.fullmatch(pattern, r.value) and (kind != "card" or "." not in r.value) for r in seen), kind


def test_odd_rows(odd_docs, no_docs):
    rows = personal_data.op4(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == "" for r in rows)
    assert personal_data.op4(no_docs).count() == 0
