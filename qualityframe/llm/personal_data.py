"""Personal data: fixed patterns plus bootstrapped contextual extraction, in DataFrame
expressions.

Method. Matches of the fixed patterns are seed entities. The words before an entity make
lexical patterns (one word, two words). Instances are the entities themselves and, as
candidates, tokens with a digit, with the number tokens that follow after single spaces, as
far as no entity overlaps; Spark keeps the graph of which pattern stands before which
instance, and scores both sides in turn: a pattern by the share of its distinct instances
that are trusted, an instance by the best confident pattern before it (a doubtful one would
only confirm itself). A pattern must introduce
several distinct seeds, and must be followed by an instance in a good part of all its own
occurrences in the corpus, so that articles and prepositions induce nothing. Patterns that
end with high confidence mark the instances after them that no fixed pattern knows. The
words before an instance are read back to the match before of its kind, however far.

Defined cases: a null or empty text has no span; positions are code points, ends are
exclusive; repeated rows each get a row and count as evidence once per distinct value;
without seeds nothing is discovered; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import discard, stored, whole

# Kinds of personal data in the order in which their spans are listed. A
# repeated part never gives back what it took, and a search starts at the start of a run
# or where the match before ended; both leave the matches as they are and keep long runs
# of the same characters from being searched again and again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OVER_255 = r"(^|\.)0*([3-9][0-9][0-9]|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})(\.|$)"
CONTEXT = "context"
INSTANCE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:(?<=[0-9A-Za-z)])\x20[().-]*+[0-9][0-9().-]*+(?=[\s,;:!?]|$))*+"
EDGES = r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$"
# the last word and the last two words before an instance; tried from the end of the text
ONE = r"(?s)^.*(?<!\p{L})(\p{L}++)[^\p{L}]*+$"
TWO = r"(?s)^.*(?<!\p{L})(\p{L}++[^\p{L}]++\p{L}++)[^\p{L}]*+$"


@dataclass(frozen=True)
class Trust:
    """When a pattern counts: seeds it must introduce, share of trusted instances, share
    of its occurrences that introduce an instance, rounds of scoring."""

    seeds: int = 5
    confidence: float = 0.8
    followed: float = 0.3
    rounds: int = 3


def luhn(digits: str) -> str:
    """SQL: does a string of digits pass the check sum?"""
    doubled = "if(a.i % 2 = 1, if(2 * cast(x AS int) > 9, 2 * cast(x AS int) - 9, 2 * cast(x AS int)), cast(x AS int))"
    return f"""aggregate(split(reverse({digits}), ''), named_struct('i', 0, 's', 0),
        (a, x) -> named_struct('i', a.i + 1, 's', a.s + {doubled}), a -> a.s % 10 = 0)"""


def base(text: str) -> dict[str, Column]:
    """Spans of each fixed kind, failing matches dropped."""
    found = {kind: spans.matches(text, pattern) for kind, pattern in BASE.items()}
    digits = lambda s: F.regexp_replace(s["match"], "[^0-9]", "")
    return {
        "email": found["email"],
        "ip": F.filter(found["ip"], lambda s: ~s["match"].rlike(OVER_255)),
        "card": F.filter(found["card"], lambda s: F.length(digits(s)).between(13, 19)),
        "phone": F.filter(found["phone"], lambda s: F.length(digits(s)).between(9, 15)),
    }


def _ranked(found: Column, kind: str, rank: int) -> Column:
    """Spans that sort by kind and then by start."""
    return F.transform(
        found,
        lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n, base, instances) for each document: sorted base spans, their number
    by kind, and entities and candidates with what stands before them. Stored."""
    out = docs.select(F.col(key).alias("key"), whole(text).alias("t"))
    for kind, found in base("t").items():
        out = out.withColumn(kind, found)
    valid = luhn("regexp_replace(s.match, '[^0-9]', '')")
    out = out.withColumn("card", F.expr(f"filter(card, s -> {valid})"))
    listed = F.concat(*[_ranked(F.col(k), k, r) for r, k in enumerate(BASE)])
    out = out.withColumn("base", F.array_sort(listed)).withColumn("numbers", spans.matches("t", INSTANCE))
    context = f"'one', lower(regexp_extract(s.gap, r'{ONE}', 1)), 'two', lower(regexp_extract(s.gap, r'{TWO}', 1))"
    seeds = [f"transform({k}, s -> named_struct('start', s.start, 'value', s.match, {context}, 'seed', true))" for k in BASE]
    others = f"""transform(filter(numbers, s -> NOT exists(base, b -> b.start < s.end AND b.end > s.start)), s -> named_struct(
        'start', s.start + length(s.match) - length(regexp_replace(s.match, '^[^A-Za-z0-9+]+', '')),
        'value', regexp_replace(s.match, r'{EDGES}', ''), {context}, 'seed', false))"""
    instances = f"filter(concat({', '.join(seeds)}, {others}), s -> s.one <> '')"
    counts = F.create_map(*[x for k in BASE for x in (F.lit(k), F.size(k).cast("long"))])
    out = out.select("key", counts.alias("n"), "base", F.expr(instances).alias("instances"))
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "personal-data")


def occurrences(found: DataFrame) -> DataFrame:
    """(row, start, stop, value, seed, pattern): an instance and a pattern before it."""
    each = found.select("row", F.expr("inline(instances)"))
    spoken = F.regexp_replace("two", r"[^\p{L}]+", " ")
    patterns = F.array_distinct(F.array("one", F.when(F.col("two") != "", spoken).otherwise(F.col("one"))))
    return each.select(
        "row", "start", (F.col("start") + F.length("value")).alias("stop"), F.lower("value").alias("value"), "seed",
        F.explode(patterns).alias("pattern"),
    )


def pattern_scores(edges: DataFrame, trust: Trust) -> DataFrame:
    """(pattern, confidence) from edges (pattern, value, seed), scored in turns. Stored."""
    trusted = edges.withColumn("score", F.col("seed").cast("double"))
    scores = None
    for _ in range(trust.rounds):
        # two instances nobody trusts are assumed beside those seen
        share = F.sum("score") / (F.count(F.lit(1)) + 2)
        new = trusted.groupBy("pattern").agg(
            share.alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds")
        )
        new = stored(new.where(F.col("seeds") >= trust.seeds).drop("seeds"), "patterns")
        if scores is not None:
            discard(scores)
        scores = new
        best = edges.join(scores, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        known = F.col("seed").cast("double")
        best_score = F.when(F.col("best") >= trust.confidence, F.col("best")).otherwise(F.lit(0.0))
        trusted = edges.join(best, "value", "left").withColumn("score", F.greatest(known, F.coalesce(best_score, F.lit(0.0))))
    return scores


def trusted_patterns(docs: DataFrame, found: DataFrame, trust: Trust, text: str = "text") -> DataFrame:
    """The patterns that may mark unseen instances: confident, and lexical enough. Stored."""
    seen = occurrences(found)
    edges = stored(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    uses = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"))
    sure = pattern_scores(edges, trust).where(F.col("confidence") >= trust.confidence)
    used = stored(sure.join(uses, "pattern"), "confident")
    if used.isEmpty():
        return used.select("pattern")
    # how often a pattern occurs at all, before whatever it may be
    words = docs.select(F.filter(F.split(F.lower(whole(text)), r"[^\p{L}]+", -1), lambda w: w != "").alias("words"))
    pairs = F.expr("zip_with(words, slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b))")
    each = words.select(F.explode(F.concat("words", F.filter(pairs, lambda p: p.isNotNull()))).alias("pattern"))
    totals = each.join(used.select("pattern"), "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    lexical = totals.join(used, "pattern").where(F.col("uses") >= trust.followed * F.col("total"))
    return stored(lexical.select("pattern"), "trusted")


def find(docs: DataFrame, trust: Trust = Trust(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, base, spans) for each document; spans are base and discovered ones."""
    found = scan(docs, key, text)
    patterns = trusted_patterns(docs, found, trust, text)
    new = occurrences(found).where(~F.col("seed")).join(patterns, "pattern")
    extra = new.groupBy("row").agg(
        F.collect_set(
            F.struct(F.lit(len(BASE)).alias("rank"), "start", F.col("stop").alias("end"), F.lit(CONTEXT).alias("kind"))
        ).alias("extra")
    )
    out = found.select("row", "key", "n", "base").join(extra, "row", "left")
    every = F.concat("base", F.coalesce("extra", F.filter("base", lambda s: F.lit(False))))
    return out.select("key", "n", "base", F.array_sort(every).alias("spans"))


def op4(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text")).select(
        F.col("key").alias("doc_id"),
        *[F.col("n")[k].alias(f"n_{k}") for k in BASE],
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(F.col("spans")).alias("spans"),
    )
