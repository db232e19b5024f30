"""Profiling, correlation, sampling and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.config import Profiling
from qualityframe.operators import (
    categories,
    forest,
    numeric,
    relations,
    semantic,
    structure,
    text,
    times,
)
from qualityframe.operators.scale import scratch_path
from qualityframe.plans import incremental
from qualityframe.plans import profile as plans

from .inputs import frame, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(source: str, names: list[str], select: str) -> str:
    """One row per column: `select` uses {c} for the column."""
    body = union([f"SELECT '{c}' AS \"column\", {select.format(c=c)} FROM src" for c in names])
    return f"WITH src AS (SELECT * FROM {source} AS t)\n{body}"


DIRT_NUMBERS = ["age", "amount", "amount_twin", "birth_year", "gap", "lot", "qty", "tax_zero"]
DIRT_LABELS = ["gender", "grade", "phone", "status"]
DIRT = sorted([*DIRT_NUMBERS, *DIRT_LABELS, "email", "ship", "zip_code"])


# ---- counts, missing values, uniqueness ----

query(
    "null_ratio",
    per_column(
        sql("dirt"), DIRT,
        "count(*) AS row_count, count(*) - count({c}) AS null_count, "
        "round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_ratio",
    ),
)(lambda s, d: rounded(structure.null_ratio(frame(s, d, "dirt"))))

query(
    "total_null_ratio",
    "SELECT round(("
    + " + ".join(f"count(*) - count({c})" for c in DIRT)
    + f") / (count(*) * {len(DIRT)})::DOUBLE, 6) AS total_null_ratio FROM {sql('dirt')} AS t",
)(lambda s, d: rounded(structure.total_null_ratio(frame(s, d, "dirt"))))

query(
    "uniqueness",
    per_column(
        sql("dirt"), DIRT,
        "count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, "
        "round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS unique_ratio, "
        "round((count(*) - count(DISTINCT {c})) / count(*)::DOUBLE, 6) AS duplicate_ratio",
    ),
)(lambda s, d: rounded(structure.uniqueness(frame(s, d, "dirt"))))

query(
    "uniqueness_documents",
    per_column(
        "documents", ["doc_id", "lang", "n_chars", "source", "text"],
        "count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, "
        "round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS unique_ratio, "
        "round((count(*) - count(DISTINCT {c})) / count(*)::DOUBLE, 6) AS duplicate_ratio",
    ),
)(lambda s, d: rounded(structure.uniqueness(table(s, d, "documents"))))

DUPLICATES = (
    "SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
    "round(CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_row_ratio "
    "FROM (SELECT count(*) AS n FROM {src} AS t GROUP BY ALL_COLUMNS) AS g"
)

query(
    "dup_row_ratio",
    DUPLICATES.format(src=sql("dirt")).replace("ALL_COLUMNS", ", ".join(DIRT)),
)(lambda s, d: rounded(structure.duplicate_rows(frame(s, d, "dirt"))))

query(
    "dataset_profile",
    f"""
    WITH src AS (SELECT * FROM {sql('readings')} AS t),
    dup AS (SELECT CAST(sum(n) AS BIGINT) AS rows_, CAST(sum(n - 1) AS BIGINT) AS again
            FROM (SELECT count(*) AS n FROM src GROUP BY event_id, value, sparse, event_type, area, ts) AS g)
    SELECT rows_ AS row_count, CAST(6 AS BIGINT) AS column_count,
      round(again / rows_::DOUBLE, 6) AS duplicate_row_ratio,
      (SELECT CAST(8 * (count(event_id) + count(value) + count(sparse) + count(ts))
          + sum(strlen(event_type)) + sum(strlen(area)) AS BIGINT) FROM src) AS bytes,
      (SELECT round((count(*) - count(sparse) + count(*) - count(area)) / (6 * count(*))::DOUBLE, 6)
         FROM src) AS total_null_ratio,
      'bigint=1,double=2,string=2,timestamp_ntz=1' AS types
    FROM dup
    """,
)(
    lambda s, d: rounded(structure.dataset_profile(frame(s, d, "readings")))
    .withColumn(
        "types",
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("type_distribution")),
                lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
            ),
            ",",
        ),
    )
    .drop("type_distribution")
)

query("fingerprint")(lambda s, d: structure.fingerprint(table(s, d, "lineitem")))

SAMPLE = Profiling(sampling_threshold=5000, sample_size=2000)

query(
    "sample_rows",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY md5(concat('42', '|', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 2000
    """,
)(
    lambda s, d: structure.sample_rows(
        table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], SAMPLE
    )
)

# ---- numbers ----

STATS = """
  count({c}) AS n, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std,
  var_samp({c}) AS variance, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
  CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50,
  CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75,
  CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END AS skew,
  CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE kurtosis({c}) END AS kurt,
  avg(CASE WHEN {c} = 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) AS zeros
"""

BIMODAL = (
    "CASE WHEN n > 3 THEN least((skew * skew + 1) / (kurt + 3 + 3 * (n - 1.0) * (n - 1.0) "
    "/ ((n - 2.0) * (n - 3.0))), 1.0) ELSE 0.0 END"
)


def stats_cte(source: str, names: list[str]) -> str:
    body = union(
        [
            f"SELECT '{c}' AS col, {STATS.format(c=f'CAST({c} AS DOUBLE)')} FROM src"
            for c in names
        ]
    )
    return f"src AS MATERIALIZED (SELECT * FROM {source} AS t), stats AS MATERIALIZED ({body})"


def numeric_oracle(source: str, names: list[str]) -> str:
    return f"""
    WITH {stats_cte(source, names)}
    SELECT col AS "column", n, round(mean, 4) AS mean, round(median, 4) AS median,
      round(std, 4) AS std, round(variance, 4) AS variance, round(lo, 4) AS "min",
      round(hi, 4) AS "max", round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75,
      round(q75 - q25, 4) AS iqr, round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis,
      round({BIMODAL}, 4) AS bimodality, round(zeros, 4) AS zero_ratio,
      round(CASE WHEN mean <> 0 THEN std / mean ELSE 0.0 END, 4) AS cv
    FROM stats
    """


LINE_NUMBERS = ["l_discount", "l_extendedprice", "l_linenumber", "l_quantity", "l_tax"]

query("numeric_profile", numeric_oracle("lineitem", LINE_NUMBERS))(
    lambda s, d: numeric.numeric_profile(table(s, d, "lineitem"), LINE_NUMBERS)
)
query("numeric_profile_nulls", numeric_oracle(sql("dirt"), ["age", "gap", "lot", "qty", "tax_zero"]))(
    lambda s, d: numeric.numeric_profile(
        frame(s, d, "dirt"), ["age", "gap", "lot", "qty", "tax_zero"]
    )
)


def outlier_cte(names: list[str]) -> str:
    """Outlier share per column on top of `stats`."""
    parts = []
    for c in names:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT s.col, s.n, s.kurt, s.skew, s.variance, s.lo, s.hi,
              sum(CASE WHEN {x} IS NULL THEN 0
                WHEN abs(s.skew) < 1 THEN CASE WHEN s.std > 0 AND abs({x} - s.mean) / s.std > 3 THEN 1 ELSE 0 END
                WHEN s.q75 = s.q25 THEN 0
                WHEN {x} < s.q25 - 1.5 * (s.q75 - s.q25) OR {x} > s.q75 + 1.5 * (s.q75 - s.q25) THEN 1
                ELSE 0 END) / s.n::DOUBLE AS outlier_ratio
            FROM src, stats AS s WHERE s.col = '{c}'
            GROUP BY s.col, s.n, s.kurt, s.skew, s.variance, s.lo, s.hi"""
        )
    return f"fenced AS MATERIALIZED ({union(parts)})"


OUTLIER_NAMES = ["amount", "qty", "tax_zero"]
query(
    "outlier_ratio",
    f"""
    WITH {stats_cte(sql('dirt'), OUTLIER_NAMES)}, {outlier_cte(OUTLIER_NAMES)}
    SELECT col AS "column", round(outlier_ratio, 4) AS outlier_ratio,
      round(abs(kurt), 4) AS heavy_tail_score, round({BIMODAL}, 4) AS multimodality_score,
      round(CASE WHEN hi > lo THEN variance / (hi - lo) ELSE 0.0 END, 4) AS low_variance_indicator
    FROM fenced
    """,
)(lambda s, d: numeric.outlier_ratio(frame(s, d, "dirt"), OUTLIER_NAMES))

# ---- labels ----

query(
    "logical_types",
    """
    WITH s AS (
      """
    + union(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS k, "
            f"avg(length({c})) AS len FROM src"
            for c in ["email", "gender", "grade", "phone", "status", "zip_code"]
        ]
    )
    + """
    )
    SELECT "column", 'string' AS dtype,
      CASE WHEN n = 0 THEN 'text'
           WHEN len < 50 AND (k < 100 OR k / n::DOUBLE < 0.1) THEN 'categorical'
           ELSE 'text' END AS logical_type FROM s
    UNION ALL SELECT * FROM (VALUES ('age', 'bigint', 'numeric'), ('amount', 'double', 'numeric'),
      ('amount_twin', 'double', 'numeric'), ('birth_year', 'bigint', 'numeric'),
      ('gap', 'double', 'numeric'), ('lot', 'int', 'numeric'), ('qty', 'double', 'numeric'),
      ('ship', 'timestamp_ntz', 'datetime'), ('tax_zero', 'double', 'numeric')) AS v
    """,
)(lambda s, d: categories.logical_types(frame(s, d, "dirt")))
ORACLES["logical_types"] = (
    f"WITH src AS (SELECT * FROM {sql('dirt')} AS t), "
    + ORACLES["logical_types"].strip().removeprefix("WITH ")
)

COUNTS = """
  SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n,
    CAST(sum(count(*)) OVER () AS BIGINT) AS total,
    count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
  FROM src WHERE {c} IS NOT NULL GROUP BY {c}
"""


def counts_cte(source: str, names: list[str], name: str = "counts") -> str:
    body = union(["SELECT * FROM (" + COUNTS.format(c=c) + ") AS x" for c in names])
    return f"src AS MATERIALIZED (SELECT * FROM {source} AS t), {name} AS MATERIALIZED ({body})"


READING_LABELS = ["area", "event_type"]
query(
    "value_counts",
    f"WITH {counts_cte(sql('readings'), READING_LABELS)} "
    'SELECT "column", "value", n, total, round(share, 6) AS share FROM counts',
)(lambda s, d: rounded(categories.value_counts(frame(s, d, "readings"), READING_LABELS)))

query(
    "rare_categories",
    f"WITH {counts_cte(sql('readings'), READING_LABELS)} "
    'SELECT "column", "value", n, round(share, 6) AS share FROM counts WHERE share < 0.01',
)(
    lambda s, d: rounded(
        categories.rare_categories(categories.value_counts(frame(s, d, "readings"), READING_LABELS))
    )
)

SUMMARY = """
  SELECT "column", count(*) AS cardinality, -sum(share * log2(share)) AS entropy,
    (arg_min("value", {{'less': -n, 'v': "value"}})) AS mode, max(share) AS mode_ratio,
    count(*) FILTER (share < 0.01) AS rare_count
  FROM counts GROUP BY "column"
"""

query(
    "categorical_profile",
    f"WITH {counts_cte(sql('readings'), READING_LABELS)}, summary AS ({SUMMARY.format()}) "
    'SELECT "column", cardinality, round(entropy, 4) AS entropy, mode, '
    "round(mode_ratio, 4) AS mode_ratio, round(mode_ratio, 4) AS dominance_ratio, rare_count FROM summary",
)(lambda s, d: categories.categorical_profile(frame(s, d, "readings"), READING_LABELS))

EVEN = "CASE WHEN cardinality > 1 THEN entropy / log2(cardinality) ELSE entropy END"
query(
    "categorical_behavior",
    f"WITH {counts_cte(sql('readings'), READING_LABELS)}, summary AS ({SUMMARY.format()}) "
    'SELECT "column", round(rare_count / cardinality::DOUBLE, 4) AS outlier_ratio, '
    f"round(1 - {EVEN}, 4) AS heavy_tail_score, round(mode_ratio, 4) AS multimodality_score, "
    f"round(1 - {EVEN}, 4) AS low_variance_indicator FROM summary",
)(lambda s, d: categories.categorical_behavior(frame(s, d, "readings"), READING_LABELS))

# ---- dates and text ----

ISO = "strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {x} = date_trunc('second', {x}) THEN '' ELSE strftime({x}, '.%f') END"
query(
    "datetime_profile",
    f"""SELECT 'ts' AS "column", {ISO.format(x='min(ts)')} AS "min", {ISO.format(x='max(ts)')} AS "max",
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 4) AS range_days FROM events
    UNION ALL SELECT 'l_shipdate', {ISO.format(x='min(l_shipdate)')}, {ISO.format(x='max(l_shipdate)')},
      round((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 86400000000.0, 4) FROM lineitem""",
)(
    lambda s, d: times.datetime_profile(table(s, d, "events")).unionByName(
        times.datetime_profile(table(s, d, "lineitem"))
    )
)

query(
    "monotonic",
    """
    WITH steps AS (SELECT event_id AS k, min(ts) AS low, max(ts) AS high FROM events GROUP BY event_id),
    lagged AS (SELECT low, lag(high) OVER (ORDER BY k) AS prev FROM steps),
    orders_ AS (SELECT o_orderdate AS low, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS prev FROM orders)
    SELECT 'ts' AS "column", NOT bool_or(coalesce(prev > low, false)) AS monotonic FROM lagged
    UNION ALL
    SELECT 'o_orderdate', NOT bool_or(coalesce(prev > low, false)) FROM orders_
    """,
)(
    lambda s, d: times.monotonic(table(s, d, "events"), "ts", "event_id").unionByName(
        times.monotonic(table(s, d, "orders"), "o_orderdate", "o_orderkey")
    )
)

TEXT = """
  round(avg(length({c})), 4) AS avg_length, round(stddev_samp(length({c})), 4) AS length_std,
  round(sum(len(regexp_extract_all({c}, '\\p{{Nd}}'))) / sum(length({c}))::DOUBLE, 4) AS digit_ratio,
  round(sum(len(regexp_extract_all({c}, '[\\s\\p{{Z}}\\x0b\\x85]'))) / sum(length({c}))::DOUBLE, 4) AS whitespace_ratio,
  round(sum(len(regexp_extract_all({c}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x0b\\x85]'))) / sum(length({c}))::DOUBLE, 4)
    AS special_char_ratio
"""
query(
    "text_profile",
    union(
        [
            f"SELECT 'text' AS \"column\", {TEXT.format(c='text')} FROM documents",
            f"SELECT 'html' AS \"column\", {TEXT.format(c='html')} FROM pages",
            f"SELECT 'url' AS \"column\", {TEXT.format(c='url')} FROM pages",
        ]
    ),
)(
    lambda s, d: text.text_profile(table(s, d, "documents"), ["text"]).unionByName(
        text.text_profile(table(s, d, "pages"), ["html", "url"])
    )
)

# ---- pairs ----

PAIR_NAMES = ["discount", "price", "qty", "tax"]


def upper(names: list[str], cell: str) -> str:
    names = sorted(names)
    return union(
        [
            f"SELECT '{a}' AS col1, '{b}' AS col2, round({cell.format(a=a, b=b)}, 6) AS \"value\" FROM src"
            for i, a in enumerate(names)
            for b in names[i:]
        ]
    )


PEARSON = f"WITH src AS MATERIALIZED (SELECT * FROM {sql('numbers')} AS t) " + upper(
    PAIR_NAMES, "corr({a}, {b})"
)
query("corr_pearson", PEARSON)(
    lambda s, d: rounded(relations.pearson(frame(s, d, "numbers"), PAIR_NAMES))
)

WIDE = sorted([*DIRT_NUMBERS, "gap2", "qty2"])
WIDE_SQL = f"(SELECT *, gap * 3 - age AS gap2, qty * qty AS qty2 FROM {sql('dirt')} AS w)"
query(
    "corr_pearson_wide",
    f"SELECT * FROM (WITH src AS MATERIALIZED (SELECT * FROM {WIDE_SQL} AS t) "
    + upper(WIDE, "corr({a}, {b})")
    + ') AS x WHERE "value" IS NOT NULL AND NOT isnan("value")',
)(
    lambda s, d: rounded(
        relations.pearson(
            frame(s, d, "dirt")
            .withColumn("gap2", F.col("gap") * 3 - F.col("age"))
            .withColumn("qty2", F.col("qty") * F.col("qty")),
            WIDE,
        )
    )
)

RANKED = union(
    [
        f"""SELECT '{a}' AS col1, '{b}' AS col2, round(corr(ra, rb), 6) AS "value" FROM (
          SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
          FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS r"""
        for i, a in enumerate(["discount", "price", "qty"])
        for b in ["discount", "price", "qty"][i:]
    ]
)
query(
    "corr_spearman",
    f"WITH src AS MATERIALIZED (SELECT * FROM {sql('numbers')} AS t) {RANKED}",
)(
    lambda s, d: rounded(
        relations.spearman(frame(s, d, "numbers"), ["discount", "price", "qty"])
    )
)

# every pair of customers would be too many for SQL at larger sizes; accounts of one
# nation-level table keep the brute force affordable
TAU = """
  WITH src AS (SELECT s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation, CAST(s_suppkey % 7 AS DOUBLE) AS week
               FROM supplier),
  rows_ AS (SELECT row_number() OVER () AS i, * FROM src)
"""


def tau(a: str, b: str) -> str:
    x, y = f"sign(p.{a} - q.{a})", f"sign(p.{b} - q.{b})"
    return (
        f"SELECT '{a}' AS col1, '{b}' AS col2, round(sum({x} * {y}) / "
        f"sqrt(sum({x} * {x}) * sum({y} * {y})::DOUBLE), 6) AS \"value\" FROM rows_ AS p, rows_ AS q WHERE p.i < q.i"
    )


query(
    "corr_kendall",
    TAU
    + union(
        [
            tau(a, b)
            for i, a in enumerate(["balance", "nation", "week"])
            for b in ["balance", "nation", "week"][i:]
        ]
    ),
)(
    lambda s, d: rounded(
        relations.kendall(
            table(s, d, "supplier").select(
                F.col("s_acctbal").alias("balance"),
                F.col("s_nationkey").cast("double").alias("nation"),
                (F.col("s_suppkey") % 7).cast("double").alias("week"),
            )
        )
    )
)

query("corr_kendall_lines")(
    lambda s, d: rounded(
        relations.kendall(
            frame(s, d, "numbers"), ["price", "qty"], rows_per_strip=20_000
        )
    )
)


def _corr_summary(s, d) -> DataFrame:
    pairs = relations.pearson(frame(s, d, "numbers"), PAIR_NAMES)
    highest, density = relations.correlation_summary(pairs)
    return rounded(
        highest.unionByName(
            density.select(
                F.lit("*").alias("column"), F.col("correlation_density").alias("max_abs_correlation")
            )
        )
    )


query(
    "corr_summary",
    "WITH src AS MATERIALIZED (SELECT * FROM "
    + sql("numbers")
    + " AS t), pairs AS MATERIALIZED ("
    + upper(PAIR_NAMES, "corr({a}, {b})").replace("round(corr", "(corr").replace(", 6) AS", ") AS")
    + """), off AS (SELECT * FROM pairs WHERE col1 <> col2)
    SELECT "column", round(max(abs("value")), 6) AS max_abs_correlation
    FROM (SELECT col1 AS "column", "value" FROM off UNION ALL SELECT col2, "value" FROM off) AS e
    GROUP BY "column"
    UNION ALL SELECT '*', round(avg(abs("value")), 6) FROM off""",
)(_corr_summary)

# ---- classes and models ----


def classes_sql(source: str, texts: list[str], numbers: list[str] = (), days: list[str] = (), others: list[str] = ()) -> str:
    """(col, predicted_class, confidence) like the classifier, `cls` as a CTE body."""
    parts = []
    for c in [*texts, *numbers, *days, *others]:
        for place, (label, pattern, words) in enumerate(semantic.CLASSES):
            named = 0.3 if any(w in c.lower() for w in words) else 0.0
            if c in texts:
                share = f"coalesce(avg(CASE WHEN regexp_matches({c}, '{pattern}') THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END), 0.0)"
            elif c in numbers and label in semantic.NUMBER_CLASSES:
                share = f"coalesce(avg(CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '{pattern}') THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END), 0.0)"
            elif c in days and label in semantic.DAY_CLASSES:
                share = f"CASE WHEN bool_and({c} = date_trunc('day', {c})) THEN 1.0 ELSE 0.0 END"
            else:
                share = "0.0"
            parts.append(
                f"SELECT '{c}' AS col, '{label}' AS label, {place} AS place, "
                f"CAST({share} AS DOUBLE) * 0.7 + {named} AS score FROM {source}"
            )
    return f"""
      SELECT col, label AS predicted_class, score AS confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY col ORDER BY score DESC, place) AS rk
        FROM ({union(parts)}) AS all_ WHERE score > 0.1) AS best
      WHERE rk = 1 AND score >= 0.4"""


PEOPLE_TEXT = ["email", "mobile", "ssn", "card", "host", "nation", "gender", "region_name", "segment"]
query(
    "semantic_class",
    f"""WITH src AS MATERIALIZED (SELECT * FROM {sql('people')} AS t),
    cls AS ({classes_sql('src', PEOPLE_TEXT, ['customer_no'])})
    SELECT col AS "column", predicted_class, round(confidence, 4) AS confidence FROM cls""",
)(lambda s, d: semantic.semantic_class(frame(s, d, "people")))

query(
    "semantic_class_orders",
    f"""WITH cls AS ({classes_sql('orders', ['o_orderstatus', 'o_orderpriority'], ['o_orderkey', 'o_custkey'], ['o_orderdate'])})
    SELECT col AS "column", predicted_class, round(confidence, 4) AS confidence FROM cls""",
)(lambda s, d: semantic.semantic_class(table(s, d, "orders")))


def _tags(s, d) -> DataFrame:
    people = frame(s, d, "people")
    shape = structure.null_ratio(people).select("column", "row_count")
    tagged = semantic.tag_columns(shape, semantic.semantic_class(people))
    return tagged.select("column", "row_count", F.array_join("semantic_tags", ",").alias("tags"))


query(
    "semantic_tags",
    f"""WITH src AS MATERIALIZED (SELECT * FROM {sql('people')} AS t),
    cls AS ({classes_sql('src', PEOPLE_TEXT, ['customer_no'])}),
    names AS (SELECT unnest(['customer_no', 'email', 'mobile', 'ssn', 'card', 'host', 'nation', 'gender',
      'region_name', 'balance', 'segment']) AS col)
    SELECT n.col AS "column", (SELECT count(*) FROM src) AS row_count,
      coalesce(c.predicted_class, '') AS tags FROM names AS n LEFT JOIN cls AS c ON n.col = c.col""",
)(_tags)

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
query("anomaly_column")(
    lambda s, d: forest.anomaly_column_frame(table(s, d, "lineitem"), FEATURES, LINE_KEY)
)
query("anomaly_rows")(lambda s, d: forest.anomaly_rows(table(s, d, "lineitem"), FEATURES, LINE_KEY))

# ---- whole profiles ----

WITHOUT_FOREST = plans.PARTS - {"anomalies"}


def _profile_table(s, d) -> DataFrame:
    return _shown(plans.profile(frame(s, d, "readings"), parts=WITHOUT_FOREST - {"pairs", "classes"}))


def _profile_growing(s, d) -> DataFrame:
    """A table that arrives in two halves: each half is read once, the states are merged."""
    readings = frame(s, d, "readings")
    folder, store = scratch_path(s, "readings"), scratch_path(s, "states")
    for rest in (0, 1):
        readings.where(f"event_id % 2 = {rest}").write.mode("append").parquet(folder)
        incremental.update(s, folder, store)
    return _shown(incremental.stored_profile(s, folder, store))


def _shown(found: plans.Profiles) -> DataFrame:
    shown = plans.rounded(found.columns, 4)
    return shown.select(
        "column", "logical_type", "row_count", "null_count", "distinct_count", "null_ratio",
        "unique_ratio", "duplicate_ratio", "bytes",
        F.col("numeric.mean").alias("mean"), F.col("numeric.skewness").alias("skewness"),
        F.col("categorical.mode").alias("mode"), F.col("categorical.entropy").alias("entropy"),
        F.col("datetime.range_days").alias("range_days"),
        F.col("behavior.outlier_ratio").alias("outlier_ratio"),
    )


def profile_rows(names: list[tuple[str, str]]) -> str:
    parts = []
    for c, t in names:
        size = f"sum(strlen({c}))" if t == "categorical" else f"8 * count({c})"
        label = t == "categorical"
        parts.append(
            f"""SELECT '{c}' AS "column", '{t}' AS logical_type, count(*) AS row_count,
              count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
              round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS null_ratio,
              round(count(DISTINCT {c}) / count(*)::DOUBLE, 4) AS unique_ratio,
              round((count(*) - count(DISTINCT {c})) / count(*)::DOUBLE, 4) AS duplicate_ratio,
              CAST({size} AS BIGINT) AS bytes,
              {f'round(avg({c}), 4)' if t == 'numeric' else 'CAST(NULL AS DOUBLE)'} AS mean,
              {f'round(skewness({c}), 4)' if t == 'numeric' else 'CAST(NULL AS DOUBLE)'} AS skewness,
              {f"(SELECT mode FROM summary WHERE summary.column = '{c}')" if label else 'CAST(NULL AS VARCHAR)'} AS mode,
              {f"(SELECT round(entropy, 4) FROM summary WHERE summary.column = '{c}')" if label else 'CAST(NULL AS DOUBLE)'} AS entropy,
              {f'round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0, 4)' if t == 'datetime' else 'CAST(NULL AS DOUBLE)'} AS range_days,
              {f"(SELECT round(rare_count / cardinality::DOUBLE, 4) FROM summary WHERE summary.column = '{c}')" if label else (f"(SELECT round(outlier_ratio, 4) FROM fenced WHERE col = '{c}')" if t == 'numeric' else 'CAST(NULL AS DOUBLE)')} AS outlier_ratio
            FROM src"""
        )
    return union(parts)


READING_NUMBERS = ["event_id", "sparse", "value"]
READING_CTES = (
    f"{stats_cte(sql('readings'), READING_NUMBERS)}, {outlier_cte(READING_NUMBERS)}, "
    + counts_cte(sql("readings"), READING_LABELS).split(", counts AS", 1)[0].replace("src AS", "src_ AS")
    + ", counts AS"
    + counts_cte(sql("readings"), READING_LABELS).split(", counts AS", 1)[1]
    + f", summary AS ({SUMMARY.format()})"
)
READING_PROFILE = f"WITH {READING_CTES} " + profile_rows(
    [
        ("area", "categorical"), ("event_id", "numeric"), ("event_type", "categorical"),
        ("sparse", "numeric"), ("ts", "datetime"), ("value", "numeric"),
    ]
)
query("profile_table", READING_PROFILE)(_profile_table)
query("profile_growing", READING_PROFILE)(_profile_growing)


def _risk_signals(s, d) -> DataFrame:
    found = plans.profile(frame(s, d, "readings"), parts=WITHOUT_FOREST - {"classes"})
    return rounded(plans.risk_signals(found).drop("run_id", "dataset_id"), 4)


def signal_rows() -> str:
    out = [
        "SELECT 'null_ratio' AS signal, 'dataset' AS subject, round(sum(n0) / (6 * max(r))::DOUBLE, 4) AS \"value\" FROM sizes",
        "SELECT 'duplicate_ratio', 'dataset', round(1 - count(*) / sum(n)::DOUBLE, 4) FROM "
        "(SELECT count(*) AS n FROM src GROUP BY event_id, value, sparse, event_type, area, ts) AS g",
        "SELECT 'correlation_density', 'dataset', round(avg(abs(v)), 4) FROM pairs",
        "SELECT 'correlation', a || '__' || b, round(v, 4) FROM pairs",
        "SELECT 'null_ratio', c, round(n0 / r::DOUBLE, 4) FROM sizes",
        "SELECT 'unique_ratio', c, round(k / r::DOUBLE, 4) FROM sizes",
        "SELECT 'duplicate_ratio', c, round((r - k) / r::DOUBLE, 4) FROM sizes",
        "SELECT 'identifier_likelihood', c, 1.0 FROM sizes WHERE k = r",
        "SELECT 'outlier_ratio', col, round(outlier_ratio, 4) FROM fenced",
        "SELECT 'heavy_tail', col, round(abs(kurt), 4) FROM fenced",
        f"SELECT 'multimodality', col, round({BIMODAL}, 4) FROM fenced",
        "SELECT 'low_variance', col, round(variance / (hi - lo), 4) FROM fenced",
        'SELECT \'outlier_ratio\', "column", round(rare_count / cardinality::DOUBLE, 4) FROM summary',
        f'SELECT \'heavy_tail\', "column", round(1 - {EVEN}, 4) FROM summary',
        'SELECT \'multimodality\', "column", round(mode_ratio, 4) FROM summary',
        f'SELECT \'low_variance\', "column", round(1 - {EVEN}, 4) FROM summary',
    ]
    return union(out)


query(
    "risk_signals",
    f"WITH {READING_CTES}, sizes AS ("
    + union(
        [
            f"SELECT '{c}' AS c, count(*) AS r, count(*) - count({c}) AS n0, count(DISTINCT {c}) AS k FROM src"
            for c in ["area", "event_id", "event_type", "sparse", "ts", "value"]
        ]
    )
    + "), pairs AS ("
    + union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM src"
            for a, b in (("event_id", "sparse"), ("event_id", "value"), ("sparse", "value"))
        ]
    )
    + f") {signal_rows()}",
)(_risk_signals)


def _profile_delta(s, d) -> DataFrame:
    parts = {"labels", "numbers"}
    before = plans.profile(frame(s, d, "orders_before"), parts=parts)
    after = plans.profile(frame(s, d, "orders_after"), parts=parts)
    return plans.profile_delta(before.columns, after.columns)


query(
    "profile_delta",
    f"""
    WITH b AS (SELECT * FROM {sql('orders_before')} AS t), a AS (SELECT * FROM {sql('orders_after')} AS t)
    SELECT 'status' AS "column", 'presence' AS metric, 'present' AS "before", 'dropped' AS "after"
    UNION ALL SELECT 'placed', 'presence', 'absent', 'added'
    UNION ALL
    SELECT 'total', 'null_ratio',
      printf('%.1f%%', (SELECT 100.0 * (count(*) - count(total)) / count(*) FROM b)),
      printf('%.1f%%', (SELECT 100.0 * (count(*) - count(total)) / count(*) FROM a))
    """,
)(_profile_delta)
