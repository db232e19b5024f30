"""Repairs of whole tables, single and as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.config import AUTOMATIC, Config
from qualityframe.operators import repair, structure
from qualityframe.operators.planning import PLAN_COLUMNS
from qualityframe.operators.scale import local_frame
from qualityframe.plans import analyze

from .inputs import frame, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, oracle: str | None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def numbers(s, d) -> DataFrame:
    return frame(s, d, "numbers")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


KEY = "l_orderkey, l_linenumber, price"
NUM = sql("numbers")

add(
    "fix_drop",
    lambda s, d: repair.drop_column(table(s, d, "orders"), "o_totalprice"),
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders",
)
add(
    "fix_dedupe",
    lambda s, d: repair.remove_duplicates(frame(s, d, "dirt")),
    f"SELECT DISTINCT * FROM {sql('dirt')} AS t",
)
add(
    "fix_impute_median",
    lambda s, d: repair.impute(numbers(s, d), "qty").select("l_orderkey", "l_linenumber", "price", "qty"),
    f"SELECT {KEY}, coalesce(qty, (SELECT median(qty) FROM {NUM} AS m)) AS qty FROM {NUM} AS t",
)
add(
    "fix_impute_mean",
    lambda s, d: rounded(
        repair.impute(numbers(s, d), "qty", strategy="mean").select(
            "l_orderkey", "l_linenumber", "price", "qty"
        )
    ),
    f"SELECT {KEY}, round(coalesce(qty, (SELECT avg(qty) FROM {NUM} AS m)), 6) AS qty FROM {NUM} AS t",
)
add(
    "fix_impute_mode",
    lambda s, d: repair.impute(frame(s, d, "readings"), "area", strategy="mode").select("event_id", "area"),
    f"""SELECT event_id, coalesce(area, (SELECT area FROM {sql('readings')} AS m WHERE area IS NOT NULL
      GROUP BY area ORDER BY count(*) DESC, area LIMIT 1)) AS area FROM {sql('readings')} AS t""",
)
add(
    "fix_clip",
    lambda s, d: rounded(repair.clip(frame(s, d, "readings"), "value").select("event_id", "value")),
    f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM {sql('readings')} AS m)
    SELECT event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value
    FROM {sql('readings')} AS t, q""",
)
add(
    "fix_clip_range",
    lambda s, d: repair.clip(table(s, d, "customer"), "c_acctbal", min=0, max=5000).select("c_custkey", "c_acctbal"),
    "SELECT c_custkey, greatest(least(c_acctbal, 5000.0::DOUBLE), 0.0::DOUBLE) AS c_acctbal FROM customer",
)
add(
    "fix_log",
    lambda s, d: rounded(
        repair.log_transform(table(s, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")
    ),
    "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal FROM customer",
)
add(
    "fix_group_rare",
    lambda s, d: repair.group_rare(frame(s, d, "readings"), "area").select("event_id", "area"),
    f"""WITH c AS (SELECT area, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM {sql('readings')} AS m
      WHERE area IS NOT NULL GROUP BY area)
    SELECT event_id, CASE WHEN t.area IS NULL THEN NULL WHEN c.share < 0.01 THEN 'OTHER' ELSE t.area END AS area
    FROM {sql('readings')} AS t LEFT JOIN c ON t.area = c.area""",
)
def _rare_plan(spark, sf_dir) -> DataFrame:
    """A share below a thousandth, through a plan."""
    plan = _plan(spark, [("group_rare", "part", {"threshold": "0.0005"}, "GROUP")])
    lines = table(spark, sf_dir, "lineitem")
    named = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    out, outcome = repair.apply_plan(named, plan)
    if outcome.errors:
        raise RuntimeError(outcome.errors)
    return out


add(
    "fix_group_rare_plan",
    _rare_plan,
    """WITH c AS (SELECT l_partkey, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM lineitem GROUP BY l_partkey)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN c.share < 0.0005 THEN 'OTHER' ELSE CAST(l_partkey AS VARCHAR) END AS part
    FROM lineitem JOIN c USING (l_partkey)""",
)


def nested(s, d) -> DataFrame:
    """Lines as arrays, structs and maps with nulls in different places, some repeated."""
    n = F.pmod("l_linenumber", F.lit(3))
    one, two = F.when(n != 0, F.col("l_quantity")), F.when(n != 1, F.col("l_quantity"))
    return table(s, d, "lineitem").select(
        F.array(one, two).alias("pair"),
        F.when(n == 2, F.array(F.col("l_quantity"))).otherwise(F.array(two)).alias("short"),
        F.struct(one.alias("x"), two.alias("y")).alias("both"),
        F.array(F.create_map(F.lit("a"), one, F.lit("b"), two)).alias("maps"),
    )


NESTED = """(SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS one,
    CASE WHEN l_linenumber % 3 <> 1 THEN l_quantity END AS two, l_linenumber % 3 AS n, l_quantity FROM lineitem)"""

add(
    "dup_nested",
    lambda s, d: structure.duplicate_rows(nested(s, d)).select(F.round("duplicate_row_ratio", 6).alias("ratio")),
    f"""SELECT round(1 - count(DISTINCT (one, two, n = 2))::DOUBLE / count(*), 6) AS ratio FROM {NESTED} AS t""",
)
add(
    "fix_dedupe_nested",
    lambda s, d: repair.remove_duplicates(nested(s, d)).select(
        F.col("both.x").alias("x"), F.col("both.y").alias("y"), F.size("short").cast("bigint").alias("n_short")
    ),
    f"SELECT DISTINCT one AS x, two AS y, 1::BIGINT AS n_short FROM {NESTED} AS t",
)
add(
    "fix_cast",
    lambda s, d: repair.cast_type(
        frame(s, d, "people").withColumn(
            "code", F.when(F.col("customer_no") % 4 == 0, "1d").otherwise(F.concat(F.lit(" "), F.col("customer_no").cast("string"), F.lit(".5e1")))
        ),
        "code", target_type="numeric",
    ).select("customer_no", "code"),
    f"""SELECT customer_no, CASE WHEN customer_no % 4 = 0 THEN NULL
      ELSE CAST(CAST(customer_no AS VARCHAR) || '.5e1' AS DOUBLE) END AS code FROM {sql('people')} AS t""",
)
add(
    "fix_mask",
    lambda s, d: repair.mask_pii(frame(s, d, "people"), "email", pii_type="email").select("customer_no", "email", "segment"),
    f"SELECT customer_no, '[MASKED_EMAIL]' AS email, segment FROM {sql('people')} AS t",
)
add(
    "fix_flag",
    lambda s, d: repair.flag_nulls(numbers(s, d), "qty").select("l_orderkey", "l_linenumber", "price", "qty_is_dirty"),
    f"SELECT {KEY}, CASE WHEN qty IS NULL THEN 1 ELSE 0 END AS qty_is_dirty FROM {NUM} AS t",
)
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
add(
    "fix_anomalies",
    lambda s, d: repair.remove_anomalies(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], LINE_KEY
    ),
    None,
)


def _plan(spark, actions: list[tuple]) -> DataFrame:
    """A hand-written plan: (operation, column, params, action type)."""
    rows = [
        ("run", "set", i, f"run/set/{i}", kind, op, column, params, "", False, True)
        for i, (op, column, params, kind) in enumerate(actions, start=1)
    ]
    types = "string string bigint string string string string map<string,string> string boolean boolean".split()
    return local_frame(spark, rows, ", ".join(f"`{c}` {t}" for c, t in zip(PLAN_COLUMNS, types)))


def _heal(spark, sf_dir) -> DataFrame:
    plan = _plan(
        spark,
        [
            ("remove_duplicates", None, {}, "DEDUPE"),
            ("drop_column", "lot", {}, "DROP"),
            ("drop_column", "not_there", {}, "DROP"),
            ("impute", "gap", {"strategy": "median"}, "IMPUTE"),
            ("clip", "amount", {}, "CLIP"),
            ("log_transform", "amount_twin", {}, "TRANSFORM"),
            ("group_rare", "grade", {"threshold": "0.01"}, "GROUP"),
            ("cast_type", "zip_code", {"target_type": "numeric"}, "REPAIR"),
            ("mask_pii", "email", {"pii_type": "email"}, "MASK"),
            ("flag_nulls", "qty", {}, "FLAG"),
            (None, None, {}, "BLOCK"),
            ("drop_column", "ship", {}, "DROP"),
        ],
    )
    healed, _ = repair.apply_plan(frame(spark, sf_dir, "dirt"), plan)
    return rounded(healed)


add(
    "heal",
    _heal,
    f"""WITH t AS MATERIALIZED (SELECT DISTINCT * FROM {sql('dirt')} AS d),
    q AS (SELECT median(gap) AS mid, quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM t),
    g AS (SELECT grade, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM t GROUP BY grade)
    SELECT qty, round(coalesce(gap, mid), 6) AS gap,
      round(greatest(least(amount, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS amount,
      round(ln(1 + greatest(amount_twin, 0)), 6) AS amount_twin, round(tax_zero, 6) AS tax_zero, status,
      CASE WHEN g.share < 0.01 THEN 'OTHER' ELSE t.grade END AS grade, gender,
      CAST(zip_code AS DOUBLE) AS zip_code, birth_year, age, '[MASKED_EMAIL]' AS email, phone, ship,
      CASE WHEN qty IS NULL THEN 1 ELSE 0 END AS qty_is_dirty
    FROM t JOIN g ON t.grade = g.grade, q""",
)


def _heal_until_pass(spark, sf_dir) -> DataFrame:
    cfg = Config(mode=AUTOMATIC, tracing=True).with_profiling(enable_ml=False)
    healed, verdicts = analyze.heal(frame(spark, sf_dir, "readings"), cfg, max_passes=4)
    return healed.withColumn("verdicts", F.lit(",".join(verdicts)))


add("heal_until_pass", _heal_until_pass, None)
