"""Inputs derived from the given tables by SQL both engines read alike.

The given tables have no nulls and dense keys, so most detectors would stay silent
on them. Every input keeps all rows of its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

INPUTS = {
    # one or more columns per detector, one seventh of the rows twice
    "dirt": """
        WITH base AS (
          SELECT
            CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
            CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS gap,
            42 AS lot,
            CASE WHEN l_partkey % 13 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS amount,
            CASE WHEN l_partkey % 13 = 0 THEN l_extendedprice * 200 + 1
                 ELSE l_extendedprice * 2 + 1 END AS amount_twin,
            CASE WHEN l_tax < 0.035 THEN 0.0e0 ELSE l_tax END AS tax_zero,
            l_linestatus AS status,
            CASE WHEN l_orderkey % 997 = 0 THEN 'X' ELSE 'A' END AS grade,
            CASE WHEN l_orderkey % 25 = 0 THEN 'F' ELSE 'M' END AS gender,
            CAST(10000 + l_orderkey AS STRING) AS zip_code,
            1940 + l_partkey % 70 AS birth_year,
            l_partkey % 130 - 4 AS age,
            CASE WHEN l_orderkey % 3 = 0 THEN 'invalid-email'
                 ELSE concat('u', CAST(l_orderkey AS STRING), '@example.com') END AS email,
            concat('555-', lpad(CAST(l_suppkey AS STRING), 4, '0')) AS phone,
            l_shipdate AS ship,
            l_orderkey AS line_order
          FROM {lineitem} AS l)
        SELECT qty, gap, lot, amount, amount_twin, tax_zero, status, grade, gender, zip_code,
               birth_year, age, email, phone, ship
        FROM (SELECT * FROM base UNION ALL SELECT * FROM base WHERE line_order % 6 = 0) AS b
    """,
    # the rows of "dirt" as they came, before any of them went bad
    "dirt_before": """
        SELECT l_quantity AS qty, l_extendedprice AS gap, 42 AS lot, l_extendedprice AS amount,
          l_extendedprice * 2 + 1 AS amount_twin, l_tax AS tax_zero, l_linestatus AS status, 'A' AS grade,
          CASE WHEN l_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
          CAST(10000 + l_orderkey AS STRING) AS zip_code,
          1940 + l_partkey % 70 AS birth_year,
          l_partkey % 130 - 4 AS age,
          concat('u', CAST(l_orderkey AS STRING), '@example.com') AS email,
          concat('555-', lpad(CAST(l_suppkey AS STRING), 4, '0')) AS phone,
          l_shipdate AS ship
        FROM {lineitem} AS l
    """,
    # numbers with nulls in different rows
    "numbers": """
        SELECT l_orderkey, l_linenumber,
          CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
          CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS discount,
          l_extendedprice AS price,
          CASE WHEN l_orderkey % 11 = 0 THEN 0.0e0 ELSE l_tax END AS tax
        FROM {lineitem} AS l
    """,
    # skewed values with far outliers, and labels
    "readings": """
        SELECT event_id,
          CASE WHEN event_id % 40 = 0 THEN value * 50 ELSE value END AS value,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS sparse,
          event_type,
          CASE WHEN event_id % 500 = 0 THEN concat('odd-', CAST(event_id % 3000 AS STRING))
               WHEN event_id % 4 = 0 THEN 'west'
               WHEN event_id % 31 = 0 THEN NULL ELSE 'east' END AS area,
          ts
        FROM {events} AS e
    """,
    # two periods of orders, the later one changed
    "orders_before": """
        SELECT o_orderkey, o_totalprice AS total, o_orderpriority AS priority, o_custkey AS cust,
               CASE WHEN o_orderkey % 10 = 0 THEN 'rush' ELSE 'plain' END AS service,
               o_orderstatus AS status
        FROM {orders} AS o
    """,
    "orders_after": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice * 1.5e0 END AS total,
               o_orderpriority AS priority,
               o_custkey AS cust,
               CASE WHEN o_orderkey % 2 = 0 THEN 'rush' ELSE 'plain' END AS service,
               o_orderdate AS placed
        FROM {orders} AS o
    """,
    # people with personal data
    "people": """
        SELECT c_custkey AS customer_no,
          CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE
            concat('user', CAST(c_custkey AS STRING), '@mail.example.org') END AS email,
          concat('+1 (555) ', lpad(CAST(c_custkey AS STRING), 7, '0')) AS mobile,
          concat(lpad(CAST(c_custkey % 900 + 100 AS STRING), 3, '0'), '-',
                 lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0'), '-',
                 lpad(CAST(c_custkey AS STRING), 4, '0')) AS ssn,
          concat('4', lpad(CAST(c_custkey AS STRING), 15, '0')) AS card,
          concat('10.0.', CAST(c_custkey % 256 AS STRING), '.', CAST(c_custkey % 99 AS STRING)) AS host,
          CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'DEU' END AS nation,
          CASE WHEN c_custkey % 20 = 0 THEN 'F' ELSE 'M' END AS gender,
          CASE WHEN c_custkey % 3 = 0 THEN 'north' ELSE 'south' END AS region_name,
          c_acctbal AS balance,
          c_mktsegment AS segment
        FROM {customer} AS c
    """,
    # findings of many runs, one row per event; a third belong to one run
    "findings": """
        SELECT
          CASE WHEN event_id % 3 = 0 THEN 'run-hot'
               ELSE concat('run-', CAST(user_id % 40 AS STRING)) END AS run_id,
          concat('ds-', CAST(event_id % 2 AS STRING)) AS dataset_id,
          event_id AS seq,
          CASE WHEN event_id % 19 IN (16, 17) THEN 'model' ELSE 'rule' END AS kind,
          concat('Detector', CAST(event_id % 19 AS STRING)) AS detector,
          CASE event_id % 19
            WHEN 0 THEN 'missing_values' WHEN 1 THEN 'duplicate_rows' WHEN 2 THEN 'constant_column'
            WHEN 3 THEN 'outliers' WHEN 4 THEN 'high_skewness' WHEN 5 THEN 'high_correlation'
            WHEN 6 THEN 'range_violation' WHEN 7 THEN 'zero_value' WHEN 8 THEN 'pattern_violation'
            WHEN 9 THEN 'data_drift' WHEN 10 THEN 'quasi_identifier_risk'
            WHEN 11 THEN 'semantic_violation' WHEN 12 THEN 'imbalance' WHEN 13 THEN 'rare_category'
            WHEN 14 THEN 'type_mismatch' WHEN 15 THEN 'potential_bias' WHEN 16 THEN 'pii_detected'
            WHEN 17 THEN 'anomaly_score' ELSE 'unknown_logical_type' END AS issue_type,
          CASE event_id % 4 WHEN 0 THEN 'completeness' WHEN 1 THEN 'validity'
            WHEN 2 THEN 'privacy' ELSE 'integrity' END AS dimension,
          CASE WHEN event_id % 19 IN (1, 5, 10, 17) THEN NULL
               ELSE concat('col_', CAST(user_id % 12 AS STRING)) END AS column_name,
          CASE WHEN event_id % 19 IN (5, 10) THEN concat('col_', CAST(user_id % 12 AS STRING))
               ELSE NULL END AS first_column,
          CASE WHEN event_id % 5 = 0 THEN 'categorical' ELSE 'numeric' END AS logical_type,
          CASE WHEN user_id % 8 = 0 THEN 0.05e0 ELSE 1.0e0 END
            * CASE WHEN value > 397 THEN 1.0e0 ELSE value / 397 END AS severity,
          CASE WHEN event_id % 19 IN (16, 17) THEN 0.8e0 ELSE 1.0e0 END AS confidence
        FROM {events} AS e
    """,
    # a trace log; a third of all events belong to one trace
    "trace": """
        WITH placed AS (
          SELECT event_id, ts, user_id, event_type, value, props,
            CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 7 END AS lane,
            CASE WHEN event_id % 3 = 0 THEN CAST(floor(event_id / 3) AS BIGINT)
                 ELSE CAST(floor(event_id / 21) AS BIGINT) END AS pos
          FROM {events} AS e)
        SELECT
          CAST(event_id AS STRING) AS event_id,
          concat('trace-', CAST(lane AS STRING)) AS trace_id,
          CASE WHEN pos = 0 THEN NULL
               WHEN event_id % 401 = 0 THEN 'gone'
               WHEN lane = 0 AND pos % 4 <> 0 THEN '0'
               WHEN lane = 0 THEN CAST(3 * CAST(floor(pos / 3) AS BIGINT) AS STRING)
               ELSE CAST(event_id % 21 + 21 * CAST(floor(pos / 2) AS BIGINT) AS STRING)
          END AS parent_event_id,
          CASE event_id % 6 WHEN 0 THEN 'rule' WHEN 1 THEN 'fix' WHEN 2 THEN 'metric'
            WHEN 3 THEN 'audit' ELSE 'trace' END AS component,
          CASE WHEN event_id % 13 = 0 THEN 'ui' WHEN event_id % 6 = 0 THEN 'check'
            WHEN event_id % 6 = 1 THEN 'proposal' WHEN event_id % 6 = 4 THEN 'error'
            WHEN event_id % 6 = 5 THEN 'decision' ELSE 'info' END AS event_type,
          CASE WHEN event_id % 50 = 0 THEN 'critical' WHEN event_id % 20 = 0 THEN 'error'
            WHEN event_id % 6 = 0 THEN 'warning' ELSE 'info' END AS severity,
          CASE WHEN user_id % 9 = 0 THEN concat('CHECK_', event_type)
               WHEN user_id % 9 = 1 THEN concat('ML_', event_type)
               WHEN user_id % 9 = 2 THEN concat('fix.', event_type, '.success')
               WHEN user_id % 9 < 6 THEN concat('COLUMN_PROFILING ', event_type)
               ELSE event_type END AS name,
          ts AS "timestamp",
          props AS inputs,
          CASE WHEN event_id % 4 = 0 THEN '{{"passed": true}}' ELSE '{{"passed": false}}' END AS outputs,
          CASE WHEN event_id % 5 = 0 THEN '{{"error_message": "bad input", "strategy": "median"}}'
               ELSE '{{}}' END AS metadata,
          CASE WHEN event_id % 17 = 0 THEN 1.5e0 ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence,
          CASE WHEN event_id % 23 = 0 THEN NULL
               WHEN event_id % 29 = 0 THEN 'free text'
               ELSE 'rule_violation,outlier_detected' END AS reason_text,
          props AS evidence
        FROM placed
    """,
}

TABLES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    text = INPUTS[name]
    sources = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(TABLES.findall(text))
    }
    return spark.sql(text.replace('"timestamp"', "`timestamp`"), **sources)


def sql(name: str) -> str:
    """The same input as a DuckDB subquery."""
    text = INPUTS[name]
    return "(" + text.format(**{t: t for t in set(TABLES.findall(text))}) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
