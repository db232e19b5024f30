"""Reading and writing: every table goes through a file and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.config import AUTOMATIC, Config
from qualityframe.operators.scale import scratch_path
from qualityframe.plans.analyze import analyze
from qualityframe.sources.readers import load, read_csv, read_json, read_table
from qualityframe.sources.sinks import write_csv, write_json

from .inputs import frame, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, oracle: str | None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def _src_csv(s, d) -> DataFrame:
    path = scratch_path(s, "orders") + ".csv"
    marked = table(s, d, "orders").withColumn(
        "o_custkey", F.when(F.col("o_custkey") % 10 == 0, "NA").otherwise(F.col("o_custkey").cast("string"))
    )
    marked.write.option("header", True).option("sep", ";").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)
    return load(s, path, delimiter=";")


add(
    "src_csv",
    _src_csv,
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
      o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""",
)
add("src_parquet", lambda s, d: load(s, f"{d}/customer.parquet"), "SELECT * FROM customer")


PARTS = "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part"


def _src_json(s, d) -> DataFrame:
    path = scratch_path(s, "parts") + ".json"
    one = table(s, d, "part")
    # each line holds an array of records
    one.groupBy(F.pmod("p_partkey", F.lit(64)).alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct(*one.columns))).alias("value")
    ).drop("chunk").write.text(path)
    return read_json(s, path, lines=True).select(*one.columns)


def _src_json_array(s, d) -> DataFrame:
    """The default form: each file is one array of records, here a few lines long."""
    path = scratch_path(s, "parts-array")
    one = table(s, d, "part")
    chunked = one.groupBy(F.pmod("p_partkey", F.lit(16)).alias("chunk"))
    text = F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct(*one.columns))), ",\n"), F.lit("\n]"))
    chunked.agg(text.alias("value")).write.partitionBy("chunk").text(path)
    return read_json(s, path).select(*one.columns)


add(
    "src_json",
    _src_json,
    PARTS,
)
add("src_json_array", _src_json_array, PARTS)


def _src_table(s, d) -> DataFrame:
    table(s, d, "supplier").createOrReplaceTempView("qualityframe_supplier")
    return read_table(s, "qualityframe_supplier")


add("src_table", _src_table, "SELECT * FROM supplier")
add("src_load", lambda s, d: load(s, f"{d}/events.parquet"), "SELECT * FROM events")


def _sink_csv(s, d) -> DataFrame:
    path = scratch_path(s, "out")
    write_csv(frame(s, d, "readings"), path)
    return read_csv(s, path)


add("sink_csv", _sink_csv, f"SELECT * FROM {sql('readings')} AS t")


def _sink_json(s, d) -> DataFrame:
    path = scratch_path(s, "out")
    write_json(table(s, d, "documents"), path)
    return read_json(s, path, lines=True)


add("sink_json", _sink_json, "SELECT doc_id, lang, n_chars, source, text FROM documents")


def _sink_results(s, d) -> DataFrame:
    path = scratch_path(s, "results")
    cfg = Config(mode=AUTOMATIC, tracing=True, lineage=True).with_profiling(enable_ml=False)
    result = analyze(frame(s, d, "orders_after"), cfg, run_id="kept")
    result.save(path)
    return s.read.json(f"{path}/findings").where(F.col("run_id") == "kept").select(
        "run_id", "seq", "issue_type", "column", F.round("severity", 6).alias("severity")
    )


add("sink_results", _sink_results, None)
