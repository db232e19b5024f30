import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from qualityframe.llm import decontaminate, simhash
from qualityframe.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, sample):
    docs = table(spark, sample, "documents")
    rows = {0: docs.count()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sample)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        rows[k + 1] = docs.count()
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert rows[1] < rows[0] and rows[2] < rows[1] and rows[3] <= rows[2]
    assert rows[3] == rows[4] == rows[5]
    assert docs.columns == [*COLUMNS, "piece_ids"]
    groups = simhash.op9(docs)
    assert groups.select("component_id").distinct().count() <= rows[5]
    assert decontaminate.op6(docs, table(spark, sample, "benchmark")).isEmpty()


def test_run_returns_the_last_stage(spark, sample):
    out = corpus_pipeline.run(spark, sample)
    assert out.columns == [*COLUMNS, "piece_ids"]
    assert out.count() > 0


def test_odd_rows_go_through_every_stage(spark, odd_docs, sample, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, sample, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = odd_docs.select(*COLUMNS)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == [*COLUMNS, "piece_ids"]


CLASHING = ["__text", "__row", "__ids", "__same", "__score", "__all", "__base", "__n", "__fp", "__key", "key", "fp", "data", "root"]


def test_columns_with_clashing_names_keep_their_values(spark, sample, tmp_path):
    secret = "password=abcdefghijkl"
    extra = [F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING]
    docs = table(spark, sample, "documents").where("doc_id < 40").withColumn("text", F.concat(F.lit(f"{secret} "), "text"))
    wide = docs.select("*", *extra)
    for _, stage in corpus_pipeline.STAGES:
        plain = {r.doc_id: r for r in stage(spark, docs, sample).collect()}
        out = stage(spark, wide, sample)
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(plain)
        for r in rows:
            assert all(r[c] == f"{c} {r.doc_id}" for c in CLASHING)
            assert r.text == plain[r.doc_id].text
    redacted = corpus_pipeline.redact(spark, wide, sample)
    assert redacted.columns == wide.columns
    assert not any(secret in str(v) for r in redacted.collect() for v in r)


def test_entry_without_this_folder():
    code = (
        "import sys; sys.modules['qualityframe.llm'] = None; import __spark_entry__ as e; "
        "names = e.queries(); assert 'all_findings' in names; "
        "assert not [n for n in names if n.startswith('op') or n == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
