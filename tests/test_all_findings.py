from datetime import date

import duckdb
import numpy as np
from qualityframe.operators import forest

from checks import detection
from checks.compare import compare, table_of
from checks.inputs import frame


def test_all_findings_has_every_detector(spark, tmp_path):
    rows = [
        (o, 1 + o * 7 % 50, 900.0 + o * 37 % 1000, o * 11 % 400, 0.01 * (o * 3 % 9), "OF"[o % 2], o % 9, date(1995, 1, 1 + o % 28))
        for o in range(1, 1200)
    ]
    schema = (
        "l_orderkey long, l_quantity long, l_extendedprice double, l_partkey long, l_tax double, "
        "l_linestatus string, l_suppkey long, l_shipdate date"
    )
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    found = detection.QUERIES["all_findings"](spark, folder)
    got = [tuple(r) for r in found.collect()]
    model = [r for r in got if r[0] == "IsolationForest"]
    drifted = {r[3] for r in got if r[0] == "DriftDetector"}
    assert {"amount", "amount_twin", "gender"} <= drifted

    scored = forest.score_rows(frame(spark, folder, "dirt"), cfg=detection.ML.profiling)
    share = np.mean([r.anomaly_score is not None and r.anomaly_score > 0.5 for r in scored.select("anomaly_score").collect()])
    assert [(r[1], r[3], r[5], r[7]) for r in model] == [("anomaly_score", None, "dataset", 0.8)]
    assert 0 < share < 1 and model[0][6] == round(share, 6)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    sql = con.sql(detection.ALL_BUT_FOREST)
    others = table_of(found.columns, [r for r in got if r[0] != "IsolationForest"])
    assert compare(others, table_of(sql.columns, sql.fetchall())) == ""
