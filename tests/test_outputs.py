"""Queries on small tables made for one fault each."""

from __future__ import annotations

import duckdb

from rxncurate.plans import outputs, recovery


def test_eval_offenders_keeps_letters_without_a_capital_form(spark, tmp_path):
    turns = [(10, 0, "user", "Große  Straße"), (11, 0, "user", "große straße"), (12, 0, "user", "GROSSE STRASSE"), (13, 0, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in recovery.eval_offenders(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(recovery.ORACLE["eval_offenders"]).fetchall()) == [(10, 0), (11, 0)]


def test_model_rows_signature_is_the_statement_s(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = {r[0]: r[1] for r in con.execute("SELECT idx, signature FROM (" + outputs.ORACLE["model_rows"] + ")").fetchall()}
    df = outputs.model_rows(spark, sf)
    assert {r.idx: r.signature for r in df.select("idx", "signature").collect()} == want and any(want.values())
    # Neither reactions nor structures are read on the rows.
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
