"""The log of results under repeated keys."""

from __future__ import annotations

from rxncurate.streaming import resume


def test_log_and_state(spark, tmp_path):
    source, log, mark = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "mark")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "idx int, prediction string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("idx int, prediction string").parquet(source)
        resume.append_results(stream, log, mark).awaitTermination(60)
    assert sorted(map(tuple, resume.current_results(spark, log).collect())) == [(1, "a"), (2, "c"), (3, "d")]
