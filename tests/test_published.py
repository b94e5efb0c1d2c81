"""Arithmetic against published figures: counts in, rates, intervals and texts out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rxncurate.operators import denoise, score


def test_weighted_extrapolation(spark):
    rows = [("many_products", 67030, 57, 29, 2, 12), ("many_reactants", 30709, 55, 2, 31, 12), ("many_reagents", 224249, 82, 5, 1, 12), ("no_reagent", 180009, 50, 3, 28, 19)]
    df = spark.createDataFrame(rows, "category string, population_n long, sample_tp long, sample_fn long, sample_fp long, sample_tn long").withColumn("sample_n", F.lit(100).cast("long"))
    got = {r["category"]: r for r in denoise.weighted_extrapolation(df).collect()}
    total = got["TOTAL"]
    assert [round(total[f"weighted_{c}"], 2) for c in ("tp", "fn", "fp", "tn")] == [328985.73, 36665.60, 63505.40, 72840.27]
    assert total["population_n"] == 501997 and total["sample_n"] == 400 and total["weight"] is None and got["many_reagents"]["weight"] == 2242.49


@pytest.mark.parametrize(("cells", "rates"), [((244, 39, 62, 55), (0.862191, 0.470085, 0.7475)), ((234, 49, 84, 33), (0.826855, 0.282051, 0.6675)), ((189, 94, 35, 82), (0.667845, 0.700855, 0.6775)), ((176, 107, 29, 88), (0.621908, 0.752137, 0.66))])
def test_confusion_rates(spark, cells, rates):
    marks = [(1, 0)] * cells[0] + [(1, 1)] * cells[1] + [(0, 0)] * cells[2] + [(0, 1)] * cells[3]
    df = spark.createDataFrame([("m", *m) for m in marks], "model string, noise_free int, filtered int")
    r = denoise.with_rates(denoise.confusion(df, ["model"])).first()
    assert (r["passed_tp"], r["filtered_fn"], r["passed_fp"], r["filtered_tn"]) == cells
    assert tuple(round(r[c], 6) for c in ("noise_free_saved", "noisy_filtered", "accuracy")) == rates


def test_extraction_metrics(spark):
    counts = {"reactants": (574, 20, 32), "reagents": (669, 11, 37), "products": (370, 3, 12)}
    first = {f"{r}_{n}": v for r, c in counts.items() for n, v in zip(("tp", "fp", "fn"), c)}
    rows = [("gemini-3.6-flash-high", int(k < 245), *[v if k == 0 else 0 for v in first.values()]) for k in range(283)]
    df = spark.createDataFrame(rows, "method string, reaction_correct int, " + ", ".join(f"{c} long" for c in first))
    metrics = score.extraction_metrics(df)
    got = {r["role"]: r for r in metrics.collect()}
    assert [round(got[r][c], 6) for r in ("reactants", "reagents", "products") for c in ("precision", "recall")] == [0.966330, 0.947195, 0.983824, 0.947592, 0.991957, 0.968586]
    one = got["products"]
    assert (one["evaluated"], one["correct"], one["incorrect"]) == (283, 245, 38) and [round(one[c], 6) for c in ("accuracy", "ci_lower", "ci_upper")] == [0.865724, 0.821067, 0.900586]
    assert score.publication_table(metrics).first()["accuracy_ci"] == "86.5724 (82.1067–90.0586)"


def test_stage_summary(spark):
    stages = ("generation", "structured", "processing", "conversion", "mapping")
    passed = (400, 396, 395, 346, 346)
    rows = [tuple(int(k < n) for n in passed) for k in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{s} int" for s in stages))
    got = {r["stage"]: r for r in denoise.stage_summary(df, stages).collect()}
    want = {"generation": (400, 400, 1.0, 0.990488, 1.0), "structured": (396, 400, 0.99, 0.974573, 0.996105), "processing": (395, 396, 0.997475, 0.985836, 0.999554), "conversion": (346, 395, 0.875949, 0.839775, 0.904881), "mapping": (346, 346, 1.0, 0.989019, 1.0)}
    for stage, (p, r, rate, low, high) in want.items():
        x = got[stage]
        assert (x["passed"], x["reached"]) == (p, r) and [round(x[c], 6) for c in ("conditional_rate", "ci_lower", "ci_upper")] == [rate, low, high]
    assert round(got["conversion"]["overall_rate"], 3) == 0.865
