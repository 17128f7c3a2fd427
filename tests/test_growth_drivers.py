"""Drivers are worked out in generated code, once per row."""
from conftest import SF
from pyspark.sql import functions as F

from tenurelens.operators import drivers as dr
from tenurelens.plans import decision_queries as dq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contributions(spark):
    d = spark.createDataFrame([("p", 2.0, 3, "Senior"), ("q", None, 1, None)], "k string, a double, b int, s string")
    eta = lambda get: get("a") - 0.5 * get("b") + F.when(get("s") == "Senior", 0.25).when(get("s") == "Unknown", -0.05).otherwise(0.0)
    out = dr.contributions(d, eta, ["a", "b", "gone", "s"], {"min": -4.0, "max": 4.0})
    assert "lambda" not in plan(out)
    got = {r.k: {x.feature: x.contribution for x in r.drivers} for r in out.collect()}
    # eta of p: 2 - 1.5 + .25 = .75; blanked: a -1.25, b 2.25, s .45
    assert {f: round(v, 9) for f, v in got["p"].items()} == {"a": -0.25, "b": 0.1875, "s": -0.0375}
    assert got["q"] == {"a": None, "b": None, "s": None}
    folded = dr.fold_to_source(out, {"b": "a"}, ["a", "b", "s"])
    assert "lambda" not in plan(folded)
    assert {x.feature: round(x.contribution, 9) for x in folded.where("k = 'p'").first().drivers} == {"a": -0.25, "s": -0.0375}


def test_drivers_are_not_worked_out_for_a_filter(spark):
    for q in (dq.m1, dq.m2):
        text = plan(q(spark, SF))
        assert "lambda" not in text and "size(" not in text
