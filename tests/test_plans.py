"""Physical plans: no products of tables, no Python in the data path, pruned scans, no single-task windows over people."""
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tenurelens.operators import metrics
from tenurelens.plans import fixtures

CHECKED = ["a1_source_filter", "b1_b10_compensation_features", "b3_pay_percentiles", "b15_team_turnover", "b17_time_in_current", "b24_change_counts",
           "b27_promotion_events", "c4_feature_ranges", "d8_outliers", "f8_industry_patterns", "i4_brier", "i6_time_dependent_auc", "i8_concordance", "i9_ece_ipcw",
           "j7_youden_threshold", "k1_risk_bands", "l4_intervention_impact", "m3_top_factors"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_plan_shape(spark, name):
    text = plan(entry_module.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "ExistingRDD"):
        assert bad not in text, bad
    # a sort or window may need one task only where a constant key says so: bounded tables
    assert "SinglePartition, ENSURE" not in "".join(re.findall(r"Window.*\n.*\n.*Exchange SinglePartition.*", text))


def test_scans_read_only_what_they_need(spark):
    text = plan(entry_module.queries()["b17_time_in_current"](spark, SF))
    orders = [s for s in re.findall(r"ReadSchema: struct<[^>]*>", text) if "o_orderkey" in s]
    assert orders and all("o_comment" not in s and "o_totalprice" not in s for s in orders)


def test_small_tables_are_broadcast_by_size(spark):
    rows = metrics.evaluation_rows(fixtures.scored(spark, SF), "logistic", 1.2, [90])
    text = plan(rows.agg(F.avg("p")))
    # G(T-), the horizons and G(h) come from one lookup table per (group, day)
    assert text.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in text


def test_reports_do_not_unfold_rows(spark):
    from tenurelens.operators import describe
    df = spark.range(100).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(1, 40)])
    plan = describe.moments(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("HashAggregate")  # only the one row of sums is unfolded
    got = {(r.feature1, r.feature2) for r in describe.correlations(df.withColumn("same", F.col("c3") * 2), threshold=0.999).collect()}
    assert ("c3", "same") in got
