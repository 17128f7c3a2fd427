"""Tables that grow with the input are joined by shuffle: what is broadcast passes the driver."""
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tenurelens.functions import scale
from tenurelens.plans import decision_queries as dq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("desc", [False, True])
def test_totals_of_buckets_are_not_broadcast(spark, desc):
    d = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 1), (None, 1.0, 4), (None, 9.0, 3)], "g string, v double, n long")
    out = scale.running_totals(d, ["g"], "v", ["n"], desc)
    assert "Broadcast" not in plan(out)
    got = {(r.g, r.v): (r.cum_n, r.all_n) for r in out.collect()}
    up = {("a", 1.0): (2, 3), ("a", 5.0): (3, 3), (None, 1.0): (4, 7), (None, 9.0): (7, 7)}
    down = {("a", 1.0): (3, 3), ("a", 5.0): (1, 3), (None, 1.0): (7, 7), (None, 9.0): (3, 7)}
    assert got == (down if desc else up)


def test_ranks_and_values_before_are_not_broadcast(spark):
    d = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), (None, 2.0, 3)], "g string, v double, id long")
    assert "Broadcast" not in plan(scale.percent_rank_by(d, ["g"], "v", "p"))
    assert "Broadcast" not in plan(scale.value_before(d, ["g"], "v", "id", "b"))


def test_baseline_rows_are_written_once_and_not_broadcast(spark):
    first, second = dq.baseline_rows(spark, SF), dq.baseline_rows(spark, SF)
    assert "Broadcast" not in plan(first) and "Broadcast" not in plan(dq.build_baseline_rows(spark, SF))
    assert first.inputFiles() == second.inputFiles()
    built = dq.build_baseline_rows(spark, SF)
    assert first.dtypes == built.dtypes and first.exceptAll(built).count() == built.exceptAll(first).count() == 0
    assert first.agg(F.count("id")).first()[0] > 0
