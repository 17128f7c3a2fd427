"""A table in one row group doesn't make one task of all that follows."""
from pyspark.sql import functions as F

from tenurelens.plans import fixtures as fx


def test_a_large_snapshot_is_dealt(spark, tmp_path):
    k = F.col("id")
    c = spark.range(1, 45001, numPartitions=1).select(k.alias("c_custkey"), (k % 25).alias("c_nationkey"), F.lit("M").alias("c_mktsegment"), (k % 900 * 1.0).alias("c_acctbal"))
    c.write.parquet(f"{tmp_path}/customer.parquet")
    b = fx.base(spark, str(tmp_path))
    assert "Exchange hashpartitioning(c_custkey" in b._jdf.queryExecution().executedPlan().toString()
    tasks = b.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in tasks)[-1] < 45000 and sum(r["count"] for r in tasks) == 90000
    assert b.select("cid", "vantage_date").distinct().count() == 90000


def test_repeated_and_missing_keys_stay(spark):
    d = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k long")
    assert sorted(str(r.k) for r in fx.dealt(d, "k", 2).collect()) == ["1", "1", "2", "None"]
    assert fx.dealt(d, "k", 4) is d
