"""The spread-out helpers give what a plain window or a small brute force gives."""
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.bootstrap import percentile_interval, replicate_means
from tenurelens.functions.scale import exact_quantiles, percent_rank_by, pin_small, previous_value, running_totals, value_bucket
from tenurelens.operators.metrics import concordance


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(5)
    # one group holds most rows; values repeat, are negative, zero and far apart
    rows = [("hot" if i % 4 else f"g{i % 7}", rnd.choice([0.0, -3.5, rnd.gauss(0, 1), rnd.gauss(0, 1e5), 2.0]), i) for i in range(2000)]
    return spark.createDataFrame(rows + [("g1", None, -1)], "g string, v double, id long").cache()


def test_buckets_keep_the_order(spark):
    vals = sorted([-1e9, -5.0, -1e-7, 0.0, 1e-9, 1e-6, 0.3, 0.30001, 1.0, 7.5, 1e12])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(value_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_percent_rank(numbers):
    w = W.partitionBy("g").orderBy("v")
    want = numbers.where("v is not null").withColumn("w", F.percent_rank().over(w)).select("id", "w")
    got = percent_rank_by(numbers, ["g"], "v", "p")
    assert got.count() == numbers.count()
    bad = got.join(want, "id").where(F.abs(F.col("p") - F.col("w")) > 1e-12).count()
    assert bad == 0 and got.where("v is null and p is not null").count() == 0


@pytest.mark.parametrize("probs", [{"a": 0.0, "b": 0.5, "c": 1.0}, {"a": 0.013, "b": 0.25, "c": 0.97}])
def test_quantiles(numbers, probs):
    got = {r["g"]: r for r in exact_quantiles(numbers, ["g"], "v", probs).collect()}
    data = numbers.where("v is not null").toPandas()
    for g, d in data.groupby("g"):
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.quantile(d.v, p), rel=1e-12, abs=1e-12)


def test_quantiles_without_groups_and_of_one_value(spark, numbers):
    r = exact_quantiles(numbers, [], "v", {"m": 0.5}).first()
    assert r["m"] == pytest.approx(np.median(numbers.where("v is not null").toPandas().v))
    one = spark.createDataFrame([(4.0,)] * 5, "v double")
    assert exact_quantiles(one, [], "v", {"a": 0.1, "b": 0.9}).first().asDict() == {"a": 4.0, "b": 4.0}


@pytest.mark.parametrize("desc", [False, True])
def test_running_totals(numbers, desc):
    d = numbers.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    order = F.desc("v") if desc else F.asc("v")
    w = W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    want = d.select("g", "v", F.sum("n").over(w).alias("w"))
    got = running_totals(d, ["g"], "v", ["n"], desc)
    assert got.join(want, ["g", "v"]).where("cum_n != w").count() == 0
    assert got.groupBy("g").agg(F.max("all_n").alias("a"), F.sum("n").alias("b")).where("a != b").count() == 0


def test_previous_value_crosses_months_and_gaps(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"p{i % 5}", 18000 + rnd.randrange(900), rnd.randrange(4)) for i in range(900)]
    d = spark.createDataFrame(rows, "p string, day int, v int").withColumn("d", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).distinct()
    w = W.partitionBy("p").orderBy("d", "v")
    want = d.withColumn("w", F.lag("v").over(w))
    got = previous_value(d, ["p"], "d", "v")
    assert got.join(want, ["p", "d", "v"]).where("not (prev_value <=> w)").count() == 0


def test_pin_small_gives_back_large_tables(spark):
    df = spark.range(50)
    assert pin_small(df, 49) is df and pin_small(df, 50).count() == 50


def test_concordance_against_pairs(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(1, 20), rnd.randrange(2), rnd.randrange(6) / 3.0) for _ in range(200)]
    good = total = strict_good = strict_total = 0.0
    for ti, ei, si in rows:
        for tj, ej, sj in rows:
            if ei and (tj > ti or (tj == ti and not ej)):
                hit = 1.0 if si > sj else 0.5 if si == sj else 0.0
                good, total = good + hit, total + 1
                if tj > ti:
                    strict_good, strict_total = strict_good + hit, strict_total + 1
    df = spark.createDataFrame([("x", *r) for r in rows], "dataset string, time int, event int, s double")
    r = concordance(df, "s").first()
    assert r["c_index"] == pytest.approx(good / total) and r["comparable_pairs"] == total
    assert concordance(df, "s", tied_times=False).first()["c_index"] == pytest.approx(strict_good / strict_total)
    # turning the score round turns the index round
    assert concordance(df.withColumn("s", -F.col("s")), "s").first()["c_index"] == pytest.approx(1 - good / total)


def test_bootstrap_is_repeatable_and_near_theory(spark):
    cells = spark.createDataFrame([("a", 1, 300.0, 300), ("a", 0, 0.0, 700)], "g string, cell int, total double, n int")
    reps = replicate_means(cells, ["g"], "total", "n", 400, cell_key=["g", "cell"])
    a, b = percentile_interval(reps, ["g"]).first(), percentile_interval(reps, ["g"]).first()
    assert a == b
    half = 1.96 * (0.3 * 0.7 / 1000) ** 0.5
    assert a["estimate"] == pytest.approx(0.3, abs=0.005) and (a["upper"] - a["lower"]) / 2 == pytest.approx(half, rel=0.2)
