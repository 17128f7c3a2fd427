"""The registered scale search covers all three distributions."""
import math

from pyspark.sql import functions as F

from tenurelens.operators import aft
from tenurelens.plans import fixtures as fx
from tenurelens.plans import model_queries as mq


def test_best_cell_where_the_normal_fits_best(spark, monkeypatch):
    # quantiles of a normal around eta = 5, all events
    from statistics import NormalDist
    rows = [("val", math.exp(5 + NormalDist().inv_cdf((i + 0.5) / 400)), 1, 5.0) for i in range(400)]
    scored = spark.createDataFrame(rows, "dataset string, time double, event int, eta double")
    monkeypatch.setattr(fx, "scored", lambda spark, sf: scored)
    best = mq.g2(spark, "").first()
    assert best["dist"] == "normal"
    cells = aft.grid_likelihood(scored).agg(F.max("loglik")).first()[0]
    assert best["loglik"] == round(cells, 4) and aft.grid_likelihood(scored).count() == 300
