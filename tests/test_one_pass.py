"""Operators that do their work in one pass: history summary, grid sums, many candidates, many columns."""
import collections
import datetime as dt
import math
import random
import re
import statistics

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tenurelens.functions import arrays, scale
from tenurelens.operators import aft, calibration, metrics, survival, tuning
from tenurelens.operators.run_summary import history_summary
from tenurelens.plans import feature_queries, features, fixtures

V = dt.date(2023, 1, 1)
COLUMNS = ["person_composite_id", "vantage_date", "rec_eff_start_dt_mod", "annl_cmpn_amt", "mnthly_cmpn_amt", "hr_cmpn_freq_cd", "mngr_lvl_cd", "job_cd", "mngr_pers_obj_id",
           "work_asgmnt_nbr", "work_loc_cd", "db_schema", "clnt_obj_id"]
SCHEMA = ("person_composite_id string, vantage_date date, rec_eff_start_dt_mod date, annl_cmpn_amt double, mnthly_cmpn_amt double, hr_cmpn_freq_cd string, mngr_lvl_cd int, job_cd string, "
          "mngr_pers_obj_id string, work_asgmnt_nbr string, work_loc_cd string, db_schema string, clnt_obj_id string")
PLACES = [("s", "c", "L0", "Unknown", "North"), ("s", "c", "L1", "Town", "North"), ("s", "c", "L2", "Village", "MISSING"), ("s", "c", "L3", "Town", "South")]


def records(seed):
    """Histories with several records a day, nulls, repeated rows, records after the vantage date, and one person with many."""
    r = random.Random(seed)
    some = lambda *x: r.choice([*x, None]) if r.random() < 0.2 else r.choice(x)
    rows = []
    for p, n in [(f"p{i}", r.choice([1, 2, 5, 12])) for i in range(25)] + [("hot", 300), ("late", 1)]:
        for _ in range(n):
            day = V + dt.timedelta(days=1) if p == "late" else V - dt.timedelta(days=r.choice([0, 3, 30, 31, 89, 90, 91, 364, 365, 366, 400, 800]) - (5 if r.random() < 0.05 else 0))
            rows.append((p, V, day, some(100.0, 100.5, 200.0, 150.0), some(8.0, 9.0), some("M", "W"), some(1, 2, 3), some("j1", "j2"), some("m1", "m2", "UNKNOWN", ""), some("1", "2"), some("L0", "L1", "L2", "L3"), "s", "c"))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows


def plain(rows):
    """The same features, by walking sorted records."""
    place, out = {p[2]: p[3:] for p in PLACES}, {}
    by = collections.defaultdict(list)
    for x in rows:
        if x[2] <= x[1]:
            by[x[0]].append(dict(zip(COLUMNS, x)))
    for p, recs in by.items():
        def run(value):
            pairs = sorted({(x["rec_eff_start_dt_mod"], value(x)) for x in recs if value(x) is not None})
            return [(d, v, pairs[i - 1][1] if i else None) for i, (d, v) in enumerate(pairs)]

        def changes(value):
            return sum(prev is not None and v != prev for _, v, prev in run(value))

        o = {}
        pay = sorted({(x["rec_eff_start_dt_mod"], x["annl_cmpn_amt"], -1 if x["mnthly_cmpn_amt"] is None else x["mnthly_cmpn_amt"]) for x in recs if x["annl_cmpn_amt"] is not None})
        if pay:
            steps = run(lambda x: x["annl_cmpn_amt"])
            now, ago = max((d, s) for d, s, _ in steps)[1], max(((d, s) for d, s, _ in steps if (V - d).days >= 365), default=(None, None))[1]
            moved = [d for d, s, q in steps if q is None or s != q]
            span = (moved[-1] - moved[0]).days
            quarter = [m for d, _, m in pay if (V - d).days <= 90 and m != -1]
            rises = [d for d, s, q in steps if q is not None and s > q]
            last = max(rises, default=None)
            months = 0.0 if last is None else (V.year - last.year) * 12 + V.month - last.month + (0 if V.day == last.day else (V.day - last.day) / 31)
            o |= {"salary_growth_rate_12m": (now - ago) / ago if ago else 0.0, "comp_chang_freq_per_year": (len(moved) - 1) * 365 / span if span > 365 else float(len(moved) - 1),
                  "compensation_volatility": statistics.stdev([s for _, s, _ in pay]) if len(pay) > 1 else 0.0, "avg_salary_last_quarter": sum(quarter) / len(quarter) if quarter else None,
                  "pay_grade_stagnation_months": months}
        codes = collections.Counter(x["hr_cmpn_freq_cd"] for x in recs if x["hr_cmpn_freq_cd"] and (V - x["rec_eff_start_dt_mod"]).days <= 365)
        n = sum(codes.values())
        o["pay_freq_diversity_score"] = 1 - sum(c * c for c in codes.values()) / n ** 2 if n else None
        up = [d for d, v, q in run(lambda x: x["mngr_lvl_cd"]) if q is not None and v > q]
        o["n_promotions"], o["time_since_last_promotion"] = len(up) or None, (V - max(up)).days if up else None
        o["promotion_velocity"] = ((max(up) - min(up)).days / (len(up) - 1) if len(up) > 1 else 0.0) if up else None
        for c, name in (("job_cd", "tenure_in_current_role"), ("mngr_pers_obj_id", "time_with_current_manager")):
            known = [(x["rec_eff_start_dt_mod"], x[c]) for x in recs if x[c] is not None]
            o[name] = (V - min(d for d, v in known if v == max(known)[1])).days if known else None
        o["manager_changes_count"] = len({x["mngr_pers_obj_id"] for x in recs} - {None, "UNKNOWN", "ONE", "", "0"})
        o["assignment_frequency_12m"] = len({x["work_asgmnt_nbr"] for x in recs if (V - x["rec_eff_start_dt_mod"]).days <= 365} - {None})
        at = lambda x, i: v if (v := place.get(x["work_loc_cd"], (None, None))[i]) and v.upper() not in ("UNKNOWN", "MISSING", "NULL") else None
        o |= {"work_location_changes_count": changes(lambda x: x["work_loc_cd"]), "num_city_chng": changes(lambda x: at(x, 0)), "num_state_chng": changes(lambda x: at(x, 1))}
        out[p] = o
    return out


@pytest.mark.parametrize("seed", range(4))
def test_history_summary(spark, seed):
    rows = records(seed)
    places = spark.createDataFrame(PLACES, "db_schema string, clnt_obj_id string, work_loc_cd string, city_nm string, state_prov_nm string")
    got = {r["person_composite_id"]: r.asDict() for r in history_summary(spark.createDataFrame(rows, SCHEMA).repartition(3), places=places).collect()}
    want = plain(rows)
    assert set(got) == set(want) and "late" not in got
    for p, o in want.items():
        for c, v in o.items():
            assert got[p][c] == (v if v is None else pytest.approx(v, rel=1e-9, abs=1e-8)), (p, c)


def test_parts_alone_agree(spark):
    df = spark.createDataFrame(records(9), SCHEMA)
    every = {r["person_composite_id"]: r for r in history_summary(df).collect()}
    for part in ("pay", "frequency", "level", "job", "manager", "assignment", "location"):
        for r in history_summary(df, [part]).collect():
            for c, v in r.asDict().items():  # sums may run in another order
                assert every[r["person_composite_id"]][c] == (pytest.approx(v, rel=1e-12, abs=1e-12) if isinstance(v, float) else v), (part, c)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_build_reads_history_once(spark):
    text = plan(feature_queries._full(spark, SF))
    scans = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "o_totalprice" in s]
    assert len(scans) == 1, scans


def test_group_left_out_when_columns_lack(spark):
    src = feature_queries._sources(spark, SF)
    src.history = src.history.drop("work_asgmnt_nbr")
    got = features.build_features(src, strict=False).columns
    assert "assignment_frequency_12m" not in got and {"salary_growth_rate_12m", "tenure_in_current_role", "manager_changes_count"} <= set(got)
    with pytest.raises(Exception):
        features.build_features(src)


def unfolded(text):
    """Generate nodes directly above a scan: nothing between them adds rows up or makes arrays."""
    lines, out = text.split("\n"), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-|*()0123456789"))
    for i, x in enumerate(lines):
        if "Generate " in x:
            for y in lines[i + 1:]:
                if depth(y) <= depth(x) or re.search("MapInArrow|Aggregate|LocalTableScan", y):
                    break
                if "FileScan" in y:
                    out.append(x.strip())
                    break
    return out


@pytest.mark.parametrize("name", ["g2_scale_grid_search", "g11_monotonicity", "i5_integrated_brier", "i5_integrated_brier_span", "j12_threshold_sweep"])
def test_grids_make_no_rows(spark, name):
    """Above the scan of people nothing unfolds rows into grid points; only the four horizons of the threshold tables are rows of their own."""
    made = unfolded(plan(entry_module.queries()[name](spark, SF)))
    assert all("explode([30,90,180,365])" in x for x in made), made
    assert unfolded("A\n+- Generate explode([1,2])\n   +- FileScan x") and not unfolded("+- Generate x\n   +- MapInArrow\n      +- FileScan x")


def test_grouped_arrays(spark):
    rows = [(i % 5 if i % 7 else None, "ab"[i % 2], float(i), None if i % 11 == 0 else 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, h string, x double, y double").repartition(4)
    got = arrays.grouped_arrays(df, ["g", "h"], 3, lambda c: np.column_stack((c["x"], np.isnan(c["y"]), np.ones(len(c["x"]))))).collect()
    want = collections.Counter()
    for g, h, x, y in rows:
        for i, v in enumerate((x, y is None, 1)):
            want[g, h, i] += v
    assert {(r.g, r.h, r.i): r.v for r in got} == dict(want)
    assert arrays.grouped_arrays(df.where("false"), ["g"], 2, lambda c: np.zeros((0, 2))).count() == 0


def test_column_quantiles(spark):
    r = np.random.default_rng(3)
    cols = {"a": r.standard_normal(3000), "b": r.integers(0, 5, 3000).astype(float), "c": np.full(3000, 7.0), "d": r.exponential(1e6, 3000), "e": np.full(3000, np.nan)}
    rows = [tuple(None if math.isnan(v) or (i % 13 == 0 and k == "a") else float(v) for k, v in zip(cols, x)) for i, x in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {x.column_name: x for x in scale.column_quantiles(df, list(cols), {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == set("abcd")
    for i, c in enumerate("abcd"):
        v = [x[i] for x in rows if x[i] is not None]
        assert [got[c][p] for p in ("p1", "p50", "p99")] == pytest.approx(np.quantile(v, [0.01, 0.5, 0.99]).tolist(), rel=1e-12)
    n = {(x.column_name, x.value): x.n for x in scale.column_value_counts(df.select("b", F.lit(None).cast("string").alias("z")), ["b", "z"]).collect()}
    assert n["z", None] == 3000 and sum(v for (c, _), v in n.items() if c == "b") == 3000


def survival_rows(spark, n=4000):
    r = np.random.default_rng(5)
    x1, x2 = r.standard_normal(n), r.integers(0, 2, n)
    t = np.exp(5 + 0.4 * x1 - 0.3 * x2 + 0.6 * r.logistic(size=n))
    end = r.uniform(50, 400, n)
    rows = [(i, float(max(1, min(a, b))), int(a <= b), float(u), float(v)) for i, (a, b, u, v) in enumerate(zip(t, end, x1, x2))]
    return spark.createDataFrame(rows, "id long, time double, event int, x1 double, x2 double")


def test_candidates_together_as_alone(spark):
    df = survival_rows(spark)
    grid = tuning.candidate_grid(("logistic", "extreme", "normal"), (0.0, 50.0), (None, 0.9))
    together = aft.fit_candidates(df, ["x1", "x2"], grid)
    for c, m in list(zip(grid, together))[::3]:
        alone = aft.fit_candidates(df.repartition(7), ["x1", "x2"], [c])[0]
        assert [m.intercept, *m.coefficients, m.sigma] == pytest.approx([alone.intercept, *alone.coefficients, alone.sigma], abs=1e-5)
    for c, m in zip(grid, together):
        assert m.gradient < 1e-4 and (c.sigma is None or m.sigma == pytest.approx(c.sigma))
    best = together[0]
    assert [best.intercept, *best.coefficients, best.sigma] == pytest.approx([5, 0.4, -0.3, 0.6], abs=0.06)
    t = tuning.run_trials(df, df, ["x1", "x2"], grid[:4]).collect()
    for r, m in zip(t, together):
        one = m.transform(df).withColumn("dataset", F.lit("v"))
        assert r.score == pytest.approx(aft.log_likelihood(one, m.sigma, (), [m.dist]).first()["objective"], rel=1e-9)
        assert r.c_index == pytest.approx(metrics.concordance(one.withColumn("_risk", -F.col("eta")), "_risk").first()["c_index"], rel=1e-9)
        assert r.calibration_slope == pytest.approx(aft.calibration_slope(one).first()["calibration_slope"], rel=1e-9)


def test_kernel_density(spark):
    got = collections.defaultdict(list)
    for r in survival.kernel_density(survival_rows(spark)).orderBy("point").collect():
        got[r.event, r["scale"]].append((r.x, r.density))
    assert set(got) == {(e, s) for e in (0, 1) for s in ("days", "log_days")}
    for (_, s), v in got.items():
        x, y = np.array(v).T
        assert len(v) == 200 and (np.diff(x) > 0).all() and np.trapezoid(y, x) == pytest.approx(1, abs=0.06 if s == "days" else 0.01)
    assert survival.kernel_density(spark.createDataFrame([(1.0, 1), (1.0, 0)], "time double, event int")).count() == 0


def test_confusion_counts_places(spark):
    r = random.Random(1)
    rows = [(h, r.choice([None, 0.1, 0.15, 0.2, 0.5, r.random()]), r.choice([0, 1])) for h in (30, 90) for _ in range(400)]
    grid = [(30, 0.1), (30, 0.15), (30, 0.9), (90, 0.2)]
    got = calibration.confusion(spark.createDataFrame(rows, "horizon int, p double, y int"), spark.createDataFrame(grid, "horizon int, threshold double")).collect()
    assert len(got) == 4
    for x in got:
        own = [(p >= x.threshold, y) for h, p, y in rows if h == x.horizon and p is not None]
        assert (x.tp, x.fp, x.fn, x.tn) == tuple(own.count(k) for k in ((True, 1), (True, 0), (False, 1), (False, 0)))


def test_failing_group_is_left_out_at_run_time(spark, tmp_path, monkeypatch):
    """A group that raises in a task is left out, the others are there; the next build takes up the finished ones and makes up for it."""
    src = feature_queries._sources(spark, SF)
    bad = F.when(F.col("employee_guid").isNotNull(), F.raise_error(F.lit("broken source"))).otherwise(F.col("employee_guid"))
    src.geocodes = src.geocodes.withColumn("employee_guid", bad.cast("string"))
    df, failed = features.build_in_units(src, str(tmp_path))
    assert set(failed) == {"neighborhood"} and "broken source" in failed["neighborhood"] and "sal_nghb_ratio" not in df.columns
    want = features.build_features(feature_queries._sources(spark, SF))
    assert set(want.columns) - set(df.columns) == {"sal_nghb_ratio", "median_household_income"}
    stamp = {p.name: (p / "_SUCCESS").stat().st_mtime_ns for p in tmp_path.iterdir() if (p / "_SUCCESS").exists()}
    again, failed = features.build_in_units(feature_queries._sources(spark, SF), str(tmp_path))
    assert not failed and set(again.columns) == set(want.columns)
    assert all((tmp_path / n / "_SUCCESS").stat().st_mtime_ns == m for n, m in stamp.items())
    cols = sorted(c for c in want.columns if c != "compensation_volatility")
    rounded = lambda d: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d.select(*cols).collect())
    assert rounded(again) == rounded(want)


def test_bucketed_tables_are_joined_without_a_shuffle(spark):
    from pyspark.sql import DataFrame
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry_module.queries()["a12_catalog_tables"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert "SortMergeJoin" in text and "Exchange" not in text and text.count("Bucketed: true") == 2


def test_rank_of_texts_with_one_beginning(spark):
    """Ranks along ranges: no window, and no task with most of the values."""
    n = 4000
    df = spark.range(n).select(F.lit("id").alias("column_name"), F.format_string("core_util_1_%08d", F.col("id")).alias("value"), (F.col("id") % 3).alias("n"))
    got = scale.range_ranks(df, ["column_name"], [F.desc("n"), F.asc("value")], "code")
    want = sorted(((i % 3, f"core_util_1_{i:08d}") for i in range(n)), key=lambda x: (-x[0], x[1]))
    assert [(r.n, r.value) for r in got.orderBy("code").collect()] == want and got.agg(F.min("code"), F.max("code")).first()[:] == (1, n)
    sizes = [r["count"] for r in got.groupBy("_part" if "_part" in got.columns else F.spark_partition_id()).count().collect()]
    assert max(sizes) < n
    assert not re.search(r"Window .*value", plan(got))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_curve_over_real_valued_times(spark, by):
    """Times that aren't whole numbers give the curve of the windows over days, without a window over all of them."""
    r = np.random.default_rng(8)
    rows = [(i % 2, float(t), int(e)) for i, (t, e) in enumerate(zip(r.integers(1, 60, 500), r.integers(0, 2, 500)))] + [(0, 70.0, 1), (1, 71.0, 1)]
    df = spark.createDataFrame(rows, "g int, time double, event int")
    real, days = survival.km_curve(df, by), survival.km_curve(df.withColumn("time", F.col("time").cast("int")), by)
    key = lambda x: [x[c] for c in [*by, "t"]]
    a, b = (sorted((x.asDict() for x in d.select(*by, "t", "d", "n", "n_risk", "S", "S_left").collect()), key=key) for d in (real, days))
    assert len(a) == len(b) and all(x[c] == pytest.approx(y[c], abs=1e-12) for x, y in zip(a, b) for c in x)
    assert not re.search(r"Window .*windowspecdefinition\((g#\d+, )?t#", plan(real)) and "windowspecdefinition" in plan(real)
    both = [sorted((x.asDict() for x in metrics.censoring_curve(d.withColumn("dataset", F.col("g"))).collect()), key=lambda x: (x["dataset"], x["t"])) for d in (df, df.withColumn("time", F.col("time").cast("int")))]
    assert all(x[c] == pytest.approx(y[c], abs=1e-12) for x, y in zip(*both) for c in x)


def test_isotonic_blocks_in_a_tree(spark):
    """The tree's blocks are those of pooling all points at once, and maps agree with Spark's own fit."""
    from pyspark.ml.regression import IsotonicRegression
    r = np.random.default_rng(2)
    p = np.concatenate((r.uniform(0, 1, 3000), np.full(900, 0.25), r.beta(0.3, 6, 2000)))
    y = (r.uniform(0, 1, len(p)) < np.clip(0.1 + 0.7 * p, 0, 1)).astype(int)
    rows = spark.createDataFrame([(30 if i % 3 else 90, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))] + [(30, None, 1)], "horizon int, p double, y int").repartition(6)
    cal = calibration.fit_isotonic(rows, [30, 90])
    for h in (30, 90):
        pts = rows.where((F.col("horizon") == h) & F.col("p").isNotNull()).groupBy("p").agg(F.avg(F.col("y").cast("double")).alias("label"), F.count("y").cast("double").alias("w")).orderBy("p")
        got = calibration.isotonic_blocks(rows).where(F.col("horizon") == h).orderBy("low").collect()
        own = [(x.p, x.p, x.label * x.w, x.w) for x in pts.collect()]
        assert [(x.low, x.high, round(x.total), x.weight) for x in got] == [(a, b, round(t), w) for a, b, t, w in calibration.pooled(*zip(*own))]
        m = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="w").fit(pts)
        for a, b in zip(m.boundaries, m.predictions):
            assert float(np.interp(a, *cal.knots[h])) == pytest.approx(b, abs=1e-12)
    out = cal.transform(rows).collect()
    assert all((x.p is None) == (x.q is None) and (x.q is None or 0 <= x.q <= 1) for x in out)
