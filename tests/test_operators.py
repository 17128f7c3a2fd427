"""Hand tables: ties, empty strata, edges of windows, missing values."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tenurelens.operators import aft, baselines, calibration, events, external, history, metrics, prep, profile, quality, risk, survival, whatif
from tenurelens.plans import features, fixtures
from tenurelens.sources import keys, tables

D = dt.date
V = D(2023, 1, 1)


def hist(spark, rows):
    cols = "person_composite_id string, rec_eff_start_dt_mod date, annl_cmpn_amt double, hr_cmpn_freq_cd string, mngr_lvl_cd int, mngr_pers_obj_id string"
    return spark.createDataFrame(rows, cols).withColumns({"vantage_date": F.lit(V), "mnthly_cmpn_amt": F.col("annl_cmpn_amt") / 12})


def test_km_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0)], "time int, event int")
    got = {r["t"]: (r["n_risk"], r["d"], r["S"], r["S_left"]) for r in survival.km_curve(df).collect()}
    assert got[1] == (5, 1, pytest.approx(0.8), 1.0)
    assert got[2] == (3, 2, pytest.approx(0.8 / 3), pytest.approx(0.8))
    assert got[3][2] == pytest.approx(0.8 / 3)


def test_km_last_subject_fails_and_no_events(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 365, 1), ("b", 5, 0), ("b", 365, 0)], "grp string, time int, event int")
    c = survival.km_curve(df, ["grp"])
    r = {x["grp"]: x for x in survival.retention(c, ["grp"]).collect()}
    assert r["a"]["retention_365d"] == 0.0 and r["a"]["retention_180d"] == 0.5 and r["a"]["median_days"] == 10
    assert r["b"]["retention_365d"] == 1.0 and r["b"]["median_days"] is None
    assert {x["grp"]: x["median_days"] for x in survival.median_survival(c, ["grp"]).collect()} == {"a": 10.0, "b": float("inf")}


def test_salary_history_edges(spark):
    rows = [("a", D(2021, 6, 1), 0.0, "M", 1, "m1"), ("a", D(2022, 6, 1), 100.0, "M", 2, "m2"), ("a", D(2022, 6, 1), 100.0, "M", 2, "m2"),
            ("a", D(2022, 12, 1), 90.0, "W", 2, "m1"), ("a", D(2023, 2, 1), 999.0, "M", 9, "m9"), ("b", D(2022, 1, 1), None, "M", None, "0")]
    h = hist(spark, rows)
    r = {x["person_composite_id"]: x for x in history.compensation_aggregates(h).collect()}
    assert set(r) == {"a"}
    a = r["a"]
    assert a["salary_growth_rate_12m"] == 0.0  # salary a year ago was 0
    assert a["comp_chang_freq_per_year"] == pytest.approx(2 * 365.0 / 548)
    assert a["avg_salary_last_quarter"] == pytest.approx(7.5)
    assert a["pay_grade_stagnation_months"] == pytest.approx(7.0)
    assert a["compensation_volatility"] == pytest.approx(np.std([0, 100, 90], ddof=1))
    t = history.time_in_current(h, "mngr_pers_obj_id", "days").collect()
    assert {x["person_composite_id"]: x["days"] for x in t} == {"a": (V - D(2021, 6, 1)).days, "b": 365}


def test_later_rows_change_nothing(spark):
    rows = [("a", D(2022, 3, 1), 10.0, "M", 1, "m1"), ("a", D(2022, 9, 1), 20.0, "W", 2, "m2")]
    later = rows + [("a", D(2023, 1, 2), 500.0, "X", 7, "m7")]
    for f in (history.compensation_aggregates, history.pay_frequency_consistency, history.manager_changes, history.level_promotion_features,
              lambda h: history.change_points(h, "hr_cmpn_freq_cd"), history.salary_as_of):
        assert f(hist(spark, rows)).collect() == f(hist(spark, later)).collect()


def test_promotion_window_edges(spark):
    df = spark.createDataFrame([("a", V), ("b", V)], "person_composite_id string, vantage_date date")
    day = lambda n: V - dt.timedelta(days=n)
    ev = spark.createDataFrame([("a", "pro", "opr", day(0)), ("a", "PRO", "X", day(730)), ("a", "PRO", "X", day(731)), ("a", "XFR", "REL", day(-1)),
                                ("a", "JTC", "FTPT", day(730))], "person_composite_id string, event_cd string, event_rsn_cd string, event_eff_dt date")
    r = {x["person_composite_id"]: x for x in events.add_event_features(df, ev).collect()}
    a, b = r["a"], r["b"]
    assert (a["num_promot_2yr"], a["promot_2yr_perf_ind"], a["days_since_promot"], a["promot_veloc"]) == (2, 1, 0, 730.0)
    assert a["promotion_velocity"] == pytest.approx(365.5) and a["num_transfer_2yr"] == 0 and a["days_since_transfer"] == 9999
    assert (a["job_chng_2yr_ind"], a["job_chng_fulltopart_ind"]) == (1, 1)
    assert (b["num_promot_2yr"], b["time_since_last_promotion"], b["promotion_velocity"]) == (0, 9999, 0.0)
    strict = {x["person_composite_id"]: x for x in events.promotion_time_features(df, ev.withColumn("event_cd", F.upper("event_cd"))).collect()}
    assert strict["a"]["days_since_promot"] == 730 and strict["b"]["promot_rt"] == 0.0


def test_ids_from_the_end(spark):
    d = spark.createDataFrame([("x_util_1_2",), ("w_y_util_12_34",), ("solo",)], "person_composite_id string")
    got = [tuple(r)[1:] for r in keys.parse_composite_id(d).collect()]
    assert got == [("2", "1", "x_util"), ("34", "12", "w_y_util"), ("solo", None, "")]


def test_key_tables(spark):
    d = spark.createDataFrame([("a", 1, "z"), ("b", 2, "y"), ("b", 3, "x"), ("c", None, "q"), ("c", 5, "p")], "k string, o int, v string")
    assert [r["k"] for r in keys.unique_key_rows(d, ["k"]).collect()] == ["a"]
    assert {r["k"]: r["v"] for r in keys.first_per_key(d, ["k"], "o").collect()} == {"a": "z", "b": "y", "c": "p"}
    assert keys.event_table(spark, None, None).count() == 0


def test_gates_and_csv(spark, tmp_path):
    assert tables.read_csv(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert tables.read_csv(spark, str(tmp_path / "empty.csv"), "a string, b string") is None
    (tmp_path / "latin.csv").write_bytes("State,Region\nQu\xe9bec,North\n".encode("latin-1"))
    c = tables.read_csv(spark, str(tmp_path / "latin.csv"))
    assert c.first()["State"] == "Qu\xe9bec"
    b = spark.createDataFrame([("a", "E", 1.0, V, "c")], "person_composite_id string, flsa_stus_cd string, x double, vantage_date date, clnt_obj_id string")
    assert external.normalized_flsa(b, None).first()["flsa_status_desc"] == "others"
    assert external.normalized_flsa(b, c).first()["flsa_status_desc"] == "others"


def test_save_features(spark, tmp_path):
    d = spark.createDataFrame([("a", V, 1), ("b", V, 2)], "person_composite_id string, vantage_date date, x int")
    tables.save_features(d, ["person_composite_id", "vantage_date", "nope"], path=str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert set(back.columns) == {"person_composite_id", "vantage_date"} and back.count() == 2
    tables.save_report(d, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_lenient_build_skips_a_broken_group(spark):
    sf = "/root/testdata/sf0.001"
    src = features.Sources(fixtures.base(spark, sf).drop("ltst_hire_dt"), fixtures.history(spark, sf), fixtures.terminations(spark, sf), fixtures.events(spark, sf))
    with pytest.raises(AnalysisException):
        features.build_features(src)
    out = features.build_features(src, strict=False)
    assert "fiscal_year" not in out.columns and {"career_stage", "num_promot_2yr", "flsa_status_desc", "sal_nghb_ratio"} <= set(out.columns)


def test_text_levels_and_missing_births(spark):
    d = spark.createDataFrame([("a", V, "M", None, 400), ("b", V, "5", D(1990, 1, 1), 100)],
                              "person_composite_id string, vantage_date date, mngr_lvl_cd string, birth_dt date, tenure_at_vantage_days int")
    d = d.withColumns({"full_tm_part_tm_cd": F.lit("F"), "reg_temp_cd": F.lit("R"), "flsa_stus_cd": F.lit("N")})
    r = {x["person_composite_id"]: x for x in profile.add_demographic_features(profile.job_characteristics(d)).collect()}
    assert (r["a"]["role_complexity_score"], r["b"]["role_complexity_score"], r["a"]["job_stability_ind"]) == (1, 3, 1.0)
    assert r["a"]["age_at_vantage"] is None and r["a"]["career_stage"] == "Senior" and r["b"]["age_at_vantage"] == pytest.approx(33.0)


def test_validation_report_names_the_fault(spark):
    d = spark.createDataFrame([("a", V, 5.0), ("a", V, 5.0), ("b", V, -1.0)], "person_composite_id string, vantage_date date, baseline_salary double")
    r = {(x["check"], x["column_name"]): x["n_bad"] for x in quality.validate_feature_ranges(d).collect()}
    assert r[("below_minimum", "baseline_salary")] == 1 and r[("null_value", "baseline_salary")] == 0
    assert quality.duplicate_rows(d).first()["n_bad"] == 1 and quality.duplicate_samples(d).first()["n"] == 2


def test_feature_model_keeps_train_limits(spark):
    train = spark.createDataFrame([(float(i), "x" if i < 6 else "y") for i in range(10)] + [(None, None)], "baseline_salary double, career_stage string")
    m = prep.fit_features(train, ["baseline_salary"], [], ["baseline_salary"], [], ["career_stage"])
    new = spark.createDataFrame([(1e9, "never"), (None, "x")], "baseline_salary double, career_stage string")
    a, b = m.transform(new).collect()
    assert a["baseline_salary_cap"] == pytest.approx(6.75 + 1.5 * 4.5) and a["career_stage_encoded"] == 0
    assert b["baseline_salary_cap"] == pytest.approx(4.5) and b["career_stage_encoded"] == 1
    again = prep.FeatureModel.from_json(m.to_json()).transform(new).collect()
    assert again == [a, b]


@pytest.mark.parametrize("dist", aft.DISTRIBUTIONS)
def test_fit_is_a_maximum(spark, dist):
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.normal(size=n)
    e = {"normal": rng.normal(size=n), "logistic": rng.logistic(size=n), "extreme": np.log(-np.log(rng.uniform(size=n)))}[dist]
    t = np.exp(4 + 0.5 * x + 0.7 * e)
    c = rng.exponential(120, size=n)
    rows = [(float(a), float(min(b, k)), int(b <= k)) for a, b, k in zip(x, t, c)]
    df = spark.createDataFrame(rows, "x double, time double, event int")
    m = aft.fit_aft(df, ["x"], dist)
    assert (m.intercept, m.coefficients[0], m.sigma) == (pytest.approx(4, abs=0.1), pytest.approx(0.5, abs=0.06), pytest.approx(0.7, abs=0.05))
    best = aft.log_likelihood(m.transform(df), m.sigma, (), [dist]).first()["loglik"]
    for change in ({"intercept": m.intercept + 0.01}, {"sigma": m.sigma * 1.01}, {"coefficients": [m.coefficients[0] - 0.01]}):
        o = aft.AftModel(**{**m.__dict__, **change})
        assert aft.log_likelihood(o.transform(df), o.sigma, (), [dist]).first()["loglik"] < best
    assert m.loglik == pytest.approx(best, rel=1e-6)


def test_extreme_fit_equals_the_library_weibull(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression
    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    t = np.exp(3 + 0.4 * x + 0.5 * np.log(-np.log(rng.uniform(size=800))))
    df = spark.createDataFrame([(float(a), float(b), int(i % 4 > 0)) for i, (a, b) in enumerate(zip(x, t))], "x double, time double, event int")
    m = aft.fit_aft(df, ["x"], "extreme")
    v = VectorAssembler(inputCols=["x"], outputCol="f").transform(df.withColumn("event", F.col("event").cast("double")))
    lib = AFTSurvivalRegression(featuresCol="f", labelCol="time", censorCol="event", maxIter=300, tol=1e-9).fit(v)
    assert (m.intercept, m.coefficients[0], m.sigma) == (pytest.approx(lib.intercept, abs=1e-3), pytest.approx(lib.coefficients[0], abs=1e-3), pytest.approx(lib.scale, abs=1e-3))


def scored(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "dataset string, time int, event int, eta double")


def test_equal_scores_give_half(spark):
    df = scored(spark, [(t, int(t % 3 > 0), 4.0) for t in range(1, 300)])
    assert metrics.auc(metrics.evaluation_rows(df, "logistic", 1.0, [100])).first()["auc"] == pytest.approx(0.5)
    assert metrics.concordance(df.withColumn("r", -F.col("eta")), "r").first()["c_index"] == pytest.approx(0.5)


def test_without_censoring_ipcw_is_plain(spark):
    df = scored(spark, [(1 + i * 7 % 300, 1, 3.0 + (i % 13) / 5) for i in range(400)])
    rows = metrics.evaluation_rows(df, "logistic", 1.0, [90, 180])
    plain = {r["horizon"]: r["brier"] for r in metrics.brier(rows, variant="plain").collect()}
    for variant in ("graf", "normalised"):
        for r in metrics.brier(rows, variant=variant).collect():
            assert r["brier"] == pytest.approx(plain[r["horizon"]], rel=1e-9)
    w = metrics.ipcw_weights(df).agg(F.min("ipcw"), F.max("ipcw")).first()
    assert w[0] == pytest.approx(1.0) and w[1] == pytest.approx(1.0)


def test_reversed_scores_mirror_the_auc(spark):
    df = scored(spark, [(1 + i * 11 % 364, int(i % 3 > 0), (i * 37 % 101) / 25) for i in range(500)])
    rows = metrics.evaluation_rows(df, "logistic", 1.0, [150])
    a = metrics.auc(rows).first()["auc"]
    b = metrics.auc(rows.withColumn("p", -F.col("p"))).first()["auc"]
    assert a + b == pytest.approx(1.0)


def test_contract(spark):
    df = scored(spark, [(5, 1, 0.0), (0, 1, 0.0), (7, 3, 0.0)])
    r = metrics.input_contract(df).first()
    assert (r["bad_time"], r["bad_event"]) == (1, 1)
    with pytest.raises(Exception, match="time must be"):
        metrics.require_valid(df).collect()


def test_isotonic_is_monotone_and_clips(spark):
    pts = [(90, x / 20, int(x > 8 and x != 12), 0, 0) for x in range(1, 19)]
    rows = spark.createDataFrame(pts, "horizon int, p double, y int, time int, event int")
    cal = calibration.fit_isotonic(rows, [90])
    new = spark.createDataFrame([(90, v / 100) for v in range(0, 101, 5)], "horizon int, p double")
    q = [r["q"] for r in cal.transform(new).orderBy("p").collect()]
    assert q == sorted(q) and q[0] == q[1] == 0.0 and q[-1] == 1.0


def test_bands_and_cuts(spark):
    df = spark.createDataFrame([(i / 1000, 1 + (1000 - i) // 3, int(i % 2)) for i in range(1000)], "risk double, time int, event int")
    n = {r["band"]: r["n"] for r in risk.band_statistics(risk.categorize(df)).collect()}
    assert n == {"High": 330, "Medium": 340, "Low": 330} or sum(n.values()) == 1000
    c = risk.optimal_cuts(df).first()
    assert 0.59 < c["high"] < 0.81 and 0.24 < c["medium"] < 0.46 and c["score"] > 0


def test_promotion_keeps_text_levels(spark):
    d = spark.createDataFrame([("M", "Late", 2), ("10", "Mid", 3), (None, None, None)], "job_level string, career_stage string, num_promot_2yr int")
    got = [(r["job_level"], r["career_stage"], r["num_promot_2yr"]) for r in whatif.promote(d, 1.0, "causal").collect()]
    assert got == [("M", "Senior", 3), ("10", "Late", 3), (None, None, None)]


def test_missing_location_stays_missing(spark):
    d = spark.createDataFrame([(1.0,), (None,)], "eta double")
    r = aft.risk_scores(aft.survival_at_horizons(d, "logistic", 1.0), {"min": -2.0, "max": 0.0}).collect()
    assert r[0]["risk"] == 0.5 and r[1]["risk"] is None and r[1]["surv_30d"] is None


def test_baseline_for_unseen_stratum(spark):
    train = spark.createDataFrame([("a", t, 1) for t in range(1, 21)], "grp string, time int, event int")
    test = spark.createDataFrame([("a", 5, 1), ("new", 5, 1)], "grp string, time int, event int")
    got = {r["grp"]: r["prediction"] for r in baselines.km_predictions(train, test, "grp", 10, 10).collect()}
    assert got == {"a": pytest.approx(0.5), "new": 0.5}
    r = baselines.random_predictions(test.withColumn("id", F.monotonically_increasing_id())).agg(F.min("prediction"), F.max("prediction")).first()
    assert 0.1 <= r[0] and r[1] <= 0.9


def test_concordance_counts_pairs_of_late_days(spark):
    df = spark.createDataFrame([("a", 100, 1, 1.0), ("a", 700, 1, 3.0), ("a", 900, 0, 2.0)], "dataset string, time int, event int, r double")
    r = metrics.concordance(df, "r").first()
    assert (r.comparable_pairs, round(r.c_index, 9)) == (3.0, round(1 / 3, 9))
    late = metrics.concordance(df.where("r > 1").withColumn("time", F.col("time").cast("long") * 10 ** 7), "r").first()
    assert (late.comparable_pairs, late.c_index) == (1.0, 1.0)


def test_likelihood_keeps_days_after_the_grid(spark):
    train = spark.createDataFrame([("s", t, 1) for t in range(10, 120, 10)], "g string, time int, event int")
    test = spark.createDataFrame([("s", 10, 1), ("s", 400, 1), ("s", 800, 0)], "g string, time int, event int")
    assert baselines.km_log_likelihood(train, test, "g", 1).first().n == 3


def test_ridge_moves_the_optimum(spark):
    df = spark.createDataFrame([(float(x), float(2.0 + 0.5 * x + 0.3 * ((x * 7) % 5 - 2)), 1) for x in range(40)], "x double, l double, event int").withColumn("time", F.exp("l"))
    plain, held = (aft.fit_aft(df, ["x"], "normal", ridge=r) for r in (0.0, 200.0))
    assert abs(held.coefficients[0]) < 0.98 * abs(plain.coefficients[0])
    # at the optimum the gradient of the likelihood is 2 * ridge * coefficient, both per scaled feature
    sd = df.agg(F.stddev_pop("x")).first()[0]
    z = (F.col("l") - held.intercept - held.coefficients[0] * F.col("x")) / held.sigma
    mean = df.agg(F.avg("x")).first()[0]
    g = df.agg(F.sum(z * (F.col("x") - mean) / sd) / held.sigma).first()[0]
    assert abs(g - 2 * 200.0 * held.coefficients[0] * sd) < 1e-3 * abs(g)


def test_codes_of_a_wide_category_are_joined(spark):
    df = spark.createDataFrame([(f"v{i % 1500}", float(i)) for i in range(2000)], "naics_cd string, baseline_salary double")
    few, many = (prep.fit_features(df, (), (), (), (), ["naics_cd"], most_literals=n) for n in (10, 5000))
    assert few.joined == ["naics_cd"] and many.joined == []
    a, b = ({(r.naics_cd, r.naics_cd_encoded) for r in m.transform(df).collect()} for m in (few, many))
    assert a == b and sorted(c for _, c in a) == list(range(1, 1501))
    lost = prep.FeatureModel.from_json(few.to_json())
    with pytest.raises(ValueError):
        lost.transform(df)


def test_bootstrap_interval_of_a_heavy_tail(spark):
    rows = [("a", 400 if i % 50 else 10, 0 if i % 50 else 1, 5.0 + 0.01 * (i % 7)) for i in range(3000)] + [("a", 200, 0, 5.0) for _ in range(2000)]
    df = spark.createDataFrame(rows, "dataset string, time int, event int, eta double")
    got = metrics.bootstrap_brier(df, "logistic", 0.5, [300], replicates=200).first()
    c = [r[0] for r in metrics.evaluation_rows(df, "logistic", 0.5, [300]).select((metrics._weights() * F.when(F.col("is_case"), F.pow(1 - F.col("p"), 2)).otherwise(F.pow("p", 2)))).collect()]
    r = np.random.default_rng(0)
    means = [np.mean(r.choice(c, len(c))) for _ in range(400)]
    low, high = np.percentile(means, [2.5, 97.5])
    values = [v for k, v in got.asDict().items() if k in ("lower", "upper")]
    assert abs((max(values) - min(values)) / (high - low) - 1) < 0.25
