"""Registered queries: validation, description and model-input preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenurelens.operators import describe as de
from tenurelens.operators import prep
from tenurelens.operators import quality as qu
from tenurelens.plans import fixtures as fx
from tenurelens.plans.registry import query
from tenurelens.plans.survival_queries import AGE, tidy
from tenurelens.rules import CRITICAL_FEATURES, FEATURE_GROUPS, FEATURE_RULES, group_of
from tenurelens.schema import ENTITY
from tenurelens.sources.tables import or_constant, read_table

COLUMNS = ["person_composite_id", "vantage_date", "dataset_split", "clnt_obj_id", "naics_cd", "baseline_salary", "pay_rt_type_cd",
           "tenure_at_vantage_days", "reg_temp_cd", "flsa_stus_cd", "full_tm_part_tm_cd", "team_avg_comp", "team_size", "survival_time_days", "event_indicator_all",
           "event_indicator_vol", "age_at_vantage", "career_stage", "num_promot_2yr", "promot_2yr_ind", "days_since_promot",
           "compensation_percentile_company", "company_tenure_percentile", "rec_eff_start_dt_mod", "termination_date", "job_level"]


def feature_table(spark, sf):
    """Snapshot with a few planted faults: repeated rows, future dates, values out of range."""
    b = fx.base(spark, sf)
    k = F.col("cid")
    age = F.round(F.months_between("vantage_date", "birth_dt") / 12, 6)
    d = b.withColumns({
        "age_at_vantage": age,
        "career_stage": F.when(age < 30, "Early").when(age < 45, "Mid").when(age < 60, "Late").when(k % 300 == 5, "Unset").otherwise("Senior"),
        "num_promot_2yr": (k % 8).cast("int"), "promot_2yr_ind": F.when(k % 500 == 1, 2).when(k % 8 > 0, 1).otherwise(0),
        "days_since_promot": F.when(k % 5 > 0, (k % 4000 - 5).cast("int")),
        "compensation_percentile_company": (k % 1000) / 990.0,
        "company_tenure_percentile": F.when(k % 13 > 0, 1 + (k * 7 % 99).cast("double")),
        "rec_eff_start_dt_mod": F.date_add("vantage_date", (k % 100 - 95).cast("int")),
        "termination_date": F.when(k % 9 == 0, F.date_add("vantage_date", (k % 40 - 20).cast("int"))),
        "job_level": F.lit(3)}).select(*COLUMNS, "cid")
    return d.unionByName(d.where(F.col("cid") % 200 == 0)).drop("cid")


FEAT = f"""{fx.BASE}, feat0 as (select *, round({AGE},6) age_at_vantage from base),
feat1 as (select person_composite_id, vantage_date, dataset_split, clnt_obj_id, naics_cd, baseline_salary, pay_rt_type_cd, tenure_at_vantage_days,
 reg_temp_cd, flsa_stus_cd, full_tm_part_tm_cd, team_avg_comp, team_size, survival_time_days, event_indicator_all, event_indicator_vol, age_at_vantage,
 case when age_at_vantage<30 then 'Early' when age_at_vantage<45 then 'Mid' when age_at_vantage<60 then 'Late' when cid%300=5 then 'Unset' else 'Senior' end career_stage,
 cast(cid%8 as integer) num_promot_2yr, case when cid%500=1 then 2 when cid%8>0 then 1 else 0 end promot_2yr_ind,
 case when cid%5>0 then cast(cid%4000-5 as integer) end days_since_promot, (cid%1000)/990.0 compensation_percentile_company,
 case when cid%13>0 then 1+cast(cid*7%99 as double) end company_tenure_percentile,
 vantage_date + cast(cid%100-95 as integer) rec_eff_start_dt_mod, case when cid%9=0 then vantage_date + cast(cid%40-20 as integer) end termination_date, 3 job_level, cid from feat0),
feat as (select * exclude (cid) from (select * from feat1 union all select * from feat1 where cid%200=0))"""
NUMS = ["baseline_salary", "tenure_at_vantage_days", "team_avg_comp", "team_size", "survival_time_days", "event_indicator_all", "event_indicator_vol",
        "age_at_vantage", "num_promot_2yr", "promot_2yr_ind", "days_since_promot", "compensation_percentile_company", "company_tenure_percentile", "job_level"]
TEXTS = ["dataset_split", "clnt_obj_id", "naics_cd", "pay_rt_type_cd", "reg_temp_cd", "flsa_stus_cd", "full_tm_part_tm_cd", "career_stage"]


def checks_sql(rows):
    """Twin of ``count_report``: rows of (check, column, condition text)."""
    return " union all ".join(f"select '{n}' as check, '{c}' column_name, cast(count(*) filter (where {cond}) as bigint) n_bad, count(*) filter (where {cond})=0 passed from feat" for n, c, cond in rows)


def number(v):
    return f"{v:.1f}"


TEMPORAL = [("after_vantage", c, f"{c}>vantage_date") for c in ("rec_eff_start_dt_mod", "termination_date")]
RANGES = []
for _n, _r in FEATURE_RULES.items():
    if _n in COLUMNS:
        RANGES += [("below_minimum", _n, f"{_n}<{number(_r.minimum)}")] if _r.minimum is not None else []
        RANGES += [("above_maximum", _n, f"{_n}>{number(_r.maximum)}")] if _r.maximum is not None else []
        RANGES += [("unknown_value", _n, f"{_n} not in (" + ",".join(f"'{v}'" for v in _r.values) + ")")] if _r.values else []
        RANGES += [] if _r.allow_null else [("null_value", _n, f"{_n} is null")]
BUSINESS = [("age_16_85", "age_at_vantage", "age_at_vantage<16 or age_at_vantage>85"),
            ("tenure_over_age", "tenure_at_vantage_days", "tenure_at_vantage_days/365.25>age_at_vantage-14"),
            ("many_promotions", "num_promot_2yr", "num_promot_2yr>5"),
            ("rank_0_1", "compensation_percentile_company", "compensation_percentile_company<0 or compensation_percentile_company>1"),
            ("flag_0_1", "event_indicator_all", "event_indicator_all not in (0,1)"), ("flag_0_1", "event_indicator_vol", "event_indicator_vol not in (0,1)"),
            ("flag_0_1", "promot_2yr_ind", "promot_2yr_ind not in (0,1)")]
LEAKAGE = [("forbidden_column", "termination_date", "true"), ("negative_duration", "days_since_promot", "days_since_promot<0"),
           ("censored_before_end", "survival_time_days", "event_indicator_all=0 and survival_time_days<>365")]
DUPS = """select 'duplicate_rows' as check, cast((select count(*) from feat)-(select count(*) from (select distinct * from feat)) as bigint) n_bad
 union all select 'duplicate_persons', cast((select count(*) from feat)-(select count(*) from (select distinct person_composite_id, vantage_date from feat)) as bigint)"""
DIST = " union all ".join(
    [f"""select '{c}' column_name, count(*) n_rows, count(*)-count({c}) n_null, count(distinct {c}) n_distinct,
 cast(count(*) filter (where abs({c}-m)>5*s and s>0) as bigint) n_far, concat_ws(',', case when (count(*)-count({c}))/cast(count(*) as double)>0.95 then 'mostly_null' end,
 case when count(distinct {c})<=1 then 'constant' end, case when count(distinct {c}) between 2 and 3 then 'few_values' end,
 case when count(*) filter (where abs({c}-m)>5*s and s>0)/cast(count(*) as double)>0.01 then 'outliers' end) findings
 from feat, (select avg({c}) m, stddev_samp({c}) s from feat)""" for c in NUMS] +
    [f"""select '{c}', count(*), {'count(*)-count(' + c + ')' if c != 'dataset_split' else '0'}, count(distinct {c}), 0, concat_ws(',',
 case when (count(*)-count({c}))/cast(count(*) as double)>0.95 then 'mostly_null' end, case when count(distinct {c})/cast(count(*) as double)>0.8 then 'key_like' end) from feat""" for c in TEXTS] +
    [f"select '{c}', count(*), count(*)-count({c}), 0, 0, case when (count(*)-count({c}))/cast(count(*) as double)>0.95 then 'mostly_null' else '' end from feat" for c in ("rec_eff_start_dt_mod", "termination_date")])


@query("c1_run_validations", f"""with {FEAT}, dist as ({DIST}), r as (
 select 'temporal' as check, n_bad from ({checks_sql(TEMPORAL)}) union all select 'range', n_bad from ({checks_sql(RANGES)})
 union all select 'business', n_bad from ({checks_sql([b for b in BUSINESS if b[0] != 'many_promotions'])}) union all select 'leakage', n_bad from ({checks_sql(LEAKAGE[:1])})
 union all select 'distribution', case when findings like '%mostly_null%' or findings like '%constant%' then 1 else 0 end from dist union all {DUPS})
select "check", cast(sum(n_bad) as bigint) n_bad, sum(n_bad)=0 passed from r group by 1""")
def c1(spark, sf):
    return qu.run_validations(feature_table(spark, sf))


@query("c2_duplicates", f"with {FEAT}, d as ({DUPS}) select *, n_bad=0 passed from d")
def c2(spark, sf):
    f = feature_table(spark, sf)
    return qu.duplicate_rows(f).unionByName(qu.duplicate_persons(f)).drop("column_name")


@query("c2_duplicate_samples", f"with {FEAT} select person_composite_id, vantage_date, count(*) n from feat group by 1,2 having count(*)>1 order by n desc, 1, 2 limit 5")
def c2_samples(spark, sf):
    return qu.duplicate_samples(feature_table(spark, sf))


@query("c3_temporal_consistency", f"with {FEAT} {checks_sql(TEMPORAL)}")
def c3(spark, sf):
    return qu.validate_temporal_consistency(feature_table(spark, sf))


@query("c4_feature_ranges", f"with {FEAT} {checks_sql(RANGES)}")
def c4(spark, sf):
    return qu.validate_feature_ranges(feature_table(spark, sf))


@query("c5_business_logic", f"with {FEAT} {checks_sql(BUSINESS)}")
def c5(spark, sf):
    return qu.validate_business_logic(feature_table(spark, sf))


@query("c6_data_leakage", f"with {FEAT} {checks_sql(LEAKAGE)}")
def c6(spark, sf):
    return qu.detect_data_leakage(feature_table(spark, sf))


@query("c7_feature_distributions", f"with {FEAT} {DIST}")
def c7(spark, sf):
    return qu.validate_feature_distributions(feature_table(spark, sf))


OVERVIEW = f"""select 'rows' metric, '' as key, count(*) as value from feat union all select 'persons', '', count(distinct person_composite_id) from feat
 union all select 'columns', '', {len(COLUMNS)} union all select 'split', dataset_split, count(*) from feat group by dataset_split
 union all select 'vantage', cast(vantage_date as varchar), count(*) from feat group by vantage_date"""


@query("d1_overview", f"with {FEAT} {OVERVIEW}")
def d1(spark, sf):
    return de.overview(feature_table(spark, sf))


def rate(c):
    return f"100*(select count(*)-count({c}) from feat)/cast((select count(*) from feat) as double)"


COVER = " union all ".join(
    f"""select '{g}' feature_group, cast({len(fs)} as bigint) total_features, cast({len([f for f in fs if f in COLUMNS])} as bigint) available_features,
 round({100 * len([f for f in fs if f in COLUMNS]) / len(fs)!r},6) coverage_percentage, ({' + '.join(['0.0'] + [rate(f) for f in fs if f in COLUMNS])})/{max(1, len([f for f in fs if f in COLUMNS]))} avg_null_rate"""
    for g, fs in FEATURE_GROUPS.items())


@query("d2_group_coverage", f"with {FEAT} select feature_group, total_features, available_features, coverage_percentage, round(avg_null_rate,6) avg_null_rate from ({COVER})")
def d2(spark, sf):
    return tidy(de.group_coverage(feature_table(spark, sf)))


CELLS = " union all ".join(f"select '{c}' column_name, count(*) n_rows, count(*)-count({c}) n_null from feat" for c in COLUMNS)


@query("d3_quality_metrics", f"""with {FEAT}, cells as ({CELLS})
select cast(sum(n_rows) as bigint) total_cells, cast(sum(n_null) as bigint) total_nulls, count(*) filter (where n_null>n_rows*0.5) high_null_columns, 1 zero_variance_columns,
 round(100*sum(n_null)/cast(sum(n_rows) as double),6) overall_null_rate, round(100-100*sum(n_null)/cast(sum(n_rows) as double),6) quality_score from cells""")
def d3(spark, sf):
    return tidy(de.quality_metrics(feature_table(spark, sf)))


NUM_LONG = " union all ".join(f"select '{c}' column_name, cast({c} as double) v from feat" for c in NUMS)
PCT = ", ".join(f"round(quantile_cont(v,{p}),6) {n}" for n, p in de.PERCENTILES.items())


@query("d4_numeric_distributions", f"""with {FEAT}, l as ({NUM_LONG}) select column_name, count(v) n, round(avg(v),6) mean, round(stddev_samp(v),6) std, round(min(v),6) as min, round(max(v),6) as max, {PCT} from l group by column_name""")
def d4(spark, sf):
    return tidy(de.numeric_distributions(feature_table(spark, sf)))


TEXT_LONG = " union all ".join(f"select '{c}' column_name, {c} as value from feat" for c in TEXTS)


@query("d4_top_categories", f"""with {FEAT}, l as ({TEXT_LONG}), n as (select column_name, value, count(*) n from l group by 1,2),
r as (select *, row_number() over (partition by column_name order by n desc, value nulls first) rank, count(*) over (partition by column_name) n_distinct from n)
select * from r where rank<=10""")
def d4_text(spark, sf):
    return de.top_categories(feature_table(spark, sf))


@query("d5_temporal_patterns", f"""with {FEAT} select 'vantage_split' metric, cast(vantage_date as varchar) || '/' || dataset_split as key, cast(count(*) as double) as value from feat group by vantage_date, dataset_split
union all select 'events', event_indicator_all || '/' || event_indicator_vol, count(*) from feat group by event_indicator_all, event_indicator_vol
union all select 'survival_time', k, round(v,6) from (select count(survival_time_days) n, avg(survival_time_days) mean, stddev_samp(survival_time_days) std, min(survival_time_days) mn, max(survival_time_days) mx from feat) s,
 lateral (values ('n',cast(n as double)),('mean',mean),('std',std),('min',mn),('max',mx)) t(k,v)""")
def d5(spark, sf):
    return tidy(de.temporal_patterns(feature_table(spark, sf)))


@query("d6_business_counts", f"""with {FEAT} select 'invalid_ages' metric, count(*) n_bad from feat where age_at_vantage<16 or age_at_vantage>100
union all select 'invalid_salaries', count(*) from feat where baseline_salary<10000 or baseline_salary>1000000
union all select 'invalid_tenure', count(*) from feat where tenure_at_vantage_days<0 or tenure_at_vantage_days>18250""")
def d6(spark, sf):
    return de.business_counts(feature_table(spark, sf))


def complete_sql(by):
    return " union all ".join(f"""select '{by}' dimension, cast({by} as varchar) as key, '{c}' column_name, count(*) n_rows, round(100*count({c})/cast(count(*) as double),6) completeness from feat group by {by}""" for c in COLUMNS if c != by)


@query("d7_completeness", f"with {FEAT} {complete_sql('dataset_split')} union all {complete_sql('vantage_date')}")
def d7(spark, sf):
    f = feature_table(spark, sf)
    return tidy(de.completeness(f, "dataset_split").unionByName(de.completeness(f, "vantage_date")))


RULED = [c for c in NUMS if c in FEATURE_RULES]
RULED_LONG = " union all ".join(f"select '{c}' column_name, cast({c} as double) v from feat" for c in RULED)


@query("d8_outliers", f"""with {FEAT}, l as ({RULED_LONG}), q as (select column_name, quantile_cont(v,0.25) q1, quantile_cont(v,0.75) q3, avg(v) mean, stddev_samp(v) std from l group by 1)
select column_name, round(q1,6) q1, round(q3,6) q3, round(q3-q1,6) iqr, round(q1-1.5*(q3-q1),6) lower_bound, round(q3+1.5*(q3-q1),6) upper_bound, round(any_value(mean),6) mean, round(any_value(std),6) std,
 count(*) filter (where v<q1-1.5*(q3-q1) or v>q3+1.5*(q3-q1)) outlier_count, round(100*count(*) filter (where v<q1-1.5*(q3-q1) or v>q3+1.5*(q3-q1))/cast(count(*) as double),6) outlier_percentage
from l join q using (column_name) group by column_name, q1, q3""")
def d8(spark, sf):
    return tidy(de.outliers(feature_table(spark, sf)))


@query("d9_correlations", """with li as (select l_quantity, l_extendedprice, l_discount, l_tax, cast(l_linenumber as double) l_linenumber, l_quantity*3+l_linenumber twin from lineitem),
p as (""" + " union all ".join(f"select '{a}' feature1, '{b}' feature2, abs(corr({a},{b})) correlation from li" for i, a in enumerate(
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "twin"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "twin"][i + 1:]) +
       ") select feature1, feature2, round(correlation,6) correlation from p where correlation>0.8")
def d9(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    li = li.withColumn("l_linenumber", F.col("l_linenumber").cast("double")).withColumn("twin", F.col("l_quantity") * 3 + F.col("l_linenumber"))
    return tidy(de.correlations(li))


def profile_sql():
    rows = []
    for c in COLUMNS:
        num, text = c in NUMS, c in TEXTS or c == "person_composite_id"
        rows.append(f"""select '{c}' column_name, '{group_of(c)}' feature_group, {str(c in CRITICAL_FEATURES).lower()} is_critical, {str(c in FEATURE_RULES).lower()} has_validation_rules,
 count(*) n_rows, count(*)-count({c}) n_null, count({c}) n_filled, round(100*(count(*)-count({c}))/cast(count(*) as double),6) null_percentage,
 {f'round(cast(min({c}) as double),6)' if num else 'null'} as min, {f'round(cast(max({c}) as double),6)' if num else 'null'} as max, {f'round(avg({c}),6)' if num else 'null'} mean, {f'round(stddev_samp({c}),6)' if num else 'null'} std,
 {f'count(distinct {c})' if text else 'null'} n_distinct, {f'round(count(distinct {c})/cast(count({c}) as double),6)' if text else 'null'} cardinality from feat""")
    return " union all ".join(rows)


@query("d10_feature_profile", f"with {FEAT} {profile_sql()}")
def d10(spark, sf):
    return tidy(de.feature_profile(feature_table(spark, sf)).drop("data_type"))


@query("d11_dashboard_split_metrics", f"with {FEAT} select dataset_split, count(*) record_count, count(distinct person_composite_id) unique_persons from feat group by 1")
def d11(spark, sf):
    return de.dashboard(feature_table(spark, sf))["split_metrics"]


NULLS = " union all ".join(f"select '{c}' column_name, '{group_of(c)}' feature_group, round(100*(count(*)-count({c}))/cast(count(*) as double),6) null_percentage from feat" for c in COLUMNS)


@query("d11_dashboard_null_rates", f"with {FEAT} {NULLS}")
def d11_nulls(spark, sf):
    return tidy(de.dashboard(feature_table(spark, sf))["null_rates"])


@query("d12_describe_all")
def d12(spark, sf):
    return tidy(de.describe_all(feature_table(spark, sf)))


TRAIN = "dataset_split='train'"


def _train(f):
    return f.where(F.col("dataset_split") == "train")


def limits_sql(cols, lo, hi, wide):
    return ", ".join(f"quantile_cont({c},{lo})-{wide}*(quantile_cont({c},{hi})-quantile_cont({c},{lo})) {c}_lo, quantile_cont({c},{hi})+{wide}*(quantile_cont({c},{hi})-quantile_cont({c},{lo})) {c}_hi" for c in cols)


CAPS = ["baseline_salary", "age_at_vantage", "tenure_at_vantage_days", "team_size", "team_avg_comp"]
WINS = ["company_tenure_percentile", "team_avg_comp", "baseline_salary", "age_at_vantage"]


def clip_sql(cols, suffix):
    return ", ".join(f"round(case when {c} is not null then least(greatest(cast({c} as double),{c}_lo),{c}_hi) end,6) {c}{suffix}" for c in cols)


@query("e1_iqr_cap", f"with {FEAT}, q as (select {limits_sql(CAPS, 0.25, 0.75, 1.5)} from feat where {TRAIN}) select person_composite_id, vantage_date, {clip_sql(CAPS, '_cap')} from feat, q")
def e1(spark, sf):
    f = feature_table(spark, sf)
    out = prep.clip(f, prep.fit_limits(_train(f), CAPS, "iqr"), "_cap")
    return tidy(out.select(*ENTITY, *[f"{c}_cap" for c in CAPS]))


@query("e2_log_transform", f"with {FEAT} select person_composite_id, vantage_date, round(ln(1+tenure_at_vantage_days),6) tenure_at_vantage_days_log from feat")
def e2(spark, sf):
    return tidy(prep.add_logs(feature_table(spark, sf), ["tenure_at_vantage_days"]).select(*ENTITY, "tenure_at_vantage_days_log"))


@query("e3_winsorize", f"with {FEAT}, q as (select {limits_sql(WINS, 0.01, 0.99, 0)} from feat where {TRAIN}) select person_composite_id, vantage_date, {clip_sql(WINS, '_win_cap')} from feat, q")
def e3(spark, sf):
    f = feature_table(spark, sf)
    out = prep.clip(f, prep.fit_limits(_train(f), WINS, "winsor"), "_win_cap")
    return tidy(out.select(*ENTITY, *[f"{c}_win_cap" for c in WINS]))


CATS = ["career_stage", "full_tm_part_tm_cd", "reg_temp_cd", "flsa_stus_cd"]


def code_sql(c):
    return f"""{c}_t as (select coalesce({c},'MISSING') v, row_number() over (order by count(*) desc, coalesce({c},'MISSING')) code from feat where dataset_split='val' group by 1)"""


@query("e4_frequency_codes", f"""with {FEAT}, {', '.join(code_sql(c) for c in CATS)} select person_composite_id, vantage_date, {', '.join(f'cast(coalesce({c}_t.code,0) as integer) {c}_encoded' for c in CATS)}
from feat {' '.join(f"left join {c}_t on {c}_t.v=coalesce(feat.{c},'MISSING')" for c in CATS)}""")
def e4(spark, sf):
    f = feature_table(spark, sf)
    codes = prep.fit_codes(f.where(F.col("dataset_split") == "val"), CATS)
    return prep.encode(f, codes, CATS).select(*ENTITY, *[f"{c}_encoded" for c in CATS])


@query("e5_imputation", f"""with {FEAT}, m as (select quantile_cont(baseline_salary,0.5) s, quantile_cont(age_at_vantage,0.5) a from feat where {TRAIN}),
r as (select reg_temp_cd mr from feat where {TRAIN} and reg_temp_cd is not null group by 1 order by count(*) desc, 1 limit 1)
select person_composite_id, vantage_date, round(coalesce(baseline_salary,s),6) baseline_salary, round(coalesce(age_at_vantage,a),6) age_at_vantage, coalesce(reg_temp_cd,mr) reg_temp_cd from feat, m, r""")
def e5(spark, sf):
    f = feature_table(spark, sf)
    values = prep.fit_fill(_train(f), ["baseline_salary", "age_at_vantage"], ["reg_temp_cd"])
    return tidy(prep.fill(f, values).select(*ENTITY, "baseline_salary", "age_at_vantage", "reg_temp_cd"))


E6_CODE = f"""case_t as (select coalesce(career_stage,'MISSING') v, row_number() over (order by count(*) desc, coalesce(career_stage,'MISSING')) code from feat where {TRAIN} group by 1)"""


@query("e6_process_features", f"""with {FEAT}, q as (select {limits_sql(CAPS, 0.25, 0.75, 1.5)} from feat where {TRAIN}),
w as (select {', '.join(f'quantile_cont({c},0.01) {c}_wlo, quantile_cont({c},0.99) {c}_whi' for c in WINS)} from feat where {TRAIN}), {E6_CODE},
made as (select person_composite_id, vantage_date, dataset_split, career_stage, compensation_percentile_company, company_tenure_percentile, ln(1+tenure_at_vantage_days) tlog,
 {', '.join(f'case when {c} is not null then least(greatest(cast({c} as double),{c}_lo),{c}_hi) end {c}_cap' for c in CAPS)},
 {', '.join(f'case when {c} is not null then least(greatest(cast({c} as double),{c}_wlo),{c}_whi) end {c}_win_cap' for c in WINS)} from feat, q, w),
fills as (select {', '.join(f'quantile_cont({c},0.5) {c}_m' for c in ['company_tenure_percentile'] + [f'{x}_cap' for x in CAPS] + [f'{x}_win_cap' for x in WINS])} from made where {TRAIN})
select person_composite_id, vantage_date, round(compensation_percentile_company,6) compensation_percentile_company, round(coalesce(company_tenure_percentile,company_tenure_percentile_m),6) company_tenure_percentile,
 round(tlog,6) tenure_at_vantage_days_log, {', '.join(f'round(coalesce({c},{c}_m),6) {c}' for c in [f'{x}_cap' for x in CAPS] + [f'{x}_win_cap' for x in WINS])}, cast(coalesce(code,0) as integer) career_stage_encoded
from made cross join fills left join case_t on v=coalesce(career_stage,'MISSING')""")
def e6(spark, sf):
    f = feature_table(spark, sf)
    m = prep.fit_features(_train(f), CAPS, ["tenure_at_vantage_days"], WINS, prep.DIRECT, ["career_stage"])
    return tidy(m.transform(f).select(*ENTITY, *m.columns))


@query("e7_complete_cases", f"with {FEAT} select person_composite_id, vantage_date, survival_time_days, event_indicator_all from feat where baseline_salary is not null and age_at_vantage is not null and reg_temp_cd is not null")
def e7(spark, sf):
    return prep.complete_cases(feature_table(spark, sf), ["baseline_salary", "age_at_vantage", "reg_temp_cd"]).select(
        *ENTITY, "survival_time_days", "event_indicator_all")


@query("e8_lineage", f"""with {FEAT}, s(feature, source, step) as (values ('age_at_vantage_cap','age_at_vantage','iqr_cap'),('tenure_at_vantage_days_log','tenure_at_vantage_days','log_transform'),
('team_avg_comp_win_cap','team_avg_comp','winsorize'),('career_stage_encoded','career_stage','categorical_encoding')),
n as (select 'age_at_vantage' source, count(age_at_vantage) n_filled from feat union all select 'tenure_at_vantage_days', count(tenure_at_vantage_days) from feat union all select 'team_avg_comp', count(team_avg_comp) from feat union all select 'career_stage', count(career_stage) from feat)
select feature, source, step, n_filled from s join n using (source)""")
def e8(spark, sf):
    f = feature_table(spark, sf)
    m = prep.FeatureModel(caps={"age_at_vantage": (0, 1)}, winsors={"team_avg_comp": (0, 1)}, logs=["tenure_at_vantage_days"], codes={"career_stage": {}})
    filled = qu.null_counts(f).select(F.col("column_name").alias("source"), (F.col("n_rows") - F.col("n_null")).alias("n_filled"))
    return m.lineage(spark).join(filled, "source")


@query("e9_naics_2digit", f"with {fx.BASE} select substr(naics_cd,1,2) naics_2digit, count(*) n from base group by 1")
def e9(spark, sf):
    return prep.naics_2digit(fx.base(spark, sf)).groupBy("naics_2digit").agg(F.count(F.lit(1)).alias("n"))


@query("a8_column_gate", f"with {fx.BASE} select person_composite_id, vantage_date, 0.0 missing_gate, team_avg_comp*2 present_gate from base")
def a8(spark, sf):
    b = fx.base(spark, sf)
    out = or_constant(b, [(b, ["no_such_column"])], "missing_gate", 0.0, lambda d: d.withColumn("missing_gate", F.col("no_such_column")))
    out = or_constant(out, [(b, ["team_avg_comp"])], "present_gate", 0.0, lambda d: d.withColumn("present_gate", F.col("team_avg_comp") * 2))
    return out.select(*ENTITY, "missing_gate", "present_gate")
