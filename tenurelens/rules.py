"""Feature groups and validation rules."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    minimum: float | None
    maximum: float | None
    allow_null: bool
    values: tuple = ()


# fixed values: the features of each group
FEATURE_GROUPS = {
    "compensation": [
        "baseline_salary",
        "salary_growth_rate_12m",
        "compensation_percentile_company",
        "compensation_percentile_industry",
        "compensation_volatility",
        "pay_grade_stagnation_months",
        "pay_frequency_preference",
        "comp_chang_freq_per_year",
        "avg_salary_last_quarter",
        "pay_freq_consistency_score",
    ],
    "career_progression": [
        "time_since_last_promotion",
        "promotion_velocity",
        "promot_2yr_ind",
        "demot_2yr_ind",
        "transfer_2yr_ind",
        "num_promot_2yr",
        "num_demot_2yr",
        "num_transfer_2yr",
        "promot_2yr_perf_ind",
        "promot_2yr_titlechng_ind",
        "promot_2yr_mktadjst_ind",
        "demot_2yr_compreorg_ind",
        "demot_2yr_perfissue_ind",
        "days_since_promot",
        "days_since_transfer",
        "promot_veloc",
        "promot_rt",
    ],
    "demographic": [
        "age_at_vantage",
        "gender_cd",
        "career_stage",
        "retirement_eligibility_years",
        "generation_cohort",
        "tenure_age_ratio",
        "career_joiner_stage",
        "tenure_age_risk",
    ],
    "job_characteristics": [
        "job_level",
        "job_family_turnover_rate",
        "flsa_stus_cd",
        "full_tm_part_tm_cd",
        "reg_temp_cd",
        "role_complexity_score",
        "job_stability_ind",
        "flsa_status_desc",
    ],
    "manager_environment": [
        "time_with_current_manager",
        "manager_tenure_days",
        "manager_span_control",
        "manager_changes_count",
        "is_manager_ind",
    ],
    "team_environment": [
        "team_size",
        "team_turnover_rate",
        "team_avg_tnur_days",
        "peer_salary_ratio",
        "team_avg_comp",
    ],
    "tenure_dynamics": [
        "tenure_at_vantage_days",
        "tenure_in_current_role",
        "company_tenure_percentile",
    ],
    "work_patterns": [
        "assignment_frequency_12m",
        "work_location_changes_count",
        "num_city_chng",
        "num_state_chng",
    ],
    "company_factors": [
        "naics_cd",
        "company_size_tier",
        "fscl_actv_ind",
    ],
    "temporal": [
        "hire_date_seasonality",
        "fiscal_year_effect",
        "quarter_effect",
    ],
    "job_change_events": [
        "job_chng_2yr_ind",
        "num_job_chng_2yr",
        "job_chng_fulltopart_ind",
        "job_chng_nexmptoexmp_ind",
    ],
    "external": [
        "salary_growth_rate12m_to_cpi_rate",
        "sal_nghb_ratio",
    ],
    "targets": [
        "survival_time_days",
        "event_indicator_all",
        "event_indicator_vol",
    ],
}
# fixed values: minimum, maximum, whether null is allowed, allowed values
FEATURE_RULES = {
    "baseline_salary": Rule(0, 1000000, False),
    "salary_growth_rate_12m": Rule(-1, 5, True),
    "compensation_percentile_company": Rule(0, 1, True),
    "compensation_percentile_industry": Rule(0, 1, True),
    "compensation_volatility": Rule(0, None, True),
    "pay_grade_stagnation_months": Rule(0, 600, True),
    "pay_frequency_preference": Rule(0, 2, False),
    "comp_chang_freq_per_year": Rule(0, 24, True),
    "avg_salary_last_quarter": Rule(0, None, True),
    "pay_freq_consistency_score": Rule(0, 1, True),
    "time_since_last_promotion": Rule(0, 10000, True),
    "promotion_velocity": Rule(0, None, True),
    "promot_2yr_ind": Rule(0, 1, False),
    "demot_2yr_ind": Rule(0, 1, False),
    "transfer_2yr_ind": Rule(0, 1, False),
    "num_promot_2yr": Rule(0, 20, False),
    "num_demot_2yr": Rule(0, 20, False),
    "num_transfer_2yr": Rule(0, 20, False),
    "promot_2yr_perf_ind": Rule(0, 1, False),
    "promot_2yr_titlechng_ind": Rule(0, 1, False),
    "promot_2yr_mktadjst_ind": Rule(0, 1, False),
    "demot_2yr_compreorg_ind": Rule(0, 1, False),
    "demot_2yr_perfissue_ind": Rule(0, 1, False),
    "days_since_promot": Rule(0, 10000, True),
    "days_since_transfer": Rule(0, 10000, True),
    "promot_veloc": Rule(0, None, True),
    "promot_rt": Rule(0, 1, True),
    "age_at_vantage": Rule(16, 100, True),
    "career_stage": Rule(None, None, True, ("Early", "Mid", "Late", "Senior")),
    "retirement_eligibility_years": Rule(0, 50, True),
    "generation_cohort": Rule(None, None, True, ("Gen Z", "Millennial", "Gen X", "Baby Boomer", "Silent Generation")),
    "tenure_age_ratio": Rule(0, 1, True),
    "career_joiner_stage": Rule(None, None, True, ("early_career", "mid_career_joiner", "late_career_joiner", "experienced_loyal", "other")),
    "tenure_age_risk": Rule(None, None, True, ("burnout_risk", "retirement_on_disengagement_risk", "normal")),
    "job_level": Rule(1, 10, True),
    "job_family_turnover_rate": Rule(0, 1, True),
    "role_complexity_score": Rule(1, 3, False),
    "job_stability_ind": Rule(0, 1, False),
    "flsa_status_desc": Rule(None, None, True, ("exempt", "non-exempt", "others")),
    "time_with_current_manager": Rule(0, 10000, True),
    "manager_tenure_days": Rule(0, 20000, True),
    "manager_span_control": Rule(0, 1000, True),
    "manager_changes_count": Rule(0, 20, False),
    "is_manager_ind": Rule(0, 1, True),
    "team_size": Rule(1, 1000, True),
    "team_turnover_rate": Rule(0, 1, True),
    "team_avg_tnur_days": Rule(0, 20000, True),
    "peer_salary_ratio": Rule(0.1, 10, True),
    "team_avg_comp": Rule(0, None, True),
    "tenure_at_vantage_days": Rule(0, 20000, False),
    "tenure_in_current_role": Rule(0, 20000, True),
    "company_tenure_percentile": Rule(1, 100, True),
    "assignment_frequency_12m": Rule(0, 50, False),
    "work_location_changes_count": Rule(0, 20, False),
    "num_city_chng": Rule(0, 20, False),
    "num_state_chng": Rule(0, 10, False),
    "company_size_tier": Rule(None, None, False, ("Small", "Medium", "Large", "Enterprise", "Unknown")),
    "job_chng_2yr_ind": Rule(0, 1, False),
    "num_job_chng_2yr": Rule(0, 20, False),
    "job_chng_fulltopart_ind": Rule(0, 1, False),
    "job_chng_nexmptoexmp_ind": Rule(0, 1, False),
    "salary_growth_rate12m_to_cpi_rate": Rule(-10, 10, True),
    "sal_nghb_ratio": Rule(0.1, 20, True),
    "survival_time_days": Rule(0, 365, False),
    "event_indicator_all": Rule(0, 1, False),
    "event_indicator_vol": Rule(0, 1, False),
}
# fixed values: features every table must have, and limits of the business checks
CRITICAL_FEATURES = ["person_composite_id", "vantage_date", "baseline_salary", "tenure_at_vantage_days", "age_at_vantage",
                     "job_level", "survival_time_days", "event_indicator_all"]
AGE_LIMITS, SALARY_LIMITS, MAX_TENURE_DAYS, MAX_SPAN = (16, 100), (10000, 1000000), 50 * 365, 1000


def group_of(name: str) -> str:
    return next((g for g, names in FEATURE_GROUPS.items() if name in names), "other")
