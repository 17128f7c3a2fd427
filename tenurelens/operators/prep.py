"""Model inputs: capping, logs, winsorising, category codes, imputation; fit on train, apply anywhere."""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurelens.functions.scale import column_quantiles, column_value_counts, range_ranks
from tenurelens.operators.quality import numeric_columns

# fixed values: columns per transformation
CAP = ["baseline_salary", "salary_growth_rate_12m", "peer_salary_ratio", "compensation_volatility", "age_at_vantage",
       "tenure_at_vantage_days", "time_with_current_manager", "tenure_in_current_role", "team_size", "team_avg_comp"]
LOG = ["role_complexity_score", "tenure_in_current_role", "tenure_at_vantage_days", "compensation_volatility",
       "time_with_current_manager", "pay_grade_stagnation_months"]
WINSOR = ["company_tenure_percentile", "team_avg_turn_days", "team_avg_comp", "peer_salary_ratio", "baseline_salary",
          "salary_growth_rate_12m", "age_at_vantage", "pay_grade_stagnation_months"]
DIRECT = ["compensation_percentile_company", "company_tenure_percentile"]
CATEGORY = ["pay_rate_type_cd", "career_stage", "generation_cohort", "gender_cd", "hire_date_seasonality", "full_tm_part_tm_cd",
            "reg_temp_cd", "flsa_stus_cd", "fscl_actv_ind", "company_size_tier", "naics_2digit"]
MISSING = "MISSING"


def naics_2digit(df: DataFrame) -> DataFrame:
    return df.withColumn("naics_2digit", F.substring("naics_cd", 1, 2))


def complete_cases(df: DataFrame, features, targets=("survival_time_days", "event_indicator_all")) -> DataFrame:
    """Rows without a null in features or targets."""
    use = [*features, *targets]
    return df.na.drop(subset=use)


def fit_limits(train: DataFrame, columns, kind: str) -> dict:
    """Clip limits per column: Tukey fences (``iqr``) or 1st and 99th percentile (``winsor``)."""
    lo, hi = (0.25, 0.75) if kind == "iqr" else (0.01, 0.99)
    if not columns:
        return {}
    q = column_quantiles(train, columns, {"lo": lo, "hi": hi}).collect()
    wide = 1.5 if kind == "iqr" else 0.0
    return {r["column_name"]: (r["lo"] - wide * (r["hi"] - r["lo"]), r["hi"] + wide * (r["hi"] - r["lo"])) for r in q}


def clip(df: DataFrame, limits: dict, suffix: str) -> DataFrame:
    """Add ``<column><suffix>`` clipped to its limits; null stays null."""
    def c(name, lo, hi):
        v = F.col(name).cast("double")
        return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
    return df.withColumns({f"{n}{suffix}": c(n, *ab) for n, ab in limits.items()}) if limits else df


def add_logs(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log1p(F.col(c).cast("double")) for c in columns}) if columns else df


def fit_codes(train: DataFrame, columns) -> DataFrame:
    """Code table (column, value, code): most frequent value 1, ties by value; null is MISSING."""
    filled = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns])
    ranked = range_ranks(column_value_counts(filled, columns), ["column_name"], [F.desc("n"), F.asc("value")], "code")
    return ranked.select("column_name", "value", "n", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, columns) -> DataFrame:
    """Add ``<column>_encoded``; unseen values get 0.  One join per column on the code table."""
    out = df
    for c in columns:
        table = codes.where(F.col("column_name") == c).select(F.col("value").alias("_v"), F.col("code").alias(f"{c}_encoded"))
        out = out.withColumn("_v", F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).join(table, "_v", "left").drop("_v")
        out = out.withColumn(f"{c}_encoded", F.coalesce(f"{c}_encoded", F.lit(0)))
    return out


def fit_fill(train: DataFrame, numeric=(), text=()) -> dict:
    """Fill values: median of numeric columns, most frequent (then smallest) value of text columns."""
    out = {}
    if numeric:
        for r in column_quantiles(train, list(numeric), {"m": 0.5}).collect():
            out[r["column_name"]] = r["m"]
        out.update({c: 0.0 for c in numeric if out.get(c) is None})
    if text:
        n = column_value_counts(train, list(text)).where(F.col("value").isNotNull())
        # highest count, smallest text
        best = n.groupBy("column_name").agg(F.max("n").alias("n")).join(n, ["column_name", "n"]).groupBy("column_name").agg(F.min("value").alias("m"))
        out.update({r["column_name"]: r["m"] for r in best.collect()})
    return out


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}) if values else df


@dataclass
class FeatureModel:
    """Fitted parameters, saved as JSON text.

    Codes of a column with very many values stay in ``code_table`` (column, value, code),
    which is joined and not part of the text.
    """
    caps: dict = field(default_factory=dict)
    winsors: dict = field(default_factory=dict)
    logs: list = field(default_factory=list)
    codes: dict = field(default_factory=dict)
    fills: dict = field(default_factory=dict)
    direct: list = field(default_factory=list)
    joined: list = field(default_factory=list)
    code_table: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def columns(self):
        made = [f"{c}_cap" for c in self.caps] + [f"{c}_log" for c in self.logs] + [f"{c}_win_cap" for c in self.winsors]
        return self.direct + made + [f"{c}_encoded" for c in [*self.codes, *self.joined]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = clip(df, self.caps, "_cap")
        out = add_logs(out, self.logs)
        out = clip(out, self.winsors, "_win_cap")
        if self.codes:
            lookup = {}
            for c, table in self.codes.items():
                value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
                # a literal map keeps encoding inside the projection
                pairs = [F.lit(x) for kv in table.items() for x in kv]
                lookup[f"{c}_encoded"] = F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(0))
            out = out.withColumns(lookup)
        if self.joined:
            if self.code_table is None:
                raise ValueError("set code_table for the columns " + ", ".join(self.joined))
            out = encode(out, self.code_table, self.joined)
        return fill(out, self.fills)

    def lineage(self, spark: SparkSession) -> DataFrame:
        """Output column, source column and step."""
        rows = [(c, c, "direct") for c in self.direct] + [(f"{c}_cap", c, "iqr_cap") for c in self.caps] + [
            (f"{c}_log", c, "log_transform") for c in self.logs] + [(f"{c}_win_cap", c, "winsorize") for c in self.winsors] + [
            (f"{c}_encoded", c, "categorical_encoding") for c in [*self.codes, *self.joined]]
        return spark.createDataFrame(rows, "feature string, source string, step string")

    def to_json(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("caps", "winsors", "logs", "codes", "fills", "direct", "joined")})

    @staticmethod
    def from_json(text: str) -> "FeatureModel":
        return FeatureModel(**json.loads(text))


def fit_features(train: DataFrame, cap=CAP, log=LOG, winsor=WINSOR, direct=DIRECT, category=CATEGORY, most_literals=1000) -> FeatureModel:
    """Learn all parameters from the training rows.

    Codes of columns with up to ``most_literals`` values become literals; the others are
    joined from the code table.  The codes are the same.
    """
    nums, has = numeric_columns(train), train.columns
    pick = lambda names: [c for c in names if c in nums]
    cats = [c for c in category if c in has]
    codes, joined, table = {}, [], None
    if cats:
        table = fit_codes(train, cats)
        rows = table.where(F.col("code") <= most_literals + 1).collect()
        joined = sorted({r["column_name"] for r in rows if r["code"] > most_literals}, key=cats.index)
        codes = {c: {r["value"]: r["code"] for r in rows if r["column_name"] == c} for c in cats if c not in joined}
    m = FeatureModel(fit_limits(train, pick(cap), "iqr"), fit_limits(train, pick(winsor), "winsor"), pick(log), codes, {},
                     [c for c in direct if c in has], joined, table if joined else None)
    made = m.transform(train)
    m.fills = fit_fill(made, [c for c in m.columns if not c.endswith("_encoded")])
    return m
