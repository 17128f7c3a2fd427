"""The feature build: an ordered list of DataFrame steps over shared sources."""
from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tenurelens.operators import events as ev
from tenurelens.operators import external as ex
from tenurelens.operators import history as hi
from tenurelens.operators import profile as pr
from tenurelens.operators.run_summary import PARTS, history_summary
from tenurelens.schema import ENTITY
from tenurelens.sources import keys

log = logging.getLogger(__name__)


@dataclass
class Sources:
    """Input tables; the optional ones fall back to constants where absent."""
    base: DataFrame
    history: DataFrame
    leavers: DataFrame
    events: DataFrame
    places: DataFrame | None = None
    snapshots: DataFrame | None = None
    regions: DataFrame | None = None
    cpi: DataFrame | None = None
    flsa: DataFrame | None = None
    people: DataFrame | None = None
    geocodes: DataFrame | None = None
    income: DataFrame | None = None
    month: str = "202301"


#: What the groups take from the history.
FROM_HISTORY = ["pay", "frequency", "job", "manager", "assignment", "location", "place"]


def with_history(base: DataFrame, history: DataFrame, places: DataFrame | None, strict=True) -> DataFrame:
    """``base`` with everything that the groups need of the history, from one pass over it.

    Unless ``strict``, parts whose columns the history lacks are left out; the groups that need them fail then on their own.
    """
    parts = FROM_HISTORY if strict else [p for p in FROM_HISTORY if set(PARTS[p]) <= set(history.columns)]
    found = history_summary(history, parts, places)
    return hi.attach(base, own_stage(found.drop("salary_0d_ago", "salary_365d_ago", "pay_freq_diversity_score"), 0))


#: Groups joined by the same tasks.
TOGETHER = 3


def own_stage(df: DataFrame, turn: int) -> DataFrame:
    """Dealt by entity again, so that what follows runs in tasks of its own: every sorted join holds memory until its task ends.

    ``turn`` changes the order of the key: Spark leaves out a shuffle to the partitioning that the rows have already.
    """
    return df.repartition(*(ENTITY if turn % 2 else ENTITY[::-1]))


def steps(s: Sources, base: DataFrame):
    """Feature groups in build order, each a function of the growing entity table, which holds the history's columns.

    Group statistics and lookups start from ``base``, not from the growing table,
    so the plan grows by one branch per step.
    """
    return [
        ("compensation", lambda d: hi.add_compensation_features(d, None, base)),
        ("demographic", pr.add_demographic_features),
        ("job", lambda d: pr.add_job_characteristics_features(d, s.leavers, base)),
        ("manager", lambda d: pr.add_manager_environment_features(d, None, s.snapshots, base)),
        ("team", lambda d: pr.add_team_environment_features(d, s.leavers, base)),
        ("tenure", lambda d: hi.add_tenure_dynamics_features(d, None, base)),
        ("work patterns", lambda d: hi.add_work_patterns_features(d, None, s.places)),
        ("company", lambda d: pr.add_company_factors_features(d, base)),
        ("temporal", pr.add_temporal_features),
        # career, promotion and job-change events share one join and one aggregation
        ("events", lambda d: ev.add_event_features(d, s.events, base)),
        ("price index", lambda d: ex.salary_growth_to_cpi(d, s.places, s.regions, s.cpi, base)),
        ("flsa", lambda d: ex.normalized_flsa(d, s.flsa, base)),
        ("neighborhood", lambda d: ex.neighborhood_salary_ratio(d, s.people, s.geocodes, s.income, s.month, base)),
    ]


def build_features(s: Sources, strict=True, sample_ids=None, normalize=True) -> DataFrame:
    """All feature groups on the filtered snapshot; client and schema are parsed from the id first.

    With ``strict=False`` a group that Spark cannot resolve (missing columns) is
    left out with a warning and the others are built.
    """
    base = keys.parse_composite_id(keys.source_filter(s.base, sample_ids))
    history = keys.restrict_to(s.history, base)
    df = with_history(base, history, s.places, strict)
    for i, (name, step) in enumerate(steps(s, base)):
        try:
            df = (own_stage(df, i // TOGETHER) if i and i % TOGETHER == 0 else df).transform(step)
        except AnalysisException as e:
            if strict:
                raise
            log.warning("feature group %s left out: %s", name, e)
    return ex.normalize(df) if normalize else df


def build_in_units(s: Sources, folder: str, sample_ids=None, normalize=True) -> tuple[DataFrame, dict[str, str]]:
    """As ``build_features``, with every group written on its own to ``folder``; returns the features and what went wrong by group.

    A group that fails, while it is planned or in a task, is left out with a warning.  A group whose files are complete isn't
    computed again, so a build that was broken off goes on where it ended.  The parts of the history are units too.  At the end
    the finished groups are joined on the entity key.
    """
    spark = s.base.sparkSession
    base = keys.parse_composite_id(keys.source_filter(s.base, sample_ids))
    history, failed = keys.restrict_to(s.history, base), {}

    def unit(name, make):
        """The unit's columns, from its files where they are complete."""
        path = f"{folder.rstrip('/')}/{name.replace(' ', '_')}"
        try:
            if not finished(spark, path):
                make().write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)
        except Exception as e:  # whatever a group's own code or data raises must not end the build
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"
            log.warning("feature group %s left out: %s", name, failed[name])

    df, made, plain = base, [], []
    for part in FROM_HISTORY:
        if part != "place" or s.places is not None:
            found = unit(f"history {part}", lambda p=part: history_summary(history, [p], s.places).drop("salary_0d_ago", "salary_365d_ago", "pay_freq_diversity_score"))
            if found is not None:
                df = hi.attach(df, found)
                plain.append(found.drop(*[c for cs in DERIVED.values() for c in cs]))
    for name, step in steps(s, base):
        def own(step=step, filled=DERIVED.get(name, [])):
            out = df.transform(step)
            return out.select(*ENTITY, *[c for c in out.columns if c not in df.columns or c in filled])
        found = unit(name, own)
        if found is not None:
            made.append(found)
    out = base
    for found in plain + made:
        out = out.drop(*[c for c in found.columns if c not in ENTITY]).join(found, ENTITY, "left")
    return (ex.normalize(out) if normalize else out), failed


#: Columns of the history that a group fills where they are missing.
DERIVED = {"compensation": ["salary_growth_rate_12m", "compensation_volatility", "pay_grade_stagnation_months"], "manager": ["manager_changes_count"],
           "tenure": ["tenure_in_current_role"], "work patterns": ["assignment_frequency_12m", "work_location_changes_count", "num_city_chng", "num_state_chng"]}


def finished(spark, path: str) -> bool:
    """Whether a write to ``path`` was completed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def build_first_version(s: Sources) -> DataFrame:
    """Incremental build of the first version: calendar-month windows, strict event dates.

    Negative ages become null; people without events keep nulls in the event columns.
    """
    base = s.base.where(F.col("work_loc_cntry_cd").isin(keys.COUNTRIES))
    df = pr.add_demographic_features(base)
    df = df.withColumn("age_at_vantage", F.when(F.col("age_at_vantage") >= 0, F.col("age_at_vantage")))
    three_codes = s.events.where(F.col("event_cd").isin(ev.PROMOTION, ev.DEMOTION, ev.TRANSFER))
    df = hi.attach(df, ev.event_counts_24_months(base, three_codes))
    df = hi.attach(df, ev.reason_indicators(base, three_codes))
    df = hi.attach(df, ev.promotion_time_features(base, three_codes))
    df = hi.add_work_patterns_features(df, s.history, s.places)
    df = hi.attach(df, hi.tenure_percentile_features(base, industry=True))
    df = hi.attach(df, hi.manager_changes(s.history, bounded=False, out="distinct_managers"))
    if s.snapshots is not None:
        df = pr.manager_indicator(df, s.snapshots, missing=0, source=base)
    return ev.add_job_change_event_features(df, s.events, mode="months", source=base)
