"""Base tables and keys: composite ids, source filters, key dimensions, snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurelens.functions.scale import by_shuffle
from tenurelens.schema import ENTITY, PERSON, VANTAGE

# fixed values: countries covered, placeholder managers, vantage date of each split and snapshot month
COUNTRIES = ["USA", "CAN"]
NO_MANAGER = ["UNKNOWN", "ONE", "", "0"]
SPLIT_VANTAGE = {"train": "2023-01-01", "val": "2023-01-01", "oot": "2024-01-01"}
SNAPSHOT_VANTAGE = {"202301": "2023-01-01", "202401": "2024-01-01"}

EVENT_SCHEMA = T.StructType([T.StructField(PERSON, T.StringType()), T.StructField("event_cd", T.StringType()),
                             T.StructField("event_rsn_cd", T.StringType()), T.StructField("event_eff_dt", T.DateType())])


def composite_id(schema="db_schema", client="clnt_obj_id", person="pers_obj_id") -> Column:
    return F.concat_ws("_", schema, client, person)


def parse_composite_id(df: DataFrame, column: str = PERSON) -> DataFrame:
    """Split an id from its end: last token person, last but one client, the rest schema."""
    parts = F.split(F.col(column), "_")
    return df.withColumns({
        "employee_id": F.try_element_at(parts, F.lit(-1)),
        "clnt_obj_id": F.try_element_at(parts, F.lit(-2)),
        "db_schema": F.concat_ws("_", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0)))),
    })


def source_filter(df: DataFrame, sample_ids=None) -> DataFrame:
    """Snapshot rows of covered countries under a real manager; optionally chosen people."""
    out = df.where(F.col("work_loc_cntry_cd").isin(COUNTRIES) & ~F.col("mngr_pers_obj_id").isin(NO_MANAGER))
    return out.where(F.col(PERSON).isin(sample_ids)) if sample_ids else out


def restrict_to(history: DataFrame, df: DataFrame, on=ENTITY) -> DataFrame:
    """History of the people in ``df`` only."""
    return history.join(by_shuffle(df.select(*on)), list(on), "left_semi")


def with_vantage_by_split(cleaned: DataFrame, splits: DataFrame, vantage=None) -> DataFrame:
    """Attach the split and its vantage date; unknown splits get a null date."""
    when = F.lit(None).cast("date")
    for name, day in (vantage or SPLIT_VANTAGE).items():
        when = F.when(F.col("dataset_split") == name, F.lit(day).cast("date")).otherwise(when)
    return cleaned.join(splits.select(PERSON, "dataset_split"), PERSON).withColumn(VANTAGE, when)


def event_table(spark: SparkSession, facts: DataFrame | None, dimension: DataFrame | None) -> DataFrame:
    """Events with composite id and descriptions; an empty typed frame without facts."""
    if facts is None:
        return spark.createDataFrame([], EVENT_SCHEMA)
    keys = ["clnt_obj_id", "db_schema", "event_cd", "event_rsn_cd"]
    out = facts.withColumn(PERSON, composite_id())
    return out if dimension is None else out.join(
        dimension.select(*keys, "event_dsc", "event_rsn_dsc"), keys, "left")


def unique_key_rows(df: DataFrame, keys) -> DataFrame:
    """Rows whose key occurs exactly once; one aggregation, no join back."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    return g.where(F.col("_n") == 1).drop("_n").select(*df.columns)


def first_per_key(df: DataFrame, keys, order: str, tiebreak=()) -> DataFrame:
    """One row per key, the smallest ``order`` with nulls last; aggregated, not sorted."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    # a null flag in front puts null orders last
    rank = F.struct(F.col(order).isNull().alias("_isnull"), F.col(order),
                    *[F.col(c) for c in tiebreak], *[F.col(c) for c in rest if c != order and c not in tiebreak])
    best = df.groupBy(*keys).agg(F.min(rank).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*df.columns)


def yearly_snapshots(df: DataFrame, keys=("aoid", "ooid"), month="yyyymm", order="source_hr", months=None) -> DataFrame:
    """Snapshot months of interest in one scan, dated, one row per key and vantage."""
    months = months or SNAPSHOT_VANTAGE
    day = F.lit(None).cast("date")
    for m, d in months.items():
        day = F.when(F.col(month) == m, F.lit(d).cast("date")).otherwise(day)
    dated = df.where(F.col(month).isin(list(months))).withColumn(VANTAGE, day).drop(month)
    return first_per_key(dated, [*keys, VANTAGE], order)
