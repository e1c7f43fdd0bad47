"""Raw events -> unit x day panel, and its summary tables.

A panel is unique on (unit, day), so every group keyed by unit holds at most one
row per calendar day, and every group keyed by day one row per unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as fv
from panelwright.functions import clean


def type_log(raw: DataFrame) -> DataFrame:
    """Typed incidents from the all-string log."""
    c = F.col
    return raw.select(
        clean.parse_timestamp(c("incident_datetime")).alias("ts"),
        clean.to_int(c("communitydistrict")).alias("unit"),
        clean.tidy_code(c("final_call_type")).alias("code"),
        clean.tidy_code(c("incident_disposition_code")).alias("disposition"),
        clean.to_int(c("incident_disposition_code")).alias("disposition_no"),
        clean.tidy_flag(c("special_event_indicator")).alias("special"),
        clean.tidy_flag(c("standby_indicator")).alias("standby"),
        clean.tidy_flag(c("transfer_indicator")).alias("transfer"),
    )


def drop_excluded(typed: DataFrame) -> DataFrame:
    """Keep real incidents; unknown flags and dispositions are kept."""
    keep = F.col("ts").isNotNull()
    for flag in ("special", "standby", "transfer"):
        keep = keep & clean.not_in_set(F.col(flag), fv.TRUTHY)
    keep = keep & clean.not_in_set(F.col("disposition"), fv.VOID_DISPOSITIONS)
    keep = keep & clean.not_in_set(
        F.col("disposition_no"), (fv.VOID_DISPOSITION_NUMBER,)
    )
    return typed.where(keep)


def build_panel(events: DataFrame, unit: Column, day: Column, hit: Column) -> DataFrame:
    """Count events and hits per (day, unit).

    One shuffle of partial counts on (day, unit); a hot unit or day is folded
    on the map side.  The NULL unit keeps its own rows.
    """
    return (
        events.groupBy(day.alias("day"), unit.alias("unit"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(hit.cast("bigint")).alias("hits"),
        )
        .withColumn("share", clean.ratio(F.col("hits"), F.col("total")))
    )


def panel_from_log(raw: DataFrame) -> DataFrame:
    kept = drop_excluded(type_log(raw))
    return build_panel(
        kept, F.col("unit"), F.to_date("ts"), clean.in_set(F.col("code"), fv.HIT_CODES)
    )


def complete_share(panel: DataFrame, min_total: int = fv.MIN_TOTAL) -> DataFrame:
    """Rows with enough volume and a known share."""
    return panel.where((F.col("total") >= min_total) & F.col("share").isNotNull())


def unit_summary(panel: DataFrame) -> DataFrame:
    """One row per known unit; medians are over at most one row per day."""
    aggs = []
    for name in ("total", "hits"):
        aggs += [
            F.sum(name).alias(f"{name}_sum"),
            F.avg(name).alias(f"{name}_mean"),
            F.median(name).alias(f"{name}_median"),
            F.stddev_samp(name).alias(f"{name}_std"),
        ]
    aggs += [
        F.avg("share").alias("share_mean"),
        F.median("share").alias("share_median"),
        F.stddev_samp("share").alias("share_std"),
        F.min("day").alias("day_min"),
        F.max("day").alias("day_max"),
        F.count("day").alias("n_days"),
    ]
    return (
        panel.where(F.col("unit").isNotNull())
        .groupBy("unit")
        .agg(*aggs)
        .withColumn("share_overall", F.try_divide("hits_sum", "total_sum"))
    )


def day_summary(panel: DataFrame) -> DataFrame:
    """One row per day; the NULL unit adds to sums but is no unit of its own."""
    return (
        panel.groupBy("day")
        .agg(
            F.sum("total").alias("total"),
            F.sum("hits").alias("hits"),
            # (unit, day) is unique: distinct units are the rows with a unit.
            F.count("unit").alias("n_units"),
        )
        .withColumn("share", F.try_divide("hits", "total"))
        .withColumn("year", F.year("day"))
        .withColumn("month", F.month("day"))
    )


def year_summary(days: DataFrame) -> DataFrame:
    """Second level over :func:`day_summary`; at most 366 rows per year."""
    return (
        days.groupBy("year")
        .agg(
            F.sum("total").alias("total_sum"),
            F.avg("total").alias("total_mean"),
            F.median("total").alias("total_median"),
            F.sum("hits").alias("hits_sum"),
            F.avg("hits").alias("hits_mean"),
            F.median("hits").alias("hits_median"),
            F.avg("share").alias("share_mean"),
            F.median("share").alias("share_median"),
            F.count("day").alias("n_days"),
        )
        .withColumn("share_overall", F.try_divide("hits_sum", "total_sum"))
    )


def overall_summary(panel: DataFrame) -> DataFrame:
    """Totals and means over all panel rows (medians: see ``quantiles``)."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("total").alias("total_sum"),
        F.sum("hits").alias("hits_sum"),
        F.try_divide(F.sum("hits"), F.sum("total")).alias("share_overall"),
        F.avg("total").alias("total_mean"),
        F.avg("hits").alias("hits_mean"),
        F.avg("share").alias("share_mean"),
    )


def level_summary(panel: DataFrame) -> DataFrame:
    """Long table: one overall row and one row per year."""
    overall = overall_summary(panel).select(
        F.lit("overall").alias("level"),
        F.lit("all").alias("group"),
        F.col("total_sum").alias("total"),
        F.col("hits_sum").alias("hits"),
        F.col("share_overall").alias("share"),
        "total_mean",
        "hits_mean",
        "share_mean",
    )
    years = year_summary(day_summary(panel)).select(
        F.lit("year").alias("level"),
        F.col("year").cast("string").alias("group"),
        F.col("total_sum").alias("total"),
        F.col("hits_sum").alias("hits"),
        F.col("share_overall").alias("share"),
        "total_mean",
        "hits_mean",
        "share_mean",
    )
    return overall.unionByName(years)


def panel_facts(panel: DataFrame, interaction_prefix: str = "_x_") -> DataFrame:
    """Rows, date range, units, rows with a unit attribute, interaction columns."""
    interactions = sum(interaction_prefix in c for c in panel.columns)
    matched = F.count("attr_unit") if "attr_unit" in panel.columns else F.lit(0)
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("day").alias("day_min"),
        F.max("day").alias("day_max"),
        F.countDistinct("unit").alias("n_units"),
        matched.cast("bigint").alias("rows_with_attributes"),
    ).withColumn("n_interactions", F.lit(interactions).cast("bigint"))
