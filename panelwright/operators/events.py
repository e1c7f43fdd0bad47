"""Event days, event windows and event time.

An event table has at most one row per calendar day.  Windows around events
are expanded on that side (day +- reach) and joined back by equality on day, so
no range join over the panel is ever needed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import fixed_values as fv
from panelwright.functions import inference
from panelwright.session import settle


def signal_days(panel: DataFrame) -> DataFrame:
    """Distinct (day, signal_z) of a panel, unknown signal left out."""
    return (
        panel.where(F.col("signal_z").isNotNull()).select("day", "signal_z").distinct()
    )


def event_days(panel: DataFrame, is_event: Column) -> DataFrame:
    """Distinct days of the panel rows that satisfy the condition.

    Settled, at most one row per calendar day: its exact size lets Catalyst join
    windows to the panel without shuffling the panel by day.
    """
    days = panel.where(is_event).select(F.col("day").alias("event_day")).distinct()
    return settle(days, "event-days", files=1)


def expand_windows(events: DataFrame, reach: int) -> DataFrame:
    """(event_day, day, days_from_event) for every day within reach."""
    return events.select(
        "event_day",
        F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("days_from_event"),
    ).withColumn("day", F.date_add("event_day", F.col("days_from_event")))


def attach_windows(panel: DataFrame, events: DataFrame, reach: int = fv.PROFILE_REACH) -> DataFrame:
    """Every panel row once per event within reach (rows repeat)."""
    return panel.join(expand_windows(events, reach), "day")


def event_time(events: DataFrame, reach: int = fv.EVENT_TIME_REACH) -> DataFrame:
    """(day, event_time): days since the event; the latest event wins."""
    return (
        expand_windows(events, reach)
        .groupBy("day")
        .agg(F.max("event_day").alias("event_day"))
        .select("day", F.date_diff("day", "event_day").alias("event_time"))
    )


def attach_event_time(
    panel: DataFrame, events: DataFrame, reach: int = fv.EVENT_TIME_REACH, suffix: str = ""
) -> DataFrame:
    """Adds ``event_time`` and ``post`` (0 outside every window)."""
    times = event_time(events, reach).withColumnRenamed("event_time", f"event_time{suffix}")
    return panel.join(times, "day", "left").withColumn(
        f"post{suffix}",
        F.coalesce((F.col(f"event_time{suffix}") >= 0).cast("int"), F.lit(0)),
    )


def offset_name(offset: int) -> str:
    return f"event_time_m{-offset}" if offset < 0 else f"event_time_{offset}"


def offset_dummies(
    reach: int = fv.EVENT_TIME_REACH, reference: int = fv.REFERENCE_OFFSET
) -> dict[str, Column]:
    """Indicator of each offset on treated rows, without the reference one."""
    return {
        offset_name(t): (
            (F.coalesce(F.col("event_time"), F.lit(10**6)) == t) & (F.col("treated") == 1)
        ).cast("int")
        for t in range(-reach, reach + 1)
        if t != reference
    }


def event_profile(
    panel: DataFrame, events: DataFrame, reach: int = fv.PROFILE_REACH
) -> DataFrame:
    """Mean, deviation and interval of the outcomes by days from the event.

    Rows are folded to one row of moments per day before the windows are
    joined, so overlapping events repeat days, never panel rows.  Days are merged
    by count, mean and squared distance from the merged mean, so values that are
    large next to their spread keep it.
    """
    values = ("log_hits_roll3", "share")

    def moments(value: str) -> list[Column]:
        v = F.col(value).cast("double")
        return [
            F.count(v).alias(f"n_{value}"),
            F.avg(v).alias(f"m_{value}"),
            (F.var_pop(v) * F.count(v)).alias(f"d_{value}"),
        ]

    days = settle(panel.groupBy("day").agg(*[c for v in values for c in moments(v)]), "day-moments", files=1)
    joined = days.join(expand_windows(events, reach), "day")
    centres = joined.groupBy("days_from_event").agg(
        *[F.try_divide(F.sum(F.col(f"n_{v}") * F.col(f"m_{v}")), F.sum(f"n_{v}")).alias(f"c_{v}") for v in values]
    )

    def merged(value: str) -> list[Column]:
        n, m, d, c = (F.col(f"{k}_{value}") for k in "nmdc")
        return [
            F.sum(n).alias(f"n_{value}"),
            F.first(c).alias(f"mean_{value}"),
            F.sum(d + n * (m - c) * (m - c)).alias(f"d_{value}"),
        ]

    sums = joined.join(centres, "days_from_event").groupBy("days_from_event").agg(*[c for v in values for c in merged(v)])

    def mean(value: str) -> Column:
        return F.col(f"mean_{value}")

    def std(value: str) -> Column:
        n = F.col(f"n_{value}")
        return F.when(n > 1, F.sqrt(F.col(f"d_{value}") / (n - 1)))

    table = sums.select(
        "days_from_event",
        mean("log_hits_roll3").alias("log_hits_mean"),
        std("log_hits_roll3").alias("log_hits_std"),
        F.col("n_log_hits_roll3").alias("n_obs"),
        mean("share").alias("share_mean"),
        std("share").alias("share_std"),
    ).withColumn("log_hits_se", F.col("log_hits_std") / F.sqrt("n_obs"))
    return table.withColumns(
        {
            "log_hits_ci_low": inference.ci_low(F.col("log_hits_mean"), F.col("log_hits_se")),
            "log_hits_ci_hi": inference.ci_high(F.col("log_hits_mean"), F.col("log_hits_se")),
        }
    )


def pre_event_mean(profile: DataFrame) -> DataFrame:
    """Unweighted mean of the profile before the event."""
    return profile.agg(
        F.avg(F.when(F.col("days_from_event") < 0, F.col("log_hits_mean"))).alias("pre_mean")
    )


def threshold_table(days: DataFrame, thresholds: Iterable[float] = fv.THRESHOLDS) -> DataFrame:
    """Event days per threshold out of a (day, signal_z) table; one pass.

    The day count is one group, too, so a threshold nobody exceeds keeps its row.
    """
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    z = F.col("signal_z")
    high = z > F.col("threshold")
    return (
        days.select("day", "signal_z", F.explode(limits).alias("threshold"))
        .groupBy("threshold")
        .agg(
            F.count(F.when(high, 1)).alias("n_days"),
            (F.count(F.when(high, 1)) / F.count(F.lit(1)) * 100).alias("pct_days"),
            F.avg(F.when(high, z)).alias("mean_z"),
            F.max(F.when(high, z)).alias("max_z"),
            F.max(F.when(high, F.struct(z.alias("z"), (-F.unix_date("day")).alias("k"), "day"))).alias("top"),
        )
        .select(
            "threshold", "n_days", "pct_days", "mean_z", "max_z",
            F.col("top.day").alias("top_day"), F.col("top.z").alias("top_z"),
        )
    )


def event_list(days: DataFrame, threshold: float = fv.EVENT_THRESHOLD) -> DataFrame:
    """Event days with their distance above the threshold and their percentile.

    The cumulative distribution runs over the daily table only.
    """
    pct = F.cume_dist().over(Window.orderBy("signal_z")) * 100
    return (
        days.withColumn("percentile", pct)
        .where(F.col("signal_z") > threshold)
        .select(
            F.col("day").alias("event_day"),
            "signal_z",
            (F.col("signal_z") - threshold).alias("above_threshold"),
            "percentile",
        )
    )


def first_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy("event_day").limit(n)
