"""Daily series shared by all units: totals, union of two series, z-score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.session import settle


def daily_totals(rows: DataFrame, day: Column | str = "day", n: Column | str = "n") -> DataFrame:
    """Sum per day; a day whose counts are all NULL is 0, unknown days drop out."""
    day = F.col(day) if isinstance(day, str) else day
    n = F.col(n) if isinstance(n, str) else n
    return (
        rows.groupBy(day.alias("day"))
        .agg(F.coalesce(F.sum(n.cast("double")), F.lit(0.0)).alias("n"))
        .where(F.col("day").isNotNull())
    )


def combine_daily(*series: DataFrame) -> DataFrame:
    """Union of the days of several daily series, a missing day adds 0."""
    stacked = series[0]
    for other in series[1:]:
        stacked = stacked.unionByName(other)
    return stacked.groupBy("day").agg(
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("signal_total")
    )


def zscore(daily: DataFrame, value: str = "signal_total", out: str = "signal_z") -> DataFrame:
    """Population z-score over all days.

    Mean and deviation are one scalar subquery, so no window without partition
    and no join is needed.
    """
    stats = daily.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    return daily.withColumn(
        out,
        F.try_divide(
            F.col(value) - stats.select("mean").scalar(), stats.select("sd").scalar()
        ),
    )


def build_signal(*series: DataFrame) -> DataFrame:
    """Settled daily table (day, signal_total, signal_z): one row per day."""
    daily = settle(combine_daily(*series), "signal", files=1)
    return zscore(daily)


def attach_signal(panel: DataFrame, signal: DataFrame) -> DataFrame:
    """Left join on day.  No hint: the settled daily table has exact size
    statistics, so Catalyst broadcasts it below its threshold only."""
    return panel.join(signal, "day", "left")
