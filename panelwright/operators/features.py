"""Row features of a panel: lags, leads, rolling means, demeaning, products.

Windows are keyed by unit; a panel has one row per unit and day, so a window
group never exceeds the number of calendar days, whatever the data volume.
All offsets share one window specification, hence one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar


def _per_unit():
    return Window.partitionBy("unit").orderBy("day")


def by_unit(df: DataFrame) -> DataFrame:
    """Cluster by unit, as windows over units need it anyway.

    The number of partitions is fixed, so adaptive execution does not fold small
    partitions together: passes that run Python over the result stay parallel.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "unit")


def _known_unit(value: Column) -> Column:
    """Rows without a unit have no history."""
    return F.when(F.col("unit").isNotNull(), value)


def lag_of(value: str, k: int, calendar_days: bool = False, window=None) -> Column:
    """Value ``k`` observed rows back (``k`` calendar days back by option).

    ``k = 0`` is the value itself, also where the unit is unknown.
    """
    if k == 0:
        return F.col(value)
    if calendar_days:
        w = (
            Window.partitionBy("unit")
            .orderBy(F.unix_date("day"))
            .rangeBetween(-k, -k)
        )
        return _known_unit(F.max(value).over(w))
    return _known_unit(F.lag(value, k).over(window or _per_unit()))


def lead_of(value: str, k: int) -> Column:
    return _known_unit(F.lead(value, k).over(_per_unit()))


def rolling3(value: str) -> Column:
    """Centred three-row mean; fewer rows at the ends."""
    return _known_unit(F.avg(value).over(_per_unit().rowsBetween(-1, 1)))


def lag_columns(
    lags: Iterable[int] = fv.FEATURE_LAGS,
    value: str = "signal_z",
    prefix: str = "z_lag",
    calendar_days: bool = False,
) -> dict[str, Column]:
    window = _per_unit()
    return {f"{prefix}{k}": lag_of(value, k, calendar_days, window) for k in lags}


def add_lags(panel: DataFrame, lags: Iterable[int] = fv.FEATURE_LAGS, **how) -> DataFrame:
    return panel.withColumns(lag_columns(lags, **how))


def add_leads(
    panel: DataFrame, value: str = "share", steps: Iterable[int] = fv.LEAD_STEPS
) -> DataFrame:
    return panel.withColumns({f"next_{k}": lead_of(value, k) for k in steps})


def rolling_columns() -> dict[str, Column]:
    return {
        "hits_roll3": rolling3("hits"),
        "signal_roll3": rolling3("signal_total"),
    }


def add_rolling(panel: DataFrame) -> DataFrame:
    """Rolling means of hits and signal with their log1p."""
    return panel.withColumns(rolling_columns()).withColumns(
        {
            "log_hits_roll3": F.log1p("hits_roll3"),
            "log_signal_roll3": F.log1p("signal_roll3"),
        }
    )


def ensure_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add only those columns the frame does not have yet."""
    return df.withColumns({n: c for n, c in columns.items() if n not in df.columns})


def feature_panel(
    panel: DataFrame, signal: DataFrame, lags: Sequence[int] = fv.FEATURE_LAGS
) -> DataFrame:
    """Panel + signal, its lags, rolling means and calendar: one shuffle on unit."""
    return with_features(by_unit(panel.join(signal, "day", "left")), lags)


def with_features(joined: DataFrame, lags: Sequence[int] = fv.FEATURE_LAGS) -> DataFrame:
    """Lags, rolling means and calendar of a panel that has its signal.

    Rows are taken as they are clustered: of a table stored by unit
    (``files.save_by_unit``) nothing is shuffled.
    """
    windowed = joined.withColumns(lag_columns(lags) | rolling_columns())
    return calendar.with_calendar(
        windowed.withColumns(
            {
                "log_hits_roll3": F.log1p("hits_roll3"),
                "log_signal_roll3": F.log1p("signal_roll3"),
            }
        )
    )


def any_known(columns: Iterable[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull()


def demean(
    panel: DataFrame,
    value: str = "share",
    by: Sequence[str] = ("unit", "dow"),
    out: str = "share_dm",
    keep_mean: bool = False,
) -> DataFrame:
    """Value minus its mean within unit x weekday.

    A window on (unit, dow): groups are bounded by the number of days, and data
    already clustered by unit is not shuffled again.  Rows without a unit get
    NULL.
    """
    mean = F.avg(value).over(Window.partitionBy(*by))
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    mean = F.when(known, mean)
    out_df = panel.withColumn(f"{value}_mean", mean)
    out_df = out_df.withColumn(out, F.col(value) - F.col(f"{value}_mean"))
    return out_df if keep_mean else out_df.drop(f"{value}_mean")


def above(threshold: float, value: str = "signal_z") -> Column:
    """1 when strictly above; an unknown value is 0."""
    return F.coalesce((F.col(value) > threshold).cast("int"), F.lit(0))


def threshold_name(threshold: float) -> str:
    return "high_" + str(float(threshold)).replace(".", "_") + "sd"


def add_threshold_flags(
    panel: DataFrame, thresholds: Iterable[float] = fv.THRESHOLDS
) -> DataFrame:
    return panel.withColumns({threshold_name(t): above(t) for t in thresholds})


def add_threshold_lags(
    panel: DataFrame,
    thresholds: Iterable[float] = fv.THRESHOLDS,
    lags: Iterable[int] = fv.THRESHOLD_LAGS,
) -> DataFrame:
    """Lags of every threshold flag; call it after the sample filter."""
    columns = {}
    for t in thresholds:
        name = threshold_name(t)
        for k in lags:
            columns[f"{name}_lag{k}"] = lag_of(name, k)
    return panel.withColumns(columns)


def interaction_columns(left: Iterable[str], right: Iterable[str]) -> dict[str, Column]:
    return {
        f"{a}_x_{b}": F.col(a) * F.col(b) for a in left for b in right
    }


def add_interactions(panel: DataFrame, left: Iterable[str], right: Iterable[str]) -> DataFrame:
    return panel.withColumns(interaction_columns(list(left), list(right)))


def split_interaction(term: Column) -> tuple[Column, Column]:
    """(lag, attribute) out of a name such as ``z_lag7_x_pct_white``."""
    pattern = r"lag(\d+)_x_(.+)$"
    lag = F.regexp_extract(term, pattern, 1)
    return (
        F.when(lag != "", lag.try_cast("int")),
        F.when(lag != "", F.regexp_extract(term, pattern, 2)),
    )
