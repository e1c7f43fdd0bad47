"""Calendar features as plain expressions over a date column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright import fixed_values as fv

MON, THU, FRI = 0, 3, 4


def day_of_week(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def iso_week_key(day: Column) -> Column:
    """ISO year and week as ``YYYY_WW``."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("_"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_index(day: Column) -> Column:
    """year * 12 + month - 1: one integer per month x year cell."""
    return F.year(day) * 12 + F.month(day) - 1


# Holidays on a date (month * 100 + day), first year they hold.
HOLIDAY_DATES = ((101, 0), (619, 2021), (704, 0), (1111, 0), (1225, 0))
# Holidays on a weekday within a range of days, first year.
HOLIDAY_RANGES = (
    (115, 121, MON, 1986),
    (215, 221, MON, 0),
    (525, 531, MON, 0),
    (901, 907, MON, 0),
    (1008, 1014, MON, 0),
    (1122, 1128, THU, 0),
)


def is_federal_holiday(day: str) -> Column:
    """1 on an observed US federal holiday, else 0; ``day`` is a date column.

    A holiday on a date moves to Friday from Saturday and to Monday from Sunday.
    Written as one SQL text, so building a plan costs one call.
    """
    def month_day(d: str) -> str:
        return f"(month({d}) * 100 + dayofmonth({d}))"

    def observed(keys) -> str:
        found = ", ".join(map(str, keys))
        return (
            f"(weekday({day}) <= {FRI} AND {month_day(day)} IN ({found})"
            f" OR weekday({day}) = {FRI} AND {month_day(f'date_add({day}, 1)')} IN ({found})"
            f" OR weekday({day}) = {MON} AND {month_day(f'date_sub({day}, 1)')} IN ({found}))"
        )

    rules = [observed([k for k, since in HOLIDAY_DATES if not since])]
    rules += [f"({observed([k])} AND year({day}) >= {since})" for k, since in HOLIDAY_DATES if since]
    rules += [
        f"(weekday({day}) = {weekday} AND {month_day(day)} BETWEEN {first} AND {last}"
        f" AND year({day}) >= {since})"
        for first, last, weekday, since in HOLIDAY_RANGES
    ]
    return F.expr(f"int(coalesce({' OR '.join(rules)}, false))")


def period_code(day: Column, periods: Iterable[tuple] = fv.PERIODS) -> Column:
    """Code of the first period that holds the day, 0 outside all of them."""
    out = None
    for first, last, code in periods:
        hit = day >= F.lit(first).cast("date")
        if last is not None:
            hit = hit & (day <= F.lit(last).cast("date"))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return F.lit(0) if out is None else out.otherwise(0)


def in_period(day: Column, first: str, last: str) -> Column:
    return day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def calendar_table(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day with its calendar features."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
        ).alias("day")
    )
    return with_calendar(days)


def with_calendar(df: DataFrame, day: str = "day") -> DataFrame:
    d = F.col(day)
    return df.withColumns(
        {
            "dow": day_of_week(d),
            "month": F.month(d),
            "year": F.year(d),
            "is_holiday": is_federal_holiday(day),
            "period": period_code(d),
        }
    )


def holiday_dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Observed federal holidays between two days, one row each."""
    return calendar_table(spark, first, last).where("is_holiday = 1").select("day")
