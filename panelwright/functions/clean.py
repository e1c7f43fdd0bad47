"""Lenient parsing and normalisation of string columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as fv

# What counts as a number; keeps Java-only spellings such as "1d" or "NaN" out.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _wall_clock(text: Column, layout: str) -> Column:
    """Text as a timestamp without zone, whatever the session's zone is.

    The text is read as UTC and its seconds are added to the epoch, so an hour
    that daylight saving skips in the session's zone keeps its value.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(layout + " xx"))
    seconds = F.make_dt_interval(secs=F.unix_seconds(instant))
    return F.lit("1970-01-01").cast("timestamp_ntz") + seconds


def parse_timestamp(text: Column, formats: Iterable[tuple] = fv.TIMESTAMP_FORMATS) -> Column:
    """First layout that fits, else NULL; has no time zone.

    A layout is tried on text of its shape only: a failed parse costs an
    exception in the parser, a failed pattern match does not.
    """
    return F.coalesce(
        *[F.when(text.rlike(shape), _wall_clock(text, layout)) for layout, shape in formats]
    )


def parse_day(text: Column) -> Column:
    """Lenient date: an ISO date or timestamp, or one of the log layouts."""
    us_date = F.when(text.rlike(r"^\d+/\d+/\d+$"), _wall_clock(text, "M/d/yyyy"))
    return F.coalesce(
        text.try_cast("timestamp_ntz"), parse_timestamp(text), us_date
    ).cast("date")


def _is_standard(text: Column) -> Column:
    return F.coalesce(text.try_cast("timestamp_ntz"), parse_timestamp(text)).cast("date")


def _in_layout(text: Column, layout: str, shape: str) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(shape), _wall_clock(trimmed, layout)).cast("date")


def _layout_fits(text: Column, layouts: Sequence[tuple]) -> list[Column]:
    standard = _is_standard(text)
    return [F.when(standard.isNull(), _in_layout(text, *at)) for at in layouts]


def day_layouts(df: DataFrame, column: str, layouts: Sequence[tuple] = fv.DAY_LAYOUTS) -> list[tuple]:
    """The layouts that dates of a text column stand in, the one that fits most rows first.

    One pass counts the rows that each layout fits, so that of "day first" and
    "month first" the one that reads more of the column is preferred; ties go by
    the order of ``layouts``.  Standard dates and the log's time layouts need none.
    """
    fits = _layout_fits(F.col(column), layouts)
    counts = df.agg(*[F.count(c).alias(str(i)) for i, c in enumerate(fits)]).first()
    return [layouts[i] for i in sorted(range(len(layouts)), key=lambda i: -counts[i]) if counts[i]]


def parse_day_as(text: Column, layouts: Sequence[tuple]) -> Column:
    """A date by the standard layouts, else by the first of ``layouts`` that fits, else NULL."""
    return F.coalesce(_is_standard(text), *[_in_layout(text, *at) for at in layouts])


def layout_counts(df: DataFrame, column: str, layouts: Sequence[tuple] = fv.DAY_LAYOUTS) -> DataFrame:
    """(layout, n): rows by the layout they are read in; "unparsed" are those that become NULL."""
    text = F.col(column)
    name = F.when(_is_standard(text).isNotNull(), "standard")
    for at in day_layouts(df, column, layouts):
        name = name.when(_in_layout(text, *at).isNotNull(), at[0])
    known = df.where(text.isNotNull())
    return known.groupBy(name.otherwise("unparsed").alias("layout")).agg(F.count(F.lit(1)).alias("n"))


def to_number(text: Column) -> Column:
    """Double, or NULL when the text is not a number."""
    text = text.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_int(text: Column) -> Column:
    """Integer by rounding ("87.0" is 87, "3.6" is 4), NULL when it does not fit."""
    return F.round(to_number(text)).try_cast("int")


def tidy_code(text: Column) -> Column:
    return F.upper(F.trim(text))


def tidy_flag(text: Column) -> Column:
    """Upper-case and trimmed; blank becomes NULL."""
    trimmed = F.trim(text)
    return F.upper(F.when(trimmed != "", trimmed))


def in_set(code: Column, values: Iterable) -> Column:
    """1 when the code is in the set, 0 otherwise; NULL counts as 0."""
    return F.coalesce(code.isin(*values), F.lit(False)).cast("int")


def not_in_set(code: Column, values: Iterable) -> Column:
    """True when the code is outside the set; NULL is kept."""
    return F.coalesce(~code.isin(*values), F.lit(True))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL unless whole is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))
