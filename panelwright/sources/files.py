"""Readers and writers."""

from __future__ import annotations

import csv
import functools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelwright import fixed_values as fv
from panelwright.functions import clean


# Delimiters a text table may have; of those that fit equally the first one is taken.
DELIMITERS = (",", ";", "\t", "|")
# Files whose first lines are read at the same time.
PROBES = 8


@dataclass(frozen=True)
class Dialect:
    """How a text table is written: its delimiter and its column names as they stand."""

    delimiter: str
    header: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        """Without blanks around them, in small letters."""
        return tuple(h.strip().lower() for h in self.header)


def _cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter, skipinitialspace=True), [])


def dialect_of(lines: Sequence[str]) -> Dialect:
    """The dialect of a file from its first lines.

    The delimiter that cuts the header into most cells; one that cuts the next
    line into as many goes before one that does not.
    """
    header = lines[0].removeprefix("\ufeff") if lines else ""

    def fit(delimiter: str) -> tuple[bool, int]:
        n = len(_cells(header, delimiter))
        return n > 1 and (len(lines) < 2 or len(_cells(lines[1], delimiter)) == n), n

    best = max(DELIMITERS, key=fit)
    return Dialect(best, tuple(_cells(header, best)))


def dialects(spark: SparkSession, path: str | Sequence[str]) -> dict[Dialect, list[str]]:
    """Files by dialect.  Only the first two lines of each file are read, through Spark's reader."""
    found = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(PROBES) as pool:
        heads = pool.map(lambda f: [r[0] for r in spark.read.text(f).head(2)], found)
        out: dict[Dialect, list[str]] = {}
        for file, lines in zip(found, heads, strict=True):
            if lines:  # a file without a line has no rows
                out.setdefault(dialect_of(lines), []).append(file)
    return out


def read_delimited(spark: SparkSession, path: str | Sequence[str]) -> list[DataFrame]:
    """Text tables with a header, one frame for each dialect, every column a string.

    Columns are named by the header of their own file (without blanks around, in
    small letters), so files may differ in delimiter, order and number of columns.
    Rows of the wrong width are dropped.  Column pruning in the CSV parser is off:
    with it a bad row would only be noticed when one of its selected cells is
    missing.
    """
    return [
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in d.names]))
        .option("header", True)
        .option("sep", d.delimiter)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .csv(found)
        for d, found in dialects(spark, path).items()
    ]


def _together(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def tidy_header(df: DataFrame) -> DataFrame:
    """Column names without blanks around them, in small letters."""
    return df.withColumnsRenamed({c: c.strip().lower() for c in df.columns})


def read_log(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] = fv.LOG_COLUMNS,
) -> DataFrame:
    """The used columns of a raw incident log, found by name in every file.

    The parser still reads whole rows, so that rows of a wrong width are found.  A
    file that lacks one of the columns is an error.
    """
    frames = read_delimited(spark, path)
    for df in frames:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing} in {df.inputFiles()[:3]}, which has {df.columns}")
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return _together([df.select(*columns) for df in frames])


def preferred(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The column that stands first in a list of accepted names, if any does."""
    rank = {name: at for at, name in enumerate(names)}
    return min(rank.keys() & set(columns), key=rank.__getitem__, default=None)


def resolve_signal_columns(
    columns: Sequence[str],
    date_names: Sequence[str] = fv.DATE_NAMES,
    count_names: Sequence[str] = fv.COUNT_NAMES,
) -> tuple[str, str | None]:
    """The date column (else the first) and the count column (else none)."""
    return preferred(columns, date_names) or columns[0], preferred(columns, count_names)


def signal_rows(df: DataFrame) -> DataFrame:
    """Any frame with a date-like and a count-like column as (day, n).

    A frame without a count column has 1 per row.  Text dates are read in the
    layouts that fit the column (:func:`clean.day_layouts`); a date in none of them
    is NULL, and ``clean.layout_counts`` says how many there are.
    """
    df = tidy_header(df)
    date, count = resolve_signal_columns(df.columns)
    n = clean.to_number(F.col(count)) if count else F.lit(1.0)
    raw = F.col(date)
    if isinstance(df.schema[date].dataType, T.StringType):
        raw = clean.parse_day_as(raw, clean.day_layouts(df, date))
    return df.select(F.to_date(raw).alias("day"), n.alias("n"))


def read_signal(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(day, n) of all files; each has its own delimiter, column order and date layouts."""
    frames = [signal_rows(df) for df in read_delimited(spark, path)]
    return _together(frames) if frames else spark.createDataFrame([], "day date, n double")


def signal_report(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(layout, n): how many dates of all files stand in which layout, and how many in none."""
    counts = []
    for df in read_delimited(spark, path):
        date, _ = resolve_signal_columns(df.columns)
        counts.append(clean.layout_counts(df, date))
    if not counts:
        return spark.createDataFrame([], "layout string, n bigint")
    return _together(counts).groupBy("layout").agg(F.sum("n").alias("n"))


def read_grid(spark: SparkSession, path: str, cells: int = 11) -> DataFrame:
    """A sheet without header saved as CSV with its row number in front."""
    names = ["row_no"] + [f"c{i}" for i in range(cells)]
    schema = ", ".join([f"{names[0]} bigint"] + [f"{n} string" for n in names[1:]])
    return spark.read.schema(schema).csv(path)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_by_unit(
    df: DataFrame, name: str, path: str, buckets: int | None = None, unit: str = "unit", day: str = "day"
) -> None:
    """A panel stored by unit: table ``name`` at ``path``, bucketed by unit, buckets sorted by day.

    One shuffle here saves one in every later read: lags, leads, rolling means and
    demeaning by unit find the rows of a unit together.  A bucket is one file
    (``buckets`` of them, by default as many as shuffle partitions), so a table
    grows by larger buckets; a unit has one row per day and never fills one.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(n, unit)
        .write.mode("overwrite")
        .bucketBy(n, unit)
        .sortBy(day)
        .option("path", path)
        .saveAsTable(name)
    )


def load_by_unit(spark: SparkSession, name: str) -> DataFrame:
    """The table that ``save_by_unit`` stored, clustered as it lies."""
    return spark.table(name)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_result(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Result table as CSV with a header; blanks around text are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", delimiter)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def load_result(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
