"""Sectioned sheets: one header row per unit, detail rows below it.

Input: ``row_no`` and string cells ``c0 ... c10``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import fixed_values as fv
from panelwright.functions import clean
from panelwright.operators.attributes import area_code, compose_code

HEADER = (
    r"(?i)(" + "|".join(a.replace(" ", r"\s+") for a, _ in fv.AREA_CODES)
    + r")\s+community\s+district\s+(\d+)"
)


def header_code(cell: Column) -> Column:
    """Unit code of a section header, NULL on other rows."""
    area = F.regexp_replace(F.regexp_extract(cell, HEADER, 1), r"\s+", " ")
    number = F.regexp_extract(cell, HEADER, 2).try_cast("int")
    return F.when(cell.rlike(HEADER), compose_code(area_code(area), number))


def carry_down(
    df: DataFrame, value: str, out: str, order: str = "row_no", block: int = 10_000
) -> DataFrame:
    """Last known value at or above each row, with the row it stands on.

    Two levels: rows are cut into blocks of ``block`` row numbers; within a block
    a window keyed by block carries the value, and only one summary row per
    block runs through the window across blocks.
    """
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_mark", mark)
    inside = Window.partitionBy("_block").orderBy(order)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("_block")
        .agg(F.max("_mark").alias("_tail"))
        .select("_block", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    )
    joined = rows.withColumn("_here", F.last("_mark", ignorenulls=True).over(inside)).join(
        blocks, "_block"
    )
    found = F.coalesce("_here", "_carried")
    return joined.withColumns(
        {out: found.getField("v"), f"{out}_row": found.getField("at")}
    ).drop("_block", "_mark", "_here", "_carried")


def sections(grid: DataFrame, skip: int = fv.SECTION_SKIP_ROWS, cap: int | None = None) -> DataFrame:
    """Detail rows with their unit: from ``skip`` rows below the header on, down
    to the next header.  ``cap`` keeps at most so many of them, if asked for."""
    marked = grid.withColumn("_header", header_code(F.col("c0")))
    carried = carry_down(marked, "_header", "unit")
    offset = F.col("row_no") - F.col("unit_row")
    rows = carried.withColumn("section_row", offset).where(offset >= skip)
    if cap is not None:
        rows = rows.where(F.col("section_row") < skip + cap)
    return rows.drop("_header")


def label_contains(label: Column, text: str) -> Column:
    """Case-insensitive substring match."""
    return F.lower(label).contains(text.lower())


def match_variables(
    details: DataFrame, variables: Sequence[tuple] = fv.GRID_VARIABLES
) -> DataFrame:
    """(unit, row_no, variable, value) of the rows that name a variable.

    The first variable whose label fits takes the row, even if its cell is not
    a number (then the row gives nothing).
    """
    first = F.coalesce(F.trim("c0"), F.lit(""))
    full = F.trim(F.concat_ws(" ", first, F.trim(F.coalesce("c1", F.lit("")))))
    name = value = None
    for label, column, cell in variables:
        hit = label_contains(full, label)
        number = clean.to_number(F.col(f"c{cell}"))
        name = F.when(hit, column) if name is None else name.when(hit, column)
        value = F.when(hit, number) if value is None else value.when(hit, number)
    return details.select(
        "unit", "row_no", name.alias("variable"), value.alias("value")
    ).where(F.col("variable").isNotNull() & F.col("value").isNotNull())


def match_extras(details: DataFrame, legacy: bool = False) -> DataFrame:
    """Income, college and poverty rows, in the same shape.

    ``legacy=True`` also takes any "median" row for income.
    """
    first = F.coalesce(F.trim("c0"), F.lit(""))
    full = F.lower(F.trim(F.concat_ws(" ", first, F.trim(F.coalesce("c1", F.lit(""))))))
    income = full.contains(fv.INCOME_WORD)
    if legacy:
        income = income | full.contains(fv.LEGACY_INCOME_WORD)
    college = full.contains(fv.COLLEGE_WORDS[0])
    for word in fv.COLLEGE_WORDS[1:]:
        college = college | full.contains(word)
    poverty = full.contains(fv.POVERTY_WORD)
    cells = [clean.to_number(F.col(f"c{i}")) for i in fv.EXTRA_CELLS]
    positive = F.coalesce(*[F.when(c > 0, c) for c in cells])
    percent = F.when(cells[1].between(0, 100), cells[1])
    found = F.array(
        F.struct(F.lit("median_income").alias("variable"), F.when(income, positive).alias("value")),
        F.struct(F.lit("pct_college").alias("variable"), F.when(college, percent).alias("value")),
        F.struct(F.lit("pct_poverty").alias("variable"), F.when(poverty, percent).alias("value")),
    )
    return (
        details.select("unit", "row_no", F.explode(found).alias("m"))
        .select("unit", "row_no", "m.variable", "m.value")
        .where(F.col("value").isNotNull())
    )


def first_match(matches: DataFrame) -> DataFrame:
    """First value per (unit, variable), by row number."""
    return matches.groupBy("unit", "variable").agg(
        F.min_by("value", "row_no").alias("value")
    )


def parse_grid(
    grid: DataFrame,
    variables: Sequence[tuple] = fv.GRID_VARIABLES,
    legacy: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """One row per section with a column per variable, full code and number.

    ``cap`` reads at most so many rows of a section, if asked for.

    Sections without any usable row keep a row of NULLs.
    """
    units = (
        grid.select(header_code(F.col("c0")).alias("unit"))
        .where(F.col("unit").isNotNull())
        .distinct()
    )
    details = sections(grid, cap=cap)
    names = [v[1] for v in variables] + ["median_income", "pct_college", "pct_poverty"]
    found = match_variables(details, variables).unionByName(match_extras(details, legacy))
    wide = found.groupBy("unit").agg(
        *[
            F.min_by(
                F.when(F.col("variable") == n, F.col("value")),
                F.when(F.col("variable") == n, F.col("row_no")),
            ).alias(n)
            for n in names
        ]
    )
    return (
        units.join(wide, "unit", "left")
        .withColumn("cd_code", F.col("unit"))
        .withColumn("cd_number", F.when(F.col("unit") >= 100, F.col("unit") % 100).otherwise(F.col("unit")))
    )


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_known, n_rows) per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in columns]
    )
    return counts.unpivot(["n_rows"], list(columns), "variable", "n_known")
