"""Static unit attributes: key matching, joins, overlap reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as fv
from panelwright.operators.quantiles import add_quartiles
from panelwright.operators.features import add_interactions


def area_code(name: Column) -> Column:
    """Code of an area name, any case; 0 when unknown."""
    lowered = F.lower(F.trim(name))
    out = None
    for area, code in fv.AREA_CODES:
        out = F.when(lowered == area, code) if out is None else out.when(lowered == area, code)
    return out.otherwise(0)


def compose_code(area: Column, number: Column) -> Column:
    return area * 100 + number


def short_number(code: Column) -> Column:
    """The number within the area of a full code; codes without one stay."""
    return F.when((code >= 100) & (code % 100 != 0), code % 100).otherwise(code)


def distinct_keys(df: DataFrame, key: str, out: str = "key") -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias(out)).where(F.col(key).isNotNull()).distinct()


def key_overlap(left: DataFrame, right: DataFrame, key: str = "unit") -> DataFrame:
    """Every key once, marked common, left_only or right_only."""
    sides = distinct_keys(left, key).withColumn("side", F.lit(1)).unionByName(
        distinct_keys(right, key).withColumn("side", F.lit(2))
    )
    return (
        sides.groupBy("key")
        .agg(F.sum("side").alias("side"))
        .select(
            "key",
            F.when(F.col("side") == 3, "common")
            .when(F.col("side") == 1, "left_only")
            .otherwise("right_only")
            .alias("found_in"),
        )
    )


def common_keys(left: DataFrame, right: DataFrame, key: str = "unit") -> DataFrame:
    return distinct_keys(left, key).intersect(distinct_keys(right, key))


def missing_keys(left: DataFrame, right: DataFrame, key: str = "unit") -> DataFrame:
    """Keys of the left side that the right side does not have."""
    return distinct_keys(left, key).subtract(distinct_keys(right, key))


def join_attributes(
    panel: DataFrame, attrs: DataFrame, key: str = "unit", attr_key: str = "unit", suffix: str = "_attr"
) -> DataFrame:
    """Left join; clashing names get a suffix, the matched key is ``attr_unit``.

    One row per unit is expected in ``attrs``.  The join has no hint: a large
    attribute table is shuffled on the unit, a small one is broadcast by its
    measured size.
    """
    renamed = attrs.select(
        F.col(attr_key).alias("attr_unit"),
        *[
            F.col(c).alias(c + suffix if c in panel.columns else c)
            for c in attrs.columns
            if c != attr_key
        ],
    )
    return panel.join(renamed, panel[key] == renamed["attr_unit"], "left")


def match_attributes(panel: DataFrame, attrs: DataFrame) -> DataFrame:
    """Join on the full code when any code matches, else on the short number.

    ``attrs`` has ``cd_code`` (full code) or ``cd_number``/``unit`` only.  The
    probe for a match reads distinct keys and stops at the first hit.
    """
    keys = distinct_keys(panel, "unit")
    if "cd_code" in attrs.columns:
        codes = distinct_keys(attrs, "cd_code")
        if keys.join(codes, "key", "left_semi").limit(1).count():
            return join_attributes(panel, attrs, "unit", "cd_code")
    numbers = panel.withColumn("_short", short_number(F.col("unit")))
    attr_key = "unit"
    if "cd_code" in attrs.columns and "cd_number" in attrs.columns:
        shorts = distinct_keys(numbers, "_short")
        if shorts.join(distinct_keys(attrs, "unit"), "key", "left_semi").limit(1).count():
            attr_key = "cd_number"
    return join_attributes(numbers, attrs, "_short", attr_key).drop("_short")


def first_per_unit(df: DataFrame, columns: Sequence[str], order: str = "day") -> DataFrame:
    """The columns of the earliest row of each unit."""
    picked = F.min_by(F.struct(*columns), F.col(order)).alias("row")
    return (
        df.where(F.col("unit").isNotNull())
        .groupBy("unit")
        .agg(picked)
        .select("unit", *[F.col(f"row.{c}").alias(c) for c in columns])
    )


def attach_first_row(panel: DataFrame, other: DataFrame, order: str = "day") -> DataFrame:
    """Columns only the other panel has, from its first row per unit."""
    extra = [c for c in other.columns if c not in panel.columns and c != "unit"]
    return panel.join(first_per_unit(other, extra, order), "unit", "left") if extra else panel


def attribute_panel(
    features: DataFrame, attrs: DataFrame, names: Sequence[str], lags: Sequence[str]
) -> DataFrame:
    """Feature panel + attributes, lag x attribute products and quartiles."""
    joined = match_attributes(features, attrs)
    return add_quartiles(add_interactions(joined, lags, names), names)
