"""Interval, t and significance columns for coefficient tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as fv


def usable_se(se: Column) -> Column:
    """NULL instead of a zero, negative or NaN standard error."""
    return F.when((se > 0) & ~F.isnan(se), se)


def ci_low(coef: Column, se: Column) -> Column:
    return coef - F.lit(fv.Z95) * se


def ci_high(coef: Column, se: Column) -> Column:
    return coef + F.lit(fv.Z95) * se


def t_stat(coef: Column, se: Column) -> Column:
    return coef / usable_se(se)


def significant(coef: Column, se: Column) -> Column:
    """"Yes" when |t| > 1.96, "No" otherwise, also without a usable error."""
    return F.when(F.abs(t_stat(coef, se)) > fv.Z95, "Yes").otherwise("No")


def normal_p_value(t: float | None) -> float | None:
    """Two-sided normal p-value; coefficient tables are fitted on the driver."""
    return None if t is None else math.erfc(abs(t) / math.sqrt(2.0))
