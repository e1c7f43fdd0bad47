"""Least squares with unit effects, categorical controls and clustered errors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar, inference
from panelwright.models import moments

# Share of a column's squared length that must remain after removing the unit
# means and all earlier columns; below it the column is not identified.
TOLERANCE = 1e-9

CONTROLS = ("dow", "month_year")


@dataclass(frozen=True)
class Spec:
    """One model: outcome, regressors, categorical controls, unit effects."""

    y: str
    x: tuple[str, ...]
    cats: tuple[str, ...] = CONTROLS
    unit_effects: bool = True
    stratum: str | None = None  # fit on this stratum only


@dataclass
class Fit:
    stratum: str
    model: str
    spec: Spec
    n_obs: int
    n_units: int
    n_params: int = 0
    r_squared: float | None = None
    mean_y: float | None = None
    skipped: bool = False
    terms: list[str] = field(default_factory=list)  # identified columns
    beta: np.ndarray | None = None
    cov: np.ndarray | None = None

    def coef(self, term: str) -> float | None:
        return float(self.beta[self.terms.index(term)]) if term in self.terms else None

    def se(self, term: str) -> float | None:
        if term not in self.terms or self.cov is None:
            return None
        i = self.terms.index(term)
        var = float(self.cov[i, i])
        return math.sqrt(var) if var > 0 else None

    def sum_of(self, terms: Sequence[str]) -> tuple[float | None, float | None, list[str]]:
        """Sum of the identified terms, its standard error, and their names."""
        used = [t for t in terms if t in self.terms]
        if not used:
            return None, None, []
        at = [self.terms.index(t) for t in used]
        total = float(self.beta[at].sum())
        if self.cov is None:
            return total, None, used
        var = float(self.cov[np.ix_(at, at)].sum())
        return total, math.sqrt(var) if var > 0 else None, used


def model_sample(
    df: DataFrame,
    x: Sequence[str],
    y: Sequence[str],
    cats: Sequence[str] = CONTROLS,
    stratum: str | None = None,
    unit: str = "unit",
) -> DataFrame:
    """The columns of a fit, complete cases only, types as the passes want them."""
    if "month_year" in cats and "month_year" not in df.columns:
        df = df.withColumn("month_year", calendar.month_index(F.col("day")))
    columns = [
        (F.col(stratum).cast("string") if stratum else F.lit("all")).alias("stratum"),
        F.col(unit).cast("string").alias("unit"),
        *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*x, *y])],
        *[F.col(c).cast("int").alias(c) for c in cats],
    ]
    return df.select(*columns).dropna()


def _identified(gram: np.ndarray, scale: np.ndarray, order: Sequence[int]) -> list[int]:
    """Columns, in the given order, that add something to those before them."""
    d = np.sqrt(np.where(scale > 0, scale, 1.0))
    a = gram / np.outer(d, d)
    kept = []
    for j in order:
        if scale[j] > 0 and a[j, j] > TOLERANCE:
            kept.append(j)
            a = a - np.outer(a[:, j], a[j, :]) / a[j, j]
    return sorted(kept)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix through its Cholesky factor."""
    half = np.linalg.solve(np.linalg.cholesky(a), np.eye(len(a)))
    return half.T @ half


def _design_columns(layout: moments.Layout, spec: Spec, raw: np.ndarray, n_units: int) -> int:
    """Columns of the full dummy design: intercept, regressors, one less than the
    levels of each control, one less than the units.  A month x year control
    counts every combination of the months and years that occur."""
    terms = layout.terms
    k = 1 + len(spec.x) + (n_units - 1 if spec.unit_effects else 0)
    for c in spec.cats:
        present = [
            level for level in layout.levels[c] if raw[0, terms.index(f"{c}={level}")] > 0
        ]
        if c == "month_year":
            k += len({v % 12 for v in present}) * len({v // 12 for v in present}) - 1
        else:
            k += len(present) - 1
    return k


def fit(
    sample: DataFrame,
    specs: dict[str, Spec],
    min_rows: int = fv.MIN_ROWS,
    small_sample: bool = True,
    scale: dict[str, float] | None = None,
    absorbed_params: int = 0,
    count_first: bool = False,
    members: Callable[[str], Sequence[str]] | None = None,
) -> list[Fit]:
    """Fit every spec on every stratum of a :func:`model_sample`.

    All specs and strata share the two passes of :mod:`moments`.  For columns
    that were demeaned beforehand, ``scale`` has their squared length before
    that and ``absorbed_params`` the design columns it stands for.
    ``count_first`` costs a pass that counts rows; strata with too few of them
    then get no matrix at all, however many there are.  ``members`` names the
    strata of a row whose ``stratum`` is a pattern (see :mod:`moments`).
    """
    short: list[Fit] = []
    if count_first:
        size = sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("u"))
        few = size.where(F.col("n") < min_rows)
        short = [
            Fit(r["stratum"], name, spec, r["n"], r["u"], skipped=True)
            for r in few.orderBy("stratum").collect()
            for name, spec in specs.items()
            if spec.stratum in (None, r["stratum"])
        ]
        sample = sample.join(size.where(F.col("n") >= min_rows).select("stratum"), "stratum", "left_semi")
    x = tuple(dict.fromkeys(c for s in specs.values() for c in s.x))
    cats = tuple(dict.fromkeys(c for s in specs.values() for c in s.cats))
    y = tuple(dict.fromkeys(s.y for s in specs.values()))
    layout = moments.Layout(x, cats, moments.find_levels(sample, cats), y)
    terms = layout.terms
    position = {t: i for i, t in enumerate(terms)}
    cross = moments.cross_moments(sample, layout, members or moments._alone)

    fits: list[Fit] = []
    residuals: dict[str, list[moments.Residual]] = {}
    pending: dict[str, list[tuple[Fit, np.ndarray, list[int]]]] = {}
    for stratum in sorted(cross):
        m = cross[stratum]
        n = int(round(m.raw[0, 0]))
        for name, spec in specs.items():
            if spec.stratum not in (None, stratum):
                continue
            out = Fit(stratum, name, spec, n, m.n_units)
            fits.append(out)
            if n < min_rows:
                out.skipped = True
                continue
            gram = m.raw - m.between if spec.unit_effects else m.raw
            controls = [position[t] for t in terms if t.split("=")[0] in spec.cats and "=" in t]
            own = [position[c] for c in spec.x]
            order = ([] if spec.unit_effects else [0]) + controls + own
            length = np.diag(m.raw).copy()
            for term, value in (scale or {}).items():
                length[position[term]] = value
            keep = _identified(gram, length, order)
            iy = position[spec.y]
            d = np.sqrt(np.diag(gram)[keep])
            inverse = _inverse(gram[np.ix_(keep, keep)] / np.outer(d, d)) / np.outer(d, d)
            beta = inverse @ gram[keep, iy]
            out.terms = [terms[i] for i in keep]
            out.beta = beta
            out.mean_y = float(m.raw[0, iy]) / n
            ssr = gram[iy, iy] - beta @ gram[keep, iy]
            tss = m.raw[iy, iy] - n * out.mean_y**2
            out.r_squared = float(1.0 - ssr / tss) if tss > 0 else None
            out.n_params = _design_columns(layout, spec, m.raw, m.n_units) + absorbed_params
            weights = np.zeros(layout.width)
            weights[iy] = 1.0
            weights[keep] -= beta
            residuals.setdefault(stratum, []).append(
                moments.Residual(weights, spec.unit_effects)
            )
            pending.setdefault(stratum, []).append((out, inverse, keep))
    if residuals:
        meats = moments.score_moments(sample, layout, residuals, members or moments._alone)
        for stratum, waiting in pending.items():
            for at, (out, inverse, keep) in enumerate(waiting):
                meat = meats[stratum][at][np.ix_(keep, keep)]
                factor = _small_sample_factor(out) if small_sample else 1.0
                if factor is not None:
                    out.cov = factor * inverse @ meat @ inverse
    return sorted([*fits, *short], key=lambda f: f.stratum) if short else fits


def _small_sample_factor(f: Fit) -> float | None:
    if f.n_units < 2 or f.n_obs <= f.n_params:
        return None
    return f.n_units / (f.n_units - 1) * (f.n_obs - 1) / (f.n_obs - f.n_params)


TIDY = (
    "stratum string, model string, term string, coef double, se double, ci_low double, "
    "ci_hi double, t_stat double, p_value double, identified boolean, n_obs bigint, "
    "n_units bigint, n_params bigint, r_squared double, skipped boolean"
)


def tidy_rows(fits: Sequence[Fit], terms: Sequence[str] | None = None) -> list[tuple]:
    rows = []
    for f in fits:
        for term in terms if terms is not None else f.spec.x:
            if term not in f.spec.x:
                continue
            b, se = f.coef(term), f.se(term)
            t = b / se if b is not None and se else None
            rows.append(
                (
                    f.stratum, f.model, term, b, se,
                    None if se is None else b - fv.Z95 * se,
                    None if se is None else b + fv.Z95 * se,
                    t, inference.normal_p_value(t), b is not None,
                    f.n_obs, f.n_units, f.n_params, f.r_squared, f.skipped,
                )
            )
    return rows


def tidy(spark: SparkSession, fits: Sequence[Fit], terms: Sequence[str] | None = None) -> DataFrame:
    """Coefficient table: one row per stratum, model and regressor."""
    return spark.createDataFrame(tidy_rows(fits, terms), TIDY)
