"""Poisson and negative binomial (NB2) regression with unit effects.

Unit intercepts are profiled out: given the slopes, a task that holds all days
of a unit solves that unit's intercept by itself.  Every Newton step is then one
pass that folds score and information per partition; no intercept table and no
unit dummies exist.  A unit has at most one row per day.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame

from panelwright.models import moments
from panelwright.models.ols import _identified

# Task code travels with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Counts up to this take their sums from a list; larger and broken ones go by gamma functions.
LISTED = 1 << 20


class NoConvergence(RuntimeError):
    """The steps of a fit did not settle."""


@dataclass
class CountFit:
    family: str
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    dispersion: float
    loglik: float
    n_obs: int
    n_units: int
    rounds: int
    fallback: bool = False  # NB2 was asked for and failed: this is the Poisson fit

    def coef(self, term: str) -> float | None:
        return float(self.beta[self.terms.index(term)]) if term in self.terms else None

    def se(self, term: str) -> float | None:
        if term not in self.terms:
            return None
        var = float(self.cov[self.terms.index(term)][self.terms.index(term)])
        return math.sqrt(var) if var > 0 else None


def _lift(x: np.ndarray, terms: int = 8):
    """Shift the argument upwards, where the asymptotic series are exact."""
    return x + terms, [x + i for i in range(terms)]


def log_gamma(x: np.ndarray) -> np.ndarray:
    z, steps = _lift(x)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    return out - sum(np.log(s) for s in steps)


def digamma(x: np.ndarray) -> np.ndarray:
    z, steps = _lift(x)
    series = 1 / (12 * z**2) - 1 / (120 * z**4) + 1 / (252 * z**6) - 1 / (240 * z**8)
    return np.log(z) - 0.5 / z - series - sum(1 / s for s in steps)


def trigamma(x: np.ndarray) -> np.ndarray:
    z, steps = _lift(x)
    series = 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9)
    return 1 / z + 0.5 / z**2 + series + sum(1 / s**2 for s in steps)


def _unit_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole units out of batches sorted by unit."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        units = pdf["unit"].to_numpy()
        cuts = np.flatnonzero(units[1:] != units[:-1]) + 1
        start = 0
        for cut in cuts:
            yield pdf.iloc[start:cut]
            start = cut
        rest = pdf.iloc[start:]
    if rest is not None and len(rest):
        yield rest


def _solve_intercept(y, eta, a: float) -> float:
    base = math.log(y.sum() / np.exp(eta).sum())
    for _ in range(100 if a > 0 else 0):
        mu = np.exp(eta + base)
        slope = (mu * (1 + a * y) / (1 + a * mu) ** 2).sum()
        step = ((y - mu) / (1 + a * mu)).sum() / slope
        step = max(-2.0, min(2.0, step))
        base += step
        if abs(step) < 1e-12:
            break
    return base


def _rising(y, a):
    """Sums of log(1 + a q), q / (1 + a q) and the latter's square over q = 0 .. y - 1."""
    if y.max() <= LISTED and (y == np.floor(y)).all():
        q = np.arange(int(y.max()))
        each = q / (1 + a * q)
        return [np.concatenate([[0.0], np.cumsum(v)])[y.astype(int)] for v in (np.log1p(a * q), each, each**2)]
    t = 1.0 / a
    base = np.full_like(y, t)
    one = digamma(y + t) - digamma(base)
    two = trigamma(base) - trigamma(y + t)
    return log_gamma(y + t) - log_gamma(base) - y * math.log(t), t * (y - t * one), t**2 * (y - 2 * t * one + t**2 * two)


def _bend(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log(1 + x) - x / (1 + x)) / x**2 and its slope; by their series where the difference cancels."""
    small, z = x < 0.1, np.maximum(x, 0.1)
    value = (np.log1p(z) - z / (1 + z)) / z**2
    slope = (1 / (1 + z) ** 2 - 2 * value) / z
    k = np.arange(20)
    terms = (-1.0) ** k * (k + 1) / (k + 2)
    powers = np.where(small, x, 0.0)[:, None] ** k
    return np.where(small, powers @ terms, value), np.where(small, powers[:, :-1] @ (terms * k)[1:], slope)


def _nb_alpha_terms(y, mu, a):
    """Log-likelihood and its first two derivatives in a.

    Nothing here divides by a difference that vanishes with a: a weak dispersion
    would be lost in rounding otherwise, and the steps of the fit would not settle.
    """
    logs, ones, squares = _rising(y, a)
    value, slope = _bend(a * mu)
    ll = logs - (y + 1.0 / a) * np.log1p(a * mu) + y * np.log(mu) - log_gamma(y + 1)
    d1 = ones + mu**2 * value - y * mu / (1 + a * mu)
    d2 = -squares + mu**3 * slope + y * (mu / (1 + a * mu)) ** 2
    return ll.sum(), d1.sum(), d2.sum()


def _newton_pass(sample: DataFrame, layout: moments.Layout, offset: str | None, beta, a: float):
    """Score, information and scalars at (beta, a), summed over all units.

    The last column stands for the dispersion.  Matrix 0 is the information with
    the unit intercepts swept out, matrix 1 the sum of squared unit scores; row
    ``p + 1`` has the score, row ``p + 2`` the scalars.
    """
    p = layout.width - 1  # the outcome is the last column of z
    wide = p + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info = np.zeros((wide, wide))
        meat = np.zeros((wide, wide))
        score = np.zeros(wide)
        scalars = np.zeros(5)  # loglik, rows, units, moment numerator, denominator
        for unit in _unit_runs(batches):
            z = layout.matrix(unit)
            x, y = z[:, :p], z[:, p]
            scalars[1] += len(y)
            scalars[2] += 1
            if y.sum() <= 0:
                continue  # intercept at minus infinity: adds nothing
            eta = x @ beta
            if offset:
                eta = eta + unit[offset].to_numpy(dtype=float)
            mu = np.exp(eta + _solve_intercept(y, eta, a))
            h = mu * (1 + a * y) / (1 + a * mu) ** 2
            s = (y - mu) / (1 + a * mu)
            g = np.zeros(wide)
            g[:p] = x.T @ s
            xh = x.T @ h
            info[:p, :p] += x.T @ (x * h[:, None]) - np.outer(xh, xh) / h.sum()
            if a > 0:
                k = mu * (y - mu) / (1 + a * mu) ** 2
                ll, l1, l2 = _nb_alpha_terms(y, mu, a)
                cross = x.T @ k - xh * (k.sum() / h.sum())
                info[:p, p] += cross
                info[p, :p] += cross
                info[p, p] += -l2 - k.sum() ** 2 / h.sum()
                g[p] = l1
            else:
                ll = (y * np.log(mu) - mu - log_gamma(y + 1)).sum()
            score += g
            meat += np.outer(g, g)
            scalars[0] += ll
            scalars[3] += ((y - mu) ** 2 - mu).sum()
            scalars[4] += (mu**2).sum()
        rows = [("all", 0, i, 0, info[i]) for i in range(wide)]
        rows += [("all", 1, i, 0, meat[i]) for i in range(wide)]
        rows += [("all", 0, wide, 0, score), ("all", 0, wide + 1, 0, scalars)]
        yield pd.DataFrame(rows, columns=["stratum", "matrix", "row", "n_units", "vec"])

    folded = sample.mapInPandas(run, moments.FOLDED)
    summed = folded.repartition("row").mapInPandas(moments._sum_rows, moments.FOLDED).toPandas()
    info, meat = np.zeros((wide, wide)), np.zeros((wide, wide))
    score = scalars = None
    for _, m, i, _, vec in summed.itertuples(index=False):
        if i == wide:
            score = np.asarray(vec)
        elif i == wide + 1:
            scalars = np.asarray(vec)
        elif m == 0:
            info[i] = vec
        else:
            meat[i] = vec
    return info, meat, score, scalars


def fit_counts(
    sample: DataFrame,
    y: str,
    x: Sequence[str],
    cats: Sequence[str] = ("dow", "month_year"),
    family: str = "nb2",
    offset: str | None = None,
    clustered: bool = False,
    max_rounds: int = 50,
) -> CountFit:
    """Maximum likelihood; ``sample`` comes from ``ols.model_sample``.

    Errors come from the observed information, or are clustered by unit as an
    option.  Without overdispersion the NB2 fit ends as a Poisson fit; if its
    steps fail (no convergence, a singular matrix, numbers that overflow), the
    Poisson fit is returned with ``fallback`` set.
    """
    layout = moments.Layout(tuple(x), tuple(cats), moments.find_levels(sample, cats), (y,))
    kept = (
        sample.repartition("unit").sortWithinPartitions("unit")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        try:
            return _fit(kept, layout, family, offset, clustered, max_rounds)
        except (NoConvergence, np.linalg.LinAlgError, FloatingPointError):
            if family == "poisson":
                raise
            return replace(_fit(kept, layout, "poisson", offset, clustered, max_rounds), fallback=True)
    finally:
        kept.unpersist()


def _fit(kept, layout, family, offset, clustered, max_rounds) -> CountFit:
    p = layout.width - 1
    terms = layout.terms[:p]
    order = [i for i, t in enumerate(terms) if "=" in t] + [
        i for i, t in enumerate(terms) if t in layout.x
    ]
    beta, a = np.zeros(p), 0.0
    keep: list[int] | None = None
    previous = None  # (beta, a, loglik) to step back to
    rounds = 0
    while True:
        rounds += 1
        if rounds > max_rounds:
            raise NoConvergence(f"no convergence in {max_rounds} rounds")
        info, meat, score, scalars = _newton_pass(kept, layout, offset, beta, a)
        if previous is not None and scalars[0] < previous[2] - 1e-7 * abs(previous[2]):
            beta = (beta + previous[0]) / 2
            a = math.sqrt(a * previous[1]) if a > 0 and previous[1] > 0 else a
            continue
        if keep is None:
            keep = _identified(info[:p, :p], np.diag(info)[:p] + 1e-9 * np.abs(info).max(), order)
        at = keep + [p] if a > 0 else keep
        block, g = info[np.ix_(at, at)].copy(), score[at].copy()
        if a > 0:  # step in log(a)
            block[-1, :] *= a
            block[:, -1] *= a
            g[-1] *= a
            block[-1, -1] = max(block[-1, -1] - g[-1], 1e-8)
        step = np.linalg.solve(block, g)
        size = np.abs(step).max()
        if size < 1e-8:
            if family == "nb2" and a == 0.0:
                start = scalars[3] / scalars[4]
                if start > 1e-6:
                    a, previous = start, None
                    continue
            break
        previous = (beta.copy(), a, scalars[0])
        shrink = min(1.0, 5.0 / size)
        beta = beta.copy()
        beta[keep] += shrink * step[: len(keep)]
        if a > 0:
            a *= math.exp(max(-2.0, min(2.0, shrink * step[-1])))
    at = keep + [p] if a > 0 else keep
    inverse = np.linalg.inv(info[np.ix_(at, at)])
    if clustered:
        n_units = scalars[2]
        inverse = n_units / (n_units - 1) * inverse @ meat[np.ix_(at, at)] @ inverse
    n = len(keep)
    return CountFit(
        "nb2" if a > 0 else "poisson",
        [terms[i] for i in keep],
        beta[keep],
        inverse[:n, :n],
        float(a),
        float(scalars[0]),
        int(scalars[1]),
        int(scalars[2]),
        rounds,
    )
