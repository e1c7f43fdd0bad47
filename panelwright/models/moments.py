"""Distributed moments of a regression sample.

The design row of an observation is ``z = [1, x, dummies, y]``.  Two passes over
the sample give everything a clustered least-squares fit needs:

* :func:`cross_moments` - ``sum z z'`` and ``sum_u S_u S_u' / n_u`` per stratum,
  with ``S_u = sum z`` over unit ``u``; their difference is the cross-product
  after removing unit means;
* :func:`score_moments` - ``sum_u s_u s_u'`` for the scores ``s_u`` of a cluster.

Dummies are never written out: a row carries the codes of its levels, and the
cross-products of a control are counts and sums by code (:class:`Block`), so a
control of a thousand weeks costs a row no more than one of seven days.

Both run the same three steps.  (1) ``mapInPandas`` folds each partition into
one small matrix per stratum and one vector per unit it meets, so a unit of any
size, or split over many partitions, is never gathered.  (2) the vectors are
shuffled by unit, summed, and turned into outer products that are again folded
per partition.  (3) the matrix rows are shuffled by row number and summed.  Only
one p x p matrix per stratum and model reaches the driver.

A row may belong to several strata (leads that are known, quartiles of several
attributes).  It is not copied: its ``stratum`` is then a pattern, ``members``
names the strata of a pattern, and sums of patterns become sums of strata.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Task code travels with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Units a task may hold before it hands its partial vectors on.
FLUSH_UNITS = 2_000
# Levels of categorical controls (day-bounded: weekday, month x year, week).
MAX_LEVELS = 20_000

# Doubles per shipped piece of a matrix (whole rows).
PIECE = 4_096

PARTIAL = "stratum string, unit string, row int, vec array<double>"
FOLDED = "stratum string, matrix int, row int, n_units bigint, vec array<double>"


@dataclass(frozen=True)
class Layout:
    """Columns of the design row."""

    x: tuple[str, ...]
    cats: tuple[str, ...]
    levels: dict[str, tuple[int, ...]] = field(hash=False)
    y: tuple[str, ...] = ()

    @property
    def terms(self) -> list[str]:
        names = ["1", *self.x]
        for c in self.cats:
            names += [f"{c}={level}" for level in self.levels[c]]
        return names + list(self.y)

    @property
    def width(self) -> int:
        return 1 + len(self.x) + sum(len(self.levels[c]) for c in self.cats) + len(self.y)

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """The design written out, for callers that need single rows of it."""
        block = Block.of(self, pdf)
        z = np.zeros((len(pdf), self.width))
        z[:, block.at] = block.dense
        for start, _, code in block.controls:
            z[np.arange(len(pdf)), start + code] = 1.0
        return z


@dataclass
class Block:
    """Design rows of one batch: plain columns, and one level code per control."""

    width: int
    at: np.ndarray  # where the plain columns stand in the design
    dense: np.ndarray
    controls: list[tuple[int, int, np.ndarray]]  # first column, levels, codes

    @classmethod
    def of(cls, layout: Layout, pdf: pd.DataFrame) -> Block:
        plain = [*layout.x, *layout.y]
        dense = np.ones((len(pdf), 1 + len(plain)))
        if plain:
            dense[:, 1:] = pdf[plain].to_numpy(dtype=float)
        start, controls = 1 + len(layout.x), []
        for c in layout.cats:
            levels = np.asarray(layout.levels[c])
            controls.append((start, len(levels), np.searchsorted(levels, pdf[c].to_numpy())))
            start += len(levels)
        at = np.r_[0 : 1 + len(layout.x), start : start + len(layout.y)]
        return cls(layout.width, at, dense, controls)

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.width, self.at, self.dense[rows], [(s, n, code[rows]) for s, n, code in self.controls])

    def gram(self) -> np.ndarray:
        """``sum z z'``."""
        out = np.zeros((self.width, self.width))
        out[np.ix_(self.at, self.at)] = self.dense.T @ self.dense
        for k, (start, n, code) in enumerate(self.controls):
            by = np.stack([np.bincount(code, weights=v, minlength=n) for v in self.dense.T], 1)
            out[start : start + n, self.at] = by
            out[self.at, start : start + n] = by.T
            out[np.arange(start, start + n), np.arange(start, start + n)] = by[:, 0]
            for start2, n2, code2 in self.controls[:k]:
                both = np.bincount(code * n2 + code2, minlength=n * n2).reshape(n, n2)
                out[start : start + n, start2 : start2 + n2] = both
                out[start2 : start2 + n2, start : start + n] = both.T
        return out

    def sums(self, group: np.ndarray, n_groups: int, weight: np.ndarray | None = None) -> np.ndarray:
        """``sum z``, or ``sum weight z``, by group number."""
        out = np.zeros((n_groups, self.width))
        for at, v in zip(self.at, self.dense.T):
            out[:, at] = np.bincount(group, weights=v if weight is None else v * weight, minlength=n_groups)
        for start, n, code in self.controls:
            out[:, start : start + n] = np.bincount(group * n + code, weights=weight, minlength=n_groups * n).reshape(n_groups, n)
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """``z @ weights``."""
        out = self.dense @ weights[self.at]
        for start, _, code in self.controls:
            out += weights[start + code]
        return out


def find_levels(sample: DataFrame, cats: Sequence[str]) -> dict[str, tuple[int, ...]]:
    """Levels of each control, read from their distinct combinations."""
    if not cats:
        return {}
    rows = sample.select(*cats).distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} level combinations in {list(cats)}")
    return {c: tuple(sorted({r[c] for r in rows})) for c in cats}


def block_rows(width: int) -> int:
    return max(1, PIECE // width)


def _groups(strata, units):
    """Number of the (stratum, unit) pair of every row, and the pairs."""
    codes, keys = pd.factorize(pd.MultiIndex.from_arrays([strata, units]))
    return codes, list(keys)


def _partial_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stratum", "unit", "row", "vec"])


def _add(store: dict, keys, sums) -> None:
    for key, s in zip(keys, sums):
        if key in store:
            store[key] += s
        else:
            store[key] = s.copy()


def _fold_outer(width: int, n_matrices: int, expand):
    """Step 2: sum vectors per unit, fold the outer products that ``expand`` names.

    ``expand`` maps the summed vectors of a unit, by stratum as the rows carry it,
    to (stratum, [(matrix number, vector, weight), ...]).  Rows without a unit are
    matrix rows to add up as they are.
    """

    block = block_rows(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: dict[str, np.ndarray] = {}
        folded: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        unit_open, parts = None, {}

        def close():
            for stratum, products in expand(parts):
                if stratum not in folded:
                    folded[stratum] = np.zeros((n_matrices, width, width))
                    counts[stratum] = 0
                counts[stratum] += 1
                for m, vec, weight in products:
                    folded[stratum][m] += weight * np.outer(vec, vec)
            parts.clear()

        for pdf in batches:
            for stratum, unit, row, vec in zip(
                pdf["stratum"], pdf["unit"], pdf["row"], pdf["vec"]
            ):
                if unit is None:
                    if stratum not in raw:
                        raw[stratum] = np.zeros((width, width))
                    part = np.asarray(vec).reshape(-1, width)
                    raw[stratum][row : row + len(part)] += part
                    continue
                if unit != unit_open:
                    close()
                    unit_open = unit
                parts[stratum] = parts[stratum] + vec if stratum in parts else np.array(vec)
        close()
        rows = []
        for stratum, matrix in raw.items():
            rows += [
                (stratum, -1, i, 0, matrix[i : i + block].ravel())
                for i in range(0, width, block)
            ]
        for stratum, stack in folded.items():
            for m in range(n_matrices):
                n = counts[stratum] if m == 0 else 0
                rows += [
                    (stratum, m, i, n if i == 0 else 0, stack[m, i : i + block].ravel())
                    for i in range(0, width, block)
                ]
        yield pd.DataFrame(rows, columns=["stratum", "matrix", "row", "n_units", "vec"])

    return run


def _sum_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 3: add up equal matrix rows."""
    total: dict[tuple, list] = {}
    for pdf in batches:
        for s, m, i, n, vec in zip(
            pdf["stratum"], pdf["matrix"], pdf["row"], pdf["n_units"], pdf["vec"]
        ):
            if (s, m, i) in total:
                total[s, m, i][0] += n
                total[s, m, i][1] += vec
            else:
                total[s, m, i] = [n, np.array(vec)]
    yield pd.DataFrame(
        [(*k, v[0], v[1]) for k, v in total.items()],
        columns=["stratum", "matrix", "row", "n_units", "vec"],
    )


def _collect(partials: DataFrame, width: int, n_matrices: int, expand):
    # All strata of a unit meet in one task; matrix rows have no unit.
    place = F.coalesce("unit", F.concat_ws("/", "stratum", "row"))
    folded = (
        partials.repartition(place)
        .sortWithinPartitions("unit", "stratum")
        .mapInPandas(_fold_outer(width, n_matrices, expand), FOLDED)
    )
    summed = folded.repartition("stratum", "row").mapInPandas(_sum_rows, FOLDED)
    raw: dict[str, np.ndarray] = {}
    stacks: dict[str, np.ndarray] = {}
    units: dict[str, int] = {}
    for s, m, i, n, vec in summed.toPandas().itertuples(index=False):
        part = np.asarray(vec).reshape(-1, width)
        at = slice(i, i + len(part))
        if m < 0:
            raw.setdefault(s, np.zeros((width, width)))[at] = part
        else:
            stacks.setdefault(s, np.zeros((n_matrices, width, width)))[m, at] = part
            units[s] = units.get(s, 0) + int(n)
    return raw, stacks, units


@dataclass
class Moments:
    raw: np.ndarray  # sum z z'
    between: np.ndarray  # sum_u S_u S_u' / n_u
    n_units: int


def _alone(pattern: str) -> Sequence[str]:
    return (pattern,)


def cross_moments(
    sample: DataFrame, layout: Layout, members: Callable[[str], Sequence[str]] = _alone
) -> dict[str, Moments]:
    """Per stratum; ``sample`` has stratum, unit and the layout's columns."""

    width, block = layout.width, block_rows(layout.width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            rows = Block.of(layout, pdf)
            strata = pdf["stratum"].to_numpy()
            found = pd.unique(strata)
            for s in found:
                g = rows.gram() if len(found) == 1 else rows.take(strata == s).gram()
                for member in members(s):
                    grams[member] = grams.get(member, 0.0) + g
            codes, keys = _groups(strata, pdf["unit"].to_numpy())
            _add(sums, keys, rows.sums(codes, len(keys)))
            if len(sums) > FLUSH_UNITS:
                yield _partial_frame([(s, u, 0, v) for (s, u), v in sums.items()])
                sums.clear()
        rows = [(s, u, 0, v) for (s, u), v in sums.items()]
        for s, g in grams.items():
            rows += [(s, None, i, g[i : i + block].ravel()) for i in range(0, width, block)]
        yield _partial_frame(rows)

    def expand(parts: dict[str, np.ndarray]):
        total: dict[str, np.ndarray] = {}
        for pattern, vec in parts.items():
            for member in members(pattern):
                total[member] = total.get(member, 0.0) + vec
        for member, vec in total.items():
            yield member, [(0, vec, 1.0 / vec[0])]

    raw, stacks, units = _collect(
        sample.mapInPandas(partial, PARTIAL), layout.width, 1, expand
    )
    return {s: Moments(raw[s], stacks[s][0], units[s]) for s in raw}


@dataclass(frozen=True)
class Residual:
    """One fitted model: ``z @ weights`` is its residual without unit effect."""

    weights: np.ndarray
    absorbed: bool


def score_moments(
    sample: DataFrame, layout: Layout, residuals: dict[str, list[Residual]],
    members: Callable[[str], Sequence[str]] = _alone,
) -> dict[str, np.ndarray]:
    """Per stratum the stacked ``sum_u s_u s_u'`` of all its models."""
    q = layout.width
    n_models = max(len(r) for r in residuals.values())
    weights = {s: np.column_stack([m.weights for m in ms]) for s, ms in residuals.items()}
    absorbed = {s: [m.absorbed for m in ms] for s, ms in residuals.items()}

    def fitted(pattern: str) -> list[str]:
        return [m for m in members(pattern) if m in weights]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Per unit and pattern: sum z, then of every model sum r and sum z r.
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            rows = Block.of(layout, pdf)
            strata, units = pdf["stratum"].to_numpy(), pdf["unit"].to_numpy()
            for s in pd.unique(strata):
                used = fitted(s)
                if not used:
                    continue
                mine = strata == s
                part = rows.take(mine)
                codes, keys = pd.factorize(units[mine])
                wide = [part.sums(codes, len(keys))]
                r = part.dot(np.hstack([weights[m] for m in used]))
                for v in r.T:
                    wide.append(np.bincount(codes, weights=v, minlength=len(keys))[:, None])
                    wide.append(part.sums(codes, len(keys), v))
                _add(sums, [(s, u) for u in keys], np.hstack(wide))
            if len(sums) > FLUSH_UNITS:
                yield _partial_frame([(s, u, 0, v) for (s, u), v in sums.items()])
                sums.clear()
        yield _partial_frame([(s, u, 0, v) for (s, u), v in sums.items()])

    def expand(parts: dict[str, np.ndarray]):
        total: dict[str, np.ndarray] = {}
        for pattern, vec in parts.items():
            at = q
            for member in fitted(pattern):
                own = (q + 1) * len(absorbed[member])
                total[member] = total.get(member, 0.0) + np.concatenate([vec[:q], vec[at : at + own]])
                at += own
        for member, vec in total.items():
            z, models = vec[:q], vec[q:].reshape(-1, q + 1)
            scores = (m[1:] - z * (m[0] / z[0]) if is_absorbed else m[1:] for m, is_absorbed in zip(models, absorbed[member]))
            yield member, [(k, score, 1.0) for k, score in enumerate(scores)]

    _, stacks, _ = _collect(sample.mapInPandas(partial, PARTIAL), q, n_models, expand)
    return stacks
