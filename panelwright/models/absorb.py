"""Two absorbed effects: unit and day.

When one side has few levels (:data:`MAX_LEVELS`), its effects are solved exactly
from one pass of cross-products in which the other side is swept out.  When both
have many, the same normal equations are solved by conjugate gradients: a round is
one pass that joins the current direction to the rows by day, takes unit means in
a window that needs no shuffle, and folds the rest to days.  Only day tables are
written between rounds, so the plan of a round does not grow, and the number of
rounds follows from how well units and days mix, not from how many there are.
Neither way needs a design matrix with a column per day and unit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.models import moments
from panelwright.session import settle

# Levels of the smaller side that may become columns of a cross-product.
MAX_LEVELS = 1_000


def demean_two_way(
    sample: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Replace each column by its residual on unit and day effects.

    ``sample`` has stratum, unit and day, with one row per unit and day; it is
    read several times and should be a settled table.
    """
    for few, other in (("unit", "day"), ("day", "unit")):
        levels = sample.select(few).distinct().limit(max_levels + 1).collect()
        if len(levels) <= max_levels:
            return _solve(sample, list(columns), few, other, sorted(r[0] for r in levels))
    return demean_by_gradients(sample, columns)


def _solve(
    sample: DataFrame, columns: list[str], few: str, other: str, levels: list
) -> DataFrame:
    """Effects of the side with few levels by normal equations, then one demeaning."""
    spark = sample.sparkSession
    codes = spark.createDataFrame(
        [(v, i) for i, v in enumerate(levels)],
        f"{few} {sample.schema[few].dataType.simpleString()}, _code int",
    )
    coded = sample.join(F.broadcast(codes), few)  # at most max_levels rows
    layout = moments.Layout(
        (), ("_code",), {"_code": tuple(range(len(levels)))}, tuple(columns)
    )
    swept = coded.select(
        "stratum", F.col(other).cast("string").alias("unit"), "_code", *columns
    )
    rows = []
    n = len(levels)
    for stratum, m in moments.cross_moments(swept, layout).items():
        gram = m.raw - m.between
        # One level per connected part is free; whatever is chosen for it
        # cancels when the other side is demeaned.
        gamma = np.linalg.lstsq(
            gram[1 : n + 1, 1 : n + 1], gram[1 : n + 1, n + 1 :], rcond=1e-11
        )[0]
        rows += [(stratum, i, *map(float, gamma[i])) for i in range(n)]
    names = [f"_e_{c}" for c in columns]
    effects = spark.createDataFrame(
        rows, "stratum string, _code int, " + ", ".join(f"{e} double" for e in names)
    )
    left = coded.join(effects, ["stratum", "_code"])
    # A group of the other side has at most one row per level of this side.
    w = Window.partitionBy("stratum", other)
    out = left.select(
        *[c for c in sample.columns if c not in columns],
        *[
            (F.col(c) - F.col(e) - F.avg(F.col(c) - F.col(e)).over(w)).alias(c)
            for c, e in zip(columns, names)
        ],
    )
    return settle(out, "demeaned")


def demean_by_gradients(
    sample: DataFrame,
    columns: Sequence[str],
    tolerance: float = 1e-11,
    max_rounds: int = 500,
) -> DataFrame:
    """The same for any number of units and days, to a tolerance.

    The day effects of all columns are found at once, each column with a step
    length of its own, scaled by the rows of a day.  Parts of the panel that share
    neither units nor days need no care: a constant shifted between units and days
    of a part is in no residual.
    """
    columns = list(columns)
    at = range(len(columns))
    w = Window.partitionBy("stratum", "unit")
    kept = sample.repartition("stratum", "unit").persist(StorageLevel.MEMORY_AND_DISK)

    def folded(rows: DataFrame, values: Sequence[str], *more) -> DataFrame:
        """Sums by day of values without their unit means."""
        left = rows.withColumns({f"_l{i}": F.col(v) - F.avg(v).over(w) for i, v in enumerate(values)})
        return left.groupBy("stratum", "day").agg(*more, *[F.sum(f"_l{i}").alias(f"_q{i}") for i in at])

    # Effects g, what is left to explain r, and the direction d, one row per day.
    start = settle(folded(kept, columns, F.count(F.lit(1)).alias("_n")), "days")
    state = start.select(
        "stratum", "day", "_n",
        *[F.lit(0.0).alias(f"_g{i}") for i in at],
        *[F.col(f"_q{i}").alias(f"_r{i}") for i in at],
        *[(F.col(f"_q{i}") / F.col("_n")).alias(f"_d{i}") for i in at],
    )
    size = _sums(state, {i: F.col(f"_r{i}") * F.col(f"_r{i}") / F.col("_n") for i in at})
    first = dict(size)
    for _ in range(max_rounds):
        if all(size[i] <= tolerance**2 * first[i] for i in at):
            break
        directions = state.select("stratum", "day", *[f"_d{i}" for i in at])
        moved = folded(kept.select("stratum", "unit", "day").join(directions, ["stratum", "day"]), [f"_d{i}" for i in at])
        both = settle(state.join(moved, ["stratum", "day"]), "days")
        c = {(k, i): F.col(f"_{k}{i}") for k in "grdq" for i in at}
        along = _sums(both, {i: c["d", i] * c["q", i] for i in at})
        # A column that is explained already stays where it is.
        step = {i: size[i] / along[i] if along[i] > 0 and size[i] > tolerance**2 * first[i] else 0.0 for i in at}
        rest = {i: c["r", i] - F.lit(step[i]) * c["q", i] for i in at}
        fresh = _sums(both, {i: rest[i] * rest[i] / F.col("_n") for i in at})
        turn = {i: fresh[i] / size[i] if step[i] else 0.0 for i in at}
        state = both.select(
            "stratum", "day", "_n",
            *[(c["g", i] + F.lit(step[i]) * c["d", i]).alias(f"_g{i}") for i in at],
            *[rest[i].alias(f"_r{i}") for i in at],
            *[(rest[i] / F.col("_n") + F.lit(turn[i]) * c["d", i]).alias(f"_d{i}") for i in at],
        )
        size = {i: fresh[i] if step[i] else size[i] for i in at}
        if not any(step.values()):
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    others = [c for c in sample.columns if c not in columns]
    left = kept.join(state.select("stratum", "day", *[f"_g{i}" for i in at]), ["stratum", "day"])
    left = left.withColumns({f"_l{i}": F.col(v) - F.col(f"_g{i}") for i, v in enumerate(columns)})
    out = settle(left.select(*others, *[(F.col(f"_l{i}") - F.avg(f"_l{i}").over(w)).alias(v) for i, v in enumerate(columns)]), "demeaned")
    kept.unpersist()
    return out


def _sums(df: DataFrame, values: dict) -> dict[int, float]:
    row = df.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(str(i)) for i, v in values.items()]).first()
    return {i: row[str(i)] for i in values}
