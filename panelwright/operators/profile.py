"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.quantiles import exact_quantiles, select_quantiles
from panelwright.session import settle

PROFILE_PROBS = (0.25, 0.5, 0.75)


def number_rows(table: DataFrame, *order) -> DataFrame:
    """Ordinal of each row of a small result table (a row per year, model, ...)."""
    return table.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_rows, n, mean, std, min, max): one row of aggregates over the
    whole table, turned into one row per column afterwards."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        v = f"double(`{c}`)"
        aggs.append(
            F.expr(
                f"struct('{c}' AS variable, count({v}) AS n, avg({v}) AS mean, "
                f"stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max)"
            ).alias(f"c{i}")
        )
    wide = df.agg(*aggs)
    cells = F.array(*[F.col(f"c{i}") for i in range(len(columns))])
    return wide.select("n_rows", F.explode(cells).alias("c")).select("n_rows", "c.*")


def describe(df: DataFrame, columns: Sequence[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """One row per numeric column: counts, moments and exact quartiles.

    Columns without any value are left out.
    """
    columns = [c for c in columns if c in df.columns]
    quartiles = (
        exact_quantiles(df, columns, PROFILE_PROBS)
        .groupBy("variable")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
                for p, name in zip(PROFILE_PROBS, ("p25", "median", "p75"))
            ]
        )
    )
    missing = F.col("n_rows") - F.col("n")
    table = _moments(df, columns).join(quartiles, "variable").select(
        "variable",
        "n",
        missing.alias("n_missing"),
        (missing / F.col("n_rows") * 100).alias("pct_missing"),
        "mean", "std", "min", "p25", "median", "p75", "max",
    )
    if kinds:
        kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        table = table.withColumn("variable_type", kind[F.col("variable")])
    return table


def describe_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, the most common one (first in order on ties) and its count."""
    long = (
        df.select([F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "variable", "value")
        .where(F.col("value").isNotNull())
    )
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    # The smallest (-count, value) is the most common value, ties by name.
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return (
        counts.groupBy("variable")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), best.alias("best"))
        .select(
            "variable", "n", "n_unique",
            F.col("best.value").alias("most_common"),
            (-F.col("best.neg")).alias("most_common_count"),
        )
    )


def short_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, range and count per column."""
    return _moments(df, columns).drop("n_rows")


def grouped_stats(df: DataFrame, by: str, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Rounded mean and deviation per group, and the count of the first column."""
    aggs = [F.count(columns[0]).alias("n")]
    for c in columns:
        aggs += [
            F.round(F.avg(c), digits).alias(f"{c}_mean"),
            F.round(F.stddev_samp(c), digits).alias(f"{c}_std"),
        ]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs)


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed."""
    known = df.where(F.col(column).isNotNull())
    ends = known.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    raw = F.floor((F.col(column) - lo) / ((hi - lo) / bins)).cast("int")
    return (
        known.select(F.least(raw, F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles, mean and whisker ends (within 1.5 box heights) per group.

    Groups may be of any type and number, and one may hold most of the rows:
    quartiles are selected by counting, then one aggregation finds the whiskers.
    """
    rows = df.select(F.col(by).alias("k"), F.col(column).cast("double").alias("value")).dropna()
    quart = select_quantiles(rows, ["k"], PROFILE_PROBS).groupBy("k").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for p, name in zip(PROFILE_PROBS, ("q1", "median", "q3"))
        ]
    )
    fence = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("value")
    stats = (
        rows.join(settle(quart, "quartiles"), "k")
        .groupBy("k", "q1", "median", "q3")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.min(F.when(value >= F.col("q1") - fence, value)).alias("whisker_low"),
            F.max(F.when(value <= F.col("q3") + fence, value)).alias("whisker_high"),
        )
    )
    return stats.select(F.col("k").alias(by), *stats.columns[1:])


def sample_rows(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Seeded random sample, for callers that ask for one.

    A row stays if the md5 of seed and key, as a number below 2^32, falls under
    the fraction: the same rows in any engine, order and partitioning.
    """
    return df.where(_drawn(key, seed, 8) < F.lit(int(fraction * 2**32)))


def _drawn(key: Sequence[str], seed: int, digits: int) -> Column:
    """The first hexadecimal digits of the md5 of seed and key as a number."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A seeded random sample of exactly ``n`` rows, or all if there are no more.

    The rows with the smallest md5 of seed and key: the same in any engine, order
    and partitioning.  Where the cut lies is found by counting hashes by their
    leading digits, three at a time, within the digits known so far: a pass returns
    4,096 counts at most and nothing is sorted.  Rows that agree in the whole key
    are interchangeable.
    """
    digits, step = 15, 3
    hashed = df.withColumn("_drawn", _drawn(key, seed, digits))
    prefix, before = 0, 0  # the cut has these leading digits; rows below them
    for known in range(step, digits + 1, step):
        unit = 16 ** (digits - known)
        low = prefix * 16**step
        part = hashed.where(F.col("_drawn").between(low * unit, (low + 16**step) * unit - 1))
        counts = part.groupBy(F.expr(f"_drawn div {unit}").alias("at")).count().orderBy("at").collect()
        for r in counts:
            if before + r["count"] > n:
                prefix = r["at"]
                break
            before += r["count"]
        else:
            return df
        if before == n:
            return hashed.where(F.col("_drawn") < prefix * unit).drop("_drawn")
    rest = hashed.where(F.col("_drawn") == prefix).limit(n - before)
    return hashed.where(F.col("_drawn") < prefix).unionByName(rest).drop("_drawn")
