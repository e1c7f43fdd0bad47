"""Exact interpolated quantiles and quantile buckets.

``percentile`` keeps the distinct values of a column in one buffer.  It is used
for columns with a bounded number of them, which is measured first (a signal has
one value per day, an attribute one per unit).  Other columns, and quantiles per
group, are selected by counting: a pass folds all values to a histogram of fixed
width, the bin that holds the wanted order statistic becomes the bracket of the
next pass, and a bracket of few rows is looked up.  No task ever holds more rows
of one key than a histogram has bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as fv
from panelwright.session import settle

# Columns with more distinct values than this are selected by counting.
MAX_DISTINCT = 100_000
# Bins of a histogram, and rows of a bracket that are looked up without another pass.
BINS, GATHER = 1_024, 4_096


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value) rows, unknown values left out; no shuffle."""
    return (
        df.select([F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], list(columns), "variable", "value")
        .where(F.col("value").isNotNull())
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float],
    max_distinct: int = MAX_DISTINCT,
) -> DataFrame:
    """(variable, prob, quantile), linear interpolation between order statistics."""
    columns, probs = list(columns), [float(p) for p in probs]
    wide = df.select([F.col(c).cast("double").alias(c) for c in columns])
    sizes = wide.agg(
        *[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)]
    ).first()
    few = [c for i, c in enumerate(columns) if sizes[i] <= max_distinct]
    many = [c for c in columns if c not in few]
    if not many:
        return _direct(wide, few, probs)
    selected = select_quantiles(unpivot(wide, many), ["variable"], probs)
    return _direct(wide, few, probs).unionByName(selected) if few else selected


def _direct(wide: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    grid = F.array(*[F.lit(p) for p in probs])
    rows = wide.agg(*[F.percentile(c, grid).alias(c) for c in columns]).unpivot(
        [], columns, "variable", "q"
    )
    return (
        rows.where(F.col("q").isNotNull())
        .select("variable", F.posexplode("q").alias("k", "quantile"))
        .select("variable", F.element_at(grid, F.col("k") + 1).alias("prob"), "quantile")
    )


def _magnitude(value: Column) -> Column:
    """Bin of a value by sign and power of two: never falls as the value grows."""
    size = F.greatest(F.least(F.log2(F.abs(value)), F.lit(1100.0)), F.lit(-1090.0))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * F.floor(size + 1100)).cast("int")


def _slot(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value among ``bins`` of equal width; both ends of the bracket differ in theirs."""
    return F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def fold(values: DataFrame, by: Sequence[str], slot: Column) -> DataFrame:
    """One row per key and bin: how many values it holds, the least and the most."""
    return values.groupBy(*by, slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _histograms(folded: DataFrame, by: Sequence[str]) -> DataFrame:
    bins = F.array_sort(F.collect_list(F.struct("slot", "n", "low", "high")))
    return folded.groupBy(*by).agg(bins.alias("bins"))


# The bin that holds the row of a rank, and the rows before it.
_HOLDER = """
aggregate(
  bins,
  named_struct('before', cast(before AS bigint), 'n', cast(null AS bigint), 'low', cast(null AS double), 'high', cast(null AS double)),
  (a, b) -> CASE WHEN a.n IS NOT NULL THEN a
    WHEN a.before + b.n > rank THEN named_struct('before', a.before, 'n', b.n, 'low', b.low, 'high', b.high)
    ELSE named_struct('before', a.before + b.n, 'n', a.n, 'low', a.low, 'high', a.high) END)
"""


def _narrowed(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brackets (keys, total, low, high, before, n, ranks), one for all ranks in it."""
    held = ranked.withColumn("h", F.expr(_HOLDER)).select(*keys, "total", "rank", "h.*")
    return held.groupBy(*keys, "total", "low", "high", "before", "n").agg(F.collect_set("rank").alias("ranks"))


def select_quantiles(values: DataFrame, keys: Sequence[str], probs: Sequence[float], bins: int = BINS, gather: int = GATHER) -> DataFrame:
    """(keys, prob, quantile) of ``values`` (keys, value), linear between order statistics.

    The first pass bins by sign and power of two, later ones cut a bracket into
    ``bins`` of equal width, so a pass narrows it by that factor and six passes
    tell any two numbers apart.  Keys may be as many as there are groups: brackets
    are a table.  Unknown values, NaN and unknown keys are left out.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    known = values.where(F.col("value").isNotNull() & ~F.isnan("value")).dropna(subset=keys)
    position = F.expr("(total - 1) * prob")
    grid = F.array(*[F.lit(p) for p in probs])
    wanted = F.array_distinct(
        F.flatten(F.transform(grid, lambda p: F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p))))
    )
    whole = _histograms(fold(known, keys, _magnitude(F.col("value"))), keys)
    total = F.aggregate("bins", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    ranked = whole.withColumn("total", total).withColumn("rank", F.explode(wanted)).withColumn("before", F.lit(0))
    brackets = settle(_narrowed(ranked, keys), "brackets")
    is_open = (F.col("low") < F.col("high")) & (F.col("n") > gather)
    while not brackets.where(is_open).isEmpty():
        wide = brackets.where(is_open)
        inside = _inside(known, wide, keys)
        found = _histograms(fold(inside, [*keys, "b_low", "b_high"], _slot(F.col("value"), F.col("b_low"), F.col("b_high"), bins)), [*keys, "b_low", "b_high"])
        old = wide.select(*keys, F.col("low").alias("b_low"), F.col("high").alias("b_high"), "total", "before", F.explode("ranks").alias("rank"))
        narrowed = _narrowed(old.join(found, [*keys, "b_low", "b_high"]), keys)
        brackets = settle(brackets.where(~is_open).unionByName(narrowed), "brackets")
    ranks = brackets.select("*", F.explode("ranks").alias("rank"))
    sure = ranks.where("low = high").select(*keys, "total", "rank", F.col("low").alias("value"))
    few = brackets.where("low < high")
    listed = _inside(known, few, keys).groupBy(*keys, "b_low", "b_high").agg(F.sort_array(F.collect_list("value")).alias("values"))
    looked = ranks.where("low < high").withColumnsRenamed({"low": "b_low", "high": "b_high"}).join(listed, [*keys, "b_low", "b_high"])
    looked = looked.select(*keys, "total", "rank", F.expr("values[cast(rank - before AS int)]").alias("value"))
    by_rank = sure.unionByName(looked).groupBy(*keys, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    rows = by_rank.withColumn("prob", F.explode(grid)).withColumn("position", position)
    v0, v1 = (F.expr(f"at[cast({f}(position) AS bigint)]") for f in ("floor", "ceil"))
    share = F.col("position") - F.floor("position")
    return rows.select(*keys, "prob", F.when(share == 0, v0).otherwise(v0 + share * (v1 - v0)).alias("quantile"))


def _inside(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    edges = brackets.select(*keys, F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    return values.join(edges, list(keys)).where("value BETWEEN b_low AND b_high")


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """The q + 1 edges of equal-count buckets over all rows of ``df``."""
    probs = [i / q for i in range(q + 1)]
    rows = exact_quantiles(df, [column], probs).collect()
    by_prob = {r["prob"]: r["quantile"] for r in rows}
    return [by_prob[p] for p in probs] if by_prob else []


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str], merge: bool = False) -> Column:
    """Label of the right-closed bucket; the first one includes its lower edge.

    Equal edges leave a bucket empty: an error, unless ``merge`` drops the
    duplicate edges, in which case labels are bucket numbers.
    """
    edges = list(edges)
    distinct = sorted(set(edges))
    if len(distinct) < len(edges):
        if not merge:
            raise ValueError(
                f"quantile edges are not unique ({edges}); pass merge=True for fewer buckets"
            )
        edges = distinct
        labels = [str(i + 1) for i in range(len(edges) - 1)]
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bucket is needed")
    out = F.when(value < edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= upper, F.lit(label))
    return out


def add_quintile(df: DataFrame, column: str = "signal_z", out: str = "quintile", merge: bool = False) -> DataFrame:
    edges = quantile_edges(df, column, len(fv.QUINTILE_LABELS))
    return df.withColumn(out, bucket(F.col(column), edges, fv.QUINTILE_LABELS, merge))


def add_quartiles(df: DataFrame, columns: Sequence[str], merge: bool = False) -> DataFrame:
    """``<column>_quartile`` for each column; all edges come from one pass."""
    q = len(fv.QUARTILE_LABELS)
    probs = [i / q for i in range(q + 1)]
    rows = exact_quantiles(df, columns, probs).collect()
    by = {(r["variable"], r["prob"]): r["quantile"] for r in rows}
    return df.withColumns(
        {
            f"{c}_quartile": bucket(
                F.col(c), [by[c, p] for p in probs], fv.QUARTILE_LABELS, merge
            )
            for c in columns
        }
    )


def trim_tails(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose value lies within the two percentiles, ends included."""
    rows = exact_quantiles(df, [column], [low, high]).collect()
    by = {r["prob"]: r["quantile"] for r in rows}
    return df.where(F.col(column).between(by[low], by[high]))
