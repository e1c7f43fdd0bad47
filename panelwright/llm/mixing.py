"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import pack, unpack
from panelwright.session import settle

#: Rows of one seeded bucket; only the bucket in which a quota ends is read row by row.
BUCKET_ROWS = 1000
#: Most (membership pattern, source) pairs that the driver's flow network takes.
MAX_ARCS = 20_000
#: Documents picked beyond the cut to come nearer to a quota.
EXTRAS = 64


def quotas(sizes: dict, weights: Sequence[float], most: int, total: float) -> dict:
    """Targets by source: ``total`` shared by weight, capped at ``most`` x size, excess reshared.

    Sources are ordered by code point, None last; weights repeat in that order.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, rest = list(order), float(total)
    while left:
        whole = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / whole > most * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / whole for s in left}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        rest = max(0.0, rest - sum(out[s] for s in over))
        left = [s for s in left if s not in over]
    return out


def route(capacity: dict, quota: dict, most: int) -> dict:
    """Min-cost flow from membership patterns to sources.

    The r-th repetition of a pattern's words costs r - 1 per word, so words are
    repeated only when every unrepeated word that a source may take is used, and
    evenly.  Returns the words sent by (pattern, source).  Successive cheapest
    paths with node potentials.
    """
    patterns, sources = list(capacity), list(quota)
    node = {("p", p): i + 1 for i, p in enumerate(patterns)} | {
        ("s", s): i + 1 + len(patterns) for i, s in enumerate(sources)
    }
    sink = len(node) + 1
    to: list[int] = []
    cap: list[float] = []
    cost: list[float] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a, b, c, w):
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0.0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)

    sent = {}
    for p in patterns:
        for r in range(most):
            arc(0, node["p", p], float(capacity[p]), float(r))
        for s in p:
            sent[p, s] = len(to)
            arc(node["p", p], node["s", s], float("inf"), 0.0)
    for s in sources:
        arc(node["s", s], sink, float(quota[s]), 0.0)
    potential = [0.0] * (sink + 1)
    while True:
        dist, via = [float("inf")] * (sink + 1), [-1] * (sink + 1)
        dist[0], heap = 0.0, [(0.0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                nd = d + cost[e] + potential[a] - potential[to[e]]
                if cap[e] > 1e-6 and nd < dist[to[e]] - 1e-12:
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if via[sink] < 0:
            break
        potential = [x + (d if d < float("inf") else dist[sink]) for x, d in zip(potential, dist, strict=True)]
        path, a = [], sink
        while a:
            path.append(via[a])
            a = to[via[a] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return {k: cap[e ^ 1] for k, e in sent.items()}


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the quota of a pair ends within its last bucket: a hash to stay below, and single picks beyond it."""
    rows = pdf.groupby("_h", sort=True)["_size"].sum()
    gap, below, over, extras = float(pdf["_gap"].iloc[0]), None, 0.0, []
    for h, n in rows.items():
        if n <= gap:
            gap -= n
            if below is not None and n:
                extras.append(int(h))
                if len(extras) == EXTRAS:
                    break
        elif below is None:
            below, over = int(h), n - gap
    if below is not None and over < gap:  # the row at the cut overshoots by less than is missing without it
        below, extras = below + 1, []
    if below is None:
        below = int(rows.index[-1]) + 1 if len(rows) and rows.index[-1] < 2**62 else 2**62
    return pd.DataFrame({"_pair": [pdf["_pair"].iloc[0]], "_below": [below], "_extras": [extras]})


def mix(
    docs: DataFrame,
    size: Column,
    members: Column,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 17,
    key: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``docs`` with what the mix takes of every row.

    ``size`` (words) and ``members`` (array of the sources a row belongs to, null
    being a source of its own; null or empty array: none) are expressions on
    ``docs``.  Added columns: ``mix_size``, ``mix_source`` (the source that takes
    the row), ``mix_source_size``, ``mix_target`` (of that source), ``mix_repeats``
    (0 to ``max_repeats``) and ``mix_taken`` (size x repeats); they replace columns of these names.

    Rows are folded to one row per membership pattern; the driver routes words
    from patterns to source quotas (at most ``MAX_ARCS`` pairs, else an error).
    Within a pair all rows are repeated floor(quota / size) times and, in the
    order of a seeded hash of ``key``, once more until the quota is met.  The
    order is cut by sums over hash buckets, so no source is ever sorted in one
    task: only the one bucket where the quota ends is read row by row.

    Rows of size 0 take 0.  Rows that agree in the whole ``key`` share their fate, so
    a key should tell rows apart: where ids may be null or repeated, name the text
    in it as well.  An empty table gives an empty result.  Results do not depend on partitioning.
    """
    spark = docs.sparkSession
    span = 2**62
    # Source names as strings, null encoded apart from any name.
    tag = F.array_sort(F.array_distinct(F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("~")))))
    hashed = F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    picked = F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in key])
    sized = pack(
        docs,
        mix_size=F.coalesce(size.cast("bigint"), F.lit(0)),
        _pattern=tag,
        _h=F.shiftrightunsigned(hashed, 2),
        _pick=picked,
    )
    slim = settle(sized.select(F.col("mix_size").alias("_size"), "_pattern", "_h", "_pick"), "mix")
    totals = slim.groupBy("_pattern").agg(F.sum("_size").alias("n"), F.count("*").alias("k")).limit(MAX_ARCS + 1).collect()
    if sum(len(r["_pattern"]) for r in totals) > MAX_ARCS:
        raise ValueError(f"more than {MAX_ARCS} pairs of membership pattern and source")
    back = lambda t: None if t == "~" else t[1:]
    capacity = {tuple(back(t) for t in r["_pattern"]): int(r["n"]) for r in totals}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = quotas(sizes, weights, max_repeats, sum(n for p, n in capacity.items() if p))
    flow = route(capacity, target, max_repeats)

    # Rows of a pattern are dealt to its sources in proportion to the flow.
    pairs, deal = [], []
    for p in capacity:
        whole, at, choices = sum(flow[p, s] for s in p), 0.0, []
        for s in p:
            at += flow[p, s] / whole if whole else 1 / len(p)
            choices.append((float(at), len(pairs)))
            pairs.append((len(pairs), s, int(sizes[s]), float(target[s]), float(flow[p, s])))
        if choices:
            choices[-1] = (2.0, choices[-1][1])
        deal.append((["~" if s is None else "=" + s for s in p], choices))
    # At most MAX_ARCS pairs: broadcast, so that no text is shuffled.
    deal_df = spark.createDataFrame(deal, "_pattern array<string>, _choices array<struct<upto:double,pair:int>>")
    pair_df = spark.createDataFrame(pairs, "_pair int, mix_source string, mix_source_size bigint, mix_target double, _quota double")
    draw = F.pmod(F.col("_pick"), F.lit(2**40)) / F.lit(float(2**40))
    pair_of = F.filter("_choices", lambda c: c["upto"] > draw)[0]["pair"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(deal_df), "_pattern", "left").withColumn("_pair", pair_of).drop("_choices", "_pattern", "_pick")

    buckets = max(1, sum(r["k"] for r in totals) // BUCKET_ROWS)
    placed = dealt(slim).withColumn("_b", F.floor(F.col("_h") / F.lit(span / buckets)))
    sums = placed.groupBy("_pair", "_b").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy("_pair").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    running = settle(sums.withColumns({"_from": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("_pair"))}), "mix-sums")
    facts = running.groupBy("_pair").agg(F.first("_all").alias("_all")).join(pair_df, "_pair")
    facts = facts.withColumn("_base", F.when(F.col("_all") > 0, F.least(F.lit(max_repeats), F.floor((F.col("_quota") + 1e-6) / F.col("_all")))).otherwise(0))
    facts = facts.withColumn("_rest", F.when(F.col("_base") < max_repeats, F.greatest(F.lit(0.0), F.col("_quota") - F.col("_base") * F.col("_all"))).otherwise(0.0))
    ends = running.join(facts.select("_pair", "_rest"), "_pair").where("_from <= _rest AND _rest < _from + _n")
    last = placed.join(ends.select("_pair", "_b", (F.col("_rest") - F.col("_from")).alias("_gap")), ["_pair", "_b"])
    last = last.groupBy("_pair", "_h").agg(F.sum("_size").alias("_size"), F.first("_gap").alias("_gap"))
    cuts = last.groupBy("_pair").applyInPandas(_cut, "_pair int, _below long, _extras array<long>")
    decided = settle(facts.join(cuts, "_pair", "left").select("_pair", "mix_source", "mix_source_size", "mix_target", "_base", F.coalesce("_below", F.lit(0)).alias("_below"), F.coalesce("_extras", F.array().cast("array<bigint>")).alias("_extras")), "mix-cuts", files=1)

    more = (F.col("_h") < F.col("_below")) | F.array_contains("_extras", F.col("_h"))
    repeats = F.coalesce(F.col("_base") + more.cast("bigint"), F.lit(0)).cast("bigint")
    out = (
        dealt(sized)
        .join(F.broadcast(decided), "_pair", "left")
        .withColumn("mix_repeats", F.when(F.col("mix_size") > 0, repeats).otherwise(F.lit(0)))
        .withColumn("mix_taken", F.col("mix_size") * F.col("mix_repeats"))
    )
    return unpack(out, docs.columns, "mix_size", "mix_source", "mix_source_size", "mix_target", "mix_repeats", "mix_taken")
