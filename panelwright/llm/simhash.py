"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import connected, pack, unpack
from panelwright.session import settle

BITS = 64
#: Numbers of parts that are tried; the cheapest by estimate is taken.
PARTS = (2, 3, 4)
#: Rows of one bucket that one task compares; a larger bucket is split into blocks.
BLOCK_ROWS = 4096
#: Runs up to this length are compared by shifting whole batches.
SHORT_RUN = 48


def fingerprint(text: str | bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    if text is None:
        return 0
    words = (text if isinstance(text, bytes) else text.encode()).lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``k1`` = doc id, ``k2`` = hash of the text, ``fp``."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["k1", "k2", "fp"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("k1"), F.xxhash64(text).alias("k2"), F.col(text).alias("t")).mapInArrow(fn, "k1 bigint, k2 bigint, fp bigint")


def _co_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        fps = b.column("fp").to_numpy().view(np.uint8).reshape(-1, 8)
        x = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
        total += x.T @ x
        n += len(x)
    i, j = np.indices((BITS, BITS))
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel() * BITS + j.ravel()), pa.array(total.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, n))], ["cell", "both", "n"])


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Near-equal groups of bits: the most correlated bit left starts a group and draws its closest ones."""
    strength = np.abs(corr) - np.eye(len(corr))
    left, groups = set(range(len(corr))), []
    for g in range(parts):
        width = len(left) // (parts - g)
        group = [max(sorted(left), key=lambda b: strength[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < width:
            nearest = max(sorted(left), key=lambda b: strength[b, group].sum())
            group.append(nearest)
            left.discard(nearest)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds (-1: part unused) with sum ``budget`` of least total cost, by dynamic programming."""
    best = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, extra in part.items():
                if used + t not in step or c + extra < step[used + t][0]:
                    step[used + t] = (c + extra, [*ts, t])
        best = step
    return best[budget]


def plan_parts(fps: DataFrame, distance: int) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each part, from counts over all fingerprints.

    Two records within ``distance`` differ in at most t_i bits of some part i if
    the t_i sum to distance - parts + 1.  The pairs that agree in a part are
    counted exactly; those within t are estimated from the bits' frequencies.
    """
    cells = fps.mapInArrow(_co_counts, "cell bigint, both bigint, n bigint").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for r in cells:
        both[r["cell"]], n = r["both"], r["n"]
    both = both.reshape(BITS, BITS) / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = (both - np.outer(p, p)) / np.outer(spread, spread)
    odds = 2 * p * (1 - p) / (1 - 2 * p * (1 - p))
    trials = {m: group_bits(corr, m) for m in PARTS if m <= distance + 1}
    masks = {(m, i): sum(1 << b for b in g) for m, groups in trials.items() for i, g in enumerate(groups)}
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    ids = list(masks)
    values = F.array(*[F.struct(F.lit(x).alias("id"), F.col("fp").bitwiseAND(F.lit(signed(masks[k]))).alias("v")) for x, k in enumerate(ids)])
    counts = fps.select(F.explode(values).alias("e")).groupBy("e.id", "e.v").agg(F.count("*").cast("double").alias("c"))
    agree = {ids[r["id"]]: r["pairs"] for r in counts.groupBy("id").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()}
    found = []
    for m, groups in trials.items():
        costs = []
        for i, g in enumerate(groups):
            near = [1.0] + [0.0] * distance  # elementary symmetric sums of the odds that a bit differs
            for b in g:
                for t in range(distance, 0, -1):
                    near[t] += near[t - 1] * odds[b]
            cost = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(math.comb(len(g), j) for j in range(t + 1))
                cost[t] = agree.get((m, i), 0.0) * sum(near[: t + 1]) + n * probes
            costs.append(cost)
        total, ts = allocate(costs, distance - m + 1)
        found.append((total, [(signed(masks[m, i]), g, t) for i, (g, t) in enumerate(zip(groups, ts, strict=True)) if t >= 0]))
    return min(found, key=lambda f: f[0])[1]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one bucket: each is met by search from a linked one."""
    out, rest = [], np.arange(len(fps))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            a = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[a]) <= distance
            hit = rest[near]
            out += [(int(fps[a]), int(fps[b])) for b in hit]
            front += hit.tolist()
            rest = rest[~near]
    return out


def _verify(distance: int):
    """Rows sorted by bucket -> links of at most ``distance`` differing bits."""

    def links(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(key)]
        a, b = [], []
        size = ends - starts
        short = np.repeat(size <= SHORT_RUN, size)
        run = np.repeat(np.arange(len(starts)), size)
        for d in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
            left = np.arange(len(key) - d)
            left = left[(run[left] == run[left + d]) & short[left]]
            if not len(left):
                break
            ok = np.bitwise_count(fps[left] ^ fps[left + d]) <= distance
            a.append(fps[left[ok]])
            b.append(fps[left[ok] + d])
        for s, e in zip(starts[size > SHORT_RUN], ends[size > SHORT_RUN], strict=True):
            pairs = _forest(fps[s:e], distance)
            a.append(np.array([x for x, _ in pairs], np.uint64))
            b.append(np.array([y for _, y in pairs], np.uint64))
        x, y = (np.concatenate([np.zeros(0, np.uint64), *v]).view(np.int64) for v in (a, b))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "v", "lo", "hi")], 1)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
            if cut:
                yield links(key[:cut], fps[:cut])
                key, fps = key[cut:], fps[cut:]
        if len(key):
            yield links(key, fps)

    return fn


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at most ``distance`` bits apart.

    Not all of them: every pair within the distance is connected by links.  Each
    fingerprint is indexed under its value in every part and probes the values
    within the part's threshold.  A bucket with many indexed rows is dealt into
    blocks, and every pair of blocks is compared on its own, so no bucket is
    gathered in one task and none is cut short.
    """
    parts = plan_parts(fps, distance)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def probes(i: int, mask: int, bits: list[int], t: int):
        flips = [signed(sum(1 << b for b in c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]
        value = F.col("fp").bitwiseAND(F.lit(mask))
        return F.transform(
            F.array(*[F.lit(f).cast("bigint") for f in flips]),
            lambda f: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(f).alias("v"), (f == 0).alias("own")),
        )

    each = [probes(i, *part) for i, part in enumerate(parts)]
    rows = fps.select("fp", F.explode(F.concat(*each)).alias("e")).select("fp", "e.*")
    full = rows.where("own").groupBy("part", "v").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK_ROWS)
    full = settle(full.select("part", "v", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks")), "full-buckets")
    if full.isEmpty():
        rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = rows.join(full, ["part", "v"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    keys = ["part", "v", "lo", "hi"]
    dealt = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_verify(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, text: str = "text") -> DataFrame:
    """One row per row of ``docs`` (``doc_id``): ``k2`` (hash of its text), ``fp`` and ``component_id``.

    Rows whose fingerprints are linked by steps of at most ``distance`` bits share
    ``component_id``, the smallest doc id among them (null ids are passed over;
    null if there is no other).  Texts without words have fingerprint 0 and link
    like any other; equal texts are one fingerprint, however many.
    """
    prints = settle(with_fingerprints(docs, text, shingle), "prints")
    distinct = settle(prints.groupBy("fp").agg(F.min("k1").alias("first")), "prints")
    roots = connected(near_links(distinct, distance))
    of_fp = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of_fp = settle(of_fp, "roots")
    least = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = of_fp.join(least, "root").select("fp", "component_id", "root")
    return prints.join(classes, "fp").select(F.col("k1").alias("doc_id"), "k2", "fp", "component_id", "root")


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates.

    The row with the smallest doc id stays (null last), then the smallest text
    hash; of rows that agree in both, one.  Columns stay as they are.
    """
    return keep_groups(docs, near_duplicates(docs, distance, shingle, text), text)


def keep_groups(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each ``root`` of ``groups`` (``doc_id``, ``k2``, ``root``), as ``keep_one`` chooses it."""
    found = settle(groups, "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k2")
    chosen = found.groupBy("root").agg(F.min(rank).alias("r"), F.count("*").alias("n"))
    same = found.groupBy("root", "doc_id", "k2").agg(F.count("*").alias("same"))
    pick = chosen.join(same, (chosen.root == same.root) & chosen.r.doc_id.eqNullSafe(same.doc_id) & (chosen.r.k2 == same.k2))
    pick = settle(pick.select(chosen.r.doc_id.alias("_id"), chosen.r.k2.alias("_k2"), "same"), "keepers")
    rows = pack(docs, _i=F.col("doc_id").cast("bigint"), _t=F.xxhash64(text))
    kept = rows.join(pick, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_k2")))
    once = kept.where("same = 1").unionByName(kept.where("same > 1").dropDuplicates(["_i", "_t"]))
    return unpack(once, docs.columns)
