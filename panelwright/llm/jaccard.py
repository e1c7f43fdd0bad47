"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

Sets whose fingerprints are close are found by the generalised pigeonhole principle
and linked if the whole sets are similar.  Similar sets may differ in many bits, so
what is unconnected then is compared under its rarest shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import connected, small_batches
from panelwright.llm.simhash import keep_groups, near_links
from panelwright.session import drop_leftovers, release, scratch_path, settle, settled

#: Words of a shingle, and least similarity of two texts that link.
WORDS, LEAST = 5, Fraction(4, 5)
#: Bits in which fingerprints differ at most for their sets to be compared first.
BITS_APART = 3
#: Sets up to this number under one shingle are compared each with each, more with some of them per round.
SMALL = 16
#: Sets of a large bucket that all others are compared with in a round, each from other components.
HEADS = 4
#: Rounds after which large buckets, too, are compared each with each. Every round costs many small jobs.
ROUNDS = 2
#: One of so many sets says which shingles are common, and most shingles that are noted as such; they only order the prefixes.
SAMPLED, MAX_COMMON = 16, 100_000
#: Numbers that a task holds before it sends them on.
FLUSH = 1 << 18


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    width = min(words, len(w))
    g = np.zeros(len(w) - width + 1, np.uint64)
    for i in range(width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(g ^ (g >> np.uint64(32)))


def _set_id(g: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(g.tobytes()), np.uint64).view(np.int64))


def _fingerprint(g: np.ndarray) -> int:
    """SimHash of a set of shingle hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(g), 1 << 14):
        ones += np.unpackbits(g[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(g), bitorder="little").view(np.int64)[0])


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("k1"), F.xxhash64(text).alias("k2"), F.col(text).alias("t"))


def _grams(t, words: int) -> np.ndarray:
    return shingles(t.as_buffer().to_pybytes() if t.is_valid else None, words)


def _prints(words: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids, n, fps, some = [], [], [], []
            for t in b.column("t"):
                g = _grams(t, words)
                s = _set_id(g)
                shown = s % SAMPLED == 0 and s not in seen
                if shown:
                    seen.add(s)
                ids.append(s)
                n.append(len(g))
                fps.append(_fingerprint(g))
                some.append(g.view(np.int64) if shown else None)
            arrays = [*(pa.array(x, pa.int64()) for x in (ids, n, fps)), pa.array(some, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *arrays], ["k1", "k2", "s", "n", "fp", "some"])

    return fn


def prefix(g: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: Fraction) -> tuple[np.ndarray, int]:
    """Rarest shingles of a set, and where the last of them stands in the order of all (31 bits).

    Similar sets share one of them, whatever the order, if all sets keep to it.
    """
    if not len(g):
        return g, 0
    hashes, level = common
    rank = np.zeros(len(g), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
        rank = np.where(hashes[at] == g, level[at], 0)
    order = np.lexsort((g, rank))[: len(g) - -(-least.numerator * len(g) // least.denominator) + 1]
    last = order[-1]
    return g[order], min(int(rank[last]), 31) << 26 | int(g[last] >> np.uint64(38))


def _listed(words: int, choose):
    """Rows (g, s, n, e) of the shingles that ``choose`` takes of every set; a task lists equal sets once."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for t in itertools.chain.from_iterable(b.column("t") for b in batches):
            g = _grams(t, words)
            s = _set_id(g)
            if s in seen:
                continue
            seen.add(s)
            use, end = choose(g)
            held.append((use, s, len(g), end))
            size += len(use)
            if size >= FLUSH:
                yield listed(held)
                held, size = [], 0
        if held:
            yield listed(held)

    def listed(held) -> pa.RecordBatch:
        times = [len(h[0]) for h in held]
        s, n, e = (np.repeat(np.array([h[k] for h in held], kind), times) for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held]).view(np.int64)), pa.array(s), pa.array(n), pa.array(e)], ["g", "s", "n", "e"])

    return fn


def _sets(words: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids, sets, size = set(), [], [], 0
        for t in itertools.chain.from_iterable(b.column("t") for b in batches):
            g = _grams(t, words)
            s = _set_id(g)
            if s in seen:
                continue
            seen.add(s)
            ids.append(s)
            sets.append(g.tobytes())
            size += len(g)
            if size >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["s", "grams"])
                ids, sets, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["s", "grams"])

    return fn


def _verify(least: Fraction):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return fn


def _pairs(x: DataFrame, y: DataFrame, keep: str, least: Fraction) -> DataFrame:
    """Pairs a < b of sets under one shingle, of sizes that allow the similarity; once for each shingle."""
    x = x.select("g", *[F.col(c).alias(f"{c}1") for c in "snre"])
    y = y.select("g", *[F.col(c).alias(f"{c}2") for c in "snre"])
    near = f"{least.denominator} * least(n1, n2) >= {least.numerator} * greatest(n1, n2)"
    both = x.join(y, "g").where(f"{keep} AND r1 <> r2 AND {near}")
    low, high = (F.when(F.col("s1") < F.col("s2"), F.struct(*(F.col(f"{c}{k}").alias(c) for c in "sne"))).otherwise(F.struct(*(F.col(f"{c}{3 - k}").alias(c) for c in "sne"))) for k in (1, 2))
    return both.select(low.alias("x"), high.alias("y"))


def _enough(pairs: DataFrame, counted: DataFrame, hot: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) that may share enough of their prefixes.

    Of the set whose prefix ends first in the order of all shingles, every prefix
    shingle that the other's prefix lacks is missing from the other set, too.
    ``counted`` has the shared shingles that few sets have, pair by pair; those of
    many sets are not counted for a pair: as many as both sets have may be shared.
    """
    more = [hot.select(F.col("s").alias(k), F.col("h").alias(f"h_{k}")) for k in ("a", "b")]
    known = pairs.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), "x", "y").join(counted, ["a", "b"], "left").join(more[0], "a", "left").join(more[1], "b", "left")
    shared = F.coalesce("c", F.lit(0)) + F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
    num, den = least.numerator, least.denominator
    overlap = F.expr(f"({num} * (x.n + y.n) + {num + den - 1}) div {num + den}")

    def fits(k: str):
        width = F.expr(f"{k}.n - ({num} * {k}.n + {den - 1}) div {den} + 1")
        return width - shared <= F.col(f"{k}.n") - overlap

    ok = F.when(F.col("x.e") < F.col("y.e"), fits("x")).when(F.col("x.e") > F.col("y.e"), fits("y")).otherwise(F.lit(True))
    return known.where(ok).select("a", "b")


def _close_prints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with equal or close fingerprints, as many as connect them."""
    sets = settle(prints.where("n > 0").select("s", "fp").distinct(), "prints")
    of_fp = settle(sets.groupBy("fp").agg(F.min("s").alias("h")), "prints")
    close = near_links(of_fp.select("fp"), BITS_APART)
    left, right = (of_fp.select(F.col("fp").alias(k), F.col("h").alias(f"h_{k}")) for k in ("a", "b"))
    near = close.join(left, "a").join(right, "b").select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b"))
    same = sets.join(of_fp, "fp").where("s <> h").select(F.col("h").alias("a"), F.col("s").alias("b"))
    return near.union(same).distinct()


def similar_links(docs: DataFrame, prints: DataFrame, words: int = WORDS, least: Fraction = LEAST, text: str = "text") -> DataFrame:
    """Links (a, b) that connect the distinct shingle sets of Jaccard similarity ``least`` or more.

    Every such pair is connected by them, and no other is but by steps of such
    pairs; sets that were connected early are linked to one of them.  Of two similar sets
    each has a shingle of the other among its rarest n - ceil(least n) + 1.  Sets
    are listed under these; those under one shingle that share enough of their
    prefixes are candidates, only their texts are read again, and the whole sets
    decide.  Under a shingle of many sets, ``HEADS`` of them are compared with all
    others; what remains unconnected goes on to the next round.  Sets that SimHash
    has connected before are not paired again.  ``prints`` names the set and the
    fingerprint of every text.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text)
    sampled = prints.where("some IS NOT NULL").dropDuplicates(["s"]).select(F.explode("some").alias("g"))
    often = sampled.groupBy("g").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "g").limit(MAX_COMMON).toArrow()
    hashes = often.column("g").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    level = np.frexp(often.column("c").to_numpy().astype(float))[1].astype(np.int64)
    shared = spark.sparkContext.broadcast((hashes[order], level[order]))
    text_of = settle(prints.groupBy("s").agg(F.min("k2").alias("k2")), "text-of")
    kind, kept = "s bigint, grams binary", scratch_path(spark, "sets")
    whole = spark.createDataFrame([], kind)

    def verified(tried: DataFrame) -> DataFrame:
        """Pairs (a, b) whose whole sets are similar."""
        nonlocal whole
        wanted = tried.select(F.col("a").alias("s")).union(tried.select("b")).distinct().join(whole.select("s"), "s", "left_anti")
        wanted = settle(wanted.join(text_of, "s"), "wanted")
        if not wanted.isEmpty():  # sets of earlier rounds are at hand
            more = texts.join(wanted.select("k2").distinct(), "k2", "left_semi").select("t").mapInArrow(_sets(words), kind)
            more.dropDuplicates(["s"]).join(wanted.select("s"), "s", "left_semi").write.mode("append").parquet(kept)
            whole = spark.read.schema(kind).parquet(kept)
        # Only sets of this round travel; their ids are few next to the sets.
        x, y = (whole.join(tried.select(F.col(k).alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias(k), F.col("grams").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        full = tried.join(x, "a").join(y, "b")
        return settle(full.mapInArrow(_verify(least), "a bigint, b bigint"), "links")

    # Close fingerprints first: one set stands for those of its fingerprint.
    links = verified(settle(_close_prints(prints), "pairs"))
    roots = settle(connected(links), "roots")
    drop_leftovers(spark)
    rows = texts.select("t").mapInArrow(_listed(words, lambda g: prefix(g, shared.value, least)), "g bigint, s bigint, n int, e int")
    rows = rows.repartition("g").groupBy("g", "s").agg(F.first("n").alias("n"), F.first("e").alias("e")).withColumn("m", F.count("*").over(Window.partitionBy("g")))
    rows = rows.where("m > 1")
    live = settle(rows.join(roots, rows.s == roots.node, "left").select("g", "s", "n", "e", "m", F.coalesce("root", "s").alias("r")), "listed")
    # Shared shingles of few sets, pair by pair, and how many of many sets a set has: as at first.
    rare = live.where(F.col("m") <= SMALL)
    counted = _pairs(rare, rare, "s1 < s2", least).groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg(F.count("*").alias("c"))
    counted = settle(counted, "counted")
    hot = settle(live.where(F.col("m") > SMALL).groupBy("s").agg(F.count("*").alias("h")), "hot")

    for turn in itertools.count():
        drop_leftovers(spark)
        small, large = (live, live.where("false")) if turn == ROUNDS else (live.where(F.col("m") <= SMALL), live.where(F.col("m") > SMALL))
        first = large.groupBy("g", F.pmod(F.xxhash64("r"), F.lit(HEADS)).alias("p")).agg(F.min(F.struct("s", "n", "r", "e")).alias("h")).select("g", "h.*")
        close = _pairs(small, small, "s1 < s2", least).union(_pairs(first, large, "s1 <> s2", least)).distinct()
        tried = settle(_enough(close, counted, hot, least), "pairs")
        fresh = verified(tried)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(fresh)  # stars so far, and what is new
        if turn == ROUNDS or large.isEmpty():
            return links
        rest = large.join(first, ["g", "s"], "left_anti").drop("m")
        if not fresh.isEmpty():  # else what is connected is as it was
            roots = settle(connected(links), "roots")
            rest = rest.drop("r").join(roots, rest.s == roots.node, "left").select("g", "s", "n", "e", F.coalesce("root", "s").alias("r"))
        counts = rest.groupBy("g").agg(F.count("*").alias("m"), F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high").select("g", "m")
        live = settle(rest.join(counts, "g").select("g", "s", "n", "e", "m", "r"), "listed")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: Fraction = LEAST, text: str = "text") -> DataFrame:
    """One row per row of ``docs`` (``doc_id``): ``k2`` (hash of its text), ``component_id`` and ``root``.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles
    is at least ``least``; linked texts share ``component_id``, the smallest doc
    id among them (null ids are passed over).  Texts without words are one group.
    Shingles are compared by 64-bit hashes.  Repeated rows and null ids are rows
    like others: copies are one set.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, least, text)


def _near_duplicates(docs: DataFrame, words: int, least: Fraction, text: str) -> DataFrame:
    found = _texts(docs, text).mapInArrow(_prints(words), "k1 bigint, k2 bigint, s bigint, n bigint, fp bigint, some array<bigint>")
    prints = settle(found, "prints")
    distinct = settle(prints.groupBy("s").agg(F.min("k1").alias("first")), "prints")
    roots = connected(similar_links(docs, prints, words, least, text))
    of_set = settle(distinct.join(roots, distinct.s == roots.node, "left").select("s", "first", F.coalesce("root", "s").alias("root")), "roots")
    classes = of_set.join(of_set.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("s", "component_id", "root")
    return prints.join(classes, "s").select(F.col("k1").alias("doc_id"), "k2", "component_id", "root")


def keep_one(docs: DataFrame, words: int = WORDS, least: Fraction = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts, chosen as ``simhash.keep_one`` does."""
    since = settled()
    kept = keep_groups(docs, near_duplicates(docs, words, least, text), text)
    release(docs.sparkSession, since, keep=1)  # only the keepers, settled last, are read again
    return kept
