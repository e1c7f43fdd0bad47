"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.session import release, settle, settled

#: Rows and bytes of texts, or of pairs of sets, that a task hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Runs of anything but ASCII white space, as ``bytes.split()`` takes them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> dict[str, str]:
    """From now on Arrow batches have few rows and bytes; returns what held before."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in bounds}
    for name, value in bounds.items():
        spark.conf.set(name, str(value))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for tables that are written inside the block; then as before."""
    before = bound_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself; one shuffle."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, root) per node.

    ``root`` is the smallest node reachable.  Rounds of large and small stars:
    every step is a minimum by key, which Spark folds before the shuffle, and an
    equality join, so a node with very many links is never gathered in a task.
    Each round is written to the shared folder, and only the last stays there.
    Nodes must not be null.
    """
    since = settled()
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    while not _are_stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = settle(
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "links",
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = settle(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        release(links.sparkSession, since, keep=1)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def pack(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``_row`` beside ``more``, so that no name can clash."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(k) for k, c in more.items()])


def unpack(df: DataFrame, columns: list[str], *outputs: str) -> DataFrame:
    """Back from ``pack``: ``columns`` but for those that ``outputs`` replace, then ``outputs``."""
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c not in outputs]
    return df.select(*kept, *outputs)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
