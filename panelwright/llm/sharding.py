"""Two-pass external shuffle of records into shards."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import pack, unpack
from panelwright.session import scratch_path, settle

#: Bytes of records that one bucket holds on average; one task has it in memory.
BUCKET_BYTES = 16 << 20
#: Smallest number of buckets, so that small inputs are spread as well.
MIN_BUCKETS = 8


def _permute(seed: int):
    """Fisher-Yates shuffle of one bucket in a canonical order; global positions follow its offset."""

    def fn(bucket: pa.Table) -> pa.Table:
        n = bucket.num_rows
        first = pa.compute.sort_indices(bucket.select(["_k1", "_k2"]), sort_keys=[("_k1", "ascending"), ("_k2", "ascending")]).to_numpy()
        # Generator.permutation is a Fisher-Yates shuffle of 0..n-1
        order = np.random.default_rng([seed, bucket.column("_bucket")[0].as_py()]).permutation(n)
        out = bucket.take(pa.array(first[order]))
        at = bucket.column("_offset")[0].as_py() + np.arange(n, dtype=np.int64)
        return out.drop_columns(["_bucket", "_offset", "_k1", "_k2"]).append_column("_at", pa.array(at))

    return fn


def shuffle_shards(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 11,
    key: Sequence[str] = ("doc_id", "text"),
    size: str = "octet_length(text) + 8",
    path: str | None = None,
) -> DataFrame:
    """``docs`` in uniformly random order, written as ``n_shards`` shards; returns a scan of them.

    First pass: a seeded hash of ``key`` scatters rows into buckets of about
    ``BUCKET_BYTES`` (their number follows from the summed ``size``, an SQL
    expression on ``docs``; null: 8).  Second pass: every bucket is shuffled
    (Fisher-Yates, seeded by bucket) and written.  A bucket takes the positions
    after those of the buckets before it, and shard k holds the positions from
    ceil(k n / shards) on, so shards differ by one row at most, and a bucket
    writes to few of them.

    Added columns: ``shard`` and ``slot`` (0, 1, ... within the shard); they
    replace columns of these names.  Rows are spread by their whole key, so one
    source or one group of equal texts fills no bucket; rows that agree in the
    whole key are interchangeable.  Nulls hash like values.  Reruns give the same
    order, whatever the partitioning.  An empty table gives empty shards.
    """
    spark = docs.sparkSession
    hashed = [F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in key])]
    total = docs.agg(F.sum(F.coalesce(F.expr(size), F.lit(8)))).first()[0] or 0
    buckets = max(MIN_BUCKETS, int(total) // BUCKET_BYTES)
    placed = pack(docs, _k1=hashed[0], _k2=hashed[1]).withColumn("_bucket", F.pmod("_k1", F.lit(buckets)).cast("int"))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = settle(counts.select("_bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")), "shard-offsets")
    n = offsets.agg(F.sum("n")).first()[0] or 0
    both = placed.join(F.broadcast(offsets.drop("n")) if buckets <= 100_000 else offsets.drop("n"), "_bucket")
    order = ["_row", "_k1", "_k2", "_bucket", "_offset"]
    row = docs.select(F.struct("*").alias("_row")).schema["_row"].dataType.simpleString()
    mixed = both.select(order).groupBy("_bucket").applyInArrow(_permute(seed), f"_row {row}, _at bigint")
    # shard of position p: the last k with ceil(k n / shards) <= p
    shard = F.expr(f"cast((cast(_at AS decimal(38,0)) * {n_shards}) div {max(n, 1)} AS int)")
    start = F.expr(f"cast((cast(shard AS decimal(38,0)) * {n} + {n_shards - 1}) div {n_shards} AS bigint)")
    out = unpack(mixed.withColumn("shard", shard).withColumn("slot", F.col("_at") - start), docs.columns, "shard", "slot")
    path = path or scratch_path(spark, f"shards-{uuid.uuid4().hex[:8]}")
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
