"""Token sequences in training order, as binary shards of fixed stride."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.session import scratch_path, settle

#: Vocabulary (base64 token and rank per line), the pattern that splits its texts, and the id that ends a document.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most bytes of a vocabulary file, which is read by the driver and broadcast.
VOCABULARY_BYTES = 32 << 20
SEQUENCE = 4096
#: Sequences in a shard file.
SHARD_SEQUENCES = 2048
ROUNDS = 6


def permute(index: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Keyed bijection of 0..n-1: a Feistel network over the next even number of bits, walked until it falls below n."""
    if n <= 1:
        return index.astype(np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(zlib.crc32(b"%d/%d" % (seed, r)).to_bytes(4, "big") * 2, "big")) for r in range(ROUNDS)]

    def scramble(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ scramble(left, key), left
            else:
                left, right = right, left ^ scramble(right, key)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


class Encoder:
    """Token ids of texts; built once per task from the broadcast vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.end = max(ranks.values()) + 1  # free in the vocabulary: ends a document
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return np.array([*self._bpe.encode_ordinary(text), self.end], self.dtype)

    def decode(self, ids) -> str:
        return self._bpe.decode([int(i) for i in ids if i != self.end])


def _read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """Through Spark's reader, so that any store will do; a path without a scheme is a local file of the driver."""
    if "://" not in path:
        path = f"file://{path}"
    lines = spark.read.text(path)
    size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    if size > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    return "\n".join(lines.toArrow().column(0).to_pylist()).encode()


def _pack(shared, pattern: str, length: int):
    """Texts of a partition in order -> full sequences (the last one padded), numbered within the partition."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = Encoder(shared.value, pattern), TaskContext.get().partitionId(), 0
        held, size, ids, rows = [], 0, [], []

        def batch() -> pa.RecordBatch:
            n, d, t, k = (list(x) for x in zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.list_(pa.int64())), pa.array(t, pa.binary())], ["part", "number", "n_tokens", "doc_ids", "tokens"])

        def cut(last: bool):
            nonlocal held, size, ids, number
            stream = np.concatenate(held) if held else np.zeros(0, encode.dtype)
            owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
            whole = -(-len(stream) // length) if last else len(stream) // length
            for s in range(whole):
                piece = stream[s * length : (s + 1) * length]
                docs = [ids[o] for o in np.unique(owner[s * length : (s + 1) * length])]
                n = len(piece)
                if n < length:
                    piece = np.concatenate([piece, np.full(length - n, encode.end, encode.dtype)])
                rows.append((number, docs, piece.tobytes(), n))
                number += 1
            rest = stream[whole * length :]
            first = int(owner[whole * length]) if len(rest) else len(held)
            skipped = whole * length - sum(len(h) for h in held[:first])
            held, ids, size = held[first:], ids[first:], len(rest)
            if held:
                held[0] = held[0][skipped:]

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
                if t is None:
                    continue
                tokens = encode(t)
                held.append(tokens)
                ids.append(i)
                size += len(tokens)
                if size >= 64 * length:
                    cut(False)
                    if len(rows) >= 256:
                        yield batch()
        cut(True)
        if rows:
            yield batch()

    return fn


def _place(n: int, seed: int, per_shard: int):
    """Slot of every sequence; tokens are compressed for the way to their shard."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=9)
        for b in batches:
            slot = permute(b.column("at").to_numpy(), n, seed)
            z = pa.array([zip_.compress(t.as_buffer()) for t in b.column("tokens")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), b.column("n_tokens"), b.column("doc_ids"), z], ["slot", "shard", "n_tokens", "doc_ids", "z"])

    return fn


def _write(path: str, per_shard: int, stride: int):
    """Sequences sorted by slot -> one file per shard; a row per sequence tells where it lies."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        open_, sink = None, None

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{root}/.{shard_name(open_)}.{attempt}", f"{root}/{shard_name(open_)}")

        for b in batches:
            crc = []
            for shard, z in zip(b.column("shard").to_pylist(), b.column("z"), strict=True):
                if shard != open_:
                    close()
                    open_, sink = shard, store.open_output_stream(f"{root}/.{shard_name(shard)}.{attempt}")
                data = unzip.decompress(z.as_buffer())
                crc.append(zlib.crc32(data))
                sink.write(data)
            offset = (b.column("slot").to_numpy() % per_shard) * stride
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("shard"), pa.array(offset), b.column("n_tokens"), pa.array(crc, pa.int64()), b.column("doc_ids")], ["slot", "shard", "offset", "n_tokens", "crc32", "doc_ids"])
        close()

    return fn


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = SEQUENCE, per_shard: int = SHARD_SEQUENCES, seed: int = 23, text: str = "text") -> DataFrame:
    """Write the token sequences of ``docs`` in training order; returns one row per sequence.

    Texts are tokenised whole, ended by one more id and packed in the order of the
    input into sequences of ``length`` ids; the last of an input partition is
    padded with that id.  Sequences are numbered through all partitions, and a
    keyed Feistel permutation gives each a slot (a bijection: walks until it falls
    below the number of sequences).  Shard k holds slots k x per_shard and on as
    little-endian records of one size, so a reader seeks to slot s at
    (s mod per_shard) x stride and reads on; ``read_slots`` does.  ``layout.json``
    beside the shards has the numbers needed.  A shard appears under its name only
    when complete, whichever attempt of a task wrote it.

    Columns: ``slot``, ``shard``, ``offset`` (bytes), ``n_tokens`` (without
    padding), ``crc32`` (of the record), ``doc_ids`` (of the documents in it).
    Null texts are left out; an empty text is its end id; repeated rows are
    written as often.  No rows: no shards.  The same files read with the same
    splits give the same shards.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    shared = spark.sparkContext.broadcast(_read_vocabulary(spark, vocabulary))
    stride = length * Encoder(shared.value, pattern).dtype.itemsize
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).alias("t"))
    packed = source.mapInArrow(_pack(shared, pattern, length), "part int, number bigint, n_tokens int, doc_ids array<bigint>, tokens binary")
    kept_path = scratch_path(spark, "sequences")
    packed.write.option("compression", "zstd").parquet(kept_path)
    kept = spark.read.schema(packed.schema).parquet(kept_path)
    counts = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per input partition
    starts = settle(counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    n = starts.agg(F.sum("n")).first()[0] or 0
    placed = kept.join(starts.drop("n"), "part").select((F.col("start") + F.col("number")).alias("at"), "n_tokens", "doc_ids", "tokens")
    slots = placed.mapInArrow(_place(n, seed, per_shard), "slot bigint, shard bigint, n_tokens int, doc_ids array<bigint>, z binary")
    parts = max(1, -(-n // per_shard))
    sorted_ = slots.repartition(min(parts, 100_000), "shard").sortWithinPartitions("slot")
    written = sorted_.mapInArrow(_write(path, per_shard, stride), "slot bigint, shard bigint, offset bigint, n_tokens int, crc32 bigint, doc_ids array<bigint>")
    rows = settle(written, "token-rows")
    layout = {"sequences": n, "length": length, "per_shard": per_shard, "stride": stride, "seed": seed, "vocabulary": vocabulary}
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps(layout).encode())
    return rows


def read_slots(path: str, start: int, count: int) -> Iterator[np.ndarray]:
    """Sequences of slots ``start`` and on, in order; a reader resumes by its next slot."""
    store, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with store.open_input_stream(f"{root}/layout.json") as f:
        at = json.loads(f.read())
    dtype = np.dtype("<u2") if at["stride"] == 2 * at["length"] else np.dtype("<u4")
    stop = min(start + count, at["sequences"])
    while start < stop:
        shard, first = divmod(start, at["per_shard"])
        n = min(stop - start, at["per_shard"] - first)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(first * at["stride"])
            for _ in range(n):
                yield np.frombuffer(f.read(at["stride"]), dtype)
        start += n
