"""Substring deduplication over words with prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import anchors

#: Words that two windows must share before their group is compared at all.
GRAM = 16


def _units(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in ranges]


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Number of the depth-``depth`` node of the suffix tree that each suffix passes through, -1 if it is alone there.

    The tree is grown from the root down to ``depth`` words: suffixes with equal
    edges stay together, and a node with one leaf is not followed further.  Edges
    are labelled by blocks of words, whose names come from pairs of names of half
    their length.
    """
    names, width = {1: words}, 1
    while 2 * width <= min(depth, 16):
        half = names[width]
        pair = half[: len(half) - width].astype(np.int64) * (int(half.max(initial=0)) + 1) + half[width:]
        names[2 * width] = np.unique(pair, return_inverse=True)[1]
        width *= 2
    node, alive, at = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while at < depth and len(alive):
        at = min(at, depth - width)  # the last edge may overlap the one before
        edge = names[width][starts[alive] + at]
        key = node[alive] * (int(edge.max(initial=0)) + 1) + edge
        _, inner, leaves = np.unique(key, return_inverse=True, return_counts=True)
        node[alive] = inner
        alive = alive[leaves[inner] > 1]
        at += width
    out = np.full(len(starts), -1, np.int64)
    out[alive] = node[alive]
    return out


def _trees(window: int):
    """Flags of the windows below a deep node that also has a leaf from an elder document."""

    def sort(t: pa.Table) -> np.ndarray:
        ids: dict[bytes, int] = {}
        rows = [[ids.setdefault(w, len(ids)) for w in d.split(b" ")] for d in t.column("data").to_pylist()]
        size = np.array([len(r) for r in rows], np.int64)
        words = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        n = t.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        starts = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(size) - size)[row]
        node = deep_nodes(words, starts, window)
        doc = t.column("id").to_numpy()[row]
        goes, below = np.zeros(len(row), bool), np.flatnonzero(node >= 0)
        if len(below):
            eldest = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(eldest, node[below], doc[below])
            goes[below] = doc[below] > eldest[node[below]]
        return goes

    return sort


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """``docs`` without passages that an elder document has.

    Every word covered by a window of ``window`` words that also starts in a
    document with a smaller doc id goes; windows are judged on the input.  Words
    are runs of anything but ASCII white space.  Added columns (they replace
    columns of these names): ``n_words``, ``n_removed`` and ``kept_text``, the
    words left, joined by one space; for a null text 0, 0 and an empty text.

    Suffixes are grouped by a prefix that is chosen by content and longer (the
    whole window) where a group would not fit in memory; the suffix tree of every
    group is grown to the window's depth, where a node with several leaves is a
    repeat.  Whole copies are told by their hash, so large groups of copies stay
    cheap.  A null doc id counts as larger than any other; rows with equal ids
    never remove each other's words.
    """
    spec = anchors.Spec(window, max(1, min(GRAM, window // 2)), True, _units, _cut)
    joined = anchors.repeated_ranges(docs, spec, _trees(window), text)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, ranges, whole in zip(*(b.column(c).to_pylist() for c in ("z", "ranges", "whole")), strict=True):
                t = b"" if z is None else unzip.decompress(z)
                words = t.split()
                if whole and len(words) >= window:
                    kept = []
                elif ranges:
                    gone = anchors.covered(ranges, len(words), window)
                    kept = [words[k] for k in np.flatnonzero(~gone)]
                else:
                    kept = words
                out.append((len(words), len(words) - len(kept), b" ".join(kept), None if z is None else t))
            n, gone, kept, t = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(t, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["_row", "_text", "n_words", "n_removed", "kept_text"])

    row = joined.schema["_row"].dataType.simpleString()
    result = joined.mapInArrow(fn, f"_row {row}, _text string, n_words bigint, n_removed bigint, kept_text string")
    return restored(result, docs.columns, text, "n_words", "n_removed", "kept_text")


def restored(df: DataFrame, columns: list[str], text: str, *outputs: str) -> DataFrame:
    """Columns as they were, with the text that travelled beside them."""
    kept = [(F.col("_text") if c == text else F.col("_row").getField(c)).alias(c) for c in columns if c not in outputs]
    return df.select(*kept, *outputs)
