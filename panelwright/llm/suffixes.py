"""Substring deduplication over bytes with suffix arrays built by induced sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import anchors
from panelwright.llm.substrings import restored

#: Bytes that two strings must share before their group is compared at all.
GRAM = 40

_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def _units(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in ranges]


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type); the last position is."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    small = np.ones(n, bool)
    if len(differs):
        rises = s[differs] < s[differs + 1]
        runs = np.diff(differs, prepend=-1)  # a run is decided by the position that ends it
        small[: differs[-1] + 1] = np.repeat(rises, runs)
        small[differs[-1] + 1 : n - 1] = False
    return small


def _deal(sa: np.ndarray, slot: np.ndarray, pos: np.ndarray, ch: np.ndarray, step: int) -> None:
    """Append positions to the buckets of their characters, in order; step -1 fills from the end."""
    order = np.argsort(ch, kind="stable")
    c = ch[order]
    count = np.bincount(c, minlength=len(slot))
    rank = np.arange(len(c)) - (np.cumsum(count) - count)[c]
    sa[slot[c] + step * rank] = pos[order]
    slot += step * count


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost S-type ones, bucket after bucket.

    ``lms``: leftmost S-type positions, sorted.  Forwards, every sorted suffix
    puts the one that begins a character earlier at the front of its bucket if
    that is L-type; backwards, at the end of its bucket if S-type.  A whole bucket
    is done in a few array operations; only predecessors in the same bucket (runs
    of one character) take another round.
    """
    n, width = len(s), int(s.max()) + 1
    size = np.bincount(s, minlength=width)
    end = np.cumsum(size)
    start = end - size
    n_large = np.bincount(s[~small], minlength=width)
    sa = np.full(n, -1, np.int32)
    by = np.split(lms, np.cumsum(np.bincount(s[lms], minlength=width))[:-1]) if len(lms) else [lms] * width
    front = start.copy()

    def earlier(pos: np.ndarray, want_small: bool) -> np.ndarray:
        p = pos[pos > 0] - 1
        return p[small[p] == want_small]

    for c in range(width):
        if not size[c]:
            continue
        at = start[c]
        while at < front[c]:
            batch = sa[at : front[c]].copy()
            at = int(front[c])
            p = earlier(batch, False)
            if len(p):
                _deal(sa, front, p, s[p], 1)
        p = earlier(by[c], False)
        if len(p):
            _deal(sa, front, p, s[p], 1)
    back = end - 1
    for c in range(width - 1, -1, -1):
        if not size[c]:
            continue
        at = end[c] - 1
        while at > back[c]:
            batch = sa[back[c] + 1 : at + 1][::-1].copy()
            at = int(back[c])
            p = earlier(batch, True)
            if len(p):
                _deal(sa, back, p, s[p], -1)
        large = sa[start[c] : start[c] + n_large[c]][::-1]
        p = earlier(large, True)
        if len(p):
            _deal(sa, back, p, s[p], -1)
    # the last suffix (the sentinel) has no successor to induce it
    sa[0] = n - 1
    return sa


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over a wide alphabet: names of pairs, then of pairs of pairs."""
    rank, h, n = names, 1, len(names)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1 if h < n else 0
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2) + nxt
        order = np.argsort(key)  # equal names keep equal ranks, so stability does not matter
        k = key[order]
        new = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        h *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``; its last value must be its only smallest one.

    Leftmost S-type substrings are sorted by inducing, named, and their order is
    settled on the string of names: by the same method while the alphabet is
    narrow, else by doubling.  All suffixes are then induced from them.
    """
    small = classify(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) <= 1:
        return induce(s, small, lms)
    first = induce(s, small, lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = first[is_lms[first]]  # substrings from one such position to the next, sorted
    stop = np.append(lms[1:], len(s) - 1)
    of = np.zeros(len(s), np.int32)
    of[lms] = stop
    a, b = order[:-1], order[1:]
    length = of[order] - order
    same = length[:-1] == length[1:]
    live = np.flatnonzero(same)
    d = 0
    while len(live):
        live = live[d <= length[live]]
        equal = s[a[live] + d] == s[b[live] + d]
        same[live[~equal]] = False
        live = live[equal]
        d += 1
    name = np.empty(len(s), np.int32)
    name[order] = np.cumsum(np.r_[0, ~same])
    reduced = name[lms]
    top = int(reduced.max())
    if top == len(lms) - 1:
        settled = order
    elif top < 1024:
        settled = lms[suffix_array(reduced)]
    else:
        settled = lms[_sort_names(reduced)]
    return induce(s, small, settled)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every position, how much its suffix shares with the one sorted before it.

    A value may be one less than that of the position before.  Only positions
    where it is not (the characters before differ) are compared; the rest follow.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n, dtype=np.int32)
    fresh = (before < 0) | (pos == 0) | (before == 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = s[inner - 1] != s[before[inner] - 1]
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = s
    eight = np.ndarray((n + 1,), "<u8", wide.tobytes(), strides=(1,))
    at = np.flatnonzero(fresh & (before >= 0))
    length = np.zeros(n, np.int32)
    live = at
    while len(live):
        x = eight[np.minimum(live + length[live], n)] ^ eight[np.minimum(before[live] + length[live], n)]
        zero = x == 0
        part = x[~zero]
        length[live[~zero]] += np.bitwise_count((part & (~part + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        live = live[zero]
        length[live] += 8
        live = live[(live + length[live] < n) & (before[live] + length[live] < n)]
    last = np.maximum.accumulate(np.where(fresh, pos, 0))
    return length[last] - (pos - last)


def _arrays(window: int):
    """Flags of the windows that another one equals."""

    def sort(t: pa.Table) -> np.ndarray:
        data = t.column("data").combine_chunks() if isinstance(t.column("data"), pa.ChunkedArray) else t.column("data")
        n = t.column("n").to_numpy().astype(np.int64)
        rows = data.to_pylist()
        # bytes from 2 on, 1 between stretches, 0 at the end; no text in UTF-8 has bytes beyond 0xF4
        s = np.frombuffer(b"\xff".join(rows) + b"\xfe", np.uint8) + np.uint8(2)
        sa = suffix_array(s)
        lcp = permuted_lcp(s, sa)[sa]
        deep = lcp >= window
        deep[:-1] |= deep[1:]
        twice = np.zeros(len(s), bool)
        twice[sa[deep]] = True
        size = np.array([len(r) + 1 for r in rows], np.int64)
        row = np.repeat(np.arange(len(n)), n)
        return twice[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(size) - size)[row]]

    return sort


def remove_repeats(docs: DataFrame, window: int = 200, text: str = "text") -> DataFrame:
    """``docs`` without any string of ``window`` bytes that starts more than once.

    Texts are read as UTF-8 bytes and matches stay within a document.  Every byte
    covered by such a string goes, in all its places, the same document included;
    strings are judged on the input.  Added columns (they replace columns of these
    names): ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of bytes that go)
    and ``kept_bytes`` (binary, as a cut may split a character); a null text counts
    as empty.

    Stretches around shared anchors are dealt to shards; each shard's suffix array
    is built by induced sorting, and permuted common prefixes tell which windows
    recur.  Whole copies are told by their hash.  Two rows that agree in id and
    text are copies of each other.
    """
    spec = anchors.Spec(window, max(1, min(GRAM, window // 2)), False, _units, _cut)
    joined = anchors.repeated_ranges(docs, spec, _arrays(window), text)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, ranges, whole in zip(*(b.column(c).to_pylist() for c in ("z", "ranges", "whole")), strict=True):
                t = b"" if z is None else unzip.decompress(z)
                gone, spans, kept = 0, 0, t
                if whole and len(t) >= window:
                    gone, spans, kept = len(t), 1, b""
                elif ranges:
                    flag = anchors.covered(ranges, len(t), window)
                    gone, spans = int(flag.sum()), int(flag[0]) + int((flag[1:] & ~flag[:-1]).sum())
                    kept = np.frombuffer(t, np.uint8)[~flag].tobytes()
                out.append((None if z is None else t, len(t), gone, spans, kept))
            t, n, gone, spans, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(t, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary())], ["_row", "_text", "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    row = joined.schema["_row"].dataType.simpleString()
    result = joined.mapInArrow(fn, f"_row {row}, _text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary")
    return restored(result, docs.columns, text, "n_bytes", "n_removed", "n_spans", "kept_bytes")
