"""Periodic runs of words by recompression."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import pack, unpack

#: Words of several documents that are handled together, and grid points looked at at once.
CHUNK_WORDS, CHUNK_POINTS = 200_000, 1_000_000


class Grammar:
    """A run-length grammar of one sequence, made by recompression, that answers LCE queries.

    Levels alternate: blocks of one symbol become one symbol, then the symbols are
    parted into left and right ones and every left one followed by a right one
    becomes one symbol with it.  What a symbol becomes depends on itself and its
    neighbours only, so equal stretches have equal symbols but at their ends, and
    two positions are compared by going up level by level while the symbols agree
    and down again where they differ: a constant number of steps a level, all
    queries at once.
    """

    def __init__(self, ids: np.ndarray, seed: int = 7) -> None:
        #: Of every level: symbols (and -1 behind the last), parent of each, first child of each parent, whether by blocks.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        rng = np.random.default_rng(seed)
        sym = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        blocks = True
        while len(sym) > 1:
            opens = np.ones(len(sym), bool)
            if blocks:
                opens[1:] = sym[1:] != sym[:-1]
            else:
                side = self._sides(sym, rng)
                opens[1:] = ~(side[:-1] & ~side[1:])
            if not opens.all():
                first = np.flatnonzero(opens)
                size = np.diff(first, append=len(sym))
                if blocks:
                    key = sym[first] * (int(size.max()) + 1) + size
                else:
                    second = np.where(size == 2, sym[np.minimum(first + 1, len(sym) - 1)] + 1, 0)
                    key = sym[first] * (int(sym.max()) + 2) + second
                up = np.cumsum(opens) - 1
                self.levels.append((np.append(sym, -1), np.append(up, len(first)), np.append(first, len(sym)), blocks))
                sym = np.unique(key, return_inverse=True)[1]
            blocks = not blocks
        self.top = np.append(sym, -1)

    @staticmethod
    def _sides(sym: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """True for positions of left symbols: of three drawn partitions, either way round, the one with most pairs."""
        best, most = np.zeros(len(sym), bool), 0
        n, tries = int(sym.max()) + 1, 0
        while tries < 3 or not most:
            left = (rng.integers(0, 2, n) == 1)[sym]
            for side in (left, ~left):
                pairs = int(np.count_nonzero(side[:-1] & ~side[1:]))
                if pairs > most:
                    best, most = side, pairs
            tries += 1
        return best

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the sequence agrees with itself from ``i`` and from ``j`` on (elementwise, i <> j)."""
        x, y = i.astype(np.int64), j.astype(np.int64)
        at = np.full(len(x), len(self.levels))  # level at which the symbols differ
        going = np.arange(len(x))
        for k, (sym, up, first, blocks) in enumerate(self.levels):
            a, b = x[going], y[going]
            same = sym[a] == sym[b]
            pa_, pb = up[a], up[b]
            apart = same & ~((first[pa_] == a) & (first[pb] == b))
            if apart.any():
                step = np.minimum(first[pa_[apart] + 1] - a[apart], first[pb[apart] + 1] - b[apart]) if blocks else 1
                a[apart] += step
                b[apart] += step
                same[apart] = sym[a[apart]] == sym[b[apart]]
                x[going], y[going] = a, b
            at[going[~same]] = k
            going = going[same]
            x[going], y[going] = up[x[going]], up[y[going]]
        for k in range(len(self.levels) - 1, -1, -1):
            sym, up, first, blocks = self.levels[k]
            down = np.flatnonzero(at > k)
            if not len(down):
                continue
            a, b = first[x[down]], first[y[down]]
            same = sym[a] == sym[b]
            if blocks:
                step = np.minimum(first[up[a[same]] + 1] - a[same], first[up[b[same]] + 1] - b[same])
            else:
                step = 1
            a[same] += step
            b[same] += step
            x[down], y[down] = a, b
        return x - i


def _grid(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (document, position, period) at which a run of four periods or more may lie.

    Such a run of period q holds two whole periods from some multiple of 2 q on,
    so n / 2 + n / 4 + n / 6 + ... points are looked at; those whose two periods
    differ in their first, middle or last word are left out.
    """
    periods = np.where(size >= least, size // 4, 0)
    doc = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = size[doc] // (2 * q)
    total = np.cumsum(points)
    cut = np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, CHUNK_POINTS), "left") if len(total) else []
    edges = np.unique(np.append(cut, len(q))).astype(np.int64)
    out = []
    for lo, hi in zip(np.append(0, edges[:-1]), edges, strict=True):
        n = points[lo:hi]
        d, p = np.repeat(doc[lo:hi], n), np.repeat(q[lo:hi], n)
        i = begin[d] + 2 * p * (np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n))
        for off in (0, -1, 2):  # first, last and middle word of the period
            o = p - 1 if off < 0 else p // 2 if off else 0
            fits = ids[i + o] == ids[i + o + p]
            d, i, p = d[fits], i[fits], p[fits]
        out.append((d, i, p))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def find(words: list[np.ndarray], least: int, times: int) -> list[np.ndarray]:
    """Runs (start, length, period) of every sequence, by start and period.

    Only sequences with candidates are compressed, all in one grammar of theirs,
    parted by symbols that occur once.
    """
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(words)
    size = np.array([len(w) for w in words], np.int64)
    if not size.sum():
        return out
    doc, i, q = _grid(np.concatenate(words), np.cumsum(size) - size, size, least)
    if not len(doc):
        return out
    i = i - (np.cumsum(size) - size)[doc]
    some = np.unique(doc)
    fence = -1 - np.arange(len(some) + 1)
    joined = np.concatenate([part for k, d in enumerate(some) for part in (fence[k : k + 1], words[d])] + [fence[-1:]])
    base = np.zeros(len(words), np.int64)
    base[some] = np.cumsum(size[some] + 1) - size[some]
    i, last = i + base[doc], len(joined) - 1
    ahead = Grammar(joined).lce(i, i + q)
    behind = Grammar(joined[::-1]).lce(last - (i - 1), last - (i + q - 1))
    start, length = i - behind - base[doc], behind + q + ahead
    long = length >= np.maximum(least, times * q)
    found = np.stack([doc, start, length, q], 1)[long]
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    # of equal stretches the smallest period; a multiple of it gives the same stretch
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    found = found[fresh]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    edges = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
    for d in np.unique(found[:, 0]):
        out[d] = found[edges[d] : edges[d + 1], 1:]
    return out


def _best(runs: np.ndarray) -> dict:
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-12)].tolist()
    start, length, period = min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return {"start": start, "length": length, "period": period}


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Words outside every run or within the first period of all runs that hold them."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _tasks(least: int, times: int):
    def chunk(texts: list[list[bytes]]) -> tuple[list, list, list, list]:
        ids: dict[bytes, int] = {}
        words = [np.fromiter((ids.setdefault(w, len(ids)) for w in t), np.int64, len(t)) for t in texts]
        n, runs, best, kept = [], [], [], []
        for t, found in zip(texts, find(words, least, times), strict=True):
            n.append(len(t))
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
            best.append(_best(found) if len(found) else None)
            kept.append(b" ".join([t[k] for k in _kept(len(t), found)] if len(found) else t))
        return n, runs, best, kept

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[list, list, list, list]] = []
            texts, held, done = [], 0, 0
            for at, t in enumerate(b.column("_t")):
                texts.append(t.as_buffer().to_pybytes().split() if t.is_valid else [])
                held += len(texts[-1])
                if held >= CHUNK_WORDS or at + 1 == b.num_rows:
                    out = [chunk(texts)]
                    n, runs, best, kept = out[0]
                    arrays = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([b.column("_row").slice(done, len(texts)), *arrays], ["_row", "n_words", "runs", "best_run", "collapsed"])
                    done += len(texts)
                    texts, held = [], 0

    return fn


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with the periodic runs of words of every text.

    A run is a stretch of words with smallest period q (words q apart are equal),
    at least ``least`` words and ``times`` periods long (``times`` >= 4), that no
    neighbouring word extends.  Added columns (they replace columns of these
    names): ``n_words``; ``runs``, an array of (start, length, period) by start,
    then period; ``best_run``, the run with the greatest length / period (ties: the
    smallest start, then period), null without runs; ``collapsed``, the words that
    no run holds after its first q words, joined by one space.

    Words are runs of anything but ASCII white space, compared as bytes.  A null
    text has no words, an empty array and an empty ``collapsed``.  Rows are
    independent of each other, so ids may be null or repeated and copies need no
    care; there is no shuffle.  A task holds one batch of rows and the grammar of
    about ``CHUNK_WORDS`` words, or of one text if that is longer.
    """
    if times < 4 or least < 2:
        raise ValueError("runs of fewer than four periods or two words are not looked for")
    packed = pack(docs, _t=F.col(text))
    row = packed.schema["_row"].dataType.simpleString()
    run = "struct<start:bigint,length:bigint,period:bigint>"
    found = packed.mapInArrow(_tasks(least, times), f"_row {row}, n_words bigint, runs array<{run}>, best_run {run}, collapsed string")
    return unpack(found, docs.columns, "n_words", "runs", "best_run", "collapsed")
