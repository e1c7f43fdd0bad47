"""Windows of fixed length that occur more than once, found through content-chosen anchors.

Shared by the substring operators.  A text is a sequence of units (words or
bytes); a window is ``window`` units in a row.  Every window is put down to one
anchor: of the runs of ``gram`` units inside it the one with the least hash.
Equal windows have equal anchors, so windows are grouped by the hash of their
anchor, a prefix that follows the text wherever it is copied to.  Neighbouring
windows with the same anchor stay together as one stretch.

1. Stretches are listed without their text and grouped by anchor.  A stretch that
   occurs whole elsewhere is settled at once, an anchor that occurs once is
   dropped.
2. What is left differs around a shared anchor.  Its text is fetched, and each
   group's suffixes are sorted (by the operator's own method) to find the windows
   in common.
3. Groups too large for memory get a longer prefix: the whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelwright.session import settle

#: Units that are hashed at a time; positions within take 24 bits.
CHUNK = 1 << 19
#: Rows of one anchor within a map task from which its group is salted, and the salts.
HOT_ROWS, SALTS = 64, 64
#: Listed rows that a map task holds back to fold equal ones.
HELD_ROWS = 200_000
#: Bytes of text that one call of the suffix sort takes.
SORT_BYTES = 1 << 20
#: Stretches of one anchor that are sorted together; larger groups go by whole windows.
GROUP_ROWS = 20_000

#: States of a listed stretch.
PLAIN, SETTLED, PARTNER, OPEN = 0, 1, 2, 3

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Spec:
    """How texts become units, and which of two equal windows goes.

    ``elder``: a window goes if an equal one is in a document with a smaller id;
    otherwise it goes if there is any equal one.
    """

    window: int
    gram: int
    elder: bool
    units: Callable[[bytes], np.ndarray]  # hashes of the units of a text
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]  # texts of unit ranges


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _POWERS[size] = tuple(np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))]) for b in (np.uint64(_BASE), inverse))
    return _POWERS[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any run of units of an array."""

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        up, self.down = _powers(n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[:n])])

    def __call__(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def stretches(units: np.ndarray, doc: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(document, first and last window start, hash of the anchor, hash of the text) of all stretches; doc: of each unit."""
    w, k, n = spec.window, spec.gram, len(units)
    if n < w:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    roll = Rolling(units)
    grams = n - k + 1
    h = mixed((roll.sums[k:] - roll.sums[:-k]) * roll.down[:grams])
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
    span, least = w - k + 1, low
    have = 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = np.flatnonzero(doc[: n - w + 1] == doc[w - 1 :])
    anchor = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    lo, hi, a = at[first], at[last], anchor[first]
    return doc[lo], lo, hi, h[a], mixed(roll(lo, hi + w) ^ np.uint64(0xA5A5A5A5))


def keys_of(text: bytes) -> tuple[int, int]:
    """128 bits of a text as two signed longs."""
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """id, t1, t2 (hash of the text), z (compressed text; null if null) of every row, and the row's other columns."""
    others = [c for c in docs.columns if c != text]
    fields = F.struct(*others) if others else F.struct(F.lit(1).alias("_"))
    source = docs.select(fields.alias("_row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.col(text).alias("t"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else None for x in b.column("t")]
            keys = [keys_of(t or b"") for t in texts]
            z = pa.array([None if t is None else zip_.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), z], ["_row", "id", "t1", "t2", "z"])

    row = source.schema["_row"].dataType.simpleString()
    return source.mapInArrow(fn, f"_row {row}, id bigint, t1 bigint, t2 bigint, z binary")


_LISTED = "sk bigint, a bigint, c bigint, id bigint, t1 bigint, t2 bigint, lo int, hi int, state tinyint, hot boolean"
_KEY = ["id", "t1", "t2"]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Run number of each row of sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _judge(run: np.ndarray, ids: np.ndarray, state: np.ndarray, elder: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal text (sorted by run): which go now, and which stand for their run."""
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, int)
    if elder:
        least = np.minimum.reduceat(ids, first) if len(first) else ids
        goes = ids > least[run]
        return goes, ~goes
    size = np.bincount(run)
    goes = (size[run] > 1) & (state != PARTNER)
    stands = np.zeros(len(run), bool)
    stands[first] = True
    return goes, stands


def _list(spec: Spec):
    def fold(parts: list[np.ndarray]) -> pa.RecordBatch:
        a, c, ids, t1, t2, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, c, a))
        a, c, ids, t1, t2, lo, hi = (x[order] for x in (a, c, ids, t1, t2, lo, hi))
        run, group = _runs(a, c), _runs(a)
        goes, stands = _judge(run, ids, np.zeros(len(a), np.int8), spec.elder)
        # rows that go are done with; one row (or those of the eldest) stands for them
        out = [x[goes] for x in (mixed(t1.view(np.uint64)).view(np.int64) ^ lo, np.zeros_like(a), np.zeros_like(a), ids, t1, t2, lo, hi)]
        state = [np.full(goes.sum(), SETTLED, np.int8)]
        many = np.bincount(run[stands | goes])[run] > 1 if not spec.elder else np.zeros(len(a), bool)
        rest = [x[stands] for x in (a, c, ids, t1, t2, lo, hi)]
        kind = np.where(many[stands], PARTNER, PLAIN).astype(np.int8)
        # a group with many different texts here is known to be mixed, and is dealt out by its texts
        runs_of = np.bincount(group[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]) if len(group) else np.zeros(0, int)
        hot = (runs_of[group] >= HOT_ROWS)[stands]
        salt = np.where(hot, (rest[1].view(np.uint64) % np.uint64(SALTS) + np.uint64(1)).astype(np.int64), 0)
        sk = rest[0] ^ mixed(salt.view(np.uint64)).view(np.int64)
        # others with this anchor must hear of it
        tell = np.flatnonzero(hot)
        tell = tell[np.r_[True, np.diff(rest[0][tell]) != 0]] if len(tell) else tell
        both = [np.concatenate([x, y, y[tell]]) for x, y in zip(out, [sk, *rest], strict=True)]
        both[0][len(out[0]) + len(sk) :] = rest[0][tell] ^ mixed(np.zeros(len(tell), np.uint64)).view(np.int64)
        state = np.concatenate([*state, kind, np.full(len(tell), PARTNER, np.int8)])
        flag = np.concatenate([np.zeros(len(out[0]), bool), hot, np.ones(len(tell), bool)])
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in both[:6]), *(pa.array(x.astype(np.int32)) for x in both[6:]), pa.array(state), pa.array(flag)], [f.split()[0] for f in _LISTED.split(", ")])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        parts: list = []
        held = 0
        batch: list[tuple[int, int, int, int, np.ndarray]] = []  # id, keys, offset, units

        def flush() -> None:
            nonlocal held
            if not batch:
                return
            units = np.concatenate([b[4] for b in batch])
            doc = np.repeat(np.arange(len(batch)), [len(b[4]) for b in batch])
            start = np.cumsum([0, *(len(b[4]) for b in batch)])[:-1]
            d, lo, hi, a, c = stretches(units, doc, spec)
            ids, t1, t2, off = (np.array([b[k] for b in batch], np.int64) for k in range(4))
            at = off[d] - start[d]
            parts.append((a.view(np.int64), c.view(np.int64), ids[d], t1[d], t2[d], lo + at, hi + at))
            held += len(d)
            batch.clear()

        size = 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t"), strict=True):
                if not t.is_valid:
                    continue
                text = t.as_buffer().to_pybytes()
                key = keys_of(text)
                if seen.get(key, i + 1) <= i:  # the same text with an id no larger is listed
                    continue
                seen[key] = i
                if len(seen) > 200_000:
                    seen.clear()
                units = spec.units(text)
                # long texts in overlapping pieces; windows are whole in one of them
                for at in range(0, max(1, len(units) - spec.window + 1), CHUNK):
                    piece = units[at : at + CHUNK + spec.window - 1]
                    if len(piece) >= spec.window:
                        batch.append((i, *key, at, piece))
                        size += len(piece)
                    if size >= CHUNK:
                        flush()
                        size = 0
                if held >= HELD_ROWS:
                    yield fold(parts)
                    parts, held = [], 0
        flush()
        if held:
            yield fold(parts)

    return fn


def _sift(elder: bool):
    """Rows sorted by (sk, a, c) -> settled ones, and those whose text must be compared."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        col = {n: t.column(n).to_numpy() for n in ("sk", "a", "c", "id", "t1", "t2", "lo", "hi", "state")}
        hot = t.column("hot").to_numpy(zero_copy_only=False)
        # within a run of equal texts one that is not yet judged elsewhere comes first, to stand for it
        order = np.lexsort((col["id"], col["state"] == PARTNER, col["c"], col["a"], col["sk"], col["state"] == SETTLED))
        col = {n: x[order] for n, x in col.items()}
        hot = hot[order]
        done = col["state"] == SETTLED
        live = ~done
        sk, a, c, ids, state = (col[n][live] for n in ("sk", "a", "c", "id", "state"))
        run, group = _runs(sk, a, c), _runs(sk, a)
        goes, stands = _judge(run, ids, state, elder)
        texts = np.bincount(group[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]) if len(group) else np.zeros(0, int)
        mixed_ = (texts[group] > 1) | (np.bincount(group, hot[live]) > 0)[group] if len(group) else np.zeros(0, bool)
        ship = stands & mixed_
        alone = (~goes & (state != PARTNER)) if not elder else np.ones(len(a), bool)
        kind = np.where(alone, OPEN, PARTNER)
        out = {n: np.concatenate([col[n][done], col[n][live][goes], col[n][live][ship]]) for n in ("a", "id", "t1", "t2", "lo", "hi")}
        out["a"][: done.sum() + goes.sum()] = 0
        st = np.concatenate([np.full(done.sum() + goes.sum(), SETTLED, np.int8), kind[ship].astype(np.int8)])
        return pa.RecordBatch.from_arrays([*(pa.array(out[n]) for n in ("a", "id", "t1", "t2", "lo", "hi")), pa.array(st)], ["a", "id", "t1", "t2", "lo", "hi", "state"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "sk", 200_000):
            yield judge(t)

    return fn


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int, weight: str | None = None, most: int = 0) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows (or ``most`` bytes of column ``weight``) that end where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        size += b.column(weight).nbytes if weight else 0
        if n < rows and not (most and size >= most):
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        edge = np.flatnonzero(k != k[-1])
        if len(edge):
            yield from _portions(t.slice(0, int(edge[-1]) + 1).combine_chunks(), key, weight, most)
            held = t.slice(int(edge[-1]) + 1).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held)
            size = sum(x.column(weight).nbytes for x in held) if weight else 0
    if held:
        yield from _portions(pa.Table.from_batches(held).combine_chunks(), key, weight, most)


def _portions(t: pa.Table, key: str, weight: str | None, most: int) -> Iterator[pa.Table]:
    """Parts of ``t`` of about ``most`` bytes of ``weight``, again cut where ``key`` changes."""
    if not weight or t.column(weight).nbytes <= most:
        yield t
        return
    k = t.column(key).to_numpy()
    ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
    size = np.cumsum([len(x) for x in t.column(weight).to_pylist()])
    start = 0
    while start < len(k):
        before = size[start - 1] if start else 0
        fits = ends[(ends > start) & (size[ends - 1] - before <= most)]
        stop = int(fits[-1]) if len(fits) else int(ends[ends > start][0])
        yield t.slice(start, stop - start).combine_chunks()
        start = stop


_TEXTS = "a bigint, b bigint, id bigint, t1 bigint, t2 bigint, lo int, n int, open boolean, data binary"


def _fetch(spec: Spec):
    """Joined texts and stretches -> a row with the text of each stretch, or one per window for large groups."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, t1, t2, z, want in zip(*(b.column(c).to_pylist() for c in ("id", "t1", "t2", "z", "want")), strict=True):
                if (i, t1, t2) in seen:
                    continue
                seen.add((i, t1, t2))
                text = unzip.decompress(z)
                once: dict[tuple, dict] = {}
                for w in want:  # a stretch that was also sent to tell of its anchor counts once
                    if w["state"] == OPEN or (w["a"], w["lo"]) not in once:
                        once[w["a"], w["lo"]] = w
                want = list(once.values())
                near = [w for w in want if not w["deep"]]
                for w, data in zip(near, spec.cut(text, [(w["lo"], w["hi"] + spec.window) for w in near]), strict=True):
                    out.append((w["a"], 0, i, t1, t2, w["lo"], w["hi"] - w["lo"] + 1, w["state"] == OPEN, data))
                    held += len(data)
                far = [w for w in want if w["deep"]]
                if far:
                    roll = Rolling(spec.units(text))
                    for w in far:
                        s = np.arange(w["lo"], w["hi"] + 1)
                        h = roll(s, s + spec.window)
                        for p, x, y in zip(s.tolist(), mixed(h).view(np.int64).tolist(), mixed(h ^ roll(s + 1, s + spec.window - 1) * np.uint64(3)).view(np.int64).tolist(), strict=True):
                            out.append((x, y, i, t1, t2, p, 0, w["state"] == OPEN, None))
                if held > 8 << 20 or len(out) > 50_000:
                    yield _texts(out)
                    out, held = [], 0
            if out:
                yield _texts(out)

    return fn


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in _TEXTS.split(", ")])


def _compare(sort: Callable):
    """Texts grouped by anchor -> ranges of window starts that go; ``sort`` flags the windows of a table."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "a", 1 << 60, "data", SORT_BYTES):
            n = t.column("n").to_numpy().astype(np.int64)
            goes = sort(t)  # one flag per window of each row, in order
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + t.column("lo").to_numpy()[row]
            goes &= t.column("open").to_numpy(zero_copy_only=False)[row]
            row, at = row[goes], at[goes]
            new = np.r_[True, (row[1:] != row[:-1]) | (np.diff(at) != 1)] if len(row) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(row)][: len(first)] - 1
            r = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(r).combine_chunks() for c in _KEY), pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))], [*_KEY, "lo", "hi"])

    return fn


def repeated_ranges(docs: DataFrame, spec: Spec, sort: Callable, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Packed rows of ``docs`` joined to what goes: ``ranges`` (window starts lo..hi of the row's text), ``whole``.

    ``whole``: the row's whole text goes, as a copy of another row's.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.col(text).alias("t"))
    listed = source.mapInArrow(_list(spec), _LISTED)
    sorted_ = listed.repartition("sk").sortWithinPartitions("sk", "a", "c")
    marks = settle(sorted_.mapInArrow(_sift(spec.elder), "a bigint, id bigint, t1 bigint, t2 bigint, lo int, hi int, state tinyint"), "marks")

    rows = packed(docs, text)
    wanted = marks.where(F.col("state") != SETTLED)
    large = settle(wanted.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > GROUP_ROWS).select("a", F.lit(True).alias("deep")), "large-groups")
    deep = not large.isEmpty()
    flagged = wanted.join(large, "a", "left") if deep else wanted.withColumn("deep", F.lit(False))
    item = F.struct("a", "lo", "hi", "state", F.coalesce("deep", F.lit(False)).alias("deep"))
    lists = flagged.groupBy(*_KEY).agg(F.collect_list(item).alias("want"))  # bounded by the text
    texts = rows.select(*_KEY, "z").join(lists, _KEY).mapInArrow(_fetch(spec), _TEXTS)
    if deep:
        texts = settle(texts, "texts")
    close = texts.where("data IS NOT NULL").drop("b").repartition("a").sortWithinPartitions("a")
    ranges = close.mapInArrow(_compare(sort), "id bigint, t1 bigint, t2 bigint, lo int, hi int")
    if deep:  # whole windows as keys: folded before the shuffle, no text needed
        single = texts.where("data IS NULL")
        same = single.groupBy("a", "b").agg(F.min("id").alias("eldest"), F.count("*").alias("k"))
        gone = single.join(same, ["a", "b"]).where(F.col("open") & (F.col("id") > F.col("eldest") if spec.elder else F.col("k") > 1))
        ranges = ranges.union(gone.select(*_KEY, "lo", F.col("lo").alias("hi")))
    ranges = ranges.union(marks.where(F.col("state") == SETTLED).select(*_KEY, "lo", "hi"))
    per_text = ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).withColumn("whole", F.lit(False))

    # copies of whole texts, told from ids and hashes alone
    length = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.col(text).alias("t"), length.alias("n")).where(F.col("n") >= spec.window)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [keys_of(t.as_buffer().to_pybytes()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.int64())], _KEY)

    ids = settle(keys.select("id", "t").mapInArrow(hashed, "id bigint, t1 bigint, t2 bigint"), "text-keys")
    classes = ids.groupBy("t1", "t2").agg(F.min("id").alias("eldest"), F.count("*").alias("k")).where("k > 1")
    copies = ids.join(classes, ["t1", "t2"])
    copies = copies.where(F.col("id") > F.col("eldest")) if spec.elder else copies
    whole = copies.select(*_KEY).distinct().withColumn("whole", F.lit(True))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    verdict = per_text.join(whole.withColumnRenamed("whole", "w"), _KEY, "full").select(*_KEY, F.coalesce("ranges", none).alias("ranges"), F.coalesce("w", F.lit(False)).alias("whole"))
    return rows.join(verdict, _KEY, "left")


def covered(ranges, n: int, window: int) -> np.ndarray:
    """Flags of the units that windows starting in ``ranges`` cover."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges:
        step[r["lo"]] += 1
        step[min(n, r["hi"] + window)] -= 1
    return np.cumsum(step)[:n] > 0
