"""How sources of one language differ in their words, recounted through minimal acyclic transducers."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.session import settle

#: Terms of one transducer, and bytes of transducers that are broadcast at once.
RANGE_TERMS, WAVE_BYTES = 100_000, 64 << 20
#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 200_000
#: Ordinals and sources of one tile of the comparison.
BLOCK, TILE = 1024, 256

#: Letters small, bytes beyond ASCII as they are, all else between terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


@dataclass(frozen=True)
class Transducer:
    """A minimal acyclic automaton whose outputs add up to a term's place in the sorted list."""

    keys: np.ndarray  # state * 256 + byte of every transition, ascending
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray  # of every state; the last state is the first one of a walk

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From sorted distinct terms: what two terms end with alike is one set of states."""
        states: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([False], [])]  # open states: whether final, transitions
        last = b""

        def close(depth: int) -> None:
            for k in range(len(last), depth, -1):
                ends, edges = path.pop()
                path[-1][1].append((last[k - 1], states.setdefault((ends[0], tuple(edges)), len(states))))

        for t in terms:
            p = 0
            while p < min(len(t), len(last)) and t[p] == last[p]:
                p += 1
            close(p)
            path.extend(([False], []) for _ in t[p:])
            path[-1][0][0] = True
            last = t
        close(0)
        ends, edges = path.pop()
        # the first state stands last, also where an equal one is there already
        table = [*states, (ends[0], tuple(edges))]
        below, keys, target, output = [], [], [], []
        for state, (is_final, out) in enumerate(table):
            n = int(is_final)
            for byte, to in out:
                keys.append(state << 8 | byte)
                target.append(to)
                output.append(n)
                n += below[to]
            below.append(n)
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(output, np.int64), np.array([f for f, _ in table], bool))

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Places of terms from 0, -1 of those that are not accepted; all terms walk side by side."""
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        data = np.frombuffer(b"".join(terms), np.uint8)
        begin = np.cumsum(size) - size
        state = np.full(len(terms), len(self.final) - 1, np.int64)
        place = np.zeros(len(terms), np.int64)
        going, k = np.flatnonzero(size > 0), 0
        while len(going) and len(self.keys):
            key = state[going] << 8 | data[begin[going] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            state[going[~known]] = -1
            going, at = going[known], at[known]
            state[going] = self.target[at]
            place[going] += self.output[at]
            k += 1
            going = going[size[going] > k]
        if not len(self.keys):
            state[size > 0] = -1
        return np.where((state >= 0) & self.final[state], place, -1)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(a.tobytes() for a in (self.keys, self.target, self.output, self.final))

    @classmethod
    def unpack(cls, keys: bytes, target: bytes, output: bytes, final: bytes) -> Transducer:
        return cls(np.frombuffer(keys, np.int64), np.frombuffer(target, np.int32), np.frombuffer(output, np.int64), np.frombuffer(final, bool))


#: First terms, ordinals before them and transducers, by language.
Wave = dict[str, list[tuple[bytes, int, Transducer]]]


def _places(wave: Wave, lang: str, terms: list[bytes]) -> np.ndarray:
    parts = wave.get(lang, [])
    if len(parts) == 1:
        _, before, t = parts[0]
        at = t.ordinals(terms)
        return np.where(at >= 0, at + before, -1)
    out = np.full(len(terms), -1, np.int64)
    order = sorted(range(len(terms)), key=terms.__getitem__)
    ranked = [terms[k] for k in order]
    edges = [bisect_left(ranked, first) for first, _, _ in parts] + [len(terms)]
    for (_, before, t), lo, hi in zip(parts, edges, edges[1:], strict=False):
        at = t.ordinals(ranked[lo:hi])
        out[order[lo:hi]] = np.where(at >= 0, at + before, -1)
    return out


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents that hold it), folded."""

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "term", "n"])
        seen.clear()

    seen: dict[str, Counter] = defaultdict(Counter)
    for b in batches:
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            seen[lang].update(set(terms_of(t.as_buffer().to_pybytes())))
            if sum(map(len, seen.values())) > HELD_TERMS:
                yield from flush()
    yield from flush()


def _build(size: int):
    """Transducers of the sorted terms of a partition, ``size`` terms each."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            parts = Transducer.build(held).pack()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([held[0].decode()]), pa.array([len(held)], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)],
                ["lang", "first", "n", "keys", "target", "output", "final"],
            )

        lang, held = None, []
        for b in batches:
            for la, t in zip(b.column("lang").to_pylist(), b.column("term").to_pylist(), strict=True):
                if held and (la != lang or len(held) == size):
                    yield made()
                    held = []
                lang = la
                held.append(t.encode())
        if held:
            yield made()

    return fn


def transducers(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term) and the transducers of each language's terms, in ranges."""
    folded = docs.select("lang", "text").mapInArrow(_documents_with, "lang string, term string, n bigint")
    kept = settle(folded.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"), "terms")
    ranges = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    made = ranges.mapInArrow(_build(RANGE_TERMS), "lang string, first string, n bigint, keys binary, target binary, output binary, final binary")
    return kept, settle(made, "transducers")


def _waves(made: DataFrame) -> Iterator[Wave]:
    """Transducers in parts that may be broadcast; ordinals go on through the ranges of a language."""
    wave: Wave = defaultdict(list)
    before: Counter = Counter()
    held = 0
    for r in made.orderBy("lang", "first").toLocalIterator():
        parts = (bytes(r["keys"]), bytes(r["target"]), bytes(r["output"]), bytes(r["final"]))
        size = sum(map(len, parts))
        if held and held + size > WAVE_BYTES:
            yield dict(wave)
            wave, held = defaultdict(list), 0
        wave[r["lang"]].append((r["first"].encode(), before[r["lang"]], Transducer.unpack(*parts)))
        before[r["lang"]] += r["n"]
        held += size
    if held:
        yield dict(wave)


def recount(docs: DataFrame, kept: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (lang, source, ordinal, n) of kept terms, and the terms' ordinals (lang, ordinal, term)."""
    spark = docs.sparkSession
    counts = spark.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    names = spark.createDataFrame([], "lang string, ordinal bigint, term string")
    for wave in _waves(made):
        shared = spark.sparkContext.broadcast(wave)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def flush() -> Iterator[pa.RecordBatch]:
                for (lang, source), c in seen.items():
                    at = _places(shared.value, lang, list(c))
                    n = np.fromiter(c.values(), np.int64, len(c))[at >= 0]
                    at = at[at >= 0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(at), pa.array(n)], ["lang", "source", "ordinal", "n"])
                seen.clear()

            seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
            held = 0
            for b in batches:
                for lang, source, t in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                    if lang in shared.value:
                        c = seen[lang, source]
                        held -= len(c)
                        c.update(terms_of(t.as_buffer().to_pybytes()))
                        held += len(c)
                    if held > HELD_TERMS:
                        yield from flush()
                        held = 0
            yield from flush()

        def number(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lang, term = b.column("lang").to_pylist(), b.column("term").to_pylist()
                at = np.full(len(term), -1, np.int64)
                for la in set(lang):
                    rows = [k for k, x in enumerate(lang) if x == la]
                    at[rows] = _places(shared.value, la, [term[k].encode() for k in rows])
                known = pa.array(at >= 0)
                yield pa.RecordBatch.from_arrays([b.column("lang").filter(known), pa.array(at[at >= 0]), b.column("term").filter(known)], ["lang", "ordinal", "term"])

        found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, ordinal bigint, n bigint")
        counts = counts.union(settle(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount"))
        names = names.union(settle(kept.mapInArrow(number, "lang string, ordinal bigint, term string"), "ordinals"))
    return counts, names


def _share(n: np.ndarray, total: np.ndarray, pseudo: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (n + pseudo) / total) by long division with base 1,000, so that nothing overflows."""
    rest, out = n + pseudo, np.zeros_like(n + total)
    while scale > 1:
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
        scale //= 1000
    return out + 1


def _compare(pseudo: int, scale: int):
    """Sums of absolute differences of two tiles of sources over one block of ordinals."""

    def fn(key: tuple, t: pa.Table) -> pa.Table:
        lang, block, low, high = (k.as_py() for k in key)
        g, at, n = (t.column(c).to_numpy() for c in ("g", "ordinal", "n"))
        own = at < 0  # one row a source: its count of all terms
        vocabulary = int(t.column("v")[0].as_py())
        width = max(0, min(BLOCK, vocabulary - block * BLOCK))
        ids, first = np.unique(g[own], return_index=True)
        total = n[own][first] + pseudo * vocabulary
        count = np.zeros((len(ids), width), np.int64)
        count[np.searchsorted(ids, g[~own]), at[~own] - block * BLOCK] = n[~own]
        p = _share(count, np.maximum(total, 1)[:, None], pseudo, scale)
        left, right = np.flatnonzero(ids // TILE == low), np.flatnonzero(ids // TILE == high)
        a, b, f = [], [], []
        for k in left:
            others = right[right > k]
            a.append(np.full(len(others), ids[k]))
            b.append(ids[others])
            f.append(np.abs(p[others] - p[k]).sum(1))
        rows = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b, f)]
        return pa.table([pa.array([lang] * len(rows[0]), pa.string()), *map(pa.array, rows)], ["lang", "a", "b", "f"])

    return fn


def audit(docs: DataFrame, least: int = 30, ranks: int = 50, pseudo: int = 5, scale: int = 1_000_000_000, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How far the sources of every language stand apart: (lang, source, part, item, value, rank).

    Terms are runs of letters and of anything beyond ASCII, lower-cased (A-Z); a
    language keeps those that ``least`` of its documents hold.  With N occurrences
    of V kept terms in a group of rows, a term that occurs n times there has the
    share p = 1 + floor(scale (n + pseudo) / (N + pseudo V)).  Part ``pair``: every
    other source of the language, with the sum of |p - p'| over all kept terms.
    Part ``term``: kept terms that occur in the source with a larger share than in
    the whole language, with the difference, ``ranks`` of them.  Ranks go by
    falling value, then by bytes.  ``scale`` is a power of 1,000.

    A first pass counts documents by term.  Kept terms are sorted, and each range
    of ``RANGE_TERMS`` becomes a minimal acyclic transducer that gives a term's
    ordinal; a second pass sends the texts through them.  Transducers are broadcast
    ``WAVE_BYTES`` at a time; a vocabulary beyond that takes one pass for each such
    part.  Counts are folded in every task, so a hot source costs one row per term
    and task; sources are compared in tiles of ``TILE`` by ``BLOCK`` ordinals.

    Null texts, languages and sources count as empty strings.  Groups without terms
    are there, with the share of a term that never occurs.  Row order, ids and
    repeated rows need no care: every row counts.  An empty table gives no rows.
    """
    if scale < 1000 or 1000 ** (len(str(scale)) // 3) != scale:
        raise ValueError("scale must be a power of 1,000")
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    kept, made = transducers(named, least)
    counts, names = recount(named, kept, made)
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    order = Window.partitionBy("lang").orderBy("source")
    groups = settle(
        groups.select(
            "lang",
            "source",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("v", F.lit(0)).alias("v"),
            (F.row_number().over(order) - 1).cast("bigint").alias("g"),
            F.count("*").over(Window.partitionBy("lang")).alias("of"),
        ),
        "groups",
    )

    cells = counts.join(groups.select("lang", "source", "g", "v", "of"), ["lang", "source"])
    cells = cells.select("lang", "g", "v", "of", "ordinal", "n", F.floor(F.col("ordinal") / BLOCK).alias("block"))
    heads = groups.select("lang", "g", "v", "of", F.lit(-1).cast("bigint").alias("ordinal"), F.col("total").alias("n"), F.explode(F.expr(f"sequence(0, greatest(v - 1, 0) div {BLOCK})")).alias("block"))
    mine = F.floor(F.col("g") / TILE)
    tiles = cells.unionByName(heads).withColumn("other", F.explode(F.expr(f"sequence(0, (of - 1) div {TILE})")))
    tiles = tiles.select("lang", "block", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"), "g", "v", "ordinal", "n")
    apart = tiles.groupBy("lang", "block", "low", "high").applyInArrow(_compare(pseudo, scale), "lang string, a bigint, b bigint, f bigint")
    apart = apart.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = apart.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(F.col("b").alias("g"), F.col("a").alias("o")))).alias("p")).select("lang", "value", "p.g", "p.o")
    name = groups.select("lang", "g", "source")
    pairs = both.join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(down).alias("rank"))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    shares = counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]).join(whole, ["lang", "ordinal"]).join(of_lang, "lang")

    def share(n: str, total: str):
        return F.expr(f"cast(1 + cast({scale} as decimal(38,0)) * ({n} + {pseudo}) div ({total} + {pseudo} * v) as bigint)")

    more = shares.withColumn("value", share("n", "total") - share("`all`", "all_total")).where("n > 0 and value > 0")
    top = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = more.select("lang", "source", "ordinal", "value", F.row_number().over(top).alias("rank")).where(F.col("rank") <= ranks)
    terms = best.join(names, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
