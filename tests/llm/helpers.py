"""Small documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random

import xxhash
from pyspark.sql import Row, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().split()


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose with copies, near copies, shared passages, repeats within a text, empty, null and long texts."""
    rng = random.Random(seed)
    vocab = [rng.choice("aeiouäéß") + "".join(rng.choice("bcdfgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, line = prose(70), prose(20)
    rows: list[str | None] = []
    for k in range(n):
        w = prose(rng.randint(1, 200))
        if k % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if k % 3 == 0:
            w[:0] = line
        rows.append(rng.choice([" ", "  ", "\n", "\t"]).join(w))
        if k % 7 == 0:
            rows.append(rows[-1])
        if k % 5 == 0:
            v = list(w)
            v[rng.randrange(len(v))] = "Changed"
            rows.append(" ".join(v))
    twice = " ".join(prose(60))
    rows += [None, None, "", " \n", "one", "one two", "ONE two", twice + " gap " + twice, "x" * 1500, "ab " * 400, " ".join(prose(6000))]
    out = [(i, t, "en", f"s{i % 5}" if i % 6 else None, None) for i, t in enumerate(rows)]
    rng.shuffle(out)
    return out


def frame(spark: SparkSession, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def as_set(df) -> list[Row]:
    return sorted(tuple(r) for r in df.collect())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def simhash(text: str | None) -> int:
    w = words_of(None if text is None else text.translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(keys: list, linked) -> list[int]:
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]
