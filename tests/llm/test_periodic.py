import random
from fractions import Fraction

import numpy as np
import pytest

from panelwright.llm import periodic, registry
from tests.llm.helpers import SCHEMA, corpus, frame, sha, words_of


def brute(w: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def test_lce_is_exact():
    rng = random.Random(4)
    for letters in (1, 2, 3, 30):
        for n in (2, 3, 17, 400):
            s = [rng.randrange(letters) for _ in range(n)] if n != 400 else [rng.randrange(letters) for _ in range(7)] * 50 + [1] * 50
            g = periodic.Grammar(np.array(s))
            pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
            pairs = rng.sample(pairs, min(len(pairs), 3000))
            i, j = np.array(pairs).T
            for a, b, got in zip(i, j, g.lce(i, j), strict=True):
                k = 0
                while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                    k += 1
                assert k == got, (s, a, b)


def test_runs_equal_brute_force_and_levels_are_few():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            unit = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * 9)[: rng.randint(0, 9 * len(unit))]
        texts.append(w)
    got = periodic.find([np.array(w, np.int64) for w in texts], 6, 4)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(w) for w in texts]
    assert sum(map(len, got)) > 100
    assert len(periodic.Grammar(np.random.default_rng(1).integers(0, 50, 100_000)).levels) < 80


def test_small_chunks_change_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [np.array([rng.randrange(2) for _ in range(rng.randint(0, 80))]) for _ in range(60)]
    before = [g.tolist() for g in periodic.find(texts, 6, 4)]
    monkeypatch.setattr(periodic, "CHUNK_POINTS", 7)
    assert [g.tolist() for g in periodic.find(texts, 6, 4)] == before


def expected(text):
    w = words_of(text)
    runs = brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return len(w), runs, best, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_operator_on_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 50)
    rows = [r for r in corpus(3) if r[1] is None or len(r[1]) < 4000]
    rows += [(None, "a b " * 9, None, None, None), (None, "a b " * 9, None, None, None), (7, " ".join("x y z z".split() * 3000), "en", "s", 1), (8, "x " * 9000, "en", "s", 1)]
    df = frame(spark, rows)
    got = periodic.find_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, runs, best, kept = expected(r.text) if len(r.text or "") < 4000 else (r.n_words, [(0, r.n_words, len(set(r.text.split())) + (r.doc_id == 7))], None, " ".join(r.text.split()[: len(set(r.text.split())) + (r.doc_id == 7)]))
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (n, runs, kept)
        if len(r.text or "") < 4000:
            assert (tuple(r.best_run) if r.best_run else None) == best
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([("a a a a a a b", 5, 6, 7)], "text string, runs int, _row int, _t int")
    out = periodic.find_runs(clash).first()
    assert (out._row, out._t, [tuple(x) for x in out.runs], out.collapsed) == (6, 7, [(0, 6, 1)], "a b")
    with pytest.raises(ValueError):
        periodic.find_runs(df, times=3)


def test_query_against_brute_force(spark, sf):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op11_recompression_runs(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.n_runs for r in got)
    for r in got:
        w = words_of(docs[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = brute(w)
        _, _, best, kept = expected(b" ".join(w).decode())
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs).encode())
        assert r.collapsed_sha256 == sha(kept.encode())
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
