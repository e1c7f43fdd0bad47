import collections
import random
import re

import pytest

from panelwright.llm import divergence
from tests.llm.helpers import SCHEMA, corpus, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(rows, least, ranks):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, term by term."""
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    df, count, groups = collections.Counter(), collections.Counter(), sorted({(la, s) for _, la, s in rows})
    for t, la, _ in rows:
        df.update((la, w) for w in set(terms(t)))
    for t, la, s in rows:
        count.update((la, s, w) for w in terms(t) if df[la, w] >= least)
    out = set()
    for la in {g[0] for g in groups}:
        kept = sorted((w for (x, w), n in df.items() if x == la and n >= least), key=str.encode)
        mine = [s for x, s in groups if x == la]

        def shares(c):
            total = sum(c) + 5 * len(kept)
            return [1 + 10**9 * (n + 5) // total for n in c]

        p = {s: shares([count[la, s, w] for w in kept]) for s in mine}
        q = shares([sum(count[la, s, w] for s in mine) for w in kept])
        for s in mine:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in mine if o != s))
            out |= {(la, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            over = sorted((q[k] - p[s][k], w.encode()) for k, w in enumerate(kept) if count[la, s, w] and p[s][k] > q[k])
            out |= {(la, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(over[:ranks])}
    return out


def test_transducer_is_minimal_and_numbers_terms():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 3000):
        words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))).encode() for _ in range(n)})
        t = divergence.Transducer.build(words)
        others = [w + b"a" for w in words] + [w[:-1] for w in words] + [b"zz", b"\xff", b""]
        others = [w for w in others if w not in set(words)]
        assert t.ordinals(words).tolist() == list(range(len(words)))
        assert set(t.ordinals(others).tolist()) <= {-1}
        assert divergence.Transducer.unpack(*t.pack()).ordinals(words).tolist() == list(range(len(words)))
        # states are as many as different sets of endings
        ends = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}} if n <= 50 else None
        assert ends is None or not words or len(t.final) == len(ends)


def test_shares_are_exact_for_large_counts():
    import numpy as np

    n, total = np.array([0, 7, 10**14, 123456789012345]), np.array([10**15 + 7] * 4)
    assert divergence._share(n, total, 5, 10**9).tolist() == [1 + 10**9 * (int(k) + 5) // int(t) for k, t in zip(n, total, strict=True)]


def sample(seed=9):
    rng = random.Random(seed)
    rows = [(r[1], rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", "", None])) for r in corpus(seed, 200) if len(r[1] or "") < 3000]
    return [*rows, ("1 2 3", "xx", "only"), (None, "xx", "none"), ("", "yy", "alone")] + [("same words here", "zz", f"s{k % 7}") for k in range(70)]


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"RANGE_TERMS": 30, "WAVE_BYTES": 4000, "HELD_TERMS": 100, "BLOCK": 7, "TILE": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = sample()
    df = frame(spark, [(i, *r, None) for i, r in enumerate(rows)])
    got = [tuple(r) for r in divergence.audit(df, 10, 20).collect()]
    want = brute(rows, 10, 20)
    assert len(got) == len(set(got)) and set(got) == want
    assert {("xx", "only", "pair", "none", 0, 1), ("yy", "alone")}.intersection({r for r in got} | {r[:2] for r in got}) == {("xx", "only", "pair", "none", 0, 1)}


def test_empty_table_and_clashing_names(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA), 1).count() == 0
    rows = [("x y", "en", "s", 1, 2, 3, "q"), ("x x", "en", "t", 1, 2, 3, "q")]
    df = spark.createDataFrame(rows, "text string, lang string, source string, g int, n int, v int, part string")
    assert {tuple(r) for r in divergence.audit(df, 1).collect()} == brute([r[:3] for r in rows], 1, 50)
    with pytest.raises(ValueError):
        divergence.audit(df, scale=10)
