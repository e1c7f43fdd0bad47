import random

import numpy as np
import pytest

from panelwright.llm import anchors, substrings, suffixes
from tests.llm.helpers import SCHEMA, corpus, frame, words_of


def plain_words(rows, window):
    eldest = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            eldest[k] = min(eldest.get(k, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if eldest[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), b" ".join(kept).decode()))
    return sorted(out)


def plain_bytes(rows, window):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] = seen.get(b[p : p + window], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


SETTINGS = [
    {},
    {"GROUP_ROWS": 2, "SORT_BYTES": 2000},  # large groups go by whole windows
    {"HOT_ROWS": 2, "SALTS": 3, "HELD_ROWS": 50},  # salted groups
    {"CHUNK": 300},  # texts longer than a piece
]


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("window", [10, 50])
def test_words_equal_brute_force(spark, monkeypatch, settings, window):
    for k, v in settings.items():
        monkeypatch.setattr(anchors, k, v)
    rows = corpus(2)
    got = substrings.remove_repeats(frame(spark, rows), window).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect())) == plain_words([r[:2] for r in rows], window)


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("window", [30, 200])
def test_bytes_equal_brute_force(spark, monkeypatch, settings, window):
    for k, v in settings.items():
        monkeypatch.setattr(anchors, k, v)
    rows = corpus(3)
    got = suffixes.remove_repeats(frame(spark, rows), window).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes")
    assert sorted((*r[:4], bytes(r[4])) for r in got.collect()) == plain_bytes([r[:2] for r in rows], window)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for trial in range(120):
        s = [rng.randint(1, 1 + trial % 5) for _ in range(rng.randint(1, 50))]
        s = (s * 3 if trial % 4 == 0 else s) + [0]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        a = np.array(s, np.uint8)
        assert suffixes.suffix_array(a).tolist() == order
        plcp = suffixes.permuted_lcp(a, np.array(order))
        for x, y in zip(order, order[1:], strict=False):
            n = 0
            while max(x, y) + n < len(s) and s[x + n] == s[y + n]:
                n += 1
            assert plcp[y] == n


def test_deep_nodes_are_equal_windows():
    rng = random.Random(6)
    words = np.array([rng.randint(0, 1) for _ in range(400)] * 2)
    starts = np.arange(len(words) - 50 + 1)
    node = substrings.deep_nodes(words, starts, 50)
    by = {}
    for p in starts:
        by.setdefault(tuple(words[p : p + 50]), []).append(p)
    for group in by.values():
        nodes = set(node[group])
        assert nodes == {-1} if len(group) == 1 else len(nodes) == 1 and -1 not in nodes


def test_null_ids_repeated_rows_and_clashing_names(spark):
    long_ = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long_, "a"), (4, long_, "b"), (4, long_, "c"), (9, long_, "d"), (None, None, "e"), (None, "", "f")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, id string, n_words int, t1 string")
    words = substrings.remove_repeats(df, 50)
    assert sorted((r.id, r.n_words, r.n_removed) for r in words.collect()) == [("a", 80, 80), ("b", 80, 0), ("c", 80, 0), ("d", 80, 80), ("e", 0, 0), ("f", 0, 0)]
    assert {r.id: r.text for r in words.collect()}["a"] == long_ and "t1" in words.columns
    n = len(long_)
    gone = suffixes.remove_repeats(df, 200)
    assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans) for r in gone.collect()) == [(k, n, n, 1) for k in "abcd"] + [("e", 0, 0, 0), ("f", 0, 0, 0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_repeats(empty).count() == suffixes.remove_repeats(empty).count() == 0
