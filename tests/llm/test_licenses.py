import random
import re

import pytest

from panelwright.llm import licenses, registry
from tests.llm.helpers import SCHEMA, corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def distance(notice, span: str) -> int:
    """Errors between a phrase and a stretch when firm words must stand as they are."""
    p, firm, at = notice.phrase, set(), 0
    for w in p.split(" "):
        if w in notice.firm:
            firm |= set(range(at, at + len(w)))
        at += len(w) + 1
    big = 99
    row = [0]
    for j in range(1, len(span) + 1):
        row.append(j)
    for i in range(1, len(p) + 1):
        fixed = i - 1 in firm
        # nothing may be put between two characters of one firm word
        inside = i in firm and fixed
        new = [big if fixed else row[0] + 1]
        for j in range(1, len(span) + 1):
            best = row[j - 1] + (0 if span[j - 1] == p[i - 1] else big if fixed else 1)
            if not fixed:
                best = min(best, row[j] + 1)
            if not inside:
                best = min(best, new[j - 1] + 1)
            new.append(min(best, big))
        row = new
    return row[-1]


def brute(notice, words: list[str]) -> int | None:
    """Fewest errors of any stretch of whole words, if few enough."""
    best = None
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            s = " ".join(words[i:j])
            if len(s) > len(notice.phrase) + notice.edits:
                break
            if len(s) >= len(notice.phrase) - notice.edits:
                d = distance(notice, s)
                if d <= notice.edits and (best is None or d < best):
                    best = d
    return best


def mutate(rng: random.Random, s: str, n: int) -> str:
    for _ in range(n):
        k, c = rng.randrange(len(s)), rng.choice("abcdeilmnst 2é")
        s = rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :]])
    return s


def test_errors_equal_brute_force():
    rng = random.Random(2)
    hits = 0
    for _ in range(400):
        n = rng.choice(licenses.NOTICES)
        parts = [mutate(rng, n.phrase, rng.randint(0, n.edits + 2)) for _ in range(rng.randint(1, 2))]
        words = " ".join([rng.choice(["", "so it is", "the mit", "under", "license version 2 cc"]), *parts, rng.choice(["", "under the", "mit license"])]).split()
        text = licenses.plain(" ".join(words).encode()).decode()
        for m in {n, *licenses.BASE}:
            got = licenses.spans(text, m)
            assert (min((e for *_, e in got), default=None)) == brute(m, words), (m.phrase, text, got)
            assert all(text[a - 1] == " " == text[b] and " " != text[a] and distance(m, text[a:b]) == e for a, b, e in got)
            hits += bool(got)
    assert hits > 100


def test_all_exact_places_are_kept_and_close_ones_overlap_nothing():
    n = licenses.Notice("x", "aa aa")
    assert licenses.spans(" aa aa aa aa aaa ", n) == [(1, 6, 0), (4, 9, 0), (7, 12, 0)]
    mit = licenses.BASE[0]
    line = licenses.plain("Under the MIT license. undr the MIT (licence)! under the mpl license, under them it license".encode()).decode()
    assert [(line[a:b], e) for a, b, e in licenses.spans(line, mit)] == [("under the mit license", 0), ("undr the mit licence", 2)]
    many = licenses.plain(b"under the mit license " * 3000 + b"undr the mit license " * 3000).decode()
    got = licenses.spans(many, mit)
    assert len(got) == 6000 and sum(e for *_, e in got) == 3000


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def base_places(text):
    w = words(text)
    return sorted((i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_operator_on_awkward_texts(spark):
    rows = corpus(4) + [
        (None, "CC-BY-NC and cc by nc", None, None, None),
        (None, "CC-BY-NC and cc by nc", None, None, None),
        (9001, "x" * 200_000 + " Permission is herebyy granted, free of charge, to any person", "en", "s", 1),
    ]
    got = licenses.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_words == len(words(r.text))
        assert [(m.first_word, m.label) for m in r.notices if m.edits == 0 and m.phrase in PHRASES.values()] == base_places(r.text)
    assert [[tuple(m) for m in r.notices] for r in got if r.doc_id == 9001] == [[("mit", "permission is hereby granted free of charge to any person", 1, 10, 1)]]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([("cc by nc", 5, 6)], "text string, notices int, _t int")
    assert [(r._t, r.n_words, len(r.notices)) for r in licenses.scan(clash).collect()] == [(6, 3, 1)]


@pytest.mark.parametrize("table", ["sf0.001"])
def test_query_against_brute_force(spark, sf, table):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op12_license_notices(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 0
    for r in got:
        places = base_places(docs[r.doc_id])
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base) == (len(words(docs[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(places) and (r.score > 0) == bool(r.labels)
        if len(docs[r.doc_id] or "") < 600:
            near = {n.label for n in licenses.NOTICES if brute(n, words(docs[r.doc_id])) is not None}
            assert r.labels == ",".join(sorted(near))
