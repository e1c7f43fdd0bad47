import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontam
from tests.llm.helpers import SCHEMA, corpus, frame

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def plain(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if w else ():
            wins.setdefault((n, tuple(w[p : p + n])), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {n for n, _ in wins}:
            for p in range(len(w) - n + 1):
                if (n, tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[n, tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


def run(spark, rows, items, **kw):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return decontam.decontaminate(frame(spark, rows), bench, **kw)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_hits_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    rows = corpus(4)
    texts = [t for _, t, *_ in rows if t]
    items = [(k, " ".join(texts[k].split()[3:40]).upper()) for k in range(0, 30, 3)]
    items += [(100, "One, two"), (101, texts[5].split()[0]), (102, ""), (103, None), (104, " - "), (9, items[0][1]), (105, " ".join(texts[2].split()[:9])), (None, " ".join(texts[7].split()[:12]))]
    got = run(spark, rows, items).select("doc_id", "n_words", "n_hit", "hit_items")
    assert sorted((*r[:3], list(r[3])) for r in got.collect()) == plain([r[:2] for r in rows], items)


def test_clean_text_lacks_hit_words_and_keeps_the_rest(spark):
    rows = [(1, "Keep this. Some leaked words, here! And end?", "en", "s", 1), (2, None, None, None, None), (3, "clean -- text", "en", "s", 1)]
    got = {r.doc_id: (r.clean_text, r.contaminated) for r in run(spark, rows, [(1, "some LEAKED words here")], clean=True).collect()}
    assert got == {1: ("Keep this! And end?", True), 2: (None, False), 3: ("clean -- text", False)}


def test_empty_tables_and_clashing_names(spark):
    assert run(spark, [], [(1, "a b")]).count() == 0
    rows = [(1, "a b c", "en", "s", 1)]
    assert [r.n_hit for r in run(spark, rows, []).collect()] == [0]
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (1, "a b c", 5, "x")], "doc_id bigint, text string, n_hit int, k string")
    got = decontam.decontaminate(df, spark.createDataFrame([(1, "b c")], "item_id bigint, text string"))
    assert [(r.n_hit, r.k) for r in got.collect()] == [(2, "x")] * 2 and got.columns.count("n_hit") == 1


def test_plan_is_native(spark):
    plan = run(spark, [(1, "a b c", "en", "s", 1)], [(1, "b c")])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_are_looked_up_by_character_and_lowered_in_ascii_only(spark):
    assert "-" not in decontam.NO_WORD + decontam.ITEM_WORD  # Java tries ranges one after another
    assert {chr(int(c, 16)) for c in re.findall(r"\\x(..)", decontam.NO_WORD)} == {chr(c) for c in range(128) if not re.match("[0-9A-Za-z]", chr(c))}
    texts = ["".join(map(chr, range(128))), "STRASSE É İ K AZ\x00b", "", None, "Plain ASCII_text-9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decontam._words(F.col("t")).alias("w"), F.regexp_count(F.coalesce("t", F.lit("")), F.lit(decontam.ANY_CASE_WORD)).alias("n"))
    want = [[w.decode() for w in words(t)] for t in texts]
    assert [(r.w, r.n) for r in df.collect()] == [(w, len(w)) for w in want]
