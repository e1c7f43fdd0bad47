import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright import session
from panelwright.llm import jaccard
from panelwright.llm.common import BATCH_BYTES, small_batches
from tests.llm.helpers import SCHEMA, components, corpus, frame, words_of


def shingles(text):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def expected(rows):
    root = components([shingles(r[1]) for r in rows], similar)
    least = {}
    for r, c in zip(rows, root, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    return {r[0]: least[c] for r, c in zip(rows, root, strict=True)}


def replaced(n, seed=5):
    """Random texts of 400 words, each with a copy in which 5 words are replaced."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(n):
        w = [word() for _ in range(400)]
        v = list(w)
        for k in rng.sample(range(400), 5):
            v[k] = word()
        texts += [" ".join(w), " ".join(v)]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


def clump(n, seed=6):
    """Copies of one text of 100 words with one or two words replaced, and as many of which only the head agrees."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for i in range(n):
        v = list(base)
        for k in rng.sample(range(100), 1 + i % 2):
            v[k] = f"x{i}"
        texts += [" ".join(v), " ".join(base[:30] + [f"y{i % 9}-{k}" for k in range(20)] + ([f"z{i}"] if i % 3 else []))]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("make,small,rounds", [(lambda: replaced(60), 16, 8), (lambda: corpus(), 16, 8), (lambda: corpus(), 2, 8), (lambda: clump(60), 3, 8), (lambda: clump(60), 2, 1)])
def test_components_equal_brute_force(spark, monkeypatch, make, small, rounds):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = make()
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == expected(rows)


def test_stage_drops_copies_with_five_words_replaced(spark, sf):
    rows = replaced(30)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_empty_table(spark):
    assert jaccard.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = replaced(4, seed=8)
    text = rows[0][1]
    odd = [(None, text, 1, 2), (None, text, 1, 2), (50, None, 3, 4), (51, "", 3, 4), (51, "", 3, 4), (None, "short one", 5, 6)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t, *_ in rows] + odd, "doc_id bigint, text string, s int, root int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(rows[k][0], rows[k][1]) for k in (0, 2, 4, 6)] + [(50, None), (None, "short one")], key=str)


def test_common_shingles_order_prefixes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    rows = clump(40, seed=9) + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(r[1] for r in corpus(2, 30))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == expected(rows)


def test_batches_are_bounded_by_bytes_and_settings_come_back(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(0, 600, 1, 2).select(F.repeat(F.lit("long text "), 5000).alias("t"))
    with small_batches(spark):
        sizes = [r["n"] for r in rows.mapInArrow(count, "n bigint").collect()]
    assert sum(sizes) == 600 and max(sizes) * 50_000 <= BATCH_BYTES + 50_000
    assert [spark.conf.get(n) for n in names] == before


def test_close_fingerprints_are_compared_first(spark, monkeypatch):
    """Candidates of SimHash: verified by whole sets, and not paired again under their shingles."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(1200)]
    texts = []
    for i in range(12):  # one word in 1,200 differs: few bits
        v = list(base)
        v[i * 90] = f"x{i}"
        texts.append(" ".join(v))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s", 1) for i, (_, t, *_) in enumerate(replaced(3))]
    df = frame(spark, rows)
    with small_batches(spark):
        prints = jaccard._texts(df, "text").mapInArrow(jaccard._prints(5), "k1 bigint, k2 bigint, s bigint, n bigint, fp bigint, some array<bigint>").localCheckpoint()
        of = {r.s: r.k1 for r in prints.collect()}
        near = {(of[r.a], of[r.b]) for r in jaccard._close_prints(prints).collect()}
    assert near and all(a < 100 and b < 100 for a, b in near)
    for r in prints.collect():
        g = shingles(next(t for i, t, *_ in rows if i == r.k1))
        assert r.n == len(g)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == expected(rows)


def test_only_the_keepers_stay_on_disk(spark, sf):
    rows = replaced(10, seed=4)
    since = session.settled()
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf)
    assert session.settled() - since == 1
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 20, 2))


def test_few_rounds_suffice_for_unlike_sets_under_common_shingles(spark, monkeypatch):
    """Every round is many small jobs; several sets of a bucket are compared with all others in one."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    tags, settle = [], jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df, tag="table", files=None: (tags.append(tag), settle(df, tag, files))[1])
    rows = clump(60, seed=12)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == expected(rows)
    assert tags.count("pairs") <= 4  # SimHash, two rounds, each with each
