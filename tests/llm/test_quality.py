import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelwright.llm import quality
from tests.llm.helpers import SCHEMA


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        w = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w) if i % 2 else " ".join(x + "%%%" for x in w)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, SCHEMA).repartition(4)
    y = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.fit(d, y.where(~quality.held_out()), voters=200, basis_rows=100)
    assert len(model.votes) == 200
    got = quality.score(d, model).join(y, "doc_id").where(quality.held_out()).collect()
    assert len(got) > 50
    assert sum((r.score >= quality.GOOD) == (r.quality == 1) for r in got) >= 0.95 * len(got)
    again = quality.fit(d.repartition(2), y.where(~quality.held_out()), voters=200, basis_rows=100)
    assert {r.doc_id: r.score for r in quality.score(d, again).collect()} == {r.doc_id: r.score for r in quality.score(d, model).collect()}


def test_held_out_rule(spark):
    import zlib

    df = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", quality.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_awkward_rows(spark):
    docs, labels = labelled(60)
    docs += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "x" * 200_000, "en", "s", 1), (1002, "x" * 200_000, "en", "s", 1), (None, "the end.", "en", "s", 1)]
    d = spark.createDataFrame([(*r, 0.5, 1) for r in docs], SCHEMA + ", score double, z int")
    y = spark.createDataFrame([*labels, (1000, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality.score(d, quality.fit(d, y))
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows) and got.columns.count("score") == 1
    none = quality.fit(d, y.where(F.lit(False)))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.fit(empty, y)).count() == 0


def test_vote_is_the_weighted_share_of_the_nearest():
    import numpy as np

    m = quality.Model(np.zeros(1), np.zeros((1, 2), np.float32), np.array([[1.0, 0], [0, 1.0], [-1.0, 0]]), np.array([1.0, 0, 0]), 0.25)
    z = np.array([[1.0, 0], [0.6, 0.8], [0, 0]])
    got = quality._vote(z, m, 2)
    assert got[0] == 1.0 and abs(got[1] - 0.6**4 / (0.6**4 + 0.8**4)) < 1e-12 and got[2] == 0.25


def sparse_rows(n, terms, seed=3):
    rng = np.random.default_rng(seed)
    topics = [rng.choice(quality.TERMS, 2 * terms, replace=False) for _ in range(90)]
    ids = [np.sort(rng.choice(topics[min(rng.geometric(0.04) - 1, 89)], terms, replace=False)).astype(np.int32) for _ in range(n)]
    tf = [(1 + rng.random(terms)).astype(np.float32) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], ["ids", "tf"])


def test_basis_spans_the_leading_singular_vectors():
    for n in (3, 150, 700):
        b, idf = sparse_rows(n, 40), np.linspace(0.5, 2, quality.TERMS)
        got = np.array(next(quality._span(idf, 64)(iter([b]))).column(0).to_pylist(), np.float64)
        x = np.zeros((n, quality.TERMS))
        for k, (at, tf) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            x[k, at] = tf * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, values, right = np.linalg.svd(x, full_matrices=False)
        assert got.shape == (quality.TERMS, min(n, 64))
        assert abs(got.T @ got - np.eye(got.shape[1])).max() < 1e-4
        assert abs(np.linalg.norm(x @ got) - np.linalg.norm(values[:64])) < 1e-4
        assert abs(abs((right[:8] * got.T[:8]).sum(1)) - 1).max() < 1e-3


def test_basis_of_all_its_rows_takes_little_memory():
    rows = sparse_rows(quality.BASIS_ROWS, 300)
    tracemalloc.start()
    try:
        list(quality._span(np.ones(quality.TERMS), quality.DIMS)(iter([rows])))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_scoring_takes_little_memory():
    rng = np.random.default_rng(1)
    model = quality.Model(np.ones(quality.TERMS), rng.random((quality.TERMS, 64)).astype(np.float32), rng.random((quality.VOTERS, 64)), np.ones(quality.VOTERS), 0.5)
    texts = pa.array([f"word {i}" for i in range(600)])
    tracemalloc.start()
    try:
        got = quality._scores(quality.Terms(), texts, model, quality.NEIGHBOURS)
        assert len(got) == 600 and tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()


def test_remembered_words_are_bounded():
    terms, fresh = quality.Terms(), quality.Terms()
    for k in range(4):
        text = b" ".join(b"%x" % (k * 60_000 + i) for i in range(60_000)) + b" " + b"y" * 100
        got, want = terms.counts(text), quality.Terms().counts(text)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        assert len(terms.known) <= quality.KNOWN_WORDS and len(terms.shapes) <= quality.KNOWN_SHAPES
    many = b" ".join(b"%x" % i for i in range(250_000))
    assert len(fresh.counts(many)[0]) and len(fresh.known) <= quality.KNOWN_WORDS
