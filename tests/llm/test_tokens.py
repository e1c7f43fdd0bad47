import zlib

import numpy as np

from panelwright.llm import tokens
from tests.llm.helpers import SCHEMA, corpus, frame


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 10, 64, 1000, 4097):
        x = np.arange(n)
        y = tokens.permute(x, n, 5)
        assert sorted(y.tolist()) == x.tolist()
        assert tokens.permute(y, n, 5, inverse=True).tolist() == x.tolist() or n <= 1
    assert (tokens.permute(np.arange(1000), 1000, 5) != tokens.permute(np.arange(1000), 1000, 6)).mean() > 0.9


def test_round_trip(spark, tmp_path):
    rows = corpus(9)
    path = str(tmp_path / "shards")
    got = sorted(tokens.materialise(frame(spark, rows), path, length=64, per_shard=16).collect())
    n = len(got)
    assert [r.slot for r in got] == list(range(n)) and all(r.shard == r.slot // 16 and r.offset == r.slot % 16 * 128 for r in got)
    records = list(tokens.read_slots(path, 0, n))
    assert all(zlib.crc32(x.tobytes()) == r.crc32 for x, r in zip(records, got, strict=True))
    assert [x.tolist() for x in tokens.read_slots(path, 17, 30)] == [x.tolist() for x in records[17:47]]
    # undo the permutation: texts come back whole, in input order within a partition
    encode = tokens.Encoder(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN)
    at = tokens.permute(np.arange(n), n, 23)
    stream = np.concatenate([records[s][: got[s].n_tokens] for s in at])
    ends = np.flatnonzero(stream == encode.end)
    texts = [encode.decode(stream[a:b]) for a, b in zip(np.r_[0, ends[:-1] + 1], ends, strict=True)]
    assert sorted(texts) == sorted(r[1] for r in rows if r[1] is not None)
    held = {d for r in got for d in r.doc_ids}
    assert held == {r[0] for r in rows if r[1] is not None}


def test_doc_ids_name_the_documents_of_a_sequence(spark, tmp_path):
    rows = [(i, f"word{i} " * (3 + 40 * (i % 3)), "en", "s", 1) for i in range(12)]
    path = str(tmp_path / "shards")
    got = sorted(tokens.materialise(frame(spark, rows).coalesce(1), path, length=32, per_shard=4).collect())
    encode = tokens.Encoder(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN)
    for r, x in zip(got, tokens.read_slots(path, 0, len(got)), strict=True):
        text = encode.decode(x[: r.n_tokens])
        ids = [i for i in range(12) if f"word{i} " in text.replace("word", " word").replace("  ", " ") + " "]
        assert set(ids) <= set(r.doc_ids)


def test_empty_and_clashing(spark, tmp_path):
    assert tokens.materialise(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).count() == 0
    df = spark.createDataFrame([(1, "a b", 3), (None, "a b", 3), (2, None, 3)], "doc_id bigint, text string, slot int")
    got = tokens.materialise(df, str(tmp_path / "b"), length=8)
    assert {d for r in got.collect() for d in r.doc_ids} == {1, None}
