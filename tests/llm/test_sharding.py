import collections

from panelwright.llm import sharding
from tests.llm.helpers import SCHEMA, corpus, frame


def test_shards_are_even_gapless_and_complete(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000)
    rows = corpus(7, 200)
    df = frame(spark, rows)
    got = sharding.shuffle_shards(df, 24).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r[0], r[1]) for r in rows) or len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shuffle_shards(df.repartition(3), 24).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {r.doc_id: (r.shard, r.slot) for r in again}
    other = sharding.shuffle_shards(df, 24, seed=12).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} != {r.doc_id: (r.shard, r.slot) for r in other}


def test_order_is_close_to_uniform(spark):
    rows = [(i, str(i), "en", "s", 1) for i in range(4000)]
    got = sharding.shuffle_shards(frame(spark, rows), 4).collect()
    counts = collections.Counter((r.shard, r.doc_id // 1000) for r in got)
    assert all(abs(n - 250) < 70 for n in counts.values()) and len(counts) == 16


def test_repeated_rows_nulls_empty_table_and_clashing_names(spark):
    rows = [(None, None, "en", "s", 1)] * 30 + [(1, "a", "en", "s", 1)] * 30
    got = sharding.shuffle_shards(frame(spark, rows), 7).collect()
    assert len(got) == 60 and max(collections.Counter(r.shard for r in got).values()) <= 9
    assert sharding.shuffle_shards(spark.createDataFrame([], SCHEMA), 3).count() == 0
    df = spark.createDataFrame([(1, "a", 9, 8)], "doc_id bigint, text string, shard int, _bucket int")
    assert [(r.shard, r._bucket) for r in sharding.shuffle_shards(df, 1).collect()] == [(0, 8)]


def test_fewer_rows_than_shards(spark):
    got = sharding.shuffle_shards(frame(spark, corpus(8)[:5]), 24).collect()
    assert len(got) == 5 and {r.slot for r in got} == {0} and len({r.shard for r in got}) == 5
