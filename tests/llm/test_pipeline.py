import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import decontam, quality, registry, tokens
from tests.llm.helpers import words_of
from tests.llm.test_decontam import plain
from tests.llm.test_jaccard import expected

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out[name] = docs
    return out


def test_stage_names_and_columns(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixture", "tokens"]
    assert all(df.columns == columns for name, df in stages.items() if name != "tokens")


def test_quality_keeps_what_is_labelled_good(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(quality.held_out())
    kept = {r.doc_id for r in stages["quality"].collect()}
    rows = held.collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in rows)
    assert right >= 0.9 * len(rows)


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages["quality"].collect()]
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == sorted(set(expected(before).values()))


def test_contaminated_documents_go(spark, sf, stages):
    before = [(r.doc_id, r.text) for r in stages["near_duplicates"].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r[0] for r in plain(before, items) if not r[2]]
    assert sorted(r.doc_id for r in stages["decontamination"].collect()) == clean


def test_mixture_repeats_documents_near_the_targets(stages):
    before = {r.doc_id: r for r in stages["decontamination"].collect()}
    after = stages["mixture"].collect()
    size = {i: len(words_of(r.text)) for i, r in before.items()}
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == before[r.doc_id].text
    assert max(times.values()) <= 3 and set(times) <= set(before)
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken - sum(size.values())) <= 0.1 * sum(size.values())


def test_tokens_hold_every_document(stages):
    ids = {r.doc_id for r in stages["mixture"].collect()}
    rows = stages["tokens"].orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert {d for r in rows for d in r.doc_ids} == ids
    assert all(0 < r.n_tokens <= tokens.SEQUENCE for r in rows)


@pytest.mark.parametrize("name", ["decontamination", "mixture"])
def test_texts_are_not_shuffled(spark, sf, stages, name):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as where tables are large
    try:
        out = dict(corpus_pipeline.STAGES)[name](spark, stages["near_duplicates"], sf)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in stages["near_duplicates"].collect()}
    finally:
        spark.conf.set(threshold, before)


def test_rows_with_hits_and_odd_columns_go(spark):
    """A null text, repeated rows and a column named as the key stay as they are."""
    item = " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + item + " y", 7), (2, None, 8), (3, "clean text", 9), (3, "clean text", 9), (4, item.upper(), 1)], "doc_id bigint, text string, k int")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, None, 8), (3, "clean text", 9), (3, "clean text", 9)]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 5


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_contract_columns(spark, sf):
    first = {
        "op1_simhash_pigeonhole": ["doc_id", "fingerprint", "component_id"],
        "op6_external_shuffle": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op9_neighbour_votes": ["doc_id", "held_out", "score", "predicted"],
        "op10_mixture_flow": ["doc_id", "size", "source_size", "target", "taken"],
    }
    for name, columns in first.items():
        assert registry.QUERIES[name](spark, sf).columns[: len(columns)] == columns
