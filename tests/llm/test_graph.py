import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import graph
from tests.llm.helpers import components

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n, dim=16, groups=20, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i in range(n):
        v = base[rng.integers(groups)] + rng.standard_normal(dim) * rng.choice([0.0, 0.03, 0.06, 0.1])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], int(rng.integers(labels)) if i % 11 else None))
    return rows


def plain(rows, threshold=0.93):
    x = [None if r[1] is None or r[2] is None or not r[1] or not all(c is not None and np.isfinite(c) for c in r[1]) or not any(r[1]) else np.array(r[1]) / np.linalg.norm(r[1]) for r in rows]

    def linked(a, b):
        return x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold

    n = len(rows)
    links = [sum(linked(a, b) for b in range(n) if b != a) for a in range(n)]
    root = components(list(range(n)), linked)
    least = {}
    for r, row in zip(root, rows, strict=True):
        least[r] = min(least.get(r, row[0]), row[0])
    return {row[0]: (k, least[r]) for row, k, r in zip(rows, links, root, strict=True)}


def run(spark, rows):
    got = graph.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}


def test_equals_brute_force(spark):
    rows = vectors(300)
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(40)]  # a group of equal vectors
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(2000 + k, v, 1) for k, v in enumerate(bad)]
    assert run(spark, rows) == plain(rows)


def test_overlapping_shards_and_blocks_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 60)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 80)
    rows = vectors(900, groups=120, labels=2)
    want, got = plain(rows), run(spark, rows)
    assert sum(min(got[i][0], want[i][0]) for i in got) >= 0.9 * sum(k for k, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    df = spark.createDataFrame(rows, SCHEMA)
    result = graph.near_vectors(df)
    assert graph.audit(df, result, every=1) >= 0.9


def test_range_search_finds_a_whole_dense_cluster():
    rng = np.random.default_rng(2)
    x = np.r_[rng.standard_normal((1, 8)) + rng.standard_normal((150, 8)) * 0.02, rng.standard_normal((150, 8))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    adj, medoid = graph.build(x)
    pairs = {(int(a), int(b)) for i, j in graph.range_search(x, adj, np.array([medoid]), 0.93) for a, b in zip(i, j, strict=True)}
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True) if a != b}
    assert pairs <= true and len(pairs) >= 0.98 * len(true)


def test_pruned_lists_skip_what_a_nearer_neighbour_covers():
    x = np.array([[1, 0, 0], [0.99, 0.14, 0], [0.98, 0.2, 0], [0.9, 0, 0.43]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keep = graph.prune(x, np.array([0]), np.array([[1, 2, 3]]))[0]
    assert keep[keep >= 0].tolist() == [1, 3]


def test_empty_table_null_and_repeated_ids(spark):
    assert graph.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5)], SCHEMA + ", rep int")
    got = graph.near_vectors(df).orderBy(F.col("vec_id").asc_nulls_first()).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny_tables(spark, n):
    rows = [(i, [1.0, float(i) / 100], 1) for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_all_links_of_tight_clumps_are_found(spark):
    """Rows about equally far apart: few are among the nearest of others, and k-means cuts what should stay whole."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for label, n, noise in (("a", 1500, 0.2), ("b", 700, 0.27)):
        centre = rng.normal(size=64)
        v = centre / np.linalg.norm(centre) + noise * rng.normal(size=(n, 64)) / 8
        rows += [(len(rows) + k, row.tolist(), label) for k, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").repartition(4)
    got = {r.vec_id: r.n_links for r in graph.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    true = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(1) - 1
    found = np.array([got[k] for k in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.999 * true.sum()
