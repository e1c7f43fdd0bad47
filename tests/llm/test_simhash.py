import random

import pytest

from panelwright.llm import common, simhash
from tests.llm.helpers import SCHEMA, components, corpus, frame
from tests.llm.helpers import simhash as plain


def expected(rows):
    ids, fps = [r[0] for r in rows], [plain(r[1]) for r in rows]
    root = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return {i: (f, least[r]) for i, f, r in zip(ids, fps, root, strict=True)}


@pytest.mark.parametrize("block,short", [(4096, 48), (3, 2)])
def test_components_equal_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "SHORT_RUN", short)
    rows = corpus()
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == expected(rows)


def test_links_connect_all_pairs_within_distance(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint"), 3)
    roots = {r.node: r.root for r in common.connected(links).collect()}
    mine = [roots.get(x, x) for (x,) in signed]
    plain_roots = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(set(zip(mine, plain_roots, strict=True))) == len(set(mine)) == len(set(plain_roots))


def test_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 9.0, 1: 90.0}]
    assert simhash.allocate(costs, 1 - 2 + 1) == (2.0 + 0.0 + 5.0, [0, 1, -1])


def test_correlated_bits_share_a_group():
    import numpy as np

    corr = np.eye(8)
    for a, b in ((0, 5), (1, 4), (2, 7), (3, 6)):
        corr[a, b] = corr[b, a] = 0.9
    groups = simhash.group_bits(corr, 4)
    assert sorted(groups) == [[0, 5], [1, 4], [2, 7], [3, 6]]


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted({c for _, c in expected(rows).values()})


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "q r s t"), (7, "q r s t"), (3, "q r s t"), (None, None), (5, "")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id bigint, text string, fp string, root int, _id string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.fp) for r in kept.collect()) == [
        (False, 3, "q r s t", "x"),
        (False, 5, "", "x"),
        (True, 0, "a b c d", "x"),
    ]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r.node: r.root for r in common.connected(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_stars_are_told_from_other_links(spark):
    for edges, stars in (([], True), ([(2, 1), (3, 1), (5, 4)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False)):
        assert common._are_stars(spark.createDataFrame(edges, "hi bigint, lo bigint")) == stars
