"""Embedding near-duplicates on robust-pruned neighbour graphs of overlapping shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelwright.llm.common import connected
from panelwright.session import settle

#: Aim and bound of the rows that one task indexes or searches.
SHARD_ROWS, BLOCK_ROWS = 400, 2000
#: Sample rows for the cluster centres, and most centres (they are broadcast).
SAMPLE_ROWS, MAX_CENTRES = 20_000, 4096
#: A vector joins its nearest centres, at most OVERLAP of them, within MARGIN radians of the nearest.
OVERLAP, MARGIN = 3, 0.35
#: Clusters are one clump if the mean cosine of their vectors is at most so much below the threshold.
CLUMP = 0.08
#: Out-degree, beam width and slack of the pruning rule.
DEGREE, BEAM, ALPHA = 24, 40, 1.2
#: Of so many of its nearest neighbours a row is made a neighbour as well.
BACK = 8


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Robust pruning for many rows at once: the nearest candidate stays and drops those it is ALPHA times nearer to."""
    keep = np.full((len(own), DEGREE), -1, np.int64)
    vec = x[np.maximum(cand, 0)]
    away = np.sqrt(np.maximum(2 - 2 * np.einsum("qd,qcd->qc", x[own], vec), 0))
    away[(cand < 0) | (cand == own[:, None])] = np.inf
    rows = np.arange(len(own))
    for r in range(DEGREE):
        best = away.argmin(1)
        live = np.isfinite(away[rows, best])
        if not live.any():
            break
        keep[live, r] = cand[rows, best][live]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("qd,qcd->qc", vec[rows, best], vec), 0))
        away[(ALPHA * between <= away) | ~live[:, None]] = np.inf
        away[rows, best] = np.inf
    return keep


def beam_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int):
    """Greedy best-first search of many queries; returns what was seen and what was expanded (queries x nodes)."""
    q = np.arange(len(queries))
    seen, done = (np.zeros((len(queries), len(x)), bool) for _ in range(2))
    seen[:, starts] = True
    beam = np.tile(starts, (len(q), 1))
    near = queries @ x[starts].T
    while True:
        open_ = np.where(done[q[:, None], beam] | ~np.isfinite(near), -np.inf, near)
        pick = open_.argmax(1)
        act = np.flatnonzero(np.isfinite(open_[q, pick]))
        if not len(act):
            return seen, done
        node = beam[act, pick[act]]
        done[act, node] = True
        nb = adj[node]
        ok = (nb >= 0) & ~seen[act[:, None], np.maximum(nb, 0)]
        seen[np.repeat(act, ok.sum(1)), nb[ok]] = True
        new = np.full((len(q), nb.shape[1]), -np.inf)
        sims = np.einsum("qd,qrd->qr", queries[act], x[np.maximum(nb, 0)])
        new[act] = np.where(ok, sims, -np.inf)
        ids = np.zeros((len(q), nb.shape[1]), np.int64)
        ids[act] = np.maximum(nb, 0)
        beam, near = np.concatenate([beam, ids], 1), np.concatenate([near, new], 1)
        if beam.shape[1] > width:
            top = np.argpartition(-near, width - 1, axis=1)[:, :width]
            beam, near = np.take_along_axis(beam, top, 1), np.take_along_axis(near, top, 1)


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Adjacency (rows x DEGREE, -1: none) and medoid, by inserting growing batches into the graph so far."""
    n = len(x)
    adj = np.full((n, DEGREE), -1, np.int64)
    medoid = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[medoid, order[order != medoid]]
    at, start = 1, np.array([medoid])
    while at < n:
        batch = order[at : at + min(at, 128)]
        seen, _ = beam_search(x, adj, x[batch], start, BEAM)
        sims = np.where(seen, x[batch] @ x.T, -np.inf)
        most = min(2 * BEAM, n)
        cand = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most < n else np.tile(np.arange(n), (len(batch), 1))
        cand = np.where(np.isfinite(np.take_along_axis(sims, cand, 1)), cand, -1)
        adj[batch] = prune(x, batch, cand)
        # reverse edges; lists that overflow are pruned again
        tail, head = np.repeat(batch, DEGREE), adj[batch].ravel()
        tail, head = tail[head >= 0], head[head >= 0]
        order_ = np.argsort(head, kind="stable")
        tail, head = tail[order_], head[order_]
        targets, first, count = np.unique(head, return_index=True, return_counts=True)
        wide = np.full((len(targets), count.max(initial=0)), -1, np.int64)
        wide[np.repeat(np.arange(len(targets)), count), np.arange(len(head)) - np.repeat(first, count)] = tail
        both = np.concatenate([adj[targets], wide], 1)
        both = np.sort(both, 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        room = (both >= 0).sum(1) <= DEGREE
        packed = -np.sort(-both, 1)[:, :DEGREE]
        adj[targets[room]] = packed[room] if packed.shape[1] == DEGREE else np.pad(packed[room], ((0, 0), (0, DEGREE - packed.shape[1])), constant_values=-1)
        if (~room).any():
            adj[targets[~room]] = prune(x, targets[~room], both[~room])
        at += len(batch)
    return adj, medoid


def both_ways(x: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Adjacency (-1: none) by which a row is reached from its nearest neighbours, too.

    In a clump whose rows are about equally far apart few rows are among the
    nearest of others, so by edges of one direction most of it is never reached.
    A row gets edges to the rows that have it among their ``BACK`` nearest; of many
    such rows it knows the nearest, and each of them the next two.
    """
    n = len(x)
    sims = np.concatenate([np.einsum("ed,ed->e", x[tail[k : k + 65536]], x[head[k : k + 65536]]) for k in range(0, len(tail), 65536)] or [np.zeros(0)])

    def rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges by key, the nearest first, and the place of each within its key."""
        order = np.lexsort((-sims, key))
        count = np.bincount(key, minlength=n)
        return order, np.arange(len(key)) - (np.cumsum(count) - count)[key[order]]

    order, place = rank(tail)
    mine = order[place < BACK]
    tail_b, head_b, sims = tail[mine], head[mine], sims[mine]
    order, place = rank(head_b)
    t, h = tail_b[order], head_b[order]
    edges = [(tail, head), (h[place < DEGREE], t[place < DEGREE])]
    for step in (1, 2):
        same = h[:-step] == h[step:]
        edges.append((t[:-step][same], t[step:][same]))
    pairs = np.unique(np.concatenate([a * n + b for a, b in edges]))
    pairs = pairs[pairs // n != pairs % n]
    tail, head = pairs // n, pairs % n
    count = np.bincount(tail, minlength=n)
    adj = np.full((n, max(1, count.max(initial=0))), -1, np.int64)
    adj[tail, np.arange(len(tail)) - (np.cumsum(count) - count)[tail]] = head
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, threshold: float, chunk: int = 256):
    """Pairs (i, j), i <> j, with cosine >= threshold that greedy search from ``starts`` and expansion of the range reach."""
    n = len(x)
    for lo in range(0, n, chunk):
        queries = x[lo : lo + chunk]
        seen, done = beam_search(x, adj, queries, starts, BEAM)
        q, v = np.nonzero(seen)
        hits = []
        while len(q):
            sims = np.concatenate([np.einsum("pd,pd->p", queries[q[k : k + 65536]], x[v[k : k + 65536]]) for k in range(0, len(q), 65536)])
            q, v = q[sims >= threshold], v[sims >= threshold]
            hits.append(np.stack([q + lo, v]))
            fresh = ~done[q, v]
            q, v = q[fresh], v[fresh]
            done[q, v] = True
            if not len(q):
                break
            nb = adj[v]
            ok = (nb >= 0) & ~seen[q[:, None], np.maximum(nb, 0)]
            pairs = np.unique(np.repeat(q, ok.sum(1)) * n + nb[ok])
            q, v = pairs // n, pairs % n
            seen[q, v] = True
        i, j = np.concatenate(hits, 1)
        yield i[i != j], j[i != j]


def _matrix(col, dim: int | None = None) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build_block(rows: pa.Table) -> pa.Table:
    x, ids = _matrix(rows.column("vec")), rows.column("rep").to_numpy()
    adj, _ = build(x)
    lists = [ids[a[a >= 0]] for a in adj]
    return pa.table({"rep": ids, "near": pa.array(lists, pa.list_(pa.int64()))})


def _search_block(threshold: float):
    def fn(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        ids, block, weight = (rows.column(c).to_numpy() for c in ("rep", "block", "copies"))
        order = np.argsort(ids, kind="stable")
        rows = rows.take(pa.array(order))
        ids, block, weight = ids[order], block[order], weight[order]
        x = _matrix(rows.column("vec"))
        near = rows.column("near").combine_chunks()
        head = near.flatten().to_numpy()
        tail = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy(zero_copy_only=False).astype(int))
        at = np.minimum(np.searchsorted(ids, head), len(ids) - 1)
        inside = ids[at] == head
        tail, at = tail[inside], at[inside]
        adj = both_ways(x, tail, at)
        starts = []
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            starts.append(own[(x[own] @ x[own].mean(0)).argmax()])
        lists = rows.column("shards").combine_chunks()
        wide = np.full((len(ids), OVERLAP), -2, np.int64)  # -2: no shard; -1: the only one of a small label
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
        wide[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        two = len(starts) > 1
        keys = []
        for i, j in range_search(x, adj, np.array(starts), threshold):
            if two:  # a pair of blocks answers for the pairs across
                i, j = i[block[i] != block[j]], j[block[i] != block[j]]
            # of shards that hold both, the smallest counts the link
            same = wide[i][:, :, None] == wide[j][:, None, :]
            common = np.where(same & (wide[i][:, :, None] > -2), wide[i][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
            i, j = i[common == shard], j[common == shard]
            keys.append(np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j)))
        pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        i, j = pairs // len(ids), pairs % len(ids)
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = links > 0
        return pa.table({"rep": ids[hit], "links": links[hit].astype(np.int64), "other": ids[root[hit]]})

    return fn


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means centres of a bounded sample, and the mean cosine of a centre's vectors with it."""
    rng = np.random.default_rng(k)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    own = (sample @ c.T).argmax(1)
    tight = np.bincount(own, (sample * c[own]).sum(1), len(c)) / np.maximum(np.bincount(own, minlength=len(c)), 1)
    return c, tight


def _apart(c: np.ndarray, tight: np.ndarray, least: float) -> np.ndarray:
    """Centres without those that cut a clump: where vectors of two centres have a mean cosine of ``least`` or more, one goes.

    The mean cosine of two clusters' vectors is that of their centres times how
    tight each is, so centres of spread out vectors stay, however close they are.
    """
    kept: list[int] = []
    for k in range(len(c)):
        if not kept or (tight[k] * tight[kept] * (c[kept] @ c[k])).max() < least:
            kept.append(k)
    return c[kept]


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Distinct usable vectors: ``rep`` (smallest id), ``copies``, ``label``, ``dim``, ``vec``."""
    e = F.col(embedding).cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & e.isNotNull())
    usable = usable.where(finite & F.exists(e, lambda v: v != 0))
    return usable.groupBy(F.col(label).cast("string").alias("label"), e.alias("vec")).agg(F.min(F.col(vec_id).cast("bigint")).alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vec"))


def shards_of(found: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``found`` with ``shards``: ids of the overlapping clusters each vector belongs to.

    A clump of vectors of which most link is not cut (``_apart``): it becomes one
    large cluster, whose pairs of blocks carry its size.
    """
    spark = found.sparkSession
    sizes = found.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD_ROWS).orderBy(F.desc("n"), "label", "dim").limit(MAX_CENTRES // 2).collect()
    total = sum(r["n"] for r in sizes)
    scale = max(SHARD_ROWS, 2 * total / MAX_CENTRES)
    centres: dict[tuple, tuple[int, np.ndarray]] = {}
    base = 0
    if sizes:
        groups = spark.createDataFrame([(r["label"], r["dim"]) for r in sizes], "label string, dim int")
        sample = found.join(F.broadcast(groups), ["label", "dim"]).orderBy(F.xxhash64("rep")).limit(SAMPLE_ROWS).select("label", "dim", "vec").toArrow()
        label, dim = sample.column("label").to_pylist(), sample.column("dim").to_pylist()
        by: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(label, dim, strict=True)):
            by.setdefault(key, []).append(k)
        for r in sizes:
            key = (r["label"], r["dim"])
            if key in by:
                c = _apart(*_centres(_matrix(sample.column("vec").take(pa.array(by[key]))), math.ceil(r["n"] / scale)), threshold - CLUMP)
                centres[key] = (base, c)
                base += len(c)
    shared = spark.sparkContext.broadcast(centres)

    def fn(batches):
        for b in batches:
            label, dim = np.array(b.column("label").to_pylist(), object), b.column("dim").to_numpy()
            out: list[list[int]] = [[-1]] * b.num_rows
            for key in set(zip(label.tolist(), dim.tolist(), strict=True)) & shared.value.keys():
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                first, c = shared.value[key]
                angle = np.arccos(np.clip(_matrix(b.column("vec").take(pa.array(at))) @ c.T, -1, 1))
                near = np.argsort(angle, 1)[:, :OVERLAP]
                ok = np.take_along_axis(angle, near, 1) <= angle.min(1, keepdims=True) + MARGIN
                for k, row, use in zip(at, near, ok, strict=True):
                    out[k] = sorted((first + row[use]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, "shards"])

    schema = T.StructType([*found.schema.fields, T.StructField("shards", T.ArrayType(T.LongType()))])
    return found.mapInArrow(fn, schema)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null and their cosine (double
    precision) is at least ``threshold``.  Vectors that are null, empty, zero or
    hold null or non-finite parts, and rows without an id, link with nothing.

    Equal vectors are one node with a count, so copies cost nothing.  Nodes are
    dealt to overlapping clusters (centres from a bounded sample; a label small
    enough is one shard), each of which is indexed by a robust-pruned graph.  The
    neighbour lists that a node has in its clusters are united, and every node
    searches each of its clusters over the united lists: greedily from the
    medoid, then on from everything within range.  A pair that several clusters
    hold is counted by the first.  A cluster with more than ``BLOCK_ROWS`` rows is
    dealt into blocks, and each pair of blocks is searched on its own.  Found
    pairs are exact; what search misses is measured by ``audit``.
    """
    found = settle(shards_of(settle(classes(vectors, vec_id, embedding, label), "vectors"), threshold), "vectors")
    member = found.withColumn("shard", F.explode("shards")).withColumn("group", F.concat_ws("\x01", "label", "dim", "shard"))
    full = member.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    full = settle(full.select("group", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "full-shards")
    member = member.join(full, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = settle(member.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "members")
    lists = member.select("group", "block", "rep", "vec").groupBy("group", "block").applyInArrow(_build_block, "rep bigint, near array<bigint>")
    united = lists.select("rep", F.explode("near").alias("b")).groupBy("rep").agg(F.collect_set("b").alias("near"))
    ready = member.join(united, "rep", "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
    ready = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ready = ready.select("group", "shard", "shards", "block", "rep", "copies", "vec", "near", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    searched = settle(ready.groupBy("group", "lo", "hi").applyInArrow(_search_block(threshold), "rep bigint, links bigint, other bigint"), "searched")
    roots = connected(searched.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = searched.groupBy("rep").agg(F.sum("links").alias("links"))
    node = found.select("rep", "copies", "label", "vec").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    node = node.select("label", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    id_ = F.col(vec_id).cast("bigint")
    every = vectors.select(id_.alias("id"), F.when(F.col(vec_id).isNotNull(), F.col(label).cast("string")).alias("l"), F.col(embedding).cast("array<double>").alias("e"))
    every = every.join(node, (F.col("l") == F.col("label")) & (F.col("e") == F.col("vec")), "left")
    root = F.coalesce("root", "id")
    return every.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, every: int = 50, most: int = 20_000) -> float:
    """Share of the true links of rows with id divisible by ``every`` (at most ``most``) that ``result`` counts."""
    spark = vectors.sparkSession
    usable = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    q = usable.where(F.col("vec_id") % every == 0).orderBy("vec_id").limit(most).select("vec_id", F.col("label").cast("string").alias("label"), "embedding").toArrow()
    shared = spark.sparkContext.broadcast((q.column("vec_id").to_numpy(), np.array(q.column("label").to_pylist(), object), np.array(q.column("embedding").to_pylist(), np.float64)))

    def fn(batches):
        ids, label, x = shared.value
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            y = np.array(b.column("embedding").to_pylist(), np.float64).reshape(b.num_rows, -1)
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            same = label[:, None] == np.array(b.column("label").to_pylist(), object)[None, :]
            total += ((x @ y.T >= threshold) & same & (ids[:, None] != b.column("vec_id").to_numpy()[None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

    true = usable.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(fn, "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))
    r = true.join(result, "vec_id").agg(F.sum(F.least("n", "n_links")).alias("a"), F.sum("n").alias("b")).first()
    return 1.0 if not r["b"] else r["a"] / r["b"]
