"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Hashed terms, latent dimensions, neighbours that vote.
TERMS, DIMS, NEIGHBOURS = 8192, 64, 25
#: Bounds of the fit: labelled rows that vote, and those of them that span the latent space.
VOTERS, BASIS_ROWS = 8000, 2000
#: Rows that a task holds as dense vectors of terms, or of similarities to all voters, at once.
DENSE_ROWS = 64
#: Most steps towards the latent space.
MOST_STEPS = 200
#: Words and shapes that a task remembers, of this many bytes at most; what is read is not bounded.
KNOWN_WORDS, KNOWN_SHAPES, KNOWN_BYTES = 100_000, 50_000, 64
#: Score from which a document counts as good.
GOOD = 0.7

#: Kinds of bytes: small letters (and all beyond ASCII), capitals, digits; others stand for themselves.
_KINDS = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_ID_BITS = TERMS.bit_length()


class Terms:
    """Term counts of texts: words, their shapes and endings; remembers what it has met."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}

    def _ids(self, word: bytes) -> int:
        """Hashed ids of a word, of its shape (runs of one kind of character) and of its ending, in one number."""
        kinds = word.translate(_KINDS)
        shape = self.shapes.get(kinds)
        if shape is None:
            shape = zlib.crc32(_RUN.sub(rb"\1\1", kinds), 1) % TERMS
            if len(kinds) <= KNOWN_BYTES:
                if len(self.shapes) >= KNOWN_SHAPES:
                    self.shapes.clear()
                self.shapes[kinds] = shape
        return zlib.crc32(word) % TERMS | shape << _ID_BITS | zlib.crc32(word[-3:], 2) % TERMS << 2 * _ID_BITS

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term ids and their weights (1 + log of the count)."""
        words = Counter(text.split())
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        known = self.known
        met: dict[bytes, int] = {}
        for w in [w for w in words if w not in known]:
            (known if len(w) <= KNOWN_BYTES and len(known) < KNOWN_WORDS else met)[w] = self._ids(w)
        n = sum(words.values())
        packed = np.fromiter((known[w] if w in known else met[w] for w in words) if met else map(known.__getitem__, words), np.int64, len(words))
        each = np.fromiter(words.values(), np.float64, len(words))
        mask = (1 << _ID_BITS) - 1
        # how much repeats, and how long the text is, as terms of their own
        lines = [x for x in text.split(b"\n") if x]
        facts = [
            b"distinct words %d" % int(10 * len(words) / max(n, 1)),
            b"distinct lines %d" % int(10 * len(set(lines)) / max(len(lines), 1)),
            b"words %d" % n.bit_length(),
            b"word length %d" % min(20, len(text) // max(n, 1)),
        ]
        ids = np.concatenate([packed & mask, packed >> _ID_BITS & mask, packed >> 2 * _ID_BITS, [zlib.crc32(f, 3) % TERMS for f in facts]]).astype(np.int64)
        tf = np.bincount(ids, np.concatenate([each, each, each, np.full(len(facts), max(1.0, n / 8))]), TERMS)
        at = np.flatnonzero(tf)
        return at, 1 + np.log(np.maximum(tf[at], 1.0))


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # TERMS
    basis: np.ndarray  # TERMS x DIMS
    voters: np.ndarray  # unit rows
    votes: np.ndarray  # their labels
    prior: float  # share of label 1


def _as_bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, seen, n = Terms(), np.zeros(TERMS, np.int64), 0
    for b in batches:
        for t in b.column(0):
            seen[terms.counts(_as_bytes(t))[0]] += 1
        n += b.num_rows
    at = np.r_[-1, np.flatnonzero(seen)]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[n, seen[at[1:]]])], ["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for b in batches:
        both = [terms.counts(_as_bytes(t)) for t in b.column("t")]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([i.astype(np.int32) for i, _ in both], pa.list_(pa.int32())), pa.array([w.astype(np.float32) for _, w in both], pa.list_(pa.float32()))], ["h", "ids", "tf"])


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows from term ids and weights."""
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, (at, tf) in enumerate(rows):
        w = tf * idf[at]
        x[k, at] = w / (np.linalg.norm(w) or 1.0)
    return x


def _leading(gram: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``dims`` largest eigenvalues of a symmetric matrix and their vectors, largest first.

    Large matrices take steps on a subspace of twice the width until the values
    stand still: ``eigh`` needs four more matrices of this size.
    """
    if len(gram) <= 4 * dims:
        values, vectors = np.linalg.eigh(gram)
        return values[::-1][:dims], vectors[:, ::-1][:, :dims]
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(gram), 2 * dims)))[0]
    before = np.zeros(dims)
    for _ in range(MOST_STEPS):
        image = gram @ q
        values, turn = np.linalg.eigh(q.T @ image)
        values = values[::-1][:dims]
        if np.abs(values - before).max() <= 1e-10 * values[0]:
            break
        before, q = values, np.linalg.qr(image)[0]
    return values, q @ turn[:, ::-1][:, :dims]


def _span(idf: np.ndarray, dims: int):
    """The basis, a row for each term: leading right singular vectors of the tf-idf rows, which are one partition of bounded size.

    Only blocks of the rows are dense at a time.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(at.values.to_numpy(), tf.values.to_numpy()) for b in batches for at, tf in zip(b.column("ids"), b.column("tf"), strict=True)]
        if not rows:
            return
        step = 4 * DENSE_ROWS
        gram = np.empty((len(rows), len(rows)))
        for i in range(0, len(rows), step):
            x = _dense(rows[i : i + step], idf)
            for j in range(0, i + 1, step):
                block = x @ _dense(rows[j : j + step], idf).T
                gram[i : i + step, j : j + step] = block
                gram[j : j + step, i : i + step] = block.T
        values, left = _leading(gram, dims)
        top = values > 1e-9
        values, left = values[top], left[:, top]
        basis = sum(_dense(rows[i : i + step], idf).T @ left[i : i + step] for i in range(0, len(rows), step))
        basis = (basis / np.sqrt(values)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(basis), pa.list_(pa.float32()))], ["row"])

    return fn


def _latent(terms: Terms, texts, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of texts in the latent space; zero where nothing is known."""
    out = (_dense([terms.counts(_as_bytes(t)) for t in texts], idf) @ basis).astype(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "quality", voters: int = VOTERS, basis_rows: int = BASIS_ROWS, dims: int = DIMS, seed: int = 5) -> Model:
    """A model from ``labelled`` (doc_id, ``label`` 0 or 1) and the texts of ``docs``.

    Document frequencies are counted over all of ``docs``.  At most ``voters``
    labelled rows, those with the smallest seeded hash of their id, become
    neighbours, and ``basis_rows`` of them span the latent space (leading right
    singular vectors of their tf-idf rows); these bounds make model and broadcast
    a few MB at any size.  Rows with a null label or id are left out, and of an id
    with several labels the largest counts; if no row is labelled, every score is
    the neutral 0.5.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(text).alias("t")).mapInArrow(_document_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen, n = np.zeros(TERMS), 0
    for r in df:
        if r["term"] < 0:
            n = r["n"]
        else:
            seen[r["term"]] = r["n"]
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    usable = labelled.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = usable.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(voters).collect()
    empty = Model(idf, np.zeros((TERMS, dims), np.float32), np.zeros((0, dims)), np.zeros(0), 0.5)
    if not chosen:
        return empty
    ids = spark.createDataFrame([(r["doc_id"], r["h"], float(r["y"])) for r in chosen], "id bigint, h bigint, y double")
    texts = docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"]).select("h", "y", docs[text].alias("t"))  # bounded by `voters`
    edge = sorted(r["h"] for r in chosen)[: max(basis_rows, 1)][-1]
    rows = texts.where(F.col("h") <= edge).select("h", "t").mapInArrow(_sparse, "h bigint, ids array<int>, tf array<float>").orderBy("h").limit(basis_rows)
    found = rows.mapInArrow(_span(idf, dims), "row array<float>").toArrow()
    if not found.num_rows:
        return empty
    basis = found.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(TERMS, -1)
    shared = spark.sparkContext.broadcast((idf, basis))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            parts = [_latent(terms, b.column("t").slice(at, DENSE_ROWS), *shared.value) for at in range(0, b.num_rows, DENSE_ROWS)]
            z = np.concatenate(parts) if parts else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(list(z), pa.list_(pa.float64()))], ["h", "y", "z"])

    placed = texts.mapInArrow(place, "h bigint, y double, z array<double>").orderBy("h", "y", "z").limit(voters).toArrow()
    z = placed.column("z").combine_chunks().flatten().to_numpy().reshape(placed.num_rows, -1)
    y = placed.column("y").to_numpy()
    return Model(idf, basis, z, y, float(y.mean()) if len(y) else 0.5)


def _vote(z: np.ndarray, model: Model, neighbours: int) -> np.ndarray:
    """Share of label 1 among the nearest neighbours, weighted by similarity."""
    if not len(model.votes):
        return np.full(len(z), model.prior)
    sims = z @ model.voters.T
    k = min(neighbours, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(z), 1))
    w = np.maximum(np.take_along_axis(sims, near, 1), 0.0) ** 4
    total = w.sum(1)
    share = (w * model.votes[near]).sum(1) / np.where(total > 0, total, 1.0)
    return np.where(total > 1e-9, share, model.prior)


def _scores(terms: Terms, texts, model: Model, neighbours: int) -> np.ndarray:
    """Scores of texts, a block of rows at a time."""
    blocks = (texts.slice(at, DENSE_ROWS) for at in range(0, len(texts), DENSE_ROWS))
    return np.concatenate([np.zeros(0), *(np.round(_vote(_latent(terms, t, model.idf, model.basis), model, neighbours), 6) for t in blocks)])


def score(docs: DataFrame, model: Model, text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, it replaces a column of this name) from the whole text.

    Every document is compared with all voters, a block of rows at a time.  A
    null text counts as an empty one; an empty text is scored by its few terms
    (that it has no words), a text unlike any voter by the share of label 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select(*keep).schema.add("score", "double")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(terms, b.column(text), m, neighbours))], [*b.schema.names, "score"])

    return docs.select(*keep).mapInArrow(fn, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
