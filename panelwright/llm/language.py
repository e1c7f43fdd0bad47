"""Language of web pages from text, markup, address and host, combined by Bayes' rule."""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.session import settle

#: Hashed byte trigrams.
GRAMS = 1 << 14
#: Most bytes of the model, which is broadcast: 8 x GRAMS for each language (512 languages). More raise an error.
MAX_MODEL_BYTES = 64 << 20
#: Trigrams overlap and are not independent: a text counts as at most so many of them.
EVIDENCE = 40
#: Pages that a level of the host hierarchy weighs as much as.
STRENGTH = 5.0
#: Pseudo-count of the table of declared against actual languages.
SMOOTH = 1.0

_HIDDEN = re.compile(rb"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
_TAG = re.compile(rb"(?s)<[^>]*>")
_OPEN = re.compile(rb"(?i)<(html|meta)\b")
_LANG = re.compile(rb"(?is)\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_META = re.compile(rb"(?i)content-language")
_CONTENT = re.compile(rb"(?is)content\s*=\s*[\"']?\s*([a-z]{2,3})\b")
#: Lower-cases ASCII letters and turns other ASCII into spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def visible(page: bytes) -> bytes:
    """Text of a page without markup, scripts, styles and comments."""
    bare = _TAG.sub(b" ", _HIDDEN.sub(b" ", page))
    return html_.unescape(bare.decode("utf-8", "replace")).encode() if b"&" in bare else bare


def declared(page: bytes) -> str:
    """Language that the markup names, the html tag before a meta tag, or an empty string; every byte is read once or twice."""
    meta, at = b"", 0
    while m := _OPEN.search(page, at):
        end = page.find(b">", m.end())
        at = len(page) if end < 0 else end
        if m.group(1).lower() == b"html":
            if found := _LANG.search(page, m.end(), at):
                return found.group(1).decode().lower()
        elif not meta and (name := _META.search(page, m.end(), at)) and (found := _CONTENT.search(page, name.end(), at)):
            meta = found.group(1)
    return meta.decode().lower()


def host_of(url: str | None) -> tuple[str, str]:
    """Host of an address and its last label; empty if there is none."""
    try:
        host = (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        host = ""
    last = host.rpartition(".")[2]
    return host, "" if last.isdigit() else last


def grams(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of letters; runs of anything else are one space."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(18), minlength=GRAMS)


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # languages x GRAMS

    def log_likelihood(self, text: bytes) -> np.ndarray:
        c = grams(text)
        n = c.sum()
        at = np.flatnonzero(c)
        return (self.log_p[:, at] @ c[at]) * (min(n, EVIDENCE) / n) if n else np.zeros(len(self.languages))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram frequencies by language over all labelled texts of ``docs``.

    Every language is kept; a model above ``MAX_MODEL_BYTES`` is an error.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for l, t in zip(b.column("l").to_pylist(), b.column("t"), strict=True):
                c = grams(t.as_buffer().to_pybytes())
                total[l] = total[l] + c if l in total else c
        for l, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at)), pa.array(at), pa.array(c[at])], ["l", "gram", "n"])

    most = MAX_MODEL_BYTES // (8 * GRAMS)
    names = sorted(r["l"] for r in labelled.select("l").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages: the model would exceed {MAX_MODEL_BYTES} bytes")
    rows = labelled.mapInArrow(count, "l string, gram bigint, n bigint").groupBy("l", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(names), GRAMS), 0.5)
    if rows.num_rows:
        index = {l: k for k, l in enumerate(names)}
        np.add.at(table, (np.array([index[l] for l in rows.column("l").to_pylist()]), rows.column("gram").to_numpy()), rows.column("n").to_numpy())
    return TextModel(names, np.log(table / table.sum(1, keepdims=True)) if names else table)


def identify(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``suffix``, ``declared``, ``text_language``, ``language``, ``probability`` of every page.

    Evidence is combined as a posterior over the model's languages:
    text likelihood x probability of the declared language given the actual one
    x prior of the host.  The table of declared against actual languages and the
    priors are summed over all pages from posteriors by text alone; a host's prior
    is smoothed towards that of its address suffix, which is smoothed towards all
    pages, and leaves out the page itself.  Sums by host and suffix are folded
    before they are shuffled, so a host with a third of all pages is no burden.

    Null or empty pages rest on markup, suffix and host; pages without an address
    form one host; without any labelled text the language is null.
    """
    names = model.languages
    k = len(names)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for i, u, h in zip(b.column("i").to_pylist(), b.column("u").to_pylist(), b.column("h"), strict=True):
                page = h.as_buffer().to_pybytes() if h.is_valid else b""
                ll = m.log_likelihood(visible(page))
                p = np.exp(ll - ll.max()) if len(ll) else ll
                out.append((i, *host_of(u), declared(page), (ll - ll.max()).tolist() if len(ll) else [], (p / p.sum()).tolist() if len(ll) else []))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "host", "suffix", "declared", "ll", "p"])

    source = pages.select(F.col(page_id).cast("bigint").alias("i"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    seen = settle(source.mapInArrow(read, "page_id bigint, host string, suffix string, declared string, ll array<double>, p array<double>"), "pages")
    base = ["page_id", "host", "suffix", "declared"]
    if not k:
        none = F.lit(None).cast("string")
        return seen.select(*base, none.alias("text_language"), none.alias("language"), F.lit(None).cast("double").alias("probability"))
    total = F.array(*[F.sum(F.col("p")[j]) for j in range(k)])
    whole = seen.agg(total.alias("p"), F.count("*").alias("n")).first()  # one row of as many numbers as languages
    all_p, all_n = [x or 0.0 for x in whole["p"]], whole["n"]
    by_suffix = seen.groupBy("suffix").agg(total.alias("suffix_p"), F.count("*").alias("suffix_n"))
    by_host = seen.groupBy("host").agg(total.alias("host_p"), F.count("*").alias("host_n"))
    # declared values beyond the known languages count as one
    said = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared") == "", F.lit("")).otherwise(F.lit("?"))
    heard = seen.withColumn("said", said).groupBy("said").agg(total.alias("said_p"))
    joined = (
        seen.withColumn("said", said)
        .join(F.broadcast(heard), "said", "left")  # at most one row per language and two
        .join(by_suffix, "suffix")
        .join(by_host, "host")
    )
    uniform = 1.0 / k

    def score(j: int):
        own = F.col("p")[j]
        root = (F.lit(all_p[j]) - own + SMOOTH * uniform) / F.lit(all_n - 1 + SMOOTH)
        mid = (F.col("suffix_p")[j] - own + STRENGTH * root) / (F.col("suffix_n") - 1 + STRENGTH)
        prior = (F.col("host_p")[j] - own + STRENGTH * mid) / (F.col("host_n") - 1 + STRENGTH)
        said_as = (F.greatest(F.lit(0.0), F.col("said_p")[j] - own) + SMOOTH) / (F.greatest(F.lit(0.0), F.lit(all_p[j]) - own) + SMOOTH * (k + 2))
        return F.col("ll")[j] + F.log(said_as) + F.log(F.greatest(F.lit(1e-12), prior))

    scored = joined.withColumn("s", F.array(*[score(j) for j in range(k)]))
    label = F.array(*[F.lit(x) for x in names])
    best = F.array_max("s")
    return scored.select(
        *base,
        F.element_at(label, F.array_position("p", F.array_max("p")).cast("int")).alias("text_language"),
        F.element_at(label, F.array_position("s", best).cast("int")).alias("language"),
        F.round(1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - best)), 6).alias("probability"),
    )
