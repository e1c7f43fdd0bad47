"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import fresh, lower_ascii
from panelwright.session import settle

#: ASCII characters but letters and digits. One by one: Java looks these up in a table, but tries ranges in turn.
NO_WORD = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: A word of a lower-cased text: letters, digits and anything beyond ASCII.
ITEM_WORD = f"[^{NO_WORD}{ascii_uppercase}]+"
#: The same words in a text whose case is as it was, and what stands between them.
ANY_CASE_WORD = f"[^{NO_WORD}]+"
BETWEEN = f"[{NO_WORD}]*"
#: Most rows of benchmark n-grams that are broadcast; a larger set is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _lower(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does so by bytes where there is nothing else to change."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _gram(length: int) -> tuple[int, int]:
    """Width and stride of blocks so that any ``length`` words in a row hold a whole block."""
    width = (length + 2) // 2
    return width, length - width + 1


def _bounded(df: DataFrame):
    """A settled set, broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    kept = settle(df, "benchmark")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per distinct text with hits: key, positions of hit words, items that occur.

    Items are cut into windows of ``window`` words (an item of fewer words is one
    window).  Any window inside a document covers a whole block of about half its
    words that begins at a multiple of a stride, so a document is probed once per
    stride by the hash of a block; windows around a block that is found are then
    compared as text.  Both sets of n-grams are broadcast if their counted size
    allows.
    """
    items = settle(
        benchmark.select(F.col(item_id).cast("string").alias("item"), F.explode(F.array(_words(F.col(item_text)))).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("n", F.least(F.size("w"), F.lit(window))),
        "benchmark",
    )
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most `window` values
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k binary, hit array<int>, items array<string>")
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n")))
    windows = _bounded(
        items.withColumn("p", starts)
        .select("n", F.concat_ws(" ", F.slice("w", F.col("p") + 1, F.col("n"))).alias("g"), "item")
        .groupBy("n", "g")
        .agg(F.collect_set("item").alias("items"))
    )
    def of_length(make):
        """An array by the window length, chosen on the rows' column n."""
        out = None
        for n in lengths:
            out = F.when(F.col("n") == n, make(n)) if out is None else out.when(F.col("n") == n, make(n))
        return out

    def block(w: Column, q: Column, width: int) -> Column:
        return F.xxhash64(F.slice(w, q + 1, F.lit(width)))

    def item_blocks(n: int) -> Column:
        width = _gram(n)[0]
        return F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda q: block(F.col("w"), q, width))

    def doc_blocks(n: int) -> Column:
        width, stride = _gram(n)
        at = F.sequence(F.lit(0), F.size("w") - width, F.lit(stride))
        found = F.transform(at, lambda q: F.struct(F.lit(n).alias("n"), q.alias("q"), block(F.col("w"), q, width).alias("h")))
        return F.when(F.size("w") >= n, found).otherwise(F.array().cast("array<struct<n:int,q:int,h:bigint>>"))

    blocks = _bounded(items.select("n", F.explode(of_length(item_blocks)).alias("h")).distinct())
    # explode of a one-element array: the words are computed once per row, whatever reads them
    keyed = docs.select(_text_key(F.col(text)).alias("k"), F.col(text).alias("t"))
    worded = keyed.select("k", F.explode(F.array(_words(F.col("t")))).alias("w"))
    probes = worded.select("k", F.explode(F.concat(*[doc_blocks(n) for n in lengths])).alias("b")).select("k", "b.*")
    found = probes.join(blocks, ["n", "h"]).groupBy("k").agg(F.collect_set(F.struct("n", "q")).alias("at"))
    found = settle(found, "found")
    candidates = keyed.join(found, "k").select("k", "at", F.explode(F.array(_words(F.col("t")))).alias("w"))
    around = F.flatten(
        F.transform(
            "at",
            lambda a: F.transform(
                # windows of n words that hold the block at q
                F.sequence(F.greatest(F.lit(0), a["q"] - of_gram(a["n"], lengths)), F.least(a["q"], F.size("w") - a["n"])),
                lambda p: F.struct(a["n"].alias("n"), p.alias("p")),
            ),
        )
    )
    checked = (
        candidates.select("k", "w", F.explode(F.array_distinct(around)).alias("c"))
        .select("k", F.col("c.n").alias("n"), F.col("c.p").alias("p"), F.concat_ws(" ", F.slice("w", F.col("c.p") + 1, F.col("c.n"))).alias("g"))
        .join(windows, ["n", "g"])
    )
    per_text = checked.groupBy("k").agg(F.collect_set(F.struct("p", "n")).alias("spans"), F.collect_set("items").alias("sets"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["p"], s["p"] + s["n"] - 1))))
    return per_text.select("k", hit.alias("hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))


def of_gram(n: Column, lengths: list[int]) -> Column:
    """Words of a window of length ``n`` before the last block that fits in it."""
    out = F.lit(0)
    for m in lengths:
        out = F.when(n == m, F.lit(m - _gram(m)[0])).otherwise(out)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` does not call contaminated.

    Only the keys of texts with hits are joined, and broadcast if they are few
    enough; then no text is shuffled.
    """
    hits = _bounded(find_hits(docs, benchmark, window, text, item_text, item_id).select("k"))
    return docs.join(hits, _text_key(docs[text]) == hits["k"], "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id", clean: bool = False) -> DataFrame:
    """``docs`` with what every row shares with the benchmark.

    Added columns (they replace columns of these names): ``n_words``, ``n_hit``
    (words inside any occurrence of a window), ``hit_items`` (sorted ids of items
    with occurring windows), ``contaminated`` and, with ``clean``, ``clean_text``:
    the text without hit words and what stands before each.

    A null text has no words; texts of any length are read whole; items without
    words match nothing; an item without an id marks words but is not listed.
    Equal texts are resolved once, so repeated rows and null ids need no care.  An
    empty benchmark hits nothing.
    """
    hits = settle(find_hits(docs, benchmark, window, text, item_text, item_id), "hits")
    outputs = ["n_words", "n_hit", "hit_items", "contaminated", *(["clean_text"] if clean else [])]
    kept = [c for c in docs.columns if c not in outputs]
    k, hit, items, whole, count_ = (fresh(docs.columns, n) for n in ("k", "hit", "items", "whole", "count"))
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(ANY_CASE_WORD)).cast("bigint")
    base = docs.select(*kept, F.col(text).alias(whole), _text_key(F.col(text)).alias(k), count.alias(count_))
    joined = base.join(hits.select(F.col("k").alias(k), F.col("hit").alias(hit), F.col("items").alias(items)), k, "left")
    n_hit = F.when(F.col(hit).isNull(), F.lit(0)).otherwise(F.size(hit)).cast("bigint")
    found = [
        F.col(count_).alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.col(items), F.array().cast("array<string>")).alias("hit_items"),
        (n_hit > 0).alias("contaminated"),
    ]
    if clean:
        parts = F.regexp_extract_all(F.col(whole), F.lit(BETWEEN + ANY_CASE_WORD), F.lit(0))
        tail = F.regexp_extract(F.col(whole), "(" + BETWEEN + ")$", 1)
        left = F.concat(F.array_join(F.filter(parts, lambda s, i: ~F.array_contains(F.col(hit), i)), ""), tail)
        found.append(F.when(n_hit > 0, left).otherwise(F.col(whole)).alias("clean_text"))
    return joined.select(*kept, *found)
