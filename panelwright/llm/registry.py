"""Queries of the corpus operators and of the pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from panelwright.llm import decontam, divergence, graph, language, licenses, mixing, periodic, quality, sharding, simhash, substrings, suffixes, tokens
from panelwright.llm.common import WORD, n_words, table


def op1_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents by the generalised pigeonhole principle."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by search on pruned graphs."""
    return graph.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM e),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN cnt ON vec_id = cnt.a
"""


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that an elder document has."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS g FROM d, unnest(range(0, greatest(len(w) - 49, 0))) AS t(p)),
gone AS (SELECT doc_id, p FROM win JOIN (SELECT g, min(doc_id) AS eldest FROM win GROUP BY g) USING (g) WHERE doc_id > eldest),
cov AS (SELECT DISTINCT doc_id, p + i AS k FROM gone, unnest(range(0, 50)) AS t(i)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS s, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of all documents, written to shards in a permuted order."""
    return tokens.materialise(table(spark, sf_dir, "documents"))


def op5_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that start more than once."""
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 400)) AS g FROM d, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS t(p)),
gone AS (SELECT doc_id, p FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
edge AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS opens FROM gone),
span AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM edge) GROUP BY doc_id, n),
gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM span),
tot AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM span GROUP BY doc_id),
head AS (SELECT doc_id, string_agg(substring(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS s FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(s, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN head USING (doc_id)
"""


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of equal counts by two-pass external shuffle."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shuffle_shards(docs, 24).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from text, markup, address suffix and host."""
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


def op8_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of a benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS g FROM il, unnest(range(0, len(w) - n + 1)) AS t(p)),
dg AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS g FROM dw, (SELECT DISTINCT n FROM win) AS l, unnest(range(0, len(w) - n + 1)) AS t(p)),
hit AS (SELECT doc_id, p, n, CAST(item_id AS VARCHAR) AS item FROM dg JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p + i) AS n_hit FROM hit, unnest(range(0, n)) AS t(i) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by votes of labelled neighbours."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.GOOD).cast("int").alias("predicted"),
    )


def op10_mixture_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to source weights 5, 2, 1 by min-cost flow."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, n_words(F.col("text")), F.array("source"), key=("doc_id", "text"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("source"),
    )


def _periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by a hash of the id, with words that recur from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.regexp_extract_all(F.when(h % 10 == 0, F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    worded = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.explode_outer(F.array(chosen)).alias("w"))
    placed = worded.withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)")
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of all documents, a tenth of them made periodic."""
    found = periodic.find_runs(_periodic_tails(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best_run.start",
        "best_run.length",
        "best_run.period",
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
       4294967295 - list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, b:
         list_reduce(range(8), lambda e, k: xor(e >> 1, CASE WHEN e & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, CAST(ascii(b) AS BIGINT))), CAST(4294967295 AS BIGINT)) AS h FROM documents),
par AS (SELECT *, len(o) AS n, h // 10 AS g FROM raw),
tail AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM par),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE o[1 : a] || list_transform(range(a, n), lambda i: o[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))]) END AS w FROM tail),
word AS (SELECT doc_id, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
often AS (SELECT doc_id, q FROM same GROUP BY doc_id, q HAVING count(*) >= 3 * q),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM same SEMI JOIN often USING (doc_id, q)),
cand AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY doc_id, q, z HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM cand GROUP BY doc_id, s, len),
tot AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS k FROM run) WHERE k = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(tot.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents, exact and with typing errors."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {(n.label, n.phrase) for n in licenses.BASE}
    exact = F.filter(
        "notices",
        lambda m: (m["edits"] == 0) & F.struct(m["label"], m["phrase"]).isin([F.struct(F.lit(a), F.lit(b)) for a, b in sorted(base)]),
    )
    likeness = F.transform("notices", lambda m: 1 - m["edits"] / F.length(m["phrase"]))
    return found.withColumn("base", exact).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("notices.label")), ",").alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )


def op13_transducer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of every language over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"), 30, 50)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
one AS (SELECT id, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t FROM one GROUP BY lang, t HAVING count(DISTINCT id) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT lang, source, t, count(*) AS c FROM one SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
voc AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN cell USING (lang, source) GROUP BY lang, source),
full_ AS (SELECT lang, source, t, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5) // (CAST(n AS HUGEINT) + 5 * v) AS p
          FROM gn JOIN kept USING (lang) JOIN voc USING (lang) LEFT JOIN cell USING (lang, source, t)),
lq AS (SELECT lang, t, 1 + CAST(1000000000 AS HUGEINT) * (sum(c) + 5) // (CAST(any_value(ln) AS HUGEINT) + 5 * any_value(v)) AS q
       FROM cell JOIN voc USING (lang) JOIN (SELECT lang, sum(c) AS ln FROM cell GROUP BY lang) USING (lang) GROUP BY lang, t),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, CAST(p - q AS BIGINT) AS value FROM full_ JOIN lq USING (lang, t) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


QUERIES = {
    "op1_simhash_pigeonhole": op1_simhash_pigeonhole,
    "op2_pruned_graph": op2_pruned_graph,
    "op3_suffix_trees": op3_suffix_trees,
    "op4_training_order": op4_training_order,
    "op5_induced_suffixes": op5_induced_suffixes,
    "op6_external_shuffle": op6_external_shuffle,
    "op7_page_languages": op7_page_languages,
    "op8_benchmark_ngrams": op8_benchmark_ngrams,
    "op9_neighbour_votes": op9_neighbour_votes,
    "op10_mixture_flow": op10_mixture_flow,
    "op11_recompression_runs": op11_recompression_runs,
    "op12_license_notices": op12_license_notices,
    "op13_transducer_audit": op13_transducer_audit,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op2_pruned_graph": OP2_SQL,
    "op3_suffix_trees": OP3_SQL,
    "op5_induced_suffixes": OP5_SQL,
    "op8_benchmark_ngrams": OP8_SQL,
    "op11_recompression_runs": OP11_SQL,
    "op13_transducer_audit": OP13_SQL,
}
