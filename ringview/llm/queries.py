"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, jaccard, licenses, lm, packing, quality_classifier, quality_rules, tokenfile, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.duplicates(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = lm.train(docs.where(~held_out), min_count=1)
    return lm.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_shards(table(spark, sf_dir, "documents"), end_id=0)
    return tokenfile.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
wd AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, i, wd.n, item_id FROM wd JOIN win ON wd.g = win.g AND wd.n = win.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archive(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    responses = warc.read_archive(spark, folder).where("record_type = 'response'")
    revisits = warc.read_archive(spark, folder, payload="false").where("record_type = 'revisit'")
    full = responses.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    other = revisits.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return full.unionByName(other)


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_TOKENS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP2_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = d.doc_id
"""


# Parts of results that SQL can express, through the same operators


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the license scan."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _phrase_sql(phrase: str, label: str) -> str:
    parts = phrase.split()
    return f"list_transform(list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: w[i:i + {len(parts) - 1}] = {parts}), lambda i: {{'at': i - 1, 'label': '{label}'}})"


BASE_LICENSES_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, {" || ".join(_phrase_sql(p, x) for p, x in licenses.PHRASES.items())} AS p FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word,
  list_max(list_transform(p, lambda x: x.at)) AS last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels
FROM p
"""


def base_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base scores of a model of words, trained on every document."""
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs, order=1)).select("doc_id", "n_tokens", "n_known", F.round("base_score", 3).alias("base_score"))


BASE_LANGUAGE_MODEL_SQL = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest(list_append({_TOKENS_SQL}, ' ')) AS t FROM documents),
c AS MATERIALIZED (SELECT t, count(*) AS c FROM t GROUP BY 1),
s AS (SELECT count(*) AS v, sum(c) AS n FROM c)
SELECT doc_id, count(*) AS n_tokens, count(*) AS n_known, round(sum(log10((c + 1) / CAST(n + v + 1 AS DOUBLE))), 3) AS base_score
FROM t JOIN c USING (t), s GROUP BY doc_id
"""


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of the quality rules and the fixed limits."""
    return op8_quality_rules(spark, sf_dir).drop("kept")


BASE_QUALITY_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_jaccard_join,
        op3_licenses,
        op4_html_extraction,
        op5_language_model,
        op6_token_shards,
        op7_quality_classifier,
        op8_quality_rules,
        op9_decontamination,
        op10_warc,
        base_licenses,
        base_language_model,
        base_quality,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": OP2_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_warc": OP10_SQL,
    "base_licenses": BASE_LICENSES_SQL,
    "base_language_model": BASE_LANGUAGE_MODEL_SQL,
    "base_quality": BASE_QUALITY_SQL,
}
