"""Each operator applied to its whole table, with production parameters."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from parleyframe.llm import (
    collocations, decontaminate, grades, language, minhash, packing, sanitise, secrets, simhash,
    spelling, substring_dedup, syncmers, token_counts)
from parleyframe.sources.tables import working_folder

QUERIES = {}
ORACLES = {}

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op6_language_id")
def op6(spark, folder):
    return language.identify(table(spark, folder, "documents"))


@query("op7_benchmark_decontamination", f"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), {UPPER}, {LOWER}) AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), {UPPER}, {LOWER}) FROM benchmark),
split AS (
  SELECT kind, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
sized AS (
  SELECT DISTINCT least(len(w), 10) AS size FROM split WHERE kind = 'i' AND len(w) > 0),
places AS (
  SELECT kind, id, size, unnest(generate_series(1, len(w) - size + 1)) AS spot, w
  FROM split, sized WHERE len(w) >= size
    AND (kind = 'd' OR size = least(len(w), 10))),
windows AS (
  SELECT kind, id, size, spot, array_to_string(w[spot:spot + size - 1], ' ') AS k FROM places),
met AS (
  SELECT d.id, d.size, d.spot, CAST(i.id AS VARCHAR) AS item FROM windows d JOIN windows i
  ON d.kind = 'd' AND i.kind = 'i' AND d.size = i.size AND d.k = i.k),
hit AS (
  SELECT id, count(DISTINCT place) AS n FROM (
    SELECT id, unnest(generate_series(spot, spot + size - 1)) AS place FROM met) x GROUP BY id),
named AS (
  SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item FROM met) y GROUP BY id)
SELECT s.id AS doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit ON s.id = hit.id LEFT JOIN named ON s.id = named.id WHERE kind = 'd'""")
def op7(spark, folder):
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_token_counts")
def op8(spark, folder):
    # A cache of this run alone, so that every distinct text is a miss.
    cache = f"{working_folder(spark).rstrip('/')}/parleyframe/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


@query("op9_simhash_near_dedup")
def op9(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_secret_scan")
def op3(spark, folder):
    return secrets.digests(table(spark, folder, "documents"))


@query("op1_substring_dedup", """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS spot, w FROM split WHERE len(w) >= 20),
ranked AS (
  SELECT doc_id, spot, row_number() OVER (
    PARTITION BY array_to_string(w[spot:spot + 19], ' ') ORDER BY doc_id, spot) AS n FROM places),
gone AS (
  SELECT doc_id, list(DISTINCT place) AS g FROM (
    SELECT doc_id, unnest(generate_series(spot, spot + 19)) AS place FROM ranked WHERE n > 1) x
  GROUP BY doc_id),
words AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS place, unnest(w) AS word FROM split),
kept AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY place) AS k, count(*) AS n
  FROM words x LEFT JOIN gone ON x.doc_id = gone.doc_id
  WHERE g IS NULL OR NOT list_contains(g, place) GROUP BY x.doc_id)
SELECT s.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM split s LEFT JOIN kept ON s.doc_id = kept.doc_id""")
def op1(spark, folder):
    return substring_dedup.deduplicate(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_best_fit_packing")
def op2(spark, folder):
    return packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_quality_grades")
def op4(spark, folder):
    return grades.select_by_grade(
        table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_pii")
def op5(spark, folder):
    return sanitise.digests(table(spark, folder, "documents"))


@query("op10_document_fingerprints")
def op10(spark, folder):
    return syncmers.compared(table(spark, folder, "documents"))


@query("op11_spelling_variants")
def op11(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_minhash_near_dedup")
def op12(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op13_phrase_collocations", f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), {UPPER}, {LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents) x),
places AS (
  SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS spot
  FROM pieces, (SELECT unnest(generate_series(1, 5)) AS size) s WHERE len(w) >= size),
f AS (
  SELECT lang, w[spot:spot + size - 1] AS p, count(*) AS a FROM places GROUP BY 1, 2),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
chosen AS (SELECT * FROM f WHERE len(p) > 1 AND a >= 100),
inner_sizes AS (
  SELECT lang, p, a, unnest(generate_series(2, len(p) - 1)) AS size FROM chosen WHERE len(p) > 2),
inner_places AS (
  SELECT *, unnest(generate_series(1, len(p) - size + 1)) AS spot FROM inner_sizes),
explained AS (
  SELECT lang, p[spot:spot + size - 1] AS p, max(a) AS longer FROM inner_places GROUP BY 1, 2),
kept AS (
  SELECT c.* FROM chosen c LEFT JOIN explained e ON c.lang = e.lang AND c.p = e.p
  WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, n,
         (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.p[1:k] = x.p
  JOIN f y ON c.lang = y.lang AND c.p[k + 1:len(c.p)] = y.p JOIN totals t ON c.lang = t.lang),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""")
def op13(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
