"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, work_path
from . import (
    contamination,
    langid,
    licenses,
    lm_scoring,
    mixing,
    periodicity,
    rollups,
    sharding,
    simhash,
    substrings,
    topk,
    vector_codes,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with its SQL where the result can be stated in SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_langid")
def op1_langid(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_topk", TOP_K_SQL)
def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf, "embeddings"))


SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
each_word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
starts AS (
  SELECT doc_id, i, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS win FROM each_word
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM starts WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE nth > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op3_substrings", SUBSTRINGS_SQL)
def op3_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.kept_digest(substrings.remove_repeats(table(spark, sf, "documents")))


def _alnum_sql(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_alnum_sql('text')} AS ws FROM documents),
b AS (SELECT item_id, {_alnum_sql('text')} AS ws FROM benchmark),
items AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
tests AS (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS spot FROM items),
sizes AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes),
hits AS (
  SELECT doc_id, item_id, places.n, i, spot
  FROM places JOIN tests ON places.n = tests.n AND array_to_string(places.ws[i:i + places.n - 1], ' ') = array_to_string(tests.ws[spot:spot + tests.n - 1], ' ')),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY 1),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - spot ORDER BY i) AS run FROM hits),
longest AS (
  SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, count(*) + any_value(n) - 1 AS k FROM runs GROUP BY doc_id, item_id, n, i - spot, run) GROUP BY 1),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


@query("op4_contamination", CONTAMINATION_SQL)
def op4_contamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return contamination.contamination_digest(found)


TOKEN_SQL = """
WITH counted AS (
  SELECT doc_id, source, lang, min(doc_id) OVER (PARTITION BY text) AS first_id,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words,
         coalesce(len(regexp_extract_all(text, '[0-9A-Za-z]+|[^\\x00-\\x7F]')), 0) AS alnum
  FROM documents),
versions AS (
  SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM counted WHERE doc_id = first_id
  UNION ALL SELECT source, lang, 'alnum-1', alnum FROM counted WHERE doc_id = first_id)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens
FROM versions GROUP BY ALL
"""


@query("op5_token_counts", TOKEN_SQL)
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after four batches: all documents with counts estimated from their length; the counts
    revised to exact ones, under a replayed id; a second tokenizer version; exact copies deleted."""
    docs = table(spark, sf, "documents")
    counts = [rollups.pattern_counts(F.col("text"), p).alias(v) for v, p in rollups.PATTERNS.items()]
    counted = stage(docs.select("doc_id", "source", "lang", F.sha1("text").alias("h"), (F.coalesce("n_chars", F.lit(0)) / 6).cast("long").alias("guess"), *counts), "token-counts")

    def version(rows: DataFrame, name: str, column: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(column).alias("tokens"))

    firsts = counted.groupBy(F.col("h").alias("of")).agg(F.min("doc_id").alias("first_id"))
    copies = counted.join(firsts, F.col("h").eqNullSafe(F.col("of"))).filter("doc_id <> first_id")
    store = rollups.TokenRollup(spark, work_path(spark, "token-totals"))
    store.commit("load", rollups.inserts(version(counted, "words-1", "guess")))
    exact = rollups.revisions(version(counted, "words-1", "guess"), version(counted, "words-1", "words-1"))
    store.commit("exact", exact)
    store.compact()
    store.commit("exact", exact)
    store.commit("second-tokenizer", rollups.inserts(version(counted, "alnum-1", "alnum-1")))
    gone = version(copies, "words-1", "words-1").union(version(copies, "alnum-1", "alnum-1"))
    store.commit("copies", rollups.deletes(gone))
    return store.totals()


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf, "documents"))


# Five hexadecimal digits of the SHA-1 are four base-32 digits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keep FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to, 'ok' AS status
FROM h
"""


@query("op7_warc", WARC_SQL)
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path)


@query("op8_mix")
def op8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_order(table(spark, sf, "documents"))


@query("op9_lm_scores")
def op9_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf, "documents"))


@query("op10_shards")
def op10_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf, "documents"))


def _codes_sql() -> str:
    """Assignments and rounds spelled out; list components are the columns c1 to cw of a part."""
    k, parts, rounds = vector_codes.ENTRIES, vector_codes.PARTS, vector_codes.ROUNDS
    steps = [
        f"""
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x
  FROM v, range(0, {parts}) AS r(part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {k}))"""
    ]
    nearest = """
a{n} AS MATERIALIZED (
  SELECT vec_id, label, part, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := entry)) AS near
  FROM p JOIN b{n} USING (part) GROUP BY ALL)"""
    update = """
m{n} AS (
  SELECT part, near.entry AS entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS c
  FROM a{n}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL),
b{m} AS (
  SELECT b.part, b.entry, coalesce(any_value(n.e), any_value(b.e)) AS e
  FROM b{n} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS e FROM m{n} GROUP BY ALL) n USING (part, entry) GROUP BY ALL)"""
    for n in range(rounds):
        steps += [nearest.format(n=n), update.format(n=n, m=n + 1)]
    steps.append(nearest.format(n=rounds))
    return f"""
WITH {",".join(steps)},
codes AS (
  SELECT vec_id, label, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM codes
"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.codes_digest(*vector_codes.compress(table(spark, sf, "embeddings")))


def _licenses_sql() -> str:
    """Every block against every template, every phrase at every word."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({listed(licenses.lower_words(p))}, '{label}')" for p, label in licenses.PHRASES.items())
    rows, halves = [], set()
    for template in licenses.prepared(licenses.TEMPLATES, dict.fromkeys(licenses.template_words(licenses.TEMPLATES, ()), 0), licenses.THRESHOLD):
        words = sorted(set(licenses.lower_words(template.text)))
        rows.append(f"('{template.label}', {template.half}, {template.need}, {listed(words)})")
        halves.add(template.half)
    return f"""
WITH d AS (SELECT doc_id, {_alnum_sql('text')} AS ws FROM documents),
phrases(parts, label) AS (VALUES {phrases}),
templates(label, half, need, tokens) AS (VALUES {", ".join(rows)}),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
places AS (SELECT doc_id, i - 1 AS place, label FROM starts JOIN phrases ON ws[i] = parts[1] AND ws[i:i + len(parts) - 1] = parts),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS labels FROM places GROUP BY 1),
stretches AS (
  SELECT doc_id, half, ws, unnest(range(0, greatest(1, (len(ws) + half - 1) // half - 1))) AS b
  FROM d, (VALUES {", ".join(f"({h})" for h in sorted(halves))}) AS s(half)),
blocks AS (SELECT doc_id, half, list_distinct(ws[b * half + 1:(b + 2) * half]) AS held FROM stretches),
found AS (
  SELECT doc_id, label, len(list_intersect(held, tokens)) / len(tokens) AS share FROM blocks JOIN templates USING (half)
  WHERE len(list_intersect(held, tokens)) >= need),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a AS first_word, base.b AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(own.share, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query("op12_licenses", _licenses_sql())
def op12_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_digest(licenses.scan(table(spark, sf, "documents")))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodicity.find_runs(table(spark, sf, "documents"), rewrite=periodicity.repeat_tail)
    return periodicity.run_digest(found)
