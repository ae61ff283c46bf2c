"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk.llm import (lines, neighbours, packing, periods, pii, quality, simhash, spelling, sptokens, substrings, tokenstore,
                            transducer, urls)
from deployrisk.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return keep


@query("op10_simhash_golay")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
keyed AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM runs),
firsts AS (SELECT s, min(doc_id) AS f FROM keyed GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 13)) AS i FROM keyed JOIN firsts USING (s) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT words.doc_id, word, words.i, gone.i IS NULL AS stays FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT stays) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY i) FILTER (stays), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=13, seed=5)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the checksum of the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = sptokens.round_trip(table(spark, sf_dir, "documents"), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
                          F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"), "parity")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op3_token_store")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written, found again by key and read back."""
    documents, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    folder = tokenstore.new_folder(spark)
    listed = tokenstore.write(documents, path, folder, end_id=2)
    found = tokenstore.look_up(listed.select("doc_id", "number"), folder)
    back = tokenstore.read(found, folder, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, text IS NULL AS missing FROM documents),
every AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
worded AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (SELECT doc_id, j, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS s FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
ranked AS (SELECT doc_id, j, row_number() OVER (PARTITION BY s ORDER BY doc_id, j) AS nth FROM runs WHERE s IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, j + unnest(range(0, 3)) AS j FROM ranked WHERE nth > 1),
dropped AS (SELECT doc_id, i FROM worded JOIN gone USING (doc_id, j)),
kept AS (SELECT every.doc_id, coalesce(string_agg(line, chr(10) ORDER BY every.i) FILTER (dropped.i IS NULL), '') AS t, count(dropped.i) AS n_removed
         FROM every LEFT JOIN dropped ON every.doc_id = dropped.doc_id AND every.i = dropped.i GROUP BY every.doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN NOT missing THEN sha256(t) END AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN counts ON d.doc_id = counts.doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.remove_lines(table(spark, sf_dir, "documents"), size=3)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, lambda s: s.kind == F.lit("email"))), F.size(F.filter(spans, lambda s: s.kind == F.lit("ip"))),
              F.size(F.filter(spans, lambda s: s.kind == F.lit("card"))), F.size(F.filter(spans, lambda s: s.kind == F.lit("phone")))]
    base = F.filter(spans, lambda s: s.kind.isin(*pii.BASE))
    return found.select("doc_id", *(c.cast("long").alias(f"n_{k}") for c, k in zip(counts, pii.BASE, strict=True)),
                        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query("op9_one_bit_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each vector whose id is divisible by 50, among all other vectors."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, nearest=5)


#: Rules and host labels of the filter (fixed values).
URL_RULES = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"),
             urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block")]
BAD_LABELS = ["casino-win", "cheap-pills", "spam-farm", "adult-x", "free-bets", "ads-track"]

OP11_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS asked FROM p),
forms AS (SELECT *, CASE WHEN regexp_replace(regexp_replace(host, '^.*@', '', 's'), '(:80|:443)?\z', '') <> '' THEN
                 regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), '(:80|:443)?\z', ''), '^www\.', '') || '/'
                 || regexp_replace(regexp_replace(regexp_replace(path, '/index\.html?\z', '/'), '/+\z', ''), '^/+', '')
                 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(asked, '&'),
                        lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_.*|ref|fbclid|gclid)(=.*)?', 's'))), '&'), ''), '') END AS form FROM parts),
listed AS (SELECT DISTINCT form FROM forms WHERE list_has_any(string_split(host, '.'), ['LABELS'])),
ruled AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM forms)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN form IS NOT NULL AND form IN (SELECT form FROM listed WHERE form IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""".replace("LABELS", "', '".join(BAD_LABELS))


@query("op11_url_filter", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; the list holds the addresses of pages on hosts with a bad label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.with_host_label(pages, BAD_LABELS), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words, with repeats planted in one text of ten."""
    found = periods.find(table(spark, sf_dir, "documents"), least=12, plant=True)
    return found.select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters and five occurrences or more, with their forms and roots."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), least_letters=6, least_count=5, slip_every=199)
    return spelling.forms(words, times=5)
