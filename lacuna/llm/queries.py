"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, licenses, mixing, ngrams, quality, secrets, suffixtree, topk, urlrules
from .common import table

URL_RULES = urlrules.parse([("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")])


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_ngram_join, op4_lm_score, op5_mixing, op6_token_counts, op7_license_scan, op8_secret_scan, op9_url_filter, op10_topk)}


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op2_sql() -> str:
    bare = lambda e: rf"length(regexp_replace({e}, '[\x20\x09-\x0D]', '', 'g'))"
    symbols = lambda e: f"(length({e}) - length(regexp_replace({e}, '[#*$%&|<>]', '', 'g')))"
    phrases = " OR ".join("contains(lower(l), '{}')".format(p.replace("'", "''")) for p in quality.BOILERPLATE)
    fails = (
        f"(100 * {symbols('l')} > {quality.MAX_SYMBOLS} * {bare('l')}) OR (length(l) - length(regexp_replace(l, '[{quality.BARS}]', '', 'g')) >= {quality.MIN_BARS}) "
        f"OR ({bare('l')} >= {quality.MIN_LONG_LINE} AND NOT regexp_matches(l, '[.,;:!?…。！？]')) "
        f"OR (length(l) - length(replace(l, '!', '')) >= 3 AND 100 * (length(l) - length(regexp_replace(l, '\\p{{Lu}}', '', 'g'))) > {quality.MAX_CAPITALS} * {bare('l')}) "
        f"OR {phrases}"
    )
    worded = r"regexp_matches({}, '[^\x20\x09-\x0D]')"
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        f"a AS (SELECT doc_id, t, {_WORDS.format(text='t')} AS w, string_split(t, chr(10)) AS every, list_filter(string_split(t, chr(10)), lambda x: {worded.format('x')}) AS lines FROM t), "
        "g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)), "
        "r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1), "
        "c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id), "
        f"l AS (SELECT doc_id, i, l, {worded.format('l')} AND ({fails}) AS bad FROM (SELECT doc_id, unnest(every) AS l, unnest(range(1, len(every) + 1)) AS i FROM a)), "
        f"f AS (SELECT doc_id, count(*) FILTER (bad) AS n_failed_lines, sum(CASE WHEN bad THEN {bare('l')} ELSE 0 END) AS lost, md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS clean_md5 FROM l GROUP BY doc_id), "
        f"m AS (SELECT a.doc_id, len(w) AS n_words, CAST({bare('t')} AS BIGINT) AS word_chars, CAST({symbols('t')} AS BIGINT) AS n_symbols, "
        "CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, clean_md5 "
        "FROM a LEFT JOIN c ON a.doc_id = c.doc_id LEFT JOIN f ON a.doc_id = f.doc_id) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, "
        f"NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {quality.MAX_LOST} * word_chars AS kept, n_failed_lines, lost_chars, clean_md5 FROM m"
    )


def _op3_sql() -> str:
    words = _WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")
    return (
        f"WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents), "
        "s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
        "o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id), "
        "l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)), "
        "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), "
        "r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d) "
        "SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d"
    )


def _op9_sql() -> str:
    host = f"translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"
    cases = sorted(URL_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    pick = lambda k: " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for h, p, v in cases)
    return (
        "WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), "
        f"h AS (SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u) "
        f"SELECT page_id, host, path, CASE {pick(0)} END AS rule, CASE {pick(1)} ELSE 'allow' END AS verdict FROM h"
    )


def _op10_sql() -> str:
    return (
        "WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings "
        "WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)), "
        "s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id), "
        "r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) "
        "SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"
    )


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force or the library."""
    return {"op2_quality": _op2_sql(), "op3_ngram_join": _op3_sql(), "op9_url_filter": _op9_sql(), "op10_topk": _op10_sql()}
