"""Query op10: the quality rules over the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_documents
from .quality import RULES, STOP_WORDS, apply_rules
from .registry import query

_STOP = ", ".join(f"'{w}'" for x in STOP_WORDS for w in dict.fromkeys((x, x.capitalize())))
_RATIO = {
    "n_words": "n_words", "n_stop_words": "n_stop_words",
    "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
    "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
    "alpha_word_ratio": "CASE WHEN n_words > 0 THEN n_alpha / n_words ELSE 0 END",
    "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
    "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END",
    "ellipsis_line_ratio": "CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END",
}
_PASS = " AND ".join(f"({_RATIO[r.metric]}) {op} {v}" for r in RULES
                     for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
w AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a),
tri AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM w
        WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM tri WHERE g IS NOT NULL)
        WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (SELECT a.rid, doc_id, len(w) AS n_words, length(list_aggregate(w || [''], 'string_agg', '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_intersect(list_distinct(w), [{_STOP}])) AS n_stop_words,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
             len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_alpha
      FROM a LEFT JOIN cov ON a.rid = cov.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {_PASS} AS kept
FROM b
"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark, sf_dir):
    q = apply_rules(read_documents(spark, sf_dir).select("doc_id", "text"))
    return q.select("doc_id", *[F.col(f"quality.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
