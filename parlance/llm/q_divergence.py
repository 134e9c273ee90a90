"""Query op12: divergence of every source from the other sources of its language, and its typical terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_documents
from .divergence import Audit, ranked
from .registry import query

TOP_TERMS = 10

_P = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
_F = "(p - q) * (p - q) // (p + q)"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (FROM c SEMI JOIN k USING (lang, term)) c USING (lang, source)
      GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "g.total")} AS p,
             {_P.format("k.n", "l.total")} AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum({_F.replace("p", "a.p").replace("q", "b.p")}) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ({_F})::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
               FROM (FROM pair UNION ALL FROM term)) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


@query("op12_source_divergence", SQL)
def op12_source_divergence(spark, sf_dir):
    audit = Audit(read_documents(spark, sf_dir))
    parts = {"pair": ranked(audit.pairs()), "term": ranked(audit.typical_terms(), TOP_TERMS)}
    pair, term = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
                  for part, rows in parts.items()]
    return pair.unionByName(term)
