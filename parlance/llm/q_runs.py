"""Query op11: periodic runs of words in every whole document, some documents made periodic by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, read_documents
from .registry import query
from .runs import periodic_runs


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document (by h = crc32 of the id) repeats words a .. a + p - 1 to its end, a and p by g = h / 10.

    Arrays are built by slicing and repeating, no lambda reads a row's words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), "")
    rows = (docs.select("doc_id", "text", (h % 10 == 0).alias("planted"),
                        F.floor(h / 10).alias("g"))
            .withColumn("words", F.when(F.col("planted"), words))
            .withColumn("n", F.size("words"))
            .withColumn("a", F.expr("cast(g % nullif(n, 0) as int)"))
            .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")))
    repeated = F.expr("slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p),"
                    " cast(ceil((n - a) / p) as int)))), 1, n)")
    text = F.when(F.col("planted") & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


SQL = rf"""
WITH c AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS w,
                  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''),
                                                                                lambda x: ord(x)::BIGINT)),
                      lambda v, x: list_reduce([xor(v, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                               lambda u, z: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) AS h
           FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
d AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
e AS (SELECT rid, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x
      FROM (SELECT *, unnest(range(n)) AS i FROM d)),
s AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' '
             || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o AS six
      FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT * FROM s WHERE six IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, six) > 1),
j AS (SELECT l.rid, l.i, r.i - l.i AS q FROM k l JOIN k r ON l.rid = r.rid AND l.six = r.six AND l.i < r.i),
m AS (SELECT rid, q, min(i) AS start, count(*) + 5 AS common
      FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM j)
      GROUP BY rid, q, island),
r AS (SELECT rid, start, common + q AS length, min(q) AS period FROM m WHERE common >= q AND common + q >= 12
      GROUP BY rid, start, common + q),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM e ANTI JOIN gone USING (rid, i) GROUP BY rid),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
                                                      ORDER BY start, period) AS t FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
       period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""


@query("op11_periodic_runs", SQL)
def op11_periodic_runs(spark, sf_dir):
    rows = periodic_runs(with_periodic_tails(read_documents(spark, sf_dir).select("doc_id", "text")))
    runs = F.col("periodic.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = rows.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(listed, 256).alias("runs_sha256"),
                       F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"),
                       period.alias("period"), F.expr("-1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
