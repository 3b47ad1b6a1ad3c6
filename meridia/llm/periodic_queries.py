"""The query over periodic runs, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import periodic_runs

_BLANK = r"[\x20\x09-\x0D]+"


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by the checksum of their id, repeat a part of their words from some word on."""
    words = F.array_remove(F.split("text", _BLANK), "")
    planted = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    numbers = planted.filter("n > 0").withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.flatten(F.array_repeat(F.slice("words", F.expr("cast(a + 1 as int)"), F.expr("cast(p as int)")), F.expr("cast((n - a) div p + 1 as int)")))
    built = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), F.lit(1), F.col("n").cast("int"))
    return planted.filter("n is null or n <= 0").select("doc_id", "text").unionByName(numbers.select("doc_id", F.array_join(built, " ").alias("text")))


def run_report(found: DataFrame) -> DataFrame:
    """The longest run, the number of runs and the digests of a table of with_runs()."""
    runs = F.col("runs")
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op11_periodic_runs(docs: DataFrame, **options) -> DataFrame:
    return run_report(periodic_runs.with_runs(with_planted_periods(docs), **options))


#: Every pair of equal words of a text, grouped into intervals by period: quadratic, for small tables.
ORACLE = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own,
    4294967295 - list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS h FROM documents),
c AS (SELECT *, len(own) AS n, h // 10 AS g FROM b),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: own[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE own END AS w FROM c),
x AS (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
m AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i),
parts AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM m),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM parts GROUP BY r, q, part HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY ALL),
best AS (SELECT r, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
