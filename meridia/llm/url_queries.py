"""The query over URL filters, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url_filter

#: The rules of the query (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Names of hosts with such a word (between full stops and hyphens) stand on the query's list of addresses.
WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def listed(pages: DataFrame) -> DataFrame:
    """The rules, and as a list of addresses to block all those of hosts with an unwanted word in their name."""
    rules = pages.sparkSession.createDataFrame([(h, p, v, "prefix") for h, p, v in RULES], url_filter.LISTED_DDL)
    host, path = url_filter.canonical_host(url_filter.host_of("url")), url_filter.canonical_path(url_filter.path_of("url"))
    own = pages.select(host.alias("host"), path.alias("path")).filter(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, WORDS)))).distinct()
    return rules.unionByName(own.select("host", "path", F.lit("block").alias("verdict"), F.lit("exact").alias("kind")))


def op12_url_filter(pages: DataFrame) -> DataFrame:
    own = pages.select("page_id", "url")
    return url_filter.judged(own, listed(own))


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH rules(h, p, v) AS (VALUES {_RULES}),
u AS (SELECT row_number() OVER () AS r, page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
met AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS place FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
c AS (SELECT r, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:(80|443))?$', '') AS h, regexp_replace(path, '/+$', '') AS p FROM u),
bad AS (SELECT r, h || p AS address FROM c WHERE len(list_intersect(regexp_split_to_array(h, '[.-]'), {list(WORDS)})) > 0)
SELECT page_id, url, host, path, rule, CASE WHEN rule IS NULL THEN address END AS listed_url, coalesce(v, CASE WHEN address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN (SELECT * FROM met WHERE place = 1) USING (r) LEFT JOIN bad USING (r)"""
