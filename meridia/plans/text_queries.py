"""Text functions, links and JSON on parts, pages, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import links, routed
from .registry import Tables, query

_NBSP = "chr(160)"


@query(f"SELECT p_partkey, regexp_replace({_NBSP} || ' ' || chr(9) || p_name || ' ' || {_NBSP}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS name FROM part")
def trim_nbsp(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("  \t"), F.col("p_name"), F.lit("  "))
    return t.part.select("p_partkey", T.strip(padded).alias("name"))


@query("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS code FROM part")
def zero_pad(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.zero_pad(F.col("p_partkey").cast("string"), 3).alias("code"))


@query("SELECT p_partkey, p_retailprice::DECIMAL(18, 4) AS fee FROM part")
def currency_clean(t: Tables) -> DataFrame:
    money = F.concat(F.lit(" $"), F.format_number("p_retailprice", 4))
    return t.part.select("p_partkey", T.currency(money).alias("fee"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace(strip_accents(text), '[\\s\\x{A0}]+', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g')), '[()]', '', 'g'), '^ +| +$', '', 'g'), ' ') AS key FROM documents")
def ascii_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.ascii_key("text").alias("key"))


@query("SELECT n_nationkey, unnest(list_filter(list_transform(string_split_regex(regexp_replace(n_name || ' / B-C, D and E', '(?i)\\s+AND\\s+', ',', 'g'), '[,/]'), lambda x: trim(x)), lambda x: x <> '')) AS name FROM nation")
def list_explode(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(T.split_list(F.concat("n_name", F.lit(" / B-C, D and E")))).alias("name"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def except_list(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name").join(t.nation.filter("n_regionkey = 1").select("n_name"), "n_name", "left_anti").select("n_nationkey", "n_name")


@query("SELECT page_id, unnest(range(len(x))) AS position, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS x FROM pages)")
def scrape_links(t: Tables) -> DataFrame:
    return links(t.pages, "page_id").withColumn("position", F.col("position").cast("long"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(lower(h), 'the') THEN 'the' WHEN contains(lower(h), 'en') OR contains(lower(h), 'la') THEN 'romance' ELSE 'other' END AS kind FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages)) GROUP BY kind")
def classify_links(t: Tables) -> DataFrame:
    kind = T.classified("href", [(["the"], "the"), (["en", "la"], "romance")], "other")
    return links(t.pages, "page_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (2020 + p_partkey % 7)::INT AS year, (1 + p_partkey % 4)::INT AS quarter, CASE p_partkey % 3 WHEN 0 THEN 'pprrvu' WHEN 1 THEN 'gpci' END AS dataset FROM part")
def filename_vintage(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    stem = F.get(F.array(F.lit("PPRRVU"), F.lit("gpci"), F.lit("readme")), (k % 3).cast("int"))
    name = F.concat(stem, (2020 + k % 7).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("_Q"), (1 + k % 4).cast("string"))).otherwise(F.get(F.array(*map(F.lit, "ABCD")), (k % 4).cast("int"))), F.lit(".txt.zip"))
    return t.part.select("p_partkey", T.year_in(name).alias("year"), T.quarter_in(name).alias("quarter"), routed(name).alias("dataset"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(length(text)) AS longest FROM conversations GROUP BY role")
def conversation_roles(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.max(F.char_length("text")).cast("long").alias("longest"))
