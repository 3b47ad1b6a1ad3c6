"""Releases, runs, alerts, enrichment by rules and release rules, on orders, lines, events and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_hash, record_id
from ..operators import alerts as A
from ..operators import enrichment as E
from ..operators import ingest as I
from ..operators import joins as J
from ..operators import observability as O
from ..operators import quality as Q
from ..operators import releases as R
from ..operators import rvu
from ..sources.readers import links
from .registry import Tables, query

NOW = dt.datetime(2024, 1, 31, 12)


def items(t: Tables) -> DataFrame:
    """Parts as relative-value items."""
    k = F.col("p_partkey")
    status = F.get(F.array(*map(F.lit, "ARTNX")), (k % 5).cast("int"))
    return t.part.select(
        k.alias("p_partkey"), F.lpad(k.cast("string"), 5, "0").alias("hcpcs"), status.alias("status_code"), F.when(k % 7 != 0, (F.col("p_size") - 5).cast("double")).alias("rvu_work"), (F.col("p_size") * 0.5).alias("rvu_pe_nonfac"), F.lit(0.25).alias("rvu_malp"),
    )


_ITEMS = "i AS (SELECT p_partkey, ['A', 'R', 'T', 'N', 'X'][p_partkey % 5 + 1] AS status_code, CASE WHEN p_partkey % 7 <> 0 THEN (p_size - 5)::DOUBLE END AS work, p_size * 0.5::DOUBLE AS pe, 0.25::DOUBLE AS mp FROM part)"


@query(f"WITH {_ITEMS} SELECT p_partkey, work + pe + mp AS total_rvu, coalesce(status_code IN ('A', 'R', 'T') AND work > 0, false) AS is_payable, CASE status_code WHEN 'A' THEN CASE WHEN work > 0 THEN 'surgery' ELSE 'evaluation' END WHEN 'R' THEN 'radiology' WHEN 'T' THEN 'therapy' ELSE 'other' END AS payment_category FROM i")
def derived_rvu_facts(t: Tables) -> DataFrame:
    return rvu.derived_facts(items(t)).select("p_partkey", "total_rvu", "is_payable", "payment_category")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS opps_cap_applies, CASE WHEN p_partkey % 4 IN (0, 1) THEN true END AS rural, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE p_retailprice::VARCHAR END AS DOUBLE) AS cap_amount_usd FROM part")
def indicator_maps(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda letters, n: F.get(F.array(*map(F.lit, letters)), (k % n).cast("int"))
    raw = t.part.select("p_partkey", pick(["Y", "N", "?"], 3).alias("CAP_APPLIES"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("CAP_AMOUNT"), pick("ABCD", 4).alias("flag"))
    return rvu.mapped(raw, "oppscap").select("p_partkey", "opps_cap_applies", rvu.rural("flag").alias("rural"), "cap_amount_usd")


@query("SELECT p_partkey, make_date(2020 + p_partkey % 6, 1 + 3 * (p_partkey % 4), 1) AS d, CASE WHEN p_partkey % 3 = 0 THEN 'anesthesia' ELSE 'physician' END AS cf_type FROM part")
def vintage_letters(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    vintage = F.concat((2020 + k % 6).cast("string"), F.get(F.array(*map(F.lit, "abcd")), (k % 4).cast("int")))
    name = F.get(F.array(F.lit("Anes_CF.csv"), F.lit("physician.csv"), F.lit("cf.csv")), (k % 3).cast("int"))
    return t.part.select("p_partkey", rvu.vintage_date(vintage).cast("date").alias("d"), rvu.factor_type(t.part, name).alias("cf_type"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN 2020 + p_partkey % 6 END::INT AS year, CASE WHEN p_partkey % 9 <> 0 THEN 1 + p_partkey % 4 END::INT AS quarter, CASE WHEN p_partkey % 9 <> 0 THEN (make_date(2020 + p_partkey % 6, 1 + 3 * (p_partkey % 4), 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE END AS last_day FROM part")
def batch_ids(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 9 == 0, "apc_").otherwise("opps_"), (2020 + k % 6).cast("string"), F.lit("q"), (1 + k % 4).cast("string"), F.lit("_r01"))
    return t.part.select("p_partkey", rvu.batch_parts(name).alias("b")).select("p_partkey", "b.year", "b.quarter", F.col("b.effective_to").alias("last_day"))


_RULES = (E.EnrichmentRule("nation", "nation", {"s_nationkey": "n_nationkey"}, ("n_name",), {"n_name": "Unknown"}, "fallback", 0.95, 0.9), E.EnrichmentRule("region", "region", {"n_regionkey": "r_regionkey"}, ("r_name",), {"r_name": "none"}))


def enriched_suppliers(t: Tables) -> DataFrame:
    """Suppliers of all nations; the nation's table lacks the last five, so the first rule falls back to its default."""
    names = t.nation.filter("n_nationkey < 20")
    s = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    return E.apply_rules(s, {"nation": names, "region": t.region.filter("r_regionkey < 4")}, list(_RULES))


@query("SELECT s_suppkey, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'Unknown' END AS n_name, CASE WHEN r_regionkey < 4 THEN r_name END AS r_name, 'high' AS s_nationkey_mapping_confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def enrich_by_rules(t: Tables) -> DataFrame:
    return enriched_suppliers(t).select("s_suppkey", "n_name", "r_name", "s_nationkey_mapping_confidence")


@query(
    """WITH j AS (SELECT n_nationkey < 20 AS a, n_regionkey < 4 AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM j)
SELECT 'nation' AS rule, n AS n_rows, na AS n_enriched, round(na / n, 6) AS rate, round(CASE WHEN na / n >= 0.95 AND na < n THEN na / n ELSE 1.0 END * CASE WHEN na / n >= 0.95 AND na < 0.9 * n THEN 0.8 ELSE 1 END, 6)::DOUBLE AS quality_score FROM c
UNION ALL SELECT 'region', n, nb, round(nb / n, 6), round(nb / n, 6)::DOUBLE FROM c"""
)
def enrichment_results(t: Tables) -> DataFrame:
    out = E.rule_results(enriched_suppliers(t), list(_RULES))
    return out.select("rule", "n_rows", "n_enriched", F.round("rate", 6).alias("rate"), F.round("quality_score", 6).alias("quality_score"))


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def tie_broken_rows(t: Tables) -> DataFrame:
    return E.tie_broken(t.part.select("p_brand", "p_size", "p_partkey"), "p_partkey")


def runs(t: Tables) -> DataFrame:
    """Events as a run log: a user is a batch, and a status and counts are given by some events only."""
    e = F.col("event_type")
    return t.events.select(F.col("user_id").cast("string").alias("batch_id"), F.col("ts").cast("timestamp").alias("at"), F.when(e == "error", "failed").when(e == "purchase", "success").when(e == "signup", "started").alias("status"), F.when(e == "click", F.col("event_id")).alias("rows_in"), F.when(e == "view", F.col("event_id")).alias("rows_out"))


@query("SELECT user_id::VARCHAR AS batch_id, arg_max(event_type, ts) FILTER (event_type IN ('error', 'purchase', 'signup')) AS kind, arg_max(event_id, ts) FILTER (event_type = 'click') AS rows_in, arg_max(event_id, ts) FILTER (event_type = 'view') AS rows_out FROM events GROUP BY user_id")
def run_state(t: Tables) -> DataFrame:
    kind = F.when(F.col("status") == "failed", "error").when(F.col("status") == "success", "purchase").when(F.col("status") == "started", "signup")
    return R.run_state(runs(t)).select("batch_id", kind.alias("kind"), "rows_in", "rows_out")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_runs(t: Tables) -> DataFrame:
    return R.recent(t.events.select("event_id", "ts", "event_type"), "ts", 20, "event_id")


def manifests(t: Tables) -> tuple[DataFrame, DataFrame]:
    day = F.to_date("ts").cast("string")
    m = t.events.groupBy(day.alias("release_id")).agg(F.count_if(F.col("event_type") == "error").alias("total_errors"), F.min(F.col("ts").cast("timestamp")).alias("started_at")).withColumn("overall_status", F.when(F.col("total_errors") > 1000, "failed").otherwise("success"))
    return m, t.events.filter("event_type = 'error'").select(day.alias("release_id"), F.when(F.col("value") > 40, "critical").otherwise("low").alias("severity"))


@query(
    """WITH m AS (SELECT ts::DATE AS d, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS started FROM events GROUP BY 1), n AS (SELECT d FROM m ORDER BY started DESC, d LIMIT 3),
a AS (SELECT count(*) AS n, count(*) FILTER (value > 40) AS c FROM events WHERE event_type = 'error' AND ts::DATE IN (SELECT d FROM n)), f AS (SELECT bool_or(errors > 1000) AS x, bool_or(errors > 100) AS y, (epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(max(started))) / 3600 > 24 AS z FROM m)
SELECT rule, alert_type, severity FROM (SELECT unnest(['ingestion_failure', 'high_error_rate', 'critical_anomaly', 'high_anomaly_count', 'no_recent_ingestion']) AS rule, unnest(['ingestion_failure', 'performance_degradation', 'anomaly_detected', 'anomaly_detected', 'system_error']) AS alert_type,
unnest(['critical', 'high', 'critical', 'medium', 'high']) AS severity, unnest([x, y, c > 0, n > 50, z]) AS holds FROM a, f) WHERE holds"""
)
def alert_rules(t: Tables) -> DataFrame:
    return A.triggered(*manifests(t), NOW).select("rule", "alert_type", "severity")


@query(
    """WITH x AS (SELECT event_type, value > 25 AS resolved, ['critical', 'high', 'low'][event_id % 3 + 1] AS severity FROM events)
SELECT 'state' AS dimension, CASE WHEN resolved THEN 'resolved' ELSE 'active' END AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM x GROUP BY ALL UNION ALL SELECT 'type', event_type, count(*) FROM x GROUP BY ALL"""
)
def alert_summary(t: Tables) -> DataFrame:
    return A.alert_summary(t.events.select((F.col("value") > 25).alias("resolved"), F.get(F.array(*map(F.lit, ["critical", "high", "low"])), (F.col("event_id") % 3).cast("int")).alias("severity"), F.col("event_type").alias("alert_type")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 1 THEN 'high' WHEN value * 40 > 1000 AND event_id % 3 = 2 THEN 'medium' ELSE ['critical', 'medium', 'low'][event_id % 3 + 1] END AS severity FROM events")
def severity_by_record(t: Tables) -> DataFrame:
    base = F.get(F.array(*map(F.lit, ["critical", "medium", "low"])), (F.col("event_id") % 3).cast("int"))
    return t.events.select("event_id", A.escalated(base, F.col("event_id") % 2 == 0, F.col("value") * 40).alias("severity"))


@query(
    """WITH l AS (SELECT CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_discount > 0.08 THEN 'warning' END AS s FROM lineitem), o AS (SELECT CASE WHEN o_totalprice > 300000 THEN 'block' END AS s FROM orders)
SELECT 'lines' AS dataset, count(*) AS n_rows, count(*) FILTER (s = 'critical') AS n_failed, count(*) FILTER (s = 'warning') AS n_warnings, round((count(*) - count(*) FILTER (s = 'critical')) / count(*), 4) AS success_rate FROM l
UNION ALL SELECT 'orders', count(*), count(*) FILTER (s = 'block'), 0, round((count(*) - count(*) FILTER (s = 'block')) / count(*), 4) FROM o"""
)
def release_manifest(t: Tables) -> DataFrame:
    release = F.lit("r1").alias("release_id")
    lines = t.lineitem.select(release, F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_discount") > 0.08, "warning").alias("reject_severity"))
    orders = t.orders.select(release, F.when(F.col("o_totalprice") > 300000, "block").alias("reject_severity"))
    return R.release_manifest({"lines": lines, "orders": orders}, "r1")


@query("SELECT 'orders' AS source, count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'pages', count(*) FROM pages")
def source_counts(t: Tables) -> DataFrame:
    return R.table_counts({"orders": t.orders, "customer": t.customer, "pages": t.pages})


@query(
    """WITH m AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS p FROM supplier), n AS (SELECT count(*) AS n_zips FROM customer)
SELECT n_zips, count(*) AS n_metadata, count(*) FILTER (p) AS n_pobox, count(*) FILTER (NOT p) AS n_other, count(*) FILTER (p IS NULL) AS n_null, round(100.0::DOUBLE * count(*) / n_zips, 2) AS coverage_percent, round(100.0::DOUBLE * count(*) FILTER (p) / count(*), 2) AS pobox_percent FROM m, n GROUP BY n_zips"""
)
def pobox_audit(t: Tables) -> DataFrame:
    flag = F.when(F.col("s_suppkey") % 3 == 0, True).when(F.col("s_suppkey") % 3 == 1, False)
    return R.pobox_audit(t.customer, t.supplier.select(flag.alias("is_pobox")))


@query("SELECT is_pobox, sample_no, zip5 FROM (SELECT s_suppkey % 2 = 0 AS is_pobox, s_suppkey AS zip5, row_number() OVER (PARTITION BY s_suppkey % 2 = 0 ORDER BY s_suppkey) AS sample_no FROM supplier) WHERE sample_no <= 10")
def pobox_samples(t: Tables) -> DataFrame:
    return R.pobox_samples(t.supplier.select((F.col("s_suppkey") % 2 == 0).alias("is_pobox"), F.col("s_suppkey").alias("zip5"))).withColumn("sample_no", F.col("sample_no").cast("long"))


@query("SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment, count(*) AS n_candidates, count(DISTINCT c_mktsegment) > 1 AS is_ambiguous FROM customer GROUP BY c_nationkey")
def default_candidates(t: Tables) -> DataFrame:
    return R.default_candidates(t.customer, "c_nationkey", "c_mktsegment")


@query("SELECT round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, min(value) AS least, max(value) AS most, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events")
def latency_profile(t: Tables) -> DataFrame:
    p = R.latency_profile(t.events, "value", F.col("event_type") != "error")
    return p.select(*[F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "p99")], "least", "most", F.round("success_rate", 6).alias("success_rate"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def newest_year_files(t: Tables) -> DataFrame:
    return R.newest_year(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")), "year").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (year(o_orderdate) * 4 + quarter(o_orderdate)) IN (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) AS q FROM orders ORDER BY q DESC LIMIT 3)")
def newest_quarter_files(t: Tables) -> DataFrame:
    return R.newest_quarters(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")), "year", "quarter", 3).select("o_orderkey")


@query("SELECT href, min(page_id * 100000 + position) AS at FROM (SELECT page_id, unnest(range(len(x))) AS position, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS x FROM pages)) GROUP BY href")
def first_links(t: Tables) -> DataFrame:
    l = links(t.pages, "page_id").withColumn("at", F.col("page_id") * 100000 + F.col("position"))
    return R.first_of_each_url(l, "href", "at").select("href", "at")


@query("SELECT page_id, (CASE WHEN page_id % 30 < 10 THEN 2000 + page_id % 30 ELSE 1990 + page_id % 30 END)::INT AS year, CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS quarter FROM pages WHERE CASE WHEN page_id % 30 < 10 THEN 2000 + page_id % 30 ELSE 1990 + page_id % 30 END BETWEEN 2003 AND 2017")
def rvu_release_links(t: Tables) -> DataFrame:
    """Made-up names: two-digit years below 10, four-digit ones from 2000 on."""
    n = F.col("page_id") % 30
    year = F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise((1990 + n).cast("string"))
    href = F.concat(F.lit("/files/rvu"), year, F.get(F.array(F.lit(""), F.lit("b"), F.lit("d")), (F.col("page_id") % 3).cast("int")), F.lit(".zip"))
    return R.rvu_release_links(t.pages.select("page_id", href.alias("href")), "https://h.org", 2003, 2017).select("page_id", "year", "quarter")


_KIND = "CASE page_id % 5 WHEN 0 THEN 'conversion_factors' WHEN 1 THEN 'abstracts' WHEN 2 THEN 'national_payment' WHEN 3 THEN 'policy_updates' ELSE 'other' END"


@query(f"SELECT page_id, {_KIND} AS kind, page_id % 2 = 0 AND page_id % 5 < 3 OR page_id % 2 = 0 AND page_id % 5 = 4 AS is_link FROM pages")
def mpfs_links(t: Tables) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ["/CF", "/pfs-abstract", "/National", "/updates", "/fee"])), (F.col("page_id") % 5).cast("int"))
    p = t.pages.select("page_id", F.concat(name, F.lit("-"), F.when(F.col("page_id") % 2 == 0, "2025").otherwise("2024")).alias("href"), F.when(F.col("page_id") % 5 == 0, "Conversion").alias("text"))
    return p.select("page_id", R.mpfs_kind("href", "text").alias("kind"), R.is_mpfs_link("href", "text", 2025).alias("is_link"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'gone' ELSE 'changed' END AS change, count(*) AS n FROM documents WHERE doc_id % 3 < 2 OR doc_id % 2 = 0 GROUP BY 1")
def changed_files(t: Tables) -> DataFrame:
    """A third of the documents is new, a third is gone, and of the rest the even ones changed."""
    k = F.col("doc_id")
    name = k.cast("string").alias("filename")
    found = t.documents.filter(k % 3 != 1).select(name, F.sha2(F.concat(k.cast("string"), F.when(k % 2 == 0, "x").otherwise("")), 256).alias("sha256"))
    known = t.documents.filter(k % 3 != 0).select(name, F.sha2(k.cast("string"), 256).alias("sha256"))
    return R.file_changes(found, known).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (doc_id % 10 = 0) AS n_added, count(*) FILTER (doc_id % 10 = 0) AS n_removed, false AS same_files FROM documents")
def same_file_sets(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = lambda mark: t.documents.select(k.cast("string").alias("filename"), F.sha2(F.concat(k.cast("string"), F.when(k % 10 == 0, mark).otherwise("")), 256).alias("sha256"))
    return R.has_same_files(rows("a"), rows("b"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3")
def optional_filters(t: Tables) -> DataFrame:
    return J.optional_filters(t.customer, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3, "c_name": None}).select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0")
def unpinned_snapshots(t: Tables) -> DataFrame:
    tags = F.when(F.col("s_suppkey") % 4 == 0, '["old", "pinned"]').when(F.col("s_suppkey") % 4 == 1, '["old"]').when(F.col("s_suppkey") % 4 == 2, "no list")
    return t.supplier.filter(~J.json_list_has(tags, "pinned")).select("s_suppkey")


@query("SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity, l_shipdate, l_partkey, l_linenumber) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def components_in_order(t: Tables) -> DataFrame:
    parts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("sequence"), F.col("l_shipdate").alias("created_at"), F.struct("l_partkey", "l_linenumber").alias("code"))
    return R.components_in_order(t.orders.select("o_orderkey"), parts, "o_orderkey").select("o_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_tax) > 1)")
def conflicting_rows(t: Tables) -> DataFrame:
    return O.rows_of_conflicting_keys(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_tax"), "l_partkey", "l_tax").select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' END AS reject_rule FROM lineitem)
SELECT reject_rule, id, sample_no FROM (SELECT *, row_number() OVER (PARTITION BY reject_rule ORDER BY id) AS sample_no FROM x WHERE reject_rule IS NOT NULL) WHERE sample_no <= 10"""
)
def failure_samples(t: Tables) -> DataFrame:
    rules = [Q.Rule("quantity", F.col("l_quantity") <= 45), Q.Rule("discount", F.col("l_discount") <= 0.08)]
    rows = Q.tagged(t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), rules)
    return Q.failure_samples(rows, ["id"]).select("reject_rule", "id", F.col("sample_no").cast("long").alias("sample_no"))


@query(
    """WITH z AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'x' || c_custkey ELSE lpad((c_custkey * 7 % 99999)::VARCHAR, 5, '0') END AS zip5, CASE WHEN c_nationkey < 20 THEN 'CA' ELSE 'zz' END AS state, (c_nationkey % 3)::VARCHAR AS locality FROM customer),
c AS (SELECT count(*) AS n, count(*) FILTER (NOT regexp_full_match(zip5, '[0-9]{5}')) AS a, count(*) FILTER (state = 'zz') AS b, count(*) - count(DISTINCT zip5) AS d FROM z)
SELECT unnest(['required_fields', 'data_types', 'zip5_format', 'state_codes', 'locality_format', 'date_formats', 'effective_date_range', 'future_dates', 'completeness', 'uniqueness']) AS rule, n AS n_rows, unnest([0, 0, a, b, 0, 0, 0, 0, 0, d]) AS n_failed, unnest([true, true, a = 0, b = 0, true, true, true, true, true, d = 0]) AS passed FROM c"""
)
def zip_locality_rules(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    z = t.customer.select(
        F.when(k % 50 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.lpad((k * 7 % 99999).cast("string"), 5, "0")).alias("zip5"), F.when(F.col("c_nationkey") < 20, "CA").otherwise("zz").alias("state"), (F.col("c_nationkey") % 3).cast("string").alias("locality"),
        F.lit("2024-01-01").alias("effective_from"), F.lit(None).cast("string").alias("effective_to"), F.lit("2024").alias("vintage"),
    )
    return Q.zip_locality_results(z, dt.date(2024, 6, 1)).select("rule", "n_rows", "n_failed", "passed")


def part_code(k: Column) -> tuple[Column, Column]:
    """The last five digits of a key to the base 36, and those before them: a code and a modifier of its own for any key."""
    text = F.lpad(F.conv(k.cast("string"), 10, 36), 13, "0")
    return F.substring(text, 9, 5), F.ltrim(F.substring(text, 1, 8), F.lit("0"))


def addenda(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Brands as ambulatory groups with their mean price, and parts as codes of them."""
    k = F.col("p_partkey")
    hcpcs, modifier = part_code(k)
    apc = F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 4, "0")
    a = t.part.groupBy(apc.alias("apc")).agg(F.round(F.avg("p_retailprice"), 2).alias("rate"))
    b = t.part.select(F.when(k % 100 == 0, "bad").otherwise(hcpcs).alias("hcpcs"), F.when(k % 100 == 0, "").otherwise(modifier).alias("modifier"), F.when(k % 40 == 1, "9999").otherwise(apc).alias("apc"), F.when(k % 60 == 2, "?").otherwise("S").alias("status_indicator"), F.lit(dt.date(2024, 1, 1)).alias("effective_from"), F.lit(dt.date(2024, 3, 31)).alias("effective_to"))
    return a, b


@query(
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 100 = 0) AS bad, count(*) FILTER (p_partkey % 60 = 2) AS odd, count(*) FILTER (p_partkey % 40 = 1) AS lost FROM part), g AS (SELECT count(DISTINCT p_brand) AS n FROM part)
SELECT unnest(['required_files_present', 'file_format_valid', 'required_columns_present', 'data_types_valid', 'hcpcs_code_format', 'apc_code_format', 'status_indicator_valid', 'payment_rates_positive', 'apc_referenced_in_b_exists_in_a', 'hcpcs_exists_for_quarter', 'no_overlapping_effective_ranges', 'row_count_drift', 'rate_bounded_drift', 'coverage_drift']) AS rule,
unnest([2, 3, 8, 8, c.n, c.n, c.n, g.n, c.n, c.n, c.n, 2, g.n, 1])::BIGINT AS n_rows, unnest([0, 1, 0, 0, bad, 0, odd, 0, lost, bad, greatest(bad - 1, 0), 0, 0, 0])::BIGINT AS n_failed FROM c, g"""
)
def opps_release_rules(t: Tables) -> DataFrame:
    a, b = addenda(t)
    spark = a.sparkSession
    files = spark.createDataFrame([("a.csv", "addendum_a"), ("b.xlsx", "addendum_b"), ("note.docx", "readme")], "name string, kind string")
    codes = t.part.select(part_code(F.col("p_partkey"))[0].alias("hcpcs"))
    before = a.withColumn("rate", F.col("rate") * 1.05)
    out = Q.opps_release_results(files, a, b, codes, before, b, columns_a={"apc": "string", "rate": "double"}, columns_b={c: "string" for c in ("hcpcs", "modifier", "apc", "status_indicator")} | {c: "date" for c in ("effective_from", "effective_to")})
    return out.select("rule", "n_rows", "n_failed")


@query("SELECT s_suppkey, n_name, round(s_acctbal * (CASE WHEN n_nationkey < 20 THEN 0.8::DOUBLE + n_nationkey * 0.02::DOUBLE ELSE 1 END), 4) AS wage_adjusted, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'Unknown' END AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def wage_adjusted(t: Tables) -> DataFrame:
    n = t.nation.filter("n_nationkey < 20")
    wage = n.select(F.col("n_nationkey").alias("s_nationkey"), (F.lit(0.8) + F.col("n_nationkey") * F.lit(0.02)).alias("index"))
    named = E.described(E.wage_adjusted(t.supplier, wage, ["s_nationkey"], "s_acctbal"), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("area")), "s_nationkey", "area")
    full = named.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    return full.select("s_suppkey", "n_name", F.round("wage_adjusted", 4).alias("wage_adjusted"), "area")


@query("SELECT n_nationkey, sha256(n_nationkey::VARCHAR || '|' || n_name || '|' || n_regionkey::VARCHAR) AS row_hash FROM nation")
def piped_row_hash(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", joined_hash([F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")], "|").alias("row_hash"))


@query("SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_zips, count(DISTINCT c_nationkey) AS n_states, DATE '2024-01-01' AS first_day, DATE '2024-12-31' AS last_day FROM customer")
def geography_stats(t: Tables) -> DataFrame:
    none = F.lit(None).cast("date")
    return R.geography_stats(t.customer.select(F.col("c_custkey").alias("zip5"), F.col("c_nationkey").alias("state"), none.alias("effective_from"), none.alias("effective_to")))


@query("SELECT y::INT AS year, q AS quarter FROM (SELECT unnest(range(1992, 2003)) AS y), (SELECT unnest(['A', 'B', 'C', 'D']) AS q) WHERE (y, q) NOT IN (SELECT DISTINCT (year(o_orderdate), ['A', 'B', 'C', 'D'][quarter(o_orderdate)]) FROM orders)")
def missing_vintages(t: Tables) -> DataFrame:
    known = t.orders.select(F.year("o_orderdate").alias("year"), F.get(F.array(*map(F.lit, "ABCD")), F.quarter("o_orderdate") - 1).alias("quarter"))
    return I.missing_vintages(known, t.spark, 1992, 2002)


@query("SELECT 'l_returnflag' AS \"column\", count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS n_out, 0 AS n_null, count(DISTINCT l_returnflag) AS n_distinct FROM lineitem UNION ALL SELECT 'l_linenumber', count(*) FILTER (l_linenumber NOT IN (1, 2, 3)), 0, count(DISTINCT l_linenumber) FROM lineitem")
def domain_violations(t: Tables) -> DataFrame:
    return O.domain_violations(t.lineitem, {"l_returnflag": ["A", "R"], "l_linenumber": [1, 2, 3]})


@query(
    f"""WITH {_ITEMS}, g AS (SELECT c_nationkey, c_mktsegment, c_custkey % 50 AS k FROM customer GROUP BY ALL HAVING count(*) > 1)
SELECT 'duplicate locality' AS kind, (SELECT count(*) FROM g) AS n UNION ALL SELECT 'missing name', (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0) UNION ALL SELECT 'missing index', (SELECT count(DISTINCT c_mktsegment) - 2 FROM customer)
UNION ALL SELECT 'payable without work', (SELECT count(*) FROM i WHERE status_code IN ('A', 'R', 'T') AND work IS NULL)"""
)
def cross_anomalies(t: Tables) -> DataFrame:
    places = t.customer.select(F.col("c_nationkey").alias("mac"), F.col("c_mktsegment").alias("locality_code"), (F.col("c_custkey") % 50).alias("county"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("locality_name"))
    indices = t.spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("none",)], "locality_code string")
    return O.cross_anomalies(items(t), indices, places)


@query("SELECT count(*) FILTER (p_size <= 20) AS n_kept, count(*) FILTER (p_size > 20 AND p_size <= 40) AS n_replaced, count(*) FILTER (p_size > 40) AS n_added, 'p_partkey' AS natural_keys, 'merge' AS strategy FROM part")
def upsert_manifest(t: Tables) -> DataFrame:
    from ..sources.sinks import upsert_manifest as manifest

    return manifest(t.part.filter("p_size <= 40"), t.part.filter("p_size > 20"), ["p_partkey"])


@query("SELECT p_partkey, substr(md5('{\"p_brand\":\"' || p_brand || '\",\"p_partkey\":' || p_partkey || '}'), 1, 16) AS record_id FROM part")
def record_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", record_id(t.part, ["p_partkey", "p_brand"]).alias("record_id"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS holds, CASE WHEN value > 20 THEN 'high' ELSE 'medium' END AS severity,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type = 'error', CASE WHEN value > 20 THEN 0 ELSE 1 END) AS i FROM events WHERE event_type IN ('error', 'purchase')),
r AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS ms, NULL::BIGINT AS raised, NULL::VARCHAR AS sev, false AS esc, false AS open, NULL::BIGINT AS esc_at, NULL::BIGINT AS esc_raised, NULL::VARCHAR AS esc_sev, false AS up, false AS done FROM e
  UNION ALL SELECT key, i, ms, CASE WHEN up THEN ms ELSE raised END, CASE WHEN up THEN severity WHEN due THEN higher ELSE sev END, CASE WHEN up THEN false ELSE esc OR due END, CASE WHEN up THEN true WHEN holds THEN open ELSE false END,
    CASE WHEN due THEN raised + 172800000 END, CASE WHEN due THEN raised END, CASE WHEN due THEN higher END, up, open AND NOT holds
  FROM (SELECT e.key, e.i, e.ms, e.holds, e.severity, r.raised, r.sev, r.esc, r.open, CASE WHEN r.sev = 'medium' THEN 'high' ELSE 'critical' END AS higher,
    coalesce(r.open AND NOT r.esc AND r.raised + 172800000 <= e.ms, false) AS due, e.holds AND NOT coalesce(r.open AND e.ms - r.raised <= 86400000, false) AS up FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)),
out AS (SELECT key, 'raised' AS event, ms, sev AS severity, raised FROM r WHERE up UNION ALL SELECT key, 'resolved', ms, sev, raised FROM r WHERE done UNION ALL SELECT key, 'escalated', esc_at, esc_sev, esc_raised FROM r WHERE esc_at IS NOT NULL
  UNION ALL SELECT key, 'escalated', raised + 172800000, CASE WHEN sev = 'medium' THEN 'high' ELSE 'critical' END, raised FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1) WHERE open AND NOT esc)
SELECT key, event, make_timestamp(ms * 1000) AS at, severity, make_timestamp(raised * 1000) AS raised_at FROM out"""
)
def alert_log(t: Tables) -> DataFrame:
    """Alerts of each user's log: errors raise them, purchases end them, and what is open for two days is escalated."""
    import datetime as dt

    from ..streaming import alert_log as A

    own = t.events.filter(F.col("event_type").isin("error", "purchase")).select("user_id", "ts", (F.col("event_type") == "error").alias("holds"), F.when(F.col("value") > 20, "high").otherwise("medium").alias("severity"))
    return A.raised_alerts(own, A.Policy({}, other_cooldown=1440, escalate_after=2880), dt.datetime(2100, 1, 1), key="user_id", at="ts")
