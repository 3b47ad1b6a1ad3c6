"""Statistics, rules, anomalies and observability on lines, parts and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_number, row_hash
from ..functions.text import row_id as natural_key_id
from ..operators import joins as J
from ..operators import observability as O
from ..operators import quality as Q
from ..operators import windows as W
from ..streaming.traces import windowed_counts
from .registry import Tables, query
from .window_queries import WINDOWS, order_windows

NOW = dt.datetime(2024, 1, 20)


@query("SELECT count(*) AS total, count(*) FILTER (l_returnflag IN ('A', 'R')) AS payable, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 25) AS surgery, count(DISTINCT l_partkey) AS codes FROM lineitem")
def stats_counts(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.agg(F.count("*").alias("total"), F.count_if(flag.isin("A", "R")).alias("payable"), F.count_if((flag == "A") & (F.col("l_quantity") > 25)).alias("surgery"), F.count_distinct("l_partkey").alias("codes"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END AS k FROM lineitem)")
def distinct_with_null(t: Tables) -> DataFrame:
    return W.distinct_with_null(t.lineitem.select(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("k")), "k")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_counts(t: Tables) -> DataFrame:
    return W.top_counts(t.events, "user_id", 10)


@query("SELECT event_type, list_sort(list(value))[least(cast(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95 FROM events GROUP BY event_type")
def latency_p95_floor_index(t: Tables) -> DataFrame:
    return W.by_percentile_index(t.events, ["event_type"], "value", 0.95, "p95")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT nullif(user_id % 5, 0)) AS states, list_sort(list(value))[least(cast(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95 FROM events GROUP BY event_type")
def trace_summary(t: Tables) -> DataFrame:
    e = t.events.withColumn("state", F.nullif(F.col("user_id") % 5, F.lit(0)))
    return O.trace_summary(e, "event_type", "value", [F.count_distinct("state").alias("states")]).withColumn("mean", F.round("mean", 4))


@query("SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 2) AS share FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def trace_analytics(t: Tables) -> DataFrame:
    s = O.shares(t.events, "event_type").orderBy(F.desc("n"), "event_type").limit(5)
    return s.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.round(F.col("n") / F.col("share")), 2))


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END"


@query(f"WITH r AS (SELECT {_STATUS} AS status, event_id % 1000 AS rows_in, CASE event_type WHEN 'error' THEN 10 ELSE 1 END AS rejected FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20') SELECT count(*) AS n_runs, count(*) FILTER (status = 'success') AS n_success, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate, round(sum(rejected) / sum(rows_in), 6) AS rejection_rate, sum(rows_in)::BIGINT AS rows_in FROM r")
def run_stats(t: Tables) -> DataFrame:
    runs = t.events.select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").alias("started_at"), F.col("value").alias("seconds"), (F.col("event_id") % 1000).alias("rows_in"), F.when(F.col("event_type") == "error", 10).otherwise(1).alias("rows_rejected"))
    return O.run_statistics(runs.withColumn("started_at", F.col("started_at").cast("timestamp")), NOW, 7).select("n_runs", "n_success", F.round("success_rate", 6).alias("success_rate"), F.round("rejection_rate", 6).alias("rejection_rate"), "rows_in")


@query("SELECT count(*) AS n, count(*) FILTER (value < 1.0) AS n_coincident, count(*) FILTER (value > 10.0) AS n_far, round(100.0::DOUBLE * count(*) FILTER (value > 10.0) / count(*), 2) AS far_percent FROM events")
def resolver_stats(t: Tables) -> DataFrame:
    far = F.count_if(F.col("value") > 10)
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("value") < 1).alias("n_coincident"), far.alias("n_far"), F.round(F.try_divide(F.lit(100.0) * far, F.count("*")), 2).alias("far_percent"))


@query("SELECT a AS n, b AS n_reference, round(abs(a - b) / b, 6) AS drift, abs(a - b) / b > 0.15 AS over_limit FROM (SELECT count(*) AS a FROM events WHERE event_type = 'click'), (SELECT count(*) AS b FROM events WHERE event_type = 'view')")
def volume_drift(t: Tables) -> DataFrame:
    return Q.drift(t.events.filter("event_type = 'click'"), t.events.filter("event_type = 'view'")).withColumn("drift", F.round("drift", 6))


@query("WITH s AS (SELECT count(*) FILTER (event_type <> 'error') / count(*) AS q, least(1.0, count(*) / 1000.0::DOUBLE) AS v, count(user_id) / count(*) AS l FROM events) SELECT round(0.25 * 1.0 + 0.20 * v + 0.20 * 1.0 + 0.25 * q + 0.10 * l, 6) AS health FROM s")
def health_weighted(t: Tables) -> DataFrame:
    n = F.count("*")
    scores = {"freshness": F.lit(1.0), "volume": F.least(F.lit(1.0), n / 1000.0), "schema": F.lit(1.0), "quality": F.count_if(F.col("event_type") != "error") / n, "lineage": F.count("user_id") / n}
    return t.events.agg(F.round(O.health(scores), 6).alias("health"))


@query("SELECT event_type, CASE WHEN h < 1 THEN 'fresh' WHEN h < 24 THEN 'stale' ELSE 'outdated' END AS freshness, CASE WHEN n = 0 THEN 'empty' WHEN n < 1000 THEN 'low' WHEN n < 100000 THEN 'normal' ELSE 'high' END AS volume FROM (SELECT event_type, count(*) AS n, (epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(max(ts))) / 3600 AS h FROM events GROUP BY event_type)")
def status_ladders(t: Tables) -> DataFrame:
    hours = (F.lit(dt.datetime(2024, 1, 31, 12)).cast("timestamp").cast("double") - F.max(F.col("ts").cast("timestamp")).cast("double")) / 3600
    return t.events.groupBy("event_type").agg(O.freshness_status(hours).alias("freshness"), O.volume_status(F.count("*")).alias("volume"))


@query("SELECT column_name AS \"column\", null_rate, null_rate > 0.05 AS over_limit FROM (SELECT unnest(['event_id', 'v']) AS column_name, unnest([a, b]) AS null_rate FROM (SELECT round(avg((event_id IS NULL)::INT), 6) AS a, round(avg((event_type = 'error')::INT), 6) AS b FROM events))")
def null_rates(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return Q.null_rates(e).withColumn("null_rate", F.round("null_rate", 6)).withColumn("over_limit", F.col("null_rate") > Q.MAX_NULL_RATE)


@query("SELECT count(*) AS n, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, count(DISTINCT user_id) AS users, round((count(event_id) + count(CASE WHEN event_type <> 'error' THEN 1 END)) / (2.0 * count(*)), 6) AS completeness FROM events")
def completeness_profile(t: Tables) -> DataFrame:
    e = t.events.withColumn("v", F.when(F.col("event_type") != "error", 1))
    return e.agg(F.count("*").alias("n"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.count_distinct("user_id").alias("users"), F.round(O.completeness(e, ["event_id", "v"]), 6).alias("completeness"))


@query("SELECT c AS \"column\", count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS most, CASE WHEN count(DISTINCT v) < 50 THEN array_to_string(list_sort(list(DISTINCT v)), '|') END AS domain FROM (SELECT 'p_size' AS c, p_size::VARCHAR AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part) GROUP BY c")
def profile_schema(t: Tables) -> DataFrame:
    return Q.profile(t.part, ["p_size", "p_brand"]).select("column", "n_distinct", "least", "most", "domain")


@query("SELECT l_orderkey, l_linenumber FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) WHERE abs(l_extendedprice - m) > 1.7 * s")
def outliers_by_deviation(t: Tables) -> DataFrame:
    return O.outliers(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 1.7).select("l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag")
def status_share(t: Tables) -> DataFrame:
    return O.shares(t.lineitem, "l_returnflag").withColumn("share", F.round("share", 6))


@query("SELECT l_partkey, count(*) AS n_rows, count(DISTINCT l_tax) AS n_values FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_tax) > 1")
def key_multi_value(t: Tables) -> DataFrame:
    return O.keys_with_several_values(t.lineitem, "l_partkey", "l_tax")


@query("SELECT 'l_discount' AS \"column\", min(l_discount) AS least, max(l_discount) AS most, count(*) FILTER (l_discount < 0.02 OR l_discount > 0.08) AS n_out FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity), count(*) FILTER (l_quantity < 2 OR l_quantity > 45) FROM lineitem")
def band_violations(t: Tables) -> DataFrame:
    return O.out_of_band(t.lineitem, {"l_discount": (0.02, 0.08), "l_quantity": (2, 45)})


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice / nullif(p_retailprice * l_quantity, 0) < 0.5 OR l_extendedprice / nullif(p_retailprice * l_quantity, 0) > 2.0")
def price_ratio(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("expected", F.col("p_retailprice") * F.col("l_quantity"))
    return O.ratio_violations(j, "l_extendedprice", "expected").select("l_orderkey", "l_linenumber")


@query("SELECT sha256(string_agg(n_nationkey::VARCHAR || '|' || n_name || '|' || coalesce(nullif(n_regionkey, 2)::VARCHAR, 'None'), chr(10) ORDER BY (n_nationkey::VARCHAR || '|' || n_name || '|' || coalesce(nullif(n_regionkey, 2)::VARCHAR, 'None')))) AS digest FROM nation")
def dataset_digest(t: Tables) -> DataFrame:
    return O.small_digest(t.nation, [F.col("n_nationkey"), F.col("n_name"), F.nullif("n_regionkey", F.lit(2))])


@query("WITH r AS (SELECT sha256(p_partkey::VARCHAR || '|' || p_name) AS h FROM part), b AS (SELECT ('0x' || substr(h, 1, 3))::INT AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM r GROUP BY ALL) SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b")
def dataset_digest_two_levels(t: Tables) -> DataFrame:
    return O.dataset_digest(t.part, [F.col("p_partkey"), F.col("p_name")])


@query("SELECT p_partkey, sha256(p_partkey::VARCHAR || chr(31) || p_name || chr(31) || coalesce(nullif(p_size, 10)::VARCHAR, '') || chr(31) || round(p_retailprice::DECIMAL(38, 10), 2)::DECIMAL(38, 2)::VARCHAR) AS row_content_hash FROM part")
def row_content_hash(t: Tables) -> DataFrame:
    p = t.part.withColumn("p_size", F.nullif("p_size", F.lit(10)))
    return p.select("p_partkey", row_hash(p, ["p_partkey", "p_name", "p_size", "p_retailprice"], {"p_retailprice": 2}).alias("row_content_hash"))


@query("SELECT l_orderkey, l_linenumber, sha256(l_orderkey::VARCHAR || chr(31) || l_linenumber::VARCHAR || chr(31) || l_shipdate::DATE::VARCHAR) AS row_id FROM lineitem")
def row_id(t: Tables) -> DataFrame:
    l = t.lineitem.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    return l.select("l_orderkey", "l_linenumber", natural_key_id(l, ["l_orderkey", "l_linenumber", "d"]).alias("row_id"))


@query(
    """WITH c AS (SELECT (c_custkey * 37)::VARCHAR AS zip5, c_mktsegment, c_acctbal FROM customer), n AS (SELECT count(*) AS n, count(*) FILTER (NOT regexp_full_match(zip5, '[0-9]{5}')) AS a, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS b, count(*) FILTER (c_acctbal < 0) AS d FROM c)
SELECT unnest(['zip5_format', 'segment_domain', 'balance_range']) AS rule, unnest(['error', 'warning', 'error']) AS severity, n AS n_rows, unnest([a, b, d]) AS n_failed, round(1 - unnest([a, b, d]) / n, 6) AS score, round(1 - unnest([a, b, d]) / n, 6) >= unnest([1.0, 0.5, 1.0]) AS passed FROM n"""
)
def rule_results(t: Tables) -> DataFrame:
    c = t.customer.withColumn("zip5", (F.col("c_custkey") * 37).cast("string"))
    rules = [Q.zip5_rule("zip5"), Q.Rule("segment_domain", Q.in_domain("c_mktsegment", ["BUILDING", "MACHINERY"]), "warning", 0.5), Q.Rule("balance_range", F.col("c_acctbal") >= 0)]
    return Q.checked(c, rules).withColumn("score", F.round("score", 6))


@query("SELECT c_custkey FROM customer WHERE NOT regexp_full_match((c_custkey * 37)::VARCHAR, '[0-9]{5}')")
def rule_zip_format(t: Tables) -> DataFrame:
    return Q.failing(t.customer.withColumn("zip5", (F.col("c_custkey") * 37).cast("string")), Q.zip5_rule("zip5")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def rule_domain(t: Tables) -> DataFrame:
    return Q.failing(t.customer, Q.Rule("domain", Q.in_domain("c_mktsegment", ["BUILDING", "MACHINERY"]))).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount BETWEEN 0.01 AND 0.09)")
def rule_range(t: Tables) -> DataFrame:
    return Q.failing(t.lineitem, Q.Rule("range", F.col("l_discount").between(0.01, 0.09))).select("l_orderkey", "l_linenumber")


@query(
    f"""WITH {WINDOWS}, v AS (SELECT o_orderkey, o_custkey, d_from, CASE WHEN o_orderkey % 5 = 0 THEN (d_to + INTERVAL 10 DAY)::DATE ELSE d_to END AS d_to FROM w), n AS (SELECT *, lead(d_from) OVER (PARTITION BY o_custkey ORDER BY d_from, d_to NULLS LAST) AS next_start FROM v)
SELECT o_custkey, count(*) AS n FROM n WHERE next_start IS NOT NULL AND (d_to IS NULL OR d_to >= next_start) GROUP BY o_custkey"""
)
def rule_overlap_windows(t: Tables) -> DataFrame:
    v = order_windows(t).withColumn("d_to", F.when(F.col("o_orderkey") % 5 == 0, F.date_add("d_to", 10)).otherwise(F.col("d_to")))
    return Q.overlapping_windows(v, ["o_custkey"], "d_from", "d_to").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '2001-01-01'")
def rule_future_date(t: Tables) -> DataFrame:
    return Q.failing(t.orders.withColumn("d", F.to_date("o_orderdate")), Q.future_rule("d", dt.date(2001, 1, 1))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'flag_domain' WHEN l_quantity > 40 THEN 'quantity_range' END AS reject_rule FROM lineitem")
def categorical_reject_split(t: Tables) -> DataFrame:
    rules = [Q.Rule("flag_domain", Q.in_domain("l_returnflag", ["A", "R"]), "block"), Q.Rule("quantity_range", F.col("l_quantity") <= 40, "warning")]
    return Q.tagged(t.lineitem, rules).select("l_orderkey", "l_linenumber", "reject_rule")


@query("SELECT s_suppkey AS k, 'negative' AS reject_rule, NULL AS segment FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT c_custkey, 'negative', c_mktsegment FROM customer WHERE c_acctbal < 0")
def reject_union(t: Tables) -> DataFrame:
    a = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("k"), F.lit("negative").alias("reject_rule"))
    b = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("negative").alias("reject_rule"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


def records(t: Tables) -> DataFrame:
    message = F.concat(F.lit("row "), F.col("event_id").cast("string"), F.get(F.array(*map(F.lit, [": bad ZIP9 code", ": schema changed", ": parse failure", ": duplicate key", ": value out of bounds", ": required field", ": other"])), (F.col("event_id") % 7).cast("int")))
    return t.events.select("event_id", message.alias("message"), F.when(F.col("user_id") % 2 == 0, "open").otherwise("closed").alias("status"), F.col("event_type").alias("rule"))


_TRIAGED = "r AS (SELECT event_id, event_id % 7 AS k, CASE WHEN user_id % 2 = 0 THEN 'open' ELSE 'closed' END AS status, event_type AS rule FROM events), c AS (SELECT *, ['zip9', 'schema', 'format', 'duplicate', 'range', 'missing', 'other'][k + 1] AS category, ['low', 'critical', 'low', 'medium', 'medium', 'high', 'low'][k + 1] AS severity FROM r)"


@query(f"WITH {_TRIAGED} SELECT event_id, category, severity FROM c")
def triage_category(t: Tables) -> DataFrame:
    return O.triaged(records(t), "message").select("event_id", "category", "severity")


@query(f"WITH {_TRIAGED} SELECT 'status' AS dimension, status AS value, count(*) AS n FROM c GROUP BY status UNION ALL SELECT 'severity', severity, count(*) FROM c GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY category UNION ALL SELECT 'rule', rule, count(*) FROM c GROUP BY rule")
def quarantine_summary(t: Tables) -> DataFrame:
    return O.quarantine_summary(O.triaged(records(t), "message"))


@query(f"WITH {_TRIAGED} SELECT rule, count(*) AS n, ['critical', 'high', 'medium', 'low'][min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END)] AS priority FROM c WHERE category <> 'schema' GROUP BY rule")
def severity_escalation(t: Tables) -> DataFrame:
    return O.batch_priority(O.triaged(records(t), "message").filter("category <> 'schema'"), "rule")


@query("SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_record_status(t: Tables) -> DataFrame:
    return O.latest_status(t.events, "user_id", "ts", "event_id").select("user_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def windowed_trace_counts(t: Tables) -> DataFrame:
    return windowed_counts(t.events, "ts", "event_type", "value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("mean", F.round("mean", 4))


@query("SELECT alert_type, n FROM (SELECT event_type AS alert_type, count(*) AS n FROM events GROUP BY event_type) WHERE n > 10 AND alert_type NOT IN (SELECT event_type FROM events WHERE event_type NOT IN ('view', 'click') AND (value > 20 OR event_type = 'error') AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 600 MINUTE)")
def open_alerts(t: Tables) -> DataFrame:
    findings = t.events.groupBy(F.col("event_type").alias("alert_type")).agg(F.count("*").alias("n")).filter("n > 10")
    history = t.events.select(F.col("event_type").alias("alert_type"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type").isin("view", "click") | ((F.col("value") <= 20) & (F.col("event_type") != "error"))).alias("resolved"))
    return O.open_alerts(findings, history, NOW, 600)


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_partkey)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS n_duplicates FROM lineitem")
def uniqueness(t: Tables) -> DataFrame:
    return Q.uniqueness(t.lineitem, ["l_orderkey", "l_partkey"])


@query("SELECT p_partkey, round(p_retailprice::DECIMAL(38, 10), 1)::DECIMAL(38, 1)::VARCHAR AS v FROM part")
def canonical_numeric(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", canonical_number("p_retailprice", 1).alias("v"))


@query("SELECT o_orderkey, round(o_totalprice::DECIMAL(18, 4), 2) AS over FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 30")
def over_cap(t: Tables) -> DataFrame:
    items = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("total"))
    return Q.over_cap(items, t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 30).alias("cap")), ["k"]).select("o_orderkey", F.round(F.col("total").cast("decimal(18,4)"), 2).alias("over"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ok' END AS result FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '1997-01-01')")
def missing_orders(t: Tables) -> DataFrame:
    none = J.missing(t.customer.withColumnRenamed("c_custkey", "o_custkey"), t.orders.filter(F.col("o_orderpriority").startswith("1") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))), ["o_custkey"])
    return none.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("ok").alias("result"))
