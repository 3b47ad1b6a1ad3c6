"""Effective dates, picks, fills, duplicates, enrichment and anti joins on orders and customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import joins as J
from ..operators import windows as W
from .registry import Tables, query

DAY, LOW, HIGH = dt.date(1998, 3, 15), dt.date(1997, 4, 1), dt.date(1997, 6, 30)


def order_windows(t: Tables) -> DataFrame:
    """Each order in force from its date to the day before its customer's next order; the last one is open."""
    day = F.to_date("o_orderdate")
    after = F.lead(day).over(Window.partitionBy("o_custkey").orderBy(day, "o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey", day.alias("d_from"), F.date_sub(after, 1).alias("d_to"))


WINDOWS = "w AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d_from, (lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) - INTERVAL 1 DAY)::DATE AS d_to FROM orders)"


@query(f"WITH {WINDOWS} SELECT o_orderkey, o_custkey FROM w WHERE d_from <= DATE '1998-03-15' AND (d_to IS NULL OR d_to >= DATE '1998-03-15')")
def asof_containment(t: Tables) -> DataFrame:
    return order_windows(t).filter(D.covers(DAY, "d_from", "d_to")).select("o_orderkey", "o_custkey")


@query(f"WITH {WINDOWS} SELECT o_orderkey, o_custkey FROM w WHERE d_from <= DATE '1998-03-15' AND d_to >= DATE '1998-03-15'")
def asof_closed_end(t: Tables) -> DataFrame:
    return order_windows(t).filter(D.covers(DAY, "d_from", "d_to", open_end=False)).select("o_orderkey", "o_custkey")


@query(f"WITH {WINDOWS} SELECT o_orderkey FROM w WHERE d_from <= DATE '1997-06-30' AND (d_to IS NULL OR d_to >= DATE '1997-04-01')")
def window_overlap(t: Tables) -> DataFrame:
    p = D.period(1997, 2)
    return order_windows(t).filter(D.overlaps(p.low, p.high, "d_from", "d_to")).select("o_orderkey")


@query(f"WITH {WINDOWS} SELECT o_orderkey FROM w WHERE d_from >= DATE '1997-04-01' AND d_to <= DATE '1997-06-30'")
def range_inside(t: Tables) -> DataFrame:
    return order_windows(t).filter(D.within(LOW, HIGH, "d_from", "d_to")).select("o_orderkey")


@query(
    f"""WITH {WINDOWS}, f AS (SELECT c_custkey, DATE '1996-01-01' + (c_custkey % 1500)::INT AS day FROM customer),
r AS (SELECT f.*, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY (d_to IS NULL OR d_to >= day) DESC, d_from DESC, o_orderkey DESC) AS rn FROM f JOIN w ON o_custkey = c_custkey AND d_from <= day)
SELECT f.c_custkey, f.day, r.o_orderkey FROM f LEFT JOIN r ON r.c_custkey = f.c_custkey AND rn = 1"""
)
def asof_latest_price(t: Tables) -> DataFrame:
    facts = t.customer.select("c_custkey", F.date_add(F.lit(dt.date(1996, 1, 1)), (F.col("c_custkey") % 1500).cast("int")).alias("day"))
    got = J.as_of(facts, order_windows(t).withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "day", "d_from", "d_to", ["c_custkey"], "o_orderkey")
    return got.select("c_custkey", "day", "o_orderkey")


_LATEST = "SELECT o_custkey, o_orderkey, d, rn FROM (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS rn FROM orders {where}) WHERE rn = 1"


@query(_LATEST.format(where=""))
def latest_effective_view(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return W.first_by(o, ["o_custkey"], [F.desc("d"), F.desc("o_orderkey")], rank="rn").withColumn("rn", F.col("rn").cast("long"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders)")
def latest_global_date(t: Tables) -> DataFrame:
    return W.latest_day(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")), "d")


@query("SELECT o_custkey, o_orderkey, d FROM (" + _LATEST.format(where="WHERE o_orderdate::DATE <= DATE '1998-03-15'") + ")")
def latest_before_date(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return W.latest_effective(o, ["o_custkey"], "d", "o_orderkey", as_of=DAY)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def forward_fill(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    return W.forward_filled(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "user_id", "last_purchase")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicates_keep_none(t: Tables) -> DataFrame:
    return W.in_duplicate_keys(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), ["h"]).select("doc_id")


@query("SELECT (count(*) - count(DISTINCT text))::BIGINT AS n_duplicates FROM documents")
def duplicates_count(t: Tables) -> DataFrame:
    return W.duplicate_count(t.documents.select(F.sha2("text", 256).alias("h")), ["h"])


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text")
def dedupe_first(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@query(
    """SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 3 = 0) DESC, CASE WHEN s_acctbal > 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey) AS rn FROM supplier) WHERE rn = 1"""
)
def preferred_mapping_nulls_last(t: Tables) -> DataFrame:
    s = t.supplier.withColumn("weight", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return W.first_by(s, ["s_nationkey"], [F.desc(F.col("s_suppkey") % 3 == 0), F.desc_nulls_last("weight"), F.asc("s_suppkey")]).select("s_nationkey", "s_suppkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def enrich_left(t: Tables) -> DataFrame:
    s = J.enriched(t.supplier, t.nation.filter("n_nationkey < 20"), {"s_nationkey": "n_nationkey"})
    return J.enriched(s, t.region, {"n_regionkey": "r_regionkey"}).select("s_suppkey", "n_name", "r_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 20")
def enrich_inner(t: Tables) -> DataFrame:
    return J.enriched(t.supplier, t.nation.filter("n_nationkey < 20"), {"s_nationkey": "n_nationkey"}, "inner").select("s_suppkey", "n_name")


def partly_placed(t: Tables) -> DataFrame:
    """All suppliers; those of the first five nations have no nation, so that both sides of a join have rows without a partner."""
    return t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey")).alias("s_nationkey"))


@query("SELECT s_suppkey, n_name FROM (SELECT s_suppkey, CASE WHEN s_nationkey >= 5 THEN s_nationkey END AS k FROM supplier) RIGHT JOIN nation ON k = n_nationkey")
def enrich_right(t: Tables) -> DataFrame:
    return J.enriched(partly_placed(t), t.nation, {"s_nationkey": "n_nationkey"}, "right").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, n_name, coalesce(k, n_nationkey) AS s_nationkey FROM (SELECT s_suppkey, CASE WHEN s_nationkey >= 5 THEN s_nationkey END AS k FROM supplier) FULL JOIN nation ON k = n_nationkey")
def enrich_outer(t: Tables) -> DataFrame:
    return J.enriched(partly_placed(t), t.nation, {"s_nationkey": "n_nationkey"}, "outer").select("s_suppkey", "n_name", "s_nationkey")


@query(
    """WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer), r AS (SELECT CASE WHEN n_nationkey = 9 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation)
SELECT c_custkey, coalesce(n_name, 'Unknown') AS n_name, n_name IS NOT NULL AS matched FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k"""
)
def enrich_defaults(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("k"))
    right = t.nation.select(F.when(F.col("n_nationkey") != 9, F.col("n_nationkey")).alias("k"), "n_name")
    return J.enriched(left, right, {"k": "k"}, defaults={"n_name": "Unknown"}, null_keys_match=True, flag="matched").select("c_custkey", "n_name", "matched")


@query("SELECT count(*) AS n_rows, count(*) FILTER (n_nationkey < 20) AS n_matched, round(count(*) FILTER (n_nationkey < 20) / count(*), 6) AS rate FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def enrichment_match_rate(t: Tables) -> DataFrame:
    s = J.enriched(t.supplier, t.nation.filter("n_nationkey < 20"), {"s_nationkey": "n_nationkey"}, flag="matched")
    return J.match_rate(s, "matched").withColumn("rate", F.round("rate", 6))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_reference_anti(t: Tables) -> DataFrame:
    return J.missing(t.customer.select(F.col("c_custkey").alias("k")), t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), ["k"]).withColumnRenamed("k", "c_custkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 10 = s_suppkey % 10) g WHERE g.p_partkey = l.l_partkey AND g.s_suppkey = l.l_suppkey)")
def referential_anti(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 10).alias("m"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 10).alias("m"))
    return J.missing_pairs(t.lineitem, parts, suppliers, "l_partkey", "l_suppkey", ["m"])


@query(
    """SELECT c.c_custkey, CASE WHEN c.c_nationkey <> s.s_nationkey THEN 'nation' ELSE 'sign' END AS conflict_type FROM customer c JOIN supplier s ON c_custkey = s_suppkey WHERE c.c_nationkey <> s.s_nationkey OR (c_acctbal > 0) <> (s_acctbal > 0)"""
)
def conflict_theta(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("sign"))
    b = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("sign"))
    return J.conflicts(a, b, "c_custkey", ["nation", "sign"]).select("c_custkey", "conflict_type")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def parent_child_count(t: Tables) -> DataFrame:
    return J.child_counts(t.customer.select("c_custkey"), t.orders.select("o_custkey"), "c_custkey", "o_custkey", "n_orders")


@query("SELECT p_brand, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 20 AND l_returnflag = 'R' GROUP BY p_brand")
def many_to_many_filtered(t: Tables) -> DataFrame:
    j = t.lineitem.filter("l_returnflag = 'R'").join(t.part.filter("p_size < 20"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT count(*) FILTER (a IS NOT NULL) AS n_authority, count(*) FILTER (b IS NOT NULL) AS n_other, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_missing, count(*) FILTER (a IS NULL) AS n_extra FROM (SELECT DISTINCT o_orderkey AS a FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_quantity > 30) ON a = b")
def key_set_parity(t: Tables) -> DataFrame:
    return J.key_parity(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.filter("l_quantity > 30").select(F.col("l_orderkey").alias("k")), ["k"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def paginate_total_order(t: Tables) -> DataFrame:
    return W.page(t.part.filter("p_size > 10").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 25).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE 'eco%'")
def ilike_search(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%RING%") | F.col("p_type").ilike("eco%")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O') AND o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def prefix_in_between(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").startswith("1") & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31 23:59:59.999999").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extension_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extension_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, r FROM (SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 3")
def extension_rank(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return t.part.select("p_partkey", F.dense_rank().over(w).cast("long").alias("r")).filter("r <= 3")
