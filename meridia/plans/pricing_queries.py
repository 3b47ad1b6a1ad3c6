"""Pricing on order lines: the part is the code, its retail price the fee, the customer's nation the locality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pricing as P
from .registry import Tables, query

FACTOR = 1.25


def claim_lines(t: Tables) -> DataFrame:
    """l_orderkey, l_linenumber, code, nation, units, status, price, modifiers and setting of each line."""
    o = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    priced = lines.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    modifiers = F.when(F.col("l_linenumber") == 1, F.array(F.lit("-50"))).when(F.col("l_linenumber") == 2, F.array(F.lit("-51"))).when(F.col("l_linenumber") == 3, F.array(F.lit("-50"), F.lit("-51"))).otherwise(F.array().cast("array<string>"))
    setting = F.get(F.array(*map(F.lit, P.SETTINGS)), (F.col("l_partkey") % 7).cast("int"))
    return priced.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("code"), F.col("c_nationkey").alias("nation"), F.col("l_quantity").alias("units"), F.col("l_returnflag").alias("status"), F.col("p_retailprice").alias("price"), modifiers.alias("modifiers"), setting.alias("setting"))


LINES = """
lines AS (SELECT l_orderkey, l_linenumber, l_partkey AS code, c_nationkey AS nation, l_quantity AS units, l_returnflag AS status, p_retailprice AS price,
  CASE l_linenumber WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS factor, l_partkey % 7 AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def index(base: float, step: float) -> F.Column:
    return P.dbl(base) + F.col("nation") * P.dbl(step)


def component_amount() -> F.Column:
    p = F.col("price")
    return P.component_amount(p * P.dbl(0.5), p * P.dbl(0.4), p * P.dbl(0.1), index(0.8, 0.02), index(0.9, 0.01), index(1.1, -0.005), P.dbl(FACTOR))


AMOUNT = "(((price * 0.5::DOUBLE) * (0.8::DOUBLE + nation * 0.02::DOUBLE)) + ((price * 0.4::DOUBLE) * (0.9::DOUBLE + nation * 0.01::DOUBLE)) + ((price * 0.1::DOUBLE) * (1.1::DOUBLE + nation * -0.005::DOUBLE))) * 1.25::DOUBLE"
CENTS = ("allowed_cents", "beneficiary_total_cents", "program_payment_cents")


def component_prices(t: Tables) -> DataFrame:
    lines = claim_lines(t).withColumn("allowed", component_amount() * P.modifier_factor(F.col("modifiers")) * F.col("units"))
    return P.with_cents(lines, "allowed", 25.0)


PRICED = f"""
WITH {LINES},
amounts AS (SELECT *, {AMOUNT} * factor * units AS allowed FROM lines),
shared AS (SELECT *, least(25.0::DOUBLE, allowed) AS ded, (allowed - least(25.0::DOUBLE, allowed)) * 0.2::DOUBLE AS coins FROM amounts),
priced AS (SELECT *, trunc(allowed * 100)::BIGINT AS allowed_cents, trunc(ded * 100)::BIGINT AS beneficiary_deductible_cents, trunc(coins * 100)::BIGINT AS beneficiary_coinsurance_cents,
  trunc((ded + coins) * 100)::BIGINT AS beneficiary_total_cents, trunc((allowed - (ded + coins)) * 100)::BIGINT AS program_payment_cents FROM shared)"""


@query(f"{PRICED} SELECT l_orderkey, l_linenumber, allowed_cents, beneficiary_total_cents, program_payment_cents FROM priced")
def price_lines_component(t: Tables) -> DataFrame:
    return component_prices(t).select("l_orderkey", "l_linenumber", *CENTS)


@query(f"{PRICED} SELECT nation, count(*) AS n_lines, {', '.join(f'sum({c})::BIGINT AS {c}' for c in P.TOTALS)} FROM priced GROUP BY nation")
def plan_totals(t: Tables) -> DataFrame:
    return P.plan_totals(component_prices(t), ["nation"])


_BY_KIND = """CASE kind WHEN 0 THEN price * 1.25::DOUBLE WHEN 1 THEN price * (0.8::DOUBLE + nation * 0.02::DOUBLE) WHEN 2 THEN price * 0.9::DOUBLE
  WHEN 3 THEN (price / 100) * (500.0::DOUBLE * (0.8::DOUBLE + nation * 0.02::DOUBLE) + 50.0::DOUBLE * (0.8::DOUBLE + nation * 0.02::DOUBLE)) WHEN 4 THEN price * 0.5::DOUBLE
  WHEN 5 THEN CASE WHEN nation % 2 = 0 THEN price * 1.2::DOUBLE ELSE price END ELSE price * 1.06::DOUBLE END"""


@query(
    f"""WITH {LINES}, a AS (SELECT *, CASE WHEN kind = 1 AND status = 'N' THEN 0.0::DOUBLE ELSE ({_BY_KIND}) * factor * units END AS allowed FROM lines),
s AS (SELECT *, CASE WHEN kind = 3 THEN least(1600.0::DOUBLE, allowed) ELSE least(0.0::DOUBLE, allowed) END AS ded, CASE WHEN kind = 3 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS rate FROM a)
SELECT ['MPFS', 'OPPS', 'ASC', 'IPPS', 'CLFS', 'DMEPOS', 'DRUGS'][kind + 1] AS setting, count(*) AS n_lines, sum(trunc(allowed * 100)::BIGINT)::BIGINT AS allowed_cents,
  sum(trunc((ded + (allowed - ded) * rate) * 100)::BIGINT)::BIGINT AS beneficiary_total_cents FROM s GROUP BY kind"""
)
def price_lines_by_setting(t: Tables) -> DataFrame:
    wage, p = index(0.8, 0.02), F.col("price")
    by = {
        "MPFS": p * P.dbl(1.25), "OPPS": p * wage, "ASC": p * P.dbl(0.9), "IPPS": (p / 100) * (P.dbl(500) * wage + P.dbl(50) * wage), "CLFS": p * P.dbl(0.5),
        "DMEPOS": F.when(F.col("nation") % 2 == 0, p * P.dbl(1.2)).otherwise(p), "DRUGS": p * P.dbl(P.SALES_PRICE_FACTOR),
    }
    amount = F.coalesce(*[F.when(F.col("setting") == s, a) for s, a in by.items()])
    lines = claim_lines(t)
    allowed = F.when((F.col("setting") == "OPPS") & P.is_packaged(F.col("status")), P.dbl(0)).otherwise(amount * P.modifier_factor(F.col("modifiers")) * F.col("units"))
    inpatient = F.col("setting") == "IPPS"
    priced = P.with_cents(lines.withColumn("allowed", allowed), "allowed", F.when(inpatient, P.dbl(P.INPATIENT_DEDUCTIBLE)).otherwise(P.dbl(0)), F.when(inpatient, P.dbl(0)).otherwise(P.dbl(P.COINSURANCE)))
    return priced.groupBy("setting").agg(F.count("*").alias("n_lines"), F.sum("allowed_cents").alias("allowed_cents"), F.sum("beneficiary_total_cents").alias("beneficiary_total_cents"))


@query(
    f"""{PRICED}, per AS (SELECT code, nation, sum(allowed_cents)::BIGINT AS cents FROM priced WHERE nation IN (3, 7) GROUP BY ALL),
a AS (SELECT code, cents FROM per WHERE nation = 3), b AS (SELECT code, cents FROM per WHERE nation = 7)
SELECT code, a.cents AS cents_a, b.cents AS cents_b, a.cents IS NOT NULL AND b.cents IS NOT NULL AS both_present, coalesce(b.cents, 0) - coalesce(a.cents, 0) AS cents_delta,
  round(CASE WHEN coalesce(a.cents, 0) = 0 AND coalesce(b.cents, 0) = 0 THEN 0.0::DOUBLE WHEN coalesce(a.cents, 0) = 0 THEN 'inf'::DOUBLE ELSE (coalesce(b.cents, 0) - coalesce(a.cents, 0)) * 100.0::DOUBLE / coalesce(a.cents, 0) END, 6) AS cents_percent
FROM a FULL JOIN b USING (code)"""
)
def compare_two_localities(t: Tables) -> DataFrame:
    side = F.when(F.col("nation") == 3, "a").when(F.col("nation") == 7, "b")
    out = P.compared_sides(component_prices(t).withColumnRenamed("allowed_cents", "cents"), ["code"], side, ["cents"])
    return out.withColumn("cents_percent", F.round("cents_percent", 6))


def fee_versions(t: Tables) -> DataFrame:
    """code, v, effective_from, effective_to: parts have a version of the year, of an earlier year (every fifth), and a newer one (every third)."""
    import datetime as dt

    p = t.part.select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price"))
    old = F.col("code") % 5 == 0
    first = p.select("code", F.col("price").alias("v"), F.when(old, dt.date(1996, 1, 1)).otherwise(dt.date(1997, 1, 1)).alias("effective_from"), F.when(old, dt.date(1996, 12, 31)).otherwise(dt.date(1997, 12, 31)).alias("effective_to"))
    newer = p.filter("code % 3 = 0").select("code", (F.col("price") * P.dbl(1.1)).alias("v"), F.lit(dt.date(1997, 4, 1)).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return first.unionByName(newer)


def reference_tables(t: Tables) -> dict[str, DataFrame]:
    """The reference tables of all seven settings, built from parts and nations."""
    import datetime as dt

    f, v = fee_versions(t), F.col("v")
    n = t.nation.select(F.col("n_nationkey").alias("nation"), F.lit(dt.date(1997, 1, 1)).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    dates = ["effective_from", "effective_to"]
    one = n.filter("nation = 0").drop("nation")
    return {
        "mpfs": f.select("code", (v * P.dbl(0.5)).alias("work_rvu"), (v * P.dbl(0.4)).alias("pe_nonfacility_rvu"), (v * P.dbl(0.3)).alias("pe_facility_rvu"), (v * P.dbl(0.1)).alias("malpractice_rvu"), *dates),
        "gpci": n.select(F.col("nation").alias("locality"), index(0.8, 0.02).alias("work"), index(0.9, 0.01).alias("pe"), index(1.1, -0.005).alias("mp"), *dates),
        "cf": one.select(F.lit("MPFS").alias("source"), P.dbl(FACTOR).alias("value"), *dates),
        "opps": f.select("code", v.alias("rate"), F.when(F.col("code") % 4 == 0, "N").otherwise("S").alias("status"), *dates),
        "wage": n.select(F.col("nation").alias("cbsa"), index(0.8, 0.02).alias("index"), *dates),
        "asc": f.select("code", (v * P.dbl(0.9)).alias("rate"), *dates),
        "ipps": f.select("code", (v / P.dbl(100)).alias("weight"), *dates),
        "ipps_base": one.select(P.dbl(500).alias("operating"), P.dbl(50).alias("capital"), *dates),
        "clfs": f.select("code", (v * P.dbl(0.5)).alias("fee"), *dates),
        "dmepos": f.select("code", F.explode(F.array(F.lit(True), F.lit(False))).alias("rural"), v, *dates).select("code", "rural", F.when(F.col("rural"), v * P.dbl(1.2)).otherwise(v).alias("fee"), *dates),
        "asp": f.select("code", v.alias("per_unit"), *dates),
    }


def engine_lines(t: Tables) -> DataFrame:
    """Lines with all that the engine asks for."""
    return claim_lines(t).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "setting", "code", F.col("nation").alias("locality"), F.col("nation").alias("cbsa"), F.when(F.col("nation") % 2 == 0, "R").otherwise("U").alias("rural_flag"),
        F.when(F.col("l_linenumber") % 2 == 1, "11").otherwise("22").alias("pos"), "units", P.dbl(1).alias("utilization_weight"), "modifiers", F.lit(True).alias("professional_component"),
    )


_FEE = "CASE WHEN code % 3 = 0 THEN price * 1.1::DOUBLE WHEN code % 5 = 0 THEN NULL ELSE price END"
_WAGE = "(0.8::DOUBLE + nation * 0.02::DOUBLE)"
_SEVEN = f"""CASE kind
  WHEN 0 THEN (((v * 0.5::DOUBLE) * (0.8::DOUBLE + nation * 0.02::DOUBLE)) + ((v * CASE WHEN l_linenumber % 2 = 1 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END) * (0.9::DOUBLE + nation * 0.01::DOUBLE)) + ((v * 0.1::DOUBLE) * (1.1::DOUBLE + nation * -0.005::DOUBLE))) * 1.25::DOUBLE
  WHEN 1 THEN v * {_WAGE} WHEN 2 THEN v * 0.9::DOUBLE WHEN 3 THEN (v / 100.0::DOUBLE) * (500.0::DOUBLE * {_WAGE} + 50.0::DOUBLE * {_WAGE}) WHEN 4 THEN v * 0.5::DOUBLE
  WHEN 5 THEN CASE WHEN nation % 2 = 0 THEN v * 1.2::DOUBLE ELSE v END ELSE v * 1.06::DOUBLE END"""


@query(
    f"""WITH {LINES}, f AS (SELECT *, {_FEE} AS v FROM lines), a AS (SELECT *, CASE WHEN kind = 1 AND v IS NOT NULL AND code % 4 = 0 THEN 0.0::DOUBLE ELSE ({_SEVEN}) * factor * units END AS allowed FROM f),
s AS (SELECT *, least(CASE WHEN kind = 3 THEN 1600.0::DOUBLE ELSE 0.0::DOUBLE END, allowed) AS ded, CASE WHEN kind = 3 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS rate FROM a WHERE allowed IS NOT NULL),
c AS (SELECT *, trunc(allowed * 100)::BIGINT AS cents, trunc((ded + (allowed - ded) * rate) * 100)::BIGINT AS own, trunc((allowed - (ded + (allowed - ded) * rate)) * 100)::BIGINT AS paid FROM s),
g AS (SELECT kind, sum(cents)::BIGINT AS allowed_cents, sum(own)::BIGINT AS beneficiary_total_cents, sum(paid)::BIGINT AS program_payment_cents, sum(CASE WHEN kind IN (0, 4, 5, 6) THEN cents ELSE 0 END)::BIGINT AS professional_allowed_cents FROM c GROUP BY kind)
SELECT ['MPFS', 'OPPS', 'ASC', 'IPPS', 'CLFS', 'DMEPOS', 'DRUGS'][kind + 1] AS setting, n_lines, n_rejected, n_packaged, allowed_cents, beneficiary_total_cents, program_payment_cents, professional_allowed_cents
FROM (SELECT kind, count(*) AS n_lines, count(*) FILTER (v IS NULL) AS n_rejected, count(*) FILTER (kind = 1 AND v IS NOT NULL AND code % 4 = 0) AS n_packaged FROM f GROUP BY kind) JOIN g USING (kind)"""
)
def price_lines_with_fees(t: Tables) -> DataFrame:
    """Every line priced by the engine, from effective-dated tables of all seven settings in the second quarter of 1997."""
    import datetime as dt

    lines = engine_lines(t)
    priced = P.priced(lines, reference_tables(t), dt.date(1997, 4, 1), dt.date(1997, 6, 30))
    sums = ("allowed_cents", "beneficiary_total_cents", "program_payment_cents", "professional_allowed_cents")
    return priced.groupBy("setting").agg(F.count("*").alias("n_lines"), F.count("reject_reason").alias("n_rejected"), F.count_if("packaged").alias("n_packaged"), *[F.sum(c).alias(c) for c in sums])


@query(
    f"""WITH {LINES}, f AS (SELECT *, {_FEE} AS v, CASE WHEN kind = 4 AND code % 2 = 0 THEN 'OTHER' WHEN kind = 6 AND code % 2 = 0 THEN NULL ELSE ['MPFS', 'OPPS', 'ASC', 'IPPS', 'CLFS', 'DMEPOS', 'DRUGS'][kind + 1] END AS setting FROM lines),
r AS (SELECT setting, CASE WHEN setting IS NULL OR setting = 'OTHER' THEN 'unknown setting' WHEN setting IN ('MPFS', 'IPPS', 'CLFS') THEN 'no table for this setting' WHEN v IS NULL THEN 'no fee for this code and period' END AS reject_reason, CASE WHEN setting = 'ASC' THEN trunc(v * 0.9::DOUBLE * factor * units * 100)::BIGINT END AS asc_cents FROM f)
SELECT setting, reject_reason, count(*) AS n_lines, sum(asc_cents)::BIGINT AS asc_cents FROM r GROUP BY ALL"""
)
def price_lines_absent_tables(t: Tables) -> DataFrame:
    """Every line comes out where tables are absent (no gpci, base rates or laboratory fees), and where its setting is unknown or null."""
    import datetime as dt

    refs = {k: v for k, v in reference_tables(t).items() if k not in ("gpci", "ipps_base", "clfs")}
    odd = F.when((F.col("setting") == "CLFS") & (F.col("code") % 2 == 0), "OTHER").when((F.col("setting") == "DRUGS") & (F.col("code") % 2 == 0), None).otherwise(F.col("setting"))
    out = P.priced(engine_lines(t).withColumn("setting", odd), refs, dt.date(1997, 4, 1), dt.date(1997, 6, 30))
    return out.groupBy("setting", "reject_reason").agg(F.count("*").alias("n_lines"), F.sum(F.when(F.col("setting") == "ASC", F.col("allowed_cents"))).alias("asc_cents"))


@query(
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.1::DOUBLE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS v FROM part WHERE p_partkey = 7),
a AS (SELECT v * (0.8::DOUBLE + 3 * 0.02::DOUBLE) * 1.5::DOUBLE * 2 AS allowed FROM p)
SELECT 'OPPS' AS setting, 7::BIGINT AS code, trunc(allowed * 100)::BIGINT AS allowed_cents, trunc(allowed * 0.2::DOUBLE * 100)::BIGINT AS beneficiary_total_cents, NULL::VARCHAR AS reject_reason FROM a"""
)
def price_single_code(t: Tables) -> DataFrame:
    """One code by itself, from the same tables as all lines."""
    import datetime as dt

    out = P.price_single(t.spark, reference_tables(t), dt.date(1997, 4, 1), dt.date(1997, 6, 30), code=7, setting="OPPS", locality=3, cbsa=3, units=2.0, modifiers=["-50"])
    return out.select("setting", F.col("code").cast("long").alias("code"), "allowed_cents", "beneficiary_total_cents", "reject_reason")


@query(
    """WITH lines AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 10 + 1 ELSE l_suppkey END AS ccn, l_partkey AS code, l_returnflag AS payer, l_linestatus AS plan FROM lineitem),
rates AS (SELECT p_partkey % 10 + 1 AS ccn, p_partkey AS code, NULL AS payer, NULL AS plan, p_retailprice AS rate, 2 AS level FROM part UNION ALL SELECT p_partkey % 10 + 1, p_partkey, 'A', NULL, p_retailprice * 0.5::DOUBLE, 1 FROM part
  UNION ALL SELECT p_partkey % 10 + 1, p_partkey, 'N', 'F', p_retailprice * 0.25::DOUBLE, 0 FROM part),
asked AS (SELECT DISTINCT ccn, code, payer, plan FROM lines),
met AS (SELECT a.*, rate, level FROM asked a JOIN rates r USING (ccn, code) WHERE (r.payer IS NULL OR r.payer = a.payer) AND (r.plan IS NULL OR r.plan = a.plan) QUALIFY row_number() OVER (PARTITION BY a.ccn, a.code, a.payer, a.plan ORDER BY level) = 1)
SELECT line_id, rate AS facility_rate, ['plan', 'payer', 'facility'][level + 1] AS facility_rate_by FROM lines LEFT JOIN met USING (ccn, code, payer, plan)"""
)
def facility_rate_lines(t: Tables) -> DataFrame:
    """Lines with the negotiated rate of their facility: of their plan, else of their payer, else of the facility."""
    import datetime as dt

    place = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 10 + 1).otherwise(F.col("l_suppkey"))
    lines = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), place.alias("ccn"), F.col("l_partkey").alias("code"), F.col("l_returnflag").alias("payer"), F.col("l_linestatus").alias("plan"))
    level = lambda payer, plan, share: F.struct(F.lit(payer).cast("string").alias("payer"), F.lit(plan).cast("string").alias("plan"), (F.col("p_retailprice") * P.dbl(share)).alias("rate"))
    rates = t.part.select((F.col("p_partkey") % 10 + 1).alias("ccn"), F.col("p_partkey").alias("code"), F.inline(F.array(level(None, None, 1), level("A", None, 0.5), level("N", "F", 0.25))))
    rates = rates.withColumns({"effective_from": F.lit(dt.date(1997, 1, 1)), "effective_to": F.lit(None).cast("date")})
    return P.facility_rates(lines, rates, dt.date(1997, 4, 1), dt.date(1997, 6, 30)).select("line_id", "facility_rate", "facility_rate_by")


@query(
    f"""WITH {LINES}, n AS (SELECT p_partkey AS code, p_size * 1.5::DOUBLE AS unit_price FROM part WHERE p_size > 10)
SELECT l_orderkey, l_linenumber, round(unit_price * (1 + code % 3) * units, 6) AS nadac_reference FROM lines LEFT JOIN n USING (code)"""
)
def drug_reference_prices(t: Tables) -> DataFrame:
    """The reference price of each line's drug from the newest of its unit prices, in the units of its code."""
    import datetime as dt

    p = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("ndc11"), F.col("p_size"))
    nadac = p.select("ndc11", (F.col("p_size") * P.dbl(1.5)).alias("unit_price"), F.lit(dt.date(2024, 2, 1)).alias("as_of")).unionByName(p.select("ndc11", F.lit(-1.0).alias("unit_price"), F.lit(dt.date(2024, 1, 1)).alias("as_of")))
    conversion = t.part.select(F.col("p_partkey").alias("ndc11"), F.col("p_partkey").alias("code"), (1 + F.col("p_partkey") % 3).alias("units_per_hcpcs"))
    lines = claim_lines(t).withColumn("ndc11", F.col("code")).withColumn("utilization_weight", P.dbl(1))
    return P.drug_reference_price(lines, nadac, conversion).select("l_orderkey", "l_linenumber", F.round("nadac_reference", 6).alias("nadac_reference"))


@query(f"WITH {LINES} SELECT status, count(*) AS n_lines, count(*) FILTER (status = 'N') AS n_packaged, sum(CASE WHEN status = 'N' THEN 0 ELSE trunc(price * units * 100)::BIGINT END)::BIGINT AS allowed_cents FROM lines GROUP BY status")
def packaged_lines(t: Tables) -> DataFrame:
    packaged = P.is_packaged(F.col("status"))
    lines = claim_lines(t).withColumn("c", F.when(packaged, 0).otherwise(P.cents(F.col("price") * F.col("units"))))
    return lines.groupBy("status").agg(F.count("*").alias("n_lines"), F.count_if(packaged).alias("n_packaged"), F.sum("c").alias("allowed_cents"))


@query(f"WITH {LINES} SELECT l_linenumber, factor, count(*) AS n_lines FROM lines GROUP BY ALL")
def modifier_fold(t: Tables) -> DataFrame:
    return claim_lines(t).groupBy("l_linenumber", P.modifier_factor(F.col("modifiers")).alias("factor")).agg(F.count("*").alias("n_lines"))


@query(
    """SELECT o_orderkey, l_partkey, floor(o_totalprice)::BIGINT AS base, greatest(0.0::DOUBLE, coalesce(TRY_CAST(l_tax AS DOUBLE), 1.0::DOUBLE)) AS units FROM orders JOIN lineitem ON l_orderkey = o_orderkey """
)
def component_defaults(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice").join(t.lineitem.select("l_orderkey", "l_partkey", "l_tax"), F.col("o_orderkey") == F.col("l_orderkey"))
    raw = rows.select("*", F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("code"), F.lit("mpfs ").alias("setting"), F.col("l_tax").cast("string").alias("units"), F.lit(None).alias("utilization_weight"), F.lit("yes").alias("professional_component"), F.lit(None).alias("facility_component"), F.lit(None).alias("sequence"), F.lit(0).alias("at"))
    c = P.components(raw, "at").filter("setting = 'MPFS' and professional_component and facility_component and sequence = 1 and utilization_weight = 1")
    return c.select("o_orderkey", F.col("code").cast("long").alias("l_partkey"), F.floor("o_totalprice").cast("long").alias("base"), "units")
