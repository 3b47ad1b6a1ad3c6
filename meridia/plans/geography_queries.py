"""Geography on customers and suppliers: coordinates come from keys, states are nations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import counties as C
from ..operators import geo as G
from ..operators import joins as J
from .registry import Tables, query


def place(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return ((k * 7919) % 18000) / F.lit(100.0) - F.lit(90.0), ((k * 104729) % 36000) / F.lit(100.0) - F.lit(180.0)


def customers(t: Tables) -> DataFrame:
    lat, lon = place("c_custkey")
    return t.customer.select("c_custkey", "c_nationkey", lat.alias("lat"), lon.alias("lon"))


PLACES = "p AS (SELECT c_custkey, c_nationkey, ((c_custkey * 7919) % 18000) / 100.0::DOUBLE - 90.0::DOUBLE AS lat, ((c_custkey * 104729) % 36000) / 100.0::DOUBLE - 180.0::DOUBLE AS lon FROM customer)"
MILES = "7918.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2.0) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2.0))))"
NEAREST = f"d AS (SELECT a.c_custkey, b.c_custkey AS nearest, {MILES} AS distance FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey), n AS (SELECT c_custkey, nearest, distance FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, nearest) = 1)"


@query(f"WITH {PLACES}, {NEAREST} SELECT c_custkey, nearest, round(distance, 3) AS distance FROM n")
def nearest_in_state(t: Tables) -> DataFrame:
    p = customers(t)
    return G.nearest_in_state(p, p, "c_custkey", "c_nationkey").withColumn("distance", F.round("distance", 3))


@query(f"WITH {PLACES}, {NEAREST} SELECT c_custkey, nearest, round(distance, 3) AS distance FROM n WHERE distance <= 300")
def nearest_within_miles(t: Tables) -> DataFrame:
    p = customers(t)
    return G.nearest_in_state(p, p, "c_custkey", "c_nationkey", miles=300.0).withColumn("distance", F.round("distance", 3))


@query(f"WITH {PLACES}, {NEAREST} SELECT n.c_custkey, n.nearest, coalesce(m.nearest <> n.c_custkey, false) AS is_asymmetric FROM n LEFT JOIN n m ON m.c_custkey = n.nearest")
def nearest_reverse_asymmetry(t: Tables) -> DataFrame:
    p = customers(t)
    return G.asymmetric(G.nearest_in_state(p, p, "c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", "nearest", "is_asymmetric")


def near_customers(t: Tables) -> DataFrame:
    """Customers on a twentieth of the globe's width and height, so that many are within the widest radius of each other."""
    return customers(t).withColumns({"lat": F.col("lat") * 0.05, "lon": F.col("lon") * 0.05})


NEAR_PLACES = PLACES[:-1].replace("p AS (", "q AS (") + "), p AS (SELECT c_custkey, c_nationkey, lat * 0.05::DOUBLE AS lat, lon * 0.05::DOUBLE AS lon FROM q)"


@query(
    f"""WITH {NEAR_PLACES}, x AS (SELECT a.c_custkey, b.c_custkey AS candidate, {MILES} AS distance, b.c_custkey % 3 = 0 AS is_pobox, b.c_custkey % 7 <> 0 AS has_locality FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey),
r AS (SELECT unnest([25, 35, 45, 55, 65, 75, 85, 95]) AS radius),
tried AS (SELECT c_custkey, radius, candidate, distance, is_pobox, has_locality FROM x JOIN r ON distance <= radius QUALIFY row_number() OVER (PARTITION BY c_custkey, radius ORDER BY is_pobox, distance, candidate) = 1)
SELECT c_custkey, candidate AS nearest, round(distance, 3) AS distance, is_pobox FROM tried WHERE has_locality QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY radius) = 1"""
)
def nearest_radius_pobox(t: Tables) -> DataFrame:
    p = near_customers(t)
    candidates = p.withColumns({"is_pobox": F.col("c_custkey") % 3 == 0, "has_locality": F.col("c_custkey") % 7 != 0})
    return G.nearest_with_boxes(p, candidates, "c_custkey", "c_nationkey").withColumn("distance", F.round("distance", 3))


@query(
    f"""WITH {NEAR_PLACES}, k AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(miles) AS miles FROM (SELECT c_custkey AS a, c_custkey + 25 AS b, (c_custkey % 50)::DOUBLE AS miles FROM customer) GROUP BY ALL),
d AS (SELECT a.c_custkey, b.c_custkey AS zip, {MILES} AS circle, miles, b.c_custkey % 10 AS population FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey LEFT JOIN k ON lo = least(a.c_custkey, b.c_custkey) AND hi = greatest(a.c_custkey, b.c_custkey)),
e AS (SELECT *, CASE WHEN miles IS NOT NULL AND abs(miles - circle) <= 1.0 THEN miles ELSE circle END AS distance, CASE WHEN miles IS NOT NULL AND abs(miles - circle) <= 1.0 THEN 'table' ELSE 'great circle' END AS method FROM d)
SELECT c_custkey, zip AS nearest, round(distance, 3) AS distance, method, distance < 1.0 AS is_coincident, distance > 10.0 AS is_far FROM e WHERE distance > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, population, zip) = 1"""
)
def nearest_by_table_distance(t: Tables) -> DataFrame:
    p = near_customers(t).withColumns({"zcta": F.col("c_custkey"), "population": F.col("c_custkey") % 10})
    known = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 25).alias("b"), (F.col("c_custkey") % 50).cast("double").alias("miles"))
    return G.nearest_by_table_search(p, p, known, "c_custkey", "c_nationkey").withColumn("distance", F.round("distance", 3))


@query(
    """WITH pairs AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey), known AS (SELECT n_nationkey AS x, (n_nationkey + 3) % 25 AS y, n_nationkey * 10 AS miles FROM nation),
k AS (SELECT least(x, y) AS lo, greatest(x, y) AS hi, min(miles) AS miles FROM known GROUP BY ALL)
SELECT a, b, miles FROM pairs LEFT JOIN k ON lo = least(a, b) AND hi = greatest(a, b)"""
)
def symmetric_pair_lookup(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), F.col("a") != F.col("b"))
    known = t.nation.select(F.col("n_nationkey").alias("x"), ((F.col("n_nationkey") + 3) % 25).alias("y"), (F.col("n_nationkey") * 10).alias("v"))
    return J.pair_lookup(pairs, known, "a", "b", "x", "y", "v", "miles").select("a", "b", "miles")


def zip_ranges(t: Tables) -> DataFrame:
    low = 100000000 + F.col("s_suppkey") * 1000000
    return t.supplier.select("s_suppkey", low.cast("string").alias("low"), (low + (F.col("s_suppkey") % 3) * 600000 + 99).cast("string").alias("high"))


def zip_codes(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (100000000 + (F.col("c_custkey") * 98731) % 120000000).cast("string").alias("zip9"))


_RANGES = "r AS (SELECT s_suppkey, (100000000 + s_suppkey * 1000000)::VARCHAR AS low, (100000000 + s_suppkey * 1000000 + (s_suppkey % 3) * 600000 + 99)::VARCHAR AS high FROM supplier), z AS (SELECT c_custkey, (100000000 + (c_custkey * 98731) % 120000000)::VARCHAR AS zip9 FROM customer)"


@query(f"WITH {_RANGES} SELECT c_custkey, s_suppkey FROM z JOIN r ON low <= zip9 AND high >= zip9")
def range_override_join(t: Tables) -> DataFrame:
    return J.range_join(zip_codes(t), zip_ranges(t), "zip9", "low", "high", prefix=5).select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice BETWEEN s_acctbal AND s_acctbal + 150")
def numeric_range_join(t: Tables) -> DataFrame:
    ranges = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 150).alias("high"))
    return J.range_join(t.orders.select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "low", "high", width=200).select("o_orderkey", "s_suppkey")


@query(f"WITH {_RANGES}, h AS (SELECT c_custkey, min(s_suppkey) AS s FROM z JOIN r ON low <= zip9 AND high >= zip9 GROUP BY c_custkey) SELECT c_custkey, coalesce(s, c_nationkey) AS locality, s IS NOT NULL AS zip9_hit FROM customer LEFT JOIN h USING (c_custkey)")
def override_else_default(t: Tables) -> DataFrame:
    hit = J.range_join(zip_codes(t), zip_ranges(t), "zip9", "low", "high", prefix=5).groupBy("c_custkey").agg(F.min("s_suppkey").alias("s"))
    return t.customer.select("c_custkey", "c_nationkey").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("s", "c_nationkey").alias("locality"), F.col("s").isNotNull().alias("zip9_hit"))


@query(
    """WITH z AS (SELECT c_custkey, c_custkey % 100 AS zip5, c_custkey % 7 AS plus4, c_nationkey FROM customer),
a AS (SELECT s_suppkey % 100 AS zip5, s_suppkey % 7 AS plus4, min(s_nationkey) AS locality FROM supplier GROUP BY ALL), b AS (SELECT n_nationkey * 3 AS zip5, n_regionkey AS locality FROM nation), c AS (SELECT r_regionkey * 11 AS zip5, r_regionkey + 50 AS locality FROM region)
SELECT c_custkey, coalesce(a.locality::VARCHAR, b.locality::VARCHAR, c.locality::VARCHAR, '01') AS locality, CASE WHEN a.locality IS NOT NULL THEN 'zip+4' WHEN b.locality IS NOT NULL THEN 'zip5' WHEN c.locality IS NOT NULL THEN 'nearest' ELSE 'default' END AS match_level
FROM z LEFT JOIN a ON a.zip5 = z.zip5 AND a.plus4 = z.plus4 LEFT JOIN b ON b.zip5 = z.zip5 LEFT JOIN c ON c.zip5 = z.zip5"""
)
def resolution_cascade(t: Tables) -> DataFrame:
    zips = t.customer.select("c_custkey", (F.col("c_custkey") % 100).alias("zip5"), (F.col("c_custkey") % 7).alias("plus4"))
    a = t.supplier.groupBy((F.col("s_suppkey") % 100).alias("zip5"), (F.col("s_suppkey") % 7).alias("plus4")).agg(F.min("s_nationkey").cast("string").alias("locality")).withColumn("state", F.lit("A"))
    b = t.nation.select((F.col("n_nationkey") * 3).alias("zip5"), F.col("n_regionkey").cast("string").alias("locality"), F.lit("B").alias("state"))
    c = t.region.select((F.col("r_regionkey") * 11).alias("zip5"), (F.col("r_regionkey") + 50).cast("string").alias("locality"), F.lit("C").alias("state"))
    return G.resolved(zips, a, b, c).select("c_custkey", "locality", "match_level")


@query("SELECT c_custkey, coalesce(s_acctbal, n_regionkey::DOUBLE) AS v, CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' WHEN n_nationkey IS NOT NULL THEN 'nation' END AS source FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey % 50")
def coalesce_fallback_lookup(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", (F.col("c_custkey") % 50).alias("m"))
    first = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("v"))
    second = base.join(t.nation.select(F.col("n_nationkey").cast("long").alias("m"), F.col("n_regionkey").cast("double").alias("v")), "m").select("c_custkey", "v")
    return J.first_found(base, [(first, "supplier"), (second, "nation")], "c_custkey", ["v"]).select("c_custkey", "v", "source")


def county_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows that list nations of a region by name or by a set phrase, and the nations as counties."""
    names = t.nation.select(F.col("n_regionkey").cast("string").alias("state_fips"), F.upper("n_name").alias("county_key"), F.col("n_nationkey").cast("string").alias("county_fips"), F.lit("County").alias("county_type"))
    few = names.groupBy("state_fips").agg(F.array_sort(F.collect_list("county_key")).alias("all"))
    pick = lambda i: F.get("all", F.lit(i))
    phrase = F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("All  Counties").alias("county_names")), F.struct(F.lit(2).alias("n"), F.concat(F.lit("ALL COUNTIES EXCEPT "), pick(0), F.lit(" and "), pick(1)).alias("county_names")), F.struct(F.lit(3).alias("n"), F.concat(pick(2), F.lit("/"), pick(3)).alias("county_names")), F.struct(F.lit(4).alias("n"), F.lit("REST OF STATE").alias("county_names"))))
    rows = few.select("state_fips", phrase.alias("p")).select((F.col("state_fips").cast("int") * 10 + F.col("p.n")).alias("row_id"), "state_fips", F.col("p.n").cast("string").alias("locality_code"), F.lit("").alias("fee_area"), "p.county_names")
    return rows, names


@query(
    """WITH n AS (SELECT n_regionkey AS s, upper(n_name) AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY upper(n_name)) AS i FROM nation)
SELECT s * 10 + 1 AS row_id, 'all' AS logic, k AS key FROM n UNION ALL SELECT s * 10 + 2, 'all_except', k FROM n WHERE i > 2 UNION ALL SELECT s * 10 + 3, 'list', k FROM n WHERE i IN (3, 4) UNION ALL SELECT s * 10 + 4, 'rest', k FROM n WHERE i NOT IN (3, 4)"""
)
def set_logic_expand(t: Tables) -> DataFrame:
    return C.expanded(*county_lists(t)).select("row_id", "logic", "key")


@query(
    """WITH n AS (SELECT n_regionkey AS s, n_nationkey AS f, upper(n_name) AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY upper(n_name)) AS i FROM nation)
SELECT s * 10 + 3 AS row_id, k AS key, f::VARCHAR AS county_fips, 'exact' AS method FROM n WHERE i IN (3, 4)
UNION ALL SELECT s * 10 + 5, 'OLD ' || k, f::VARCHAR, 'alias' FROM n WHERE i = 1
UNION ALL SELECT s * 10 + 5, 'COUNTY OF THE OTHER ' || k || 'X', f::VARCHAR, 'fuzzy' FROM n WHERE i = 2
UNION ALL SELECT DISTINCT s * 10 + 5, 'NOWHERE', NULL, NULL FROM n"""
)
def county_exact_match(t: Tables) -> DataFrame:
    """All legs: names as they stand, old names by alias, misspelt long names by likeness, and names of no county."""
    rows, names = county_lists(t)
    first = names.groupBy("state_fips").agg(F.array_sort(F.collect_list("county_key")).alias("all")).select("state_fips", F.get("all", F.lit(0)).alias("a"), F.get("all", F.lit(1)).alias("b"))
    long_name = lambda c: F.concat(F.lit("COUNTY OF THE OTHER "), c)
    known = names.join(first, "state_fips").withColumn("county_key", F.when(F.col("county_key") == F.col("b"), long_name(F.col("b"))).otherwise(F.col("county_key"))).drop("a", "b")
    asked = first.select((F.col("state_fips").cast("int") * 10 + 5).alias("row_id"), "state_fips", F.lit("5").alias("locality_code"), F.lit("").alias("fee_area"), F.concat(F.lit("Old "), F.col("a"), F.lit(", "), long_name(F.col("b")), F.lit("X / Nowhere")).alias("county_names"))
    aliases = first.select("state_fips", F.concat(F.lit("OLD "), F.col("a")).alias("alias_key"), F.col("a").alias("county_key"))
    got = C.normalized(rows.filter("locality_code = '3'").unionByName(asked), known, aliases)
    return got.select("row_id", "key", "county_fips", "method")


@query("SELECT n_regionkey * 10 + 3 AS row_id, n_regionkey::VARCHAR AS state_fips FROM nation GROUP BY n_regionkey")
def state_inference(t: Tables) -> DataFrame:
    rows, names = county_lists(t)
    return C.inferred_states(rows.filter("locality_code = '3'"), names)
