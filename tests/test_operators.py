import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from meridia.functions import dates as D
from meridia.functions import text as T
from meridia.operators import counties as C
from meridia.operators import geo as G
from meridia.operators import joins as J
from meridia.operators import observability as O
from meridia.operators import pricing as P
from meridia.operators import quality as Q
from meridia.operators import windows as W


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", dt.date: "date", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("amount,want", [(19.99, 1998), (0.005, 0), (1000000.01, 100000001), (-1.239, -123)])
def test_cents_are_cut(spark, amount, want):
    assert one(spark, P.cents(F.col("a")), a=amount) == int(amount * 100) == want


@pytest.mark.parametrize("given,want", [([], 1.0), (["-50"], 1.5), (["-51"], 0.5), (["-50", "-51"], 0.75), (["-50", "-50"], 2.25), (["-99"], 1.0)])
def test_modifiers(spark, given, want):
    assert one(spark, P.modifier_factor(F.col("m")), m=given) == want


def test_modifiers_from_text(spark):
    assert one(spark, P.modifiers_of("m"), m=" -50, lt,,") == ["-50", "LT"]


@pytest.mark.parametrize("pos,want", [("10", "f"), ("11", "n"), ("21", "n"), ("22", "f")])
def test_place_of_service(spark, pos, want):
    assert one(spark, P.practice_expense(F.col("p"), F.lit("n"), F.lit("f")), p=pos) == want
    assert one(spark, P.practice_expense(F.lit(None).cast("string"), F.lit("n"), F.lit("f")), p=pos) == "f"


@pytest.mark.parametrize("ded,want", [(0.0, (10000, 0, 2000, 2000, 8000)), (30.0, (10000, 3000, 1400, 4400, 5600)), (500.0, (10000, 10000, 0, 10000, 0))])
def test_cost_shares(spark, ded, want):
    row = P.with_cents(spark.createDataFrame([(100.0,)], "allowed double"), "allowed", ded).first()
    assert (row["allowed_cents"], row["beneficiary_deductible_cents"], row["beneficiary_coinsurance_cents"], row["beneficiary_total_cents"], row["program_payment_cents"]) == want


def references(spark):
    d = dt.date
    f, to = d(2025, 1, 1), d(2025, 12, 31)
    make = lambda rows, schema: spark.createDataFrame([(*r, f, to) for r in rows], schema + ", effective_from date, effective_to date")
    return {
        "mpfs": make([("99213", 1.0, 1.5, 0.5, 0.1)], "code string, work_rvu double, pe_nonfacility_rvu double, pe_facility_rvu double, malpractice_rvu double"),
        "gpci": make([("01", 1.0, 1.0, 1.0)], "locality string, work double, pe double, mp double"),
        "cf": make([("MPFS", 30.0)], "source string, value double"),
        "opps": make([("0001", 100.0, "S"), ("0002", 100.0, "N")], "code string, rate double, status string"),
        "wage": make([("10000", 1.1)], "cbsa string, index double"),
        "asc": make([("A1", 80.0)], "code string, rate double"),
        "ipps": make([("470", 2.0)], "code string, weight double"),
        "ipps_base": make([(1000.0, 100.0)], "operating double, capital double"),
        "clfs": make([("80053", 10.0)], "code string, fee double"),
        "dmepos": make([("E0601", True, 60.0), ("E0601", False, 50.0)], "code string, rural boolean, fee double"),
        "asp": make([("J1745", 100.0)], "code string, per_unit double"),
    }


def test_seven_settings(spark):
    rows = [
        (1, "MPFS", "99213", "R", "11", ["-50"], 2.0), (2, "OPPS", "0001", None, None, [], 1.0), (3, "OPPS", "0002", None, None, [], 1.0), (4, "ASC", "A1", None, None, [], 1.0), (5, "IPPS", "470", None, None, [], 1.0),
        (6, "CLFS", "80053", None, None, [], 1.0), (7, "DMEPOS", "E0601", "R", None, [], 1.0), (8, "DMEPOS", "E0601", None, None, [], 1.0), (9, "DRUGS", "J1745", None, None, [], 3.0), (10, "MPFS", "none", None, None, [], 1.0), (11, "SPA", "x", None, None, [], 1.0),
    ]
    lines = spark.createDataFrame([(*r, "01", "10000", 1.0, True) for r in rows], "line_id long, setting string, code string, rural_flag string, pos string, modifiers array<string>, units double, locality string, cbsa string, utilization_weight double, professional_component boolean")
    got = {r["line_id"]: r for r in P.priced(lines, references(spark), dt.date(2025, 1, 1), dt.date(2025, 12, 31)).collect()}
    want = {1: (1.0 + 1.5 + 0.1) * 30 * 1.5 * 2, 2: 100.0 * 1.1, 3: 0.0, 4: 80.0, 5: 2.0 * (1000.0 * 1.1 + 100.0 * 1.1), 6: 10.0, 7: 60.0, 8: 50.0, 9: 100.0 * 1.06 * 3}
    assert {i: got[i]["allowed_cents"] for i in want} == {i: int(x * 100) for i, x in want.items()}
    assert got[3]["packaged"] and got[5]["beneficiary_deductible_cents"] == 160000 and got[5]["beneficiary_coinsurance_cents"] == 0
    assert got[10]["reject_reason"] and got[10]["allowed_cents"] is None and got[11]["reject_reason"] == "unknown setting"
    assert got[1]["professional_allowed_cents"] > 0 and got[1]["facility_allowed_cents"] == 0 and got[2]["facility_allowed_cents"] > 0
    assert got[1]["trace_refs"] == ["mpfs_2025_01_99213", "gpci_2025_01", "cf_2025_MPFS"] and got[7]["trace_refs"] == ["dmepos_2025_E0601_true"]


def test_window_edges(spark):
    rows = [(1, "2024-01-01", "2024-03-31"), (2, "2024-04-01", None), (3, "2024-06-01", "2024-05-01")]
    df = spark.createDataFrame(rows, "id int, f string, t string").select("id", F.to_date("f").alias("f"), F.to_date("t").alias("t"))
    ids = lambda c: sorted(r["id"] for r in df.filter(c).collect())
    d = dt.date
    assert ids(D.covers(d(2024, 3, 31), "f", "t")) == [1] and ids(D.covers(d(2024, 4, 1), "f", "t")) == [2] and ids(D.covers(d(2024, 1, 1), "f", "t")) == [1]
    assert ids(D.covers(d(2025, 1, 1), "f", "t", open_end=False)) == [] and ids(D.overlaps(d(2024, 3, 31), d(2024, 4, 1), "f", "t")) == [1, 2]
    assert ids(D.within(d(2024, 1, 1), d(2024, 12, 31), "f", "t")) == [1, 3]
    assert D.quarter_bounds(2024, 4) == (d(2024, 10, 1), d(2024, 12, 31)) and D.quarter_bounds(2024, 1) == (d(2024, 1, 1), d(2024, 3, 31))
    y, q = D.decoded_quarter("n")
    assert (one(spark, y, n=20253), one(spark, q, n=20253), one(spark, q, n=20255)) == (2025, 3, None)


def test_as_of_falls_back_unless_strict(spark):
    facts = spark.createDataFrame([(1, "a", dt.date(2024, 5, 1)), (2, "a", dt.date(2023, 1, 1)), (3, "a", dt.date(2024, 2, 1))], "id int, k string, day date")
    rec = spark.createDataFrame([("a", dt.date(2024, 1, 1), dt.date(2024, 3, 31), 7)], "k string, f date, t date, v int")
    got = lambda strict: {r["id"]: r["v"] for r in J.as_of(facts, rec, ["k"], "day", "f", "t", ["id"], strict=strict).collect()}
    assert got(False) == {1: 7, 2: None, 3: 7} and got(True) == {1: None, 2: None, 3: 7}


@pytest.mark.parametrize("n,want", [(1, 1), (19, 19), (20, 20), (21, 20), (100, 96)])
def test_percentile_index(spark, n, want):
    df = spark.range(1, n + 1).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    assert W.by_percentile_index(df, ["k"], "v", 0.95, "p").first()["p"] == want


def test_distinct_counts_null(spark):
    assert W.distinct_with_null(spark.createDataFrame([(1,), (None,), (1,)], "x int"), "x").first()["n"] == 2


def test_text_functions(spark):
    assert one(spark, T.strip("c"), c=" \t a  b \n") == "a  b"
    assert one(spark, T.zero_pad("c", 2), c="123") == "123" and one(spark, T.zero_pad("c", 5), c="7") == "00007"
    assert one(spark, T.ascii_key("c"), c=" Doña  Ana (part) ") == "DONA ANA PART"
    assert one(spark, T.county_key("c", F.lit("22")), c="Orléans Parish") == "ORLEANS"
    assert one(spark, T.split_list("c"), c="A AND B/C, D,MIAMI-DADE,, ") == ["A", "B", "C", "D", "MIAMI-DADE"]
    assert [one(spark, T.set_logic("c"), c=x) for x in ("all counties", "ALL COUNTIES EXCEPT X", "REST OF STATE", "Polk")] == ["all", "all_except", "rest", "list"]
    assert one(spark, T.currency("c"), c="$1,234.56780") == __import__("decimal").Decimal("1234.5678")
    assert [one(spark, T.canonical_number("c", 2, e), c="1.005") for e in (False, True)] == ["1.01", "1.00"]
    assert one(spark, T.canonical_number("c", 2), c="x") == ""
    assert one(spark, T.year_in("c"), c="RVU2025_Q3.zip") == 2025 and one(spark, T.quarter_in("c"), c="rvu25D.zip") == 4


def test_hashes_equal_hashlib(spark):
    df = spark.createDataFrame([("a", None, 1.005, True, dt.date(2024, 1, 2)), ("", "NULL", None, None, None)], "a string, b string, c double, d boolean, e date")
    got = [r["h"] for r in df.select(T.row_hash(df, df.columns, {"c": 2}).alias("h")).collect()]
    want = [hashlib.sha256("\x1f".join(x).encode()).hexdigest() for x in (["a", "", "1.01", "True", "2024-01-02"], ["", "NULL", "", "", ""])]
    assert got == want
    assert df.select(T.short_row_hash(df, ["a"]).alias("h")).first()["h"] == hashlib.sha256(b"a").hexdigest()[:16]


def test_range_join_over_prefixes(spark):
    p = spark.createDataFrame([("902100005",), ("902110000",), ("100000000",)], "z string")
    r = spark.createDataFrame([("902100000", "902109999", 1), ("902105000", "902119999", 2)], "lo string, hi string, v int")
    assert sorted((x["z"], x["v"]) for x in J.range_join(p, r, "z", "lo", "hi", prefix=5).collect()) == [("902100005", 1), ("902110000", 2)]


def test_nearest_ties_and_tables(spark):
    known = spark.createDataFrame([("A", "B", 5.9), ("C", "A", 5.0)], "a string, b string, miles double")
    row = lambda z, zb, lat: (1, z, "A", zb, 0.0, 0.0, lat, 0.0, None)
    lat = 5.0 / (G.EARTH_MILES * 3.141592653589793 / 180)
    pairs = spark.createDataFrame([row("z1", "B", lat), row("z2", "C", lat), row("z0", "A", 0.0)], "k int, zip string, zcta_a string, zcta_b string, lat_a double, lon_a double, lat_b double, lon_b double, population int")
    got = G.nearest_by_table(pairs, known, "k").first()
    assert (got["nearest"], got["method"], round(got["distance"], 6)) == ("z2", "table", 5.0)
    far = known.filter("a = 'A'").withColumn("miles", F.lit(6.1))
    assert G.nearest_by_table(pairs.filter("zip = 'z1'"), far, "k").first()["method"] == "great circle"


@pytest.mark.parametrize("rows,want", [([("p", 5.0, True, True), ("z", 30.0, False, True)], "p"), ([("p", 26.0, True, True), ("z", 30.0, False, True)], "z"), ([("z", 95.0, False, True)], "z"), ([("z", 95.1, False, True)], None), ([("p", 5.0, True, False), ("z", 30.0, False, True)], "z"), ([("z", 5.0, False, False), ("y", 6.0, False, True)], None)])
def test_widening_search(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, candidate string, distance double, is_pobox boolean, has_locality boolean")
    got = G.nearest_by_radius(df, "k").first()
    assert (got and got["nearest"]) == want


def test_preferred_zcta(spark):
    m = spark.createDataFrame([("1", "c", "x", 0.9), ("1", "b", "Zip matches ZCTA", None), ("2", "b", "x", None), ("2", "a", "x", 0.0)], "zip5 string, zcta5 string, relationship string, weight double")
    assert {r["zip5"]: r["zcta5"] for r in G.preferred_zcta(m).collect()} == {"1": "b", "2": "a"}


def test_cascade_strict(spark):
    z = spark.createDataFrame([(1, "10001", "0001"), (2, "10001", None), (3, "10002", None), (4, "99999", None)], "id int, zip5 string, plus4 string")
    a = spark.createDataFrame([("10001", "0001", "07", "NY")], "zip5 string, plus4 string, locality string, state string")
    b = spark.createDataFrame([("10001", "01", "NY")], "zip5 string, locality string, state string")
    n = spark.createDataFrame([("10002", "02", "NY")], "zip5 string, locality string, state string")
    got = lambda s: {r["id"]: (r["match_level"], r["locality"]) for r in G.resolved(z, a, b, n, strict=s).collect()}
    assert got(False) == {1: ("zip+4", "07"), 2: ("zip5", "01"), 3: ("nearest", "02"), 4: ("default", "01")}
    assert got(True)[3] == ("error", None) and got(True)[1] == ("zip+4", "07")


def test_rules_pass_and_fail(spark):
    rvu = spark.createDataFrame([("99213", "A", 1.0, 1.0, 1.0, 0.1, "0", "XXX", "01"), ("9921", "N", 1.0, 1.0, 0.0, 0.0, "1", "abc", ""), ("99214", None, -1.0, 0.0, 0.0, 0.0, "0", "000", None)], "hcpcs string, status_code string, work_rvu double, pe_rvu_nonfac double, pe_rvu_fac double, mp_rvu double, na_indicator string, global_days string, physician_supervision string")
    failed = {r["rule"]: r["n_failed"] for r in Q.checked(rvu, Q.rvu_rules()).collect()}
    assert failed == {"hcpcs_length": 1, "hcpcs_format": 1, "status_present": 1, "status_domain": 0, "not_payable_without_rvu": 1, "na_means_no_nonfacility": 1, "global_days_domain": 1, "supervision_domain": 0, "rvu_not_negative": 1, "rvu_range": 0}
    z = spark.createDataFrame([("902100000", "902109999", "CA", "01", "A", "v", dt.date(2024, 1, 1), None), ("90210", "902119999", "XX", "1", "Q", None, dt.date(2024, 2, 1), dt.date(2024, 1, 1))], "zip9_low string, zip9_high string, state string, locality string, rural_flag string, vintage string, effective_from date, effective_to date")
    assert {r["rule"]: r["n_failed"] for r in Q.checked(z, Q.zip9_rules()).collect()} == {"zip9_digits": 1, "zip9_order": 0, "state_domain": 1, "locality_format": 1, "rural_flag": 1, "window_order": 1, "one_prefix": 1, "completeness": 1}
    assert Q.overall(Q.checked(z, Q.zip9_rules())).first()["valid"] is False
    good, bad = Q.split(Q.tagged(rvu, Q.rvu_rules()))
    assert good.count() == 1 and bad.count() == 2 and Q.column_drift(["a", "b"], ["b", "c"]) == pytest.approx(2 / 3)
    assert Q.checked(rvu.limit(0), Q.rvu_rules()).filter("passed").count() == 10


def test_counties(spark):
    counties = spark.createDataFrame([("12", "MIAMI-DADE", "12086", "County"), ("51", "FAIRFAX", "51059", "County"), ("51", "FAIRFAX", "51600", "city"), ("51", "ALBEMARLE", "51003", "County"), ("12", "POLK", "12105", "County")], "state_fips string, county_key string, county_fips string, county_type string")
    aliases = spark.createDataFrame([("12", "DADE", "MIAMI-DADE")], "state_fips string, alias_key string, county_key string")
    rows = spark.createDataFrame([(1, "12", "01", "", "Dade"), (2, "51", "01", "", "Fairfax"), (3, "51", "02", "Fairfax City", "Fairfax"), (4, "51", "03", "", "Albemarl, Nowhere"), (5, "12", "99", "", "REST OF FLORIDA")], "row_id int, state_fips string, locality_code string, fee_area string, county_names string")
    got = {(r["row_id"], r["key"]): (r["county_fips"], r["method"], r["reject_reason"] is not None) for r in C.normalized(rows, counties, aliases).collect()}
    assert got == {(1, "DADE"): ("12086", "alias", False), (2, "FAIRFAX"): ("51059", "exact", False), (3, "FAIRFAX"): ("51600", "exact", False), (4, "ALBEMARL"): (None, None, True) if C.indel_ratios(["ALBEMARL"], ["ALBEMARLE"])[0] < 0.95 else ("51003", "fuzzy", False), (4, "NOWHERE"): (None, None, True), (5, "MIAMI-DADE"): ("12086", "exact", False), (5, "POLK"): ("12105", "exact", False)}
    assert {r["row_id"]: r["state_fips"] for r in C.inferred_states(rows.limit(4), counties).collect()} == {1: None, 2: "51", 3: "51", 4: None}


def test_scores_and_alerts(spark):
    assert one(spark, P.percent_change(F.lit(0), F.lit(5)), x=1) == float("inf") and one(spark, P.percent_change(F.lit(0), F.lit(0)), x=1) == 0
    assert one(spark, O.reproducibility(F.lit(True), F.lit(3), F.lit(2)), x=1) == 0.667 and one(spark, O.reproducibility(F.lit(True), F.lit(0), F.lit(0)), x=1) == 1.0
    assert one(spark, O.system_health(F.lit(11), F.lit(0)), x=1) == "degraded" and one(spark, O.quality_status(F.lit(0.9)), x=1) == "good"
    assert one(spark, O.mean_positive([F.lit(0.5), F.lit(0.0), F.lit(1.0)]), x=1) == 0.75


def test_digest_of_copies_equals_a_plain_one_and_gathers_no_rows(spark):
    rows = spark.range(50).unionByName(spark.range(10_000).selectExpr("7L as id")).unionByName(spark.range(3).selectExpr("cast(null as long) as id"))
    plan = O.dataset_digest(rows, [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # of the buckets' digests only
    hashes = [hashlib.sha256(str(r["id"]).encode()).hexdigest() for r in rows.collect()]
    for n in (4096, 16):
        own = {}
        for h in hashes:
            own.setdefault(int(h[:3], 16) % n, []).append(h)
        want = hashlib.sha256("\n".join(hashlib.sha256("\n".join(sorted(own[b])).encode()).hexdigest() for b in sorted(own)).encode()).hexdigest()
        assert tuple(O.dataset_digest(rows, [F.col("id")], n).first()) == (10_053, want)


@pytest.mark.parametrize("given", [[], ["clfs"], ["mpfs", "clfs", "ipps", "ipps_base"]])
def test_every_line_comes_out_whatever_tables_there_are(spark, given):
    """A setting without its table, or without one that its formula needs, is rejected and not lost."""
    lines = spark.createDataFrame([(i, s, "80053", "01", "1", None, None, 1.0, 1.0, [], True) for i, s in enumerate(["CLFS", "DRUGS", "XX", None, "MPFS", "IPPS"])], "line_id long, setting string, code string, locality string, cbsa string, rural_flag string, pos string, units double, utilization_weight double, modifiers array<string>, professional_component boolean")
    refs = {k: v for k, v in references(spark).items() if k in given}
    got = {r["line_id"]: (r["reject_reason"], r["allowed_cents"]) for r in P.priced(lines, refs, dt.date(2025, 1, 1), dt.date(2025, 12, 31)).collect()}
    none = ("no table for this setting", None)
    assert got == {0: (None, 1000) if "clfs" in given else none, 1: none, 2: ("unknown setting", None), 3: ("unknown setting", None), 4: none, 5: none}


def test_searches_by_predicate_against_all_pairs(spark):
    """Clusters of coinciding and close places, in which most of what is near does not count, and lonely ones far away."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(220):
        base = rng.choice([(40.0, -75.0), (40.3, -75.2), (41.5, -74.0), (10.0, 179.99), (10.0, -179.99)])
        spread = rng.choice([0.0, 0.005, 0.2])
        rows.append((i, rng.choice(["A", "B"]), base[0] + rng.uniform(-spread, spread), base[1] + rng.uniform(-spread, spread), rng.random() < 0.5, rng.random() < 0.6, rng.choice([None, 1, 2]), f"z{i}"))
    rows += [(900, "C", 0.0, 0.0, False, True, 1, "z900"), (901, "D", 5.0, 5.0, True, True, 1, "z901"), (902, "D", 5.0, 6.0, False, False, 1, "z902"), (903, "E", None, None, False, True, 1, "z903"), (904, "F", 1.0, 1.0, False, True, 1, "z904"), (905, "F", 1.0, 1.01, False, True, 1, "z905")]
    df = spark.createDataFrame(rows, "k int, state string, lat double, lon double, is_pobox boolean, has_locality boolean, population int, zcta string")
    known = spark.createDataFrame([(f"z{rng.randrange(220)}", f"z{rng.randrange(220)}", float(rng.choice([0, 0.5, 1, 3, 14]))) for _ in range(4000)], "a string, b string, miles double")
    left = df.select(F.col("k"), "state", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("zcta").alias("zcta_a"))
    right = df.select(F.col("k").alias("zip"), "state", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("zcta").alias("zcta_b"), "population", "is_pobox", "has_locality")
    pairs = left.join(right, "state").filter("k <> zip and lat_a is not null and lat_b is not null").withColumn("distance", G.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    table = lambda d: sorted((r["k"], r["nearest"], round(r["distance"], 6), *r[3:]) for r in d.collect())
    want = table(G.nearest_by_radius(pairs.withColumn("candidate", F.col("zip")), "k"))
    assert table(G.nearest_with_boxes(df, df, "k", "state")) == want and len(want) > 150
    want = table(G.nearest_by_table(pairs.drop("distance"), known, "k"))
    assert table(G.nearest_by_table_search(df, df, known, "k", "state")) == want and {r[3] for r in want} == {"table", "great circle"}
    far = pairs.filter("distance > 1").groupBy("k").agg(F.min(F.struct("distance", "zip")).alias("b")).select("k", F.col("b.zip").alias("nearest"), F.col("b.distance").alias("distance"))
    assert table(G.nearest_in_state(df, df, "k", "state", beyond=1.0)) == table(far)


@pytest.mark.parametrize("kind", ["date", "timestamp"])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_against_all_pairs(spark, strict, kind):
    """Windows that follow each other, nest, overlap, begin together and never end, over many buckets of time."""
    import random

    rng = random.Random(8)
    day = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=n)
    records, facts = [], []
    for i in range(600):
        k, f = rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(1500)
        records.append((k, None if rng.random() < 0.02 else day(f), rng.choice([None, day(f + rng.choice([-3, 0, 2, 30, 700]))]) if k == "c" else day(f + rng.choice([-3, 0, 2, 2, 30, 700])), rng.randrange(3), i))
    for i in range(500):
        facts.append((i, rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *map(day, range(-5, 2000, 7))])))
    rec = spark.createDataFrame(records, "k string, f date, t date, tie int, v int")
    cast = lambda df, *c: df.withColumns({x: F.col(x).cast(kind) for x in c})
    got = J.as_of(cast(spark.createDataFrame(facts, "id int, k string, day date"), "day"), cast(rec, "f", "t"), ["k"], "day", "f", "t", ["id"], "tie", "v", strict=strict)
    want = {}
    for i, k, d in facts:
        began = [(t is None or t >= d, f, tie, v) for rk, f, t, tie, v in records if k is not None and d is not None and rk == k and f is not None and f <= d]
        began = [b for b in began if b[0]] if strict else began
        want[i] = max(began)[3] if began else None
    assert {r["id"]: r["v"] for r in got.collect()} == want and len(set(want.values())) > 60


def test_as_of_of_a_hot_key_makes_no_pairs(spark):
    """One key with thousands of versions and days that each hold one day: no join sees more than a row for each."""
    n = 4000
    rec = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("f"), F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("t"), F.col("id").alias("v"))
    facts = rec.select("k", F.date_add("f", 0).alias("day"), F.col("v").alias("id"))
    out = J.as_of(facts, rec, ["k"], "day", "f", "t", ["id"])
    assert out.filter("id = v").count() == n == out.count()
    # windows that lie apart leave nothing to look up among older records
    apart = J.as_of(facts.withColumn("day", F.date_add("day", 5000)), rec, ["k"], "day", "f", "t", ["id"])
    assert apart.filter(f"v = {n - 1}").count() == n


def test_likeness_of_names_side_by_side():
    import random

    from meridia.operators.counties import indel_ratios

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                row[j], diagonal = (diagonal + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ABÉ 𝒳") for _ in range(n))
    pairs = [(word(rng.choice([0, 1, 5, 20, 63, 64, 65, 90])), word(rng.choice([0, 1, 5, 20, 64, 70]))) for _ in range(200)]
    a, b = map(list, zip(*pairs))
    assert list(indel_ratios(a, b)) == [plain(x, y) for x, y in pairs]


def test_fuzzy_names_against_all_counties_of_a_state(spark):
    """Names with up to three slips, near-twins that leave no lead, and names of several states."""
    import random

    from meridia.operators import counties as C

    rng = random.Random(11)
    letters = "ABCDEFGHIKLMNOPRSTUVWY "
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 9, 12, 20, 21, 30, 45, 70]))).strip() or "X" for _ in range(80)]
    base += [n[:-1] + "Q" for n in base[::5]] + [n + "S" for n in base[::9]]
    county = [(rng.choice(["01", "02"]), n, f"{i:03d}", rng.choice(["County", "city"])) for i, n in enumerate(base)]

    def slip(n):
        for _ in range(rng.choice([1, 1, 2, 3])):
            i = rng.randrange(len(n) + 1)
            n = rng.choice([n[:i] + rng.choice(letters) + n[i:], n[:i] + n[i + 1 :]])
        return n or "Y"

    asked = [(i, rng.choice(["01", "02"]) if rng.random() < 0.2 else s, slip(n)) for i, (s, n, _, _) in enumerate(county * 4)]
    names = spark.createDataFrame(asked, "name_id long, state_fips string, key string").withColumn("fee_area", F.lit(""))
    got = C.matched(names, spark.createDataFrame(county, "state_fips string, county_key string, county_fips string, county_type string"), spark.createDataFrame([], "state_fips string, alias_key string, county_key string"))
    got = {r["name_id"]: (r["county_fips"], r["method"]) for r in got.collect()}
    fuzzy = 0
    for i, s, k in asked:
        own = [(n, f) for t, n, f, _ in county if t == s]
        if any(n == k for n, _ in own):
            assert got[i][1] == "exact"
            continue
        close = [(n, f) for n, f in own if 2 * min(len(n), len(k)) >= 0.95 * (len(n) + len(k))]
        scored = sorted((-x, f) for (_, f), x in zip(close, C.indel_ratios([k] * len(close), [n for n, _ in close])))
        good = scored and -scored[0][0] >= 0.95 and -scored[0][0] + (scored[1][0] if len(scored) > 1 else 0) >= 0.02
        assert got[i] == ((scored[0][1], "fuzzy") if good else (None, None)), (i, s, k)
        fuzzy += bool(good)
    assert fuzzy > 40


def test_missing_pairs_against_all_pairs(spark):
    """Keys that occur in several groups, repeated rows, keys without a partner, and nulls, which equal nothing."""
    left = [(1, 0), (1, 1), (1, 1), (2, 0), (3, None), (None, 0), (4, 2)]
    right = [(10, 0), (11, 1), (11, 1), (12, None), (None, 0), (13, 0), (13, 1)]
    asked = [(a, b) for a in (1, 2, 3, 4, 5, None) for b in (10, 11, 12, 13, 14, None)] * 2
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    got = J.missing_pairs(df(asked, "ab"), df(left, "am"), df(right, "bm"), "a", "b", ["m"]).collect()
    pairs = {(a, b) for a, m in left for b, n in right if None not in (a, b, m) and m == n}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, set(asked) - pairs))


@pytest.mark.parametrize("beyond", [0.0, 1.0, 400.0])
def test_bounded_searches_against_all_pairs_of_the_globe(spark, beyond):
    """Coinciding, close, antipodal and polar places, and both sides of the date line."""
    import random

    rng = random.Random(11)
    bases = [(0.0, 0.0), (0.0, 180.0), (0.0, -180.0), (90.0, 10.0), (-90.0, -20.0), (89.999, 100.0), (45.0, 179.999), (-30.0, 60.0)]
    rows = []
    for i in range(240):
        (lat, lon), spread = rng.choice(bases), rng.choice([0.0, 1e-6, 0.01, 3.0])
        rows.append((i, rng.choice("AB"), max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), max(-180.0, min(180.0, lon + rng.uniform(-spread, spread)))))
    rows += [(900, "C", 10.0, 20.0), (901, "C", -10.0, -160.0)]
    df = spark.createDataFrame(rows, "k int, state string, lat double, lon double")
    pairs = df.join(df.select("state", F.col("k").alias("nearest"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")), "state").filter("k <> nearest")
    pairs = pairs.withColumn("distance", G.haversine(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).filter(F.col("distance") > beyond if beyond else F.lit(True))
    want = {r["k"]: (r["b"]["nearest"], r["b"]["distance"]) for r in pairs.groupBy("k").agg(F.min(F.struct("distance", "nearest")).alias("b")).collect()}
    got = {r["k"]: (r["nearest"], r["distance"]) for r in G.nearest_in_state(df, df, "k", "state", beyond=beyond).collect()}
    assert got == want and len(want) == len(rows)


@pytest.mark.parametrize("miles, beyond", [(0.02, 0.0), (1.0, 0.0), (300.0, 0.0), (300.0, 1.0), (5000.0, 400.0), (30000.0, 0.0)])
def test_searches_within_miles_against_all_pairs_of_the_globe(spark, miles, beyond):
    """Coinciding, close, lonely, antipodal and polar places, both sides of the date line, and sources that are no candidates."""
    import random

    rng = random.Random(12)
    bases = [(0.0, 0.0), (0.0, 180.0), (0.0, -180.0), (90.0, 10.0), (-90.0, -20.0), (89.999, 100.0), (45.0, 179.999), (-30.0, 60.0)]
    rows = []
    for i in range(240):
        (lat, lon), spread = rng.choice(bases), rng.choice([0.0, 1e-6, 0.01, 3.0, 40.0])
        rows.append((i, rng.choice("AB"), max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), max(-180.0, min(180.0, lon + rng.uniform(-spread, spread)))))
    rows += [(900, "C", 10.0, 20.0), (901, "C", 14.0, 20.0), (902, "D", 0.0, 0.0), (903, "B", None, None)]
    df = spark.createDataFrame(rows, "k int, state string, lat double, lon double")
    candidates = df.filter("k % 3 > 0 or k > 800")
    pairs = df.join(candidates.select("state", F.col("k").alias("nearest"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")), "state").filter("k <> nearest and lat is not null and lat_b is not null")
    pairs = pairs.withColumn("distance", G.haversine(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).filter((F.col("distance") <= miles) & ((F.col("distance") > beyond) if beyond else F.lit(True)))
    want = {r["k"]: (r["b"]["nearest"], r["b"]["distance"]) for r in pairs.groupBy("k").agg(F.min(F.struct("distance", "nearest")).alias("b")).collect()}
    got = {r["k"]: (r["nearest"], r["distance"]) for r in G.nearest_in_state(df, candidates, "k", "state", miles=miles, beyond=beyond).collect()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("lat, most", [(0, 7), (88, 30)])
def test_a_search_within_miles_looks_into_few_cells_where_a_candidate_is_close(spark, lat, most):
    """Where neighbours are a third of a mile apart, 300 miles are not searched: neither nine cells a source, nor a whole row of them at a pole."""
    n = 400
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("A").alias("state"), (lat + (F.col("id") % 20) * 0.005).alias("lat"), (F.floor(F.col("id") / 20) * 0.005).alias("lon"))
    near = G.nearest_in_state(df, df, "k", "state", miles=300.0)
    assert near.count() == n and near.filter("distance > 0.4").count() == 0
    near.collect()
    made, todo = [], [near._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "GenerateExec":
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= most * n, made
