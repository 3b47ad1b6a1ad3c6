"""Edges of enrichment rules, ingest chains, releases, alerts and readers; the usual cases are in the queries' SQL."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meridia.operators import alerts, enrichment, geo, ingest, pricing, quality, releases, rvu, windows
from meridia.sources import layouts, readers, sinks
from meridia.streaming import traces


def test_strategies_and_absent_references(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    ref = spark.createDataFrame([("1", "one")], "k string, v string")
    rule = lambda s, **more: enrichment.EnrichmentRule("r", "ref", {"k": "k"}, ("v",), {"v": "none"}, s, **more)
    got = lambda r, refs=None: sorted((x["k"] or "", x["v"] or "") for x in enrichment.apply_rule(df, refs if refs is not None else {"ref": ref}, r).collect())
    assert got(rule("exact")) == [("", ""), ("1", "one"), ("2", "")]
    assert got(rule("fallback", threshold=0.9)) == [("", "none"), ("1", "one"), ("2", "none")]
    assert got(rule("fallback", threshold=0.1)) == got(rule("exact"))
    assert got(rule("default")) == [("", "none"), ("1", "none"), ("2", "none")]
    assert got(rule("exact"), {}) == [("", ""), ("1", ""), ("2", "")]
    with pytest.raises(ValueError):
        enrichment.apply_rule(df, {}, rule("other"))
    own = {"nearest": lambda a, b, r: a.withColumns({"v": F.lit("near"), "_found_r": F.lit(True)})}
    assert {x["v"] for x in enrichment.apply_rule(df, {"ref": ref}, rule("nearest"), own).collect()} == {"near"}
    rows = enrichment.apply_rule(df, {"ref": ref}, rule("exact"))
    r = enrichment.rule_results(rows, [rule("exact", completeness_gate=0.9)]).first()
    assert (r["n_rows"], r["n_enriched"]) == (3, 1) and abs(r["quality_score"] - 0.8 / 3) < 1e-9
    registry = spark.createDataFrame([("s", 1, dt.date(2024, 1, 1), None), ("s", 2, dt.date(2025, 1, 1), None), ("s", 3, dt.date(2026, 1, 1), None)], "source string, version int, effective_from date, effective_to date")
    assert [x["version"] for x in enrichment.registered(registry, dt.date(2025, 6, 1)).collect()] == [2]


def test_a_release_is_validated_and_published(spark, tmp_path):
    at = dt.datetime(2025, 1, 5)
    files = {
        "pprrvu": spark.createDataFrame([("99213", "", "A", "000", "1.3", "0.9", "0.5", "0.1", "", "Y")], ["HCPCS", "MODIFIER", "STATUS", "GLOBAL_DAYS", "WORK_RVU", "PE_NONFAC_RVU", "PE_FAC_RVU", "MALP_RVU", "NA_INDICATOR", "OPPS_CAP"]),
        "gpci": spark.createDataFrame([("5", "06", "1.05", "1.2", "0.6")], ["LOCALITY", "STATE", "WORK_GPCI", "PE_GPCI", "MALP_GPCI"]),
    }
    spec = ingest.rvu_spec(release_id="rvu25a", batch_id="b1", year=2025, quarter=1)
    done = ingest.run_release(spark, spec, files, {}, f"{tmp_path}/c", release_id="rvu25a", batch_id="b1", at=at)
    assert done["valid"] and set(done["paths"]) == {"pprrvu", "gpci"}
    row = ingest.latest_view(spark, spec.publish["pprrvu"], f"{tmp_path}/c", dt.date(2025, 2, 1)).first()
    assert (row["hcpcs"], row["rvu_work"], row["opps_cap_applicable"], row["effective_from"], row["release_id"]) == ("99213", 1.3, True, dt.date(2025, 1, 1), "rvu25a")
    assert sorted(r["status"] for r in spark.read.parquet(f"{tmp_path}/c/_runs").collect()) == ["started", "success"]
    bad = files | {"gpci": files["gpci"].withColumn("WORK_GPCI", F.lit("9.9"))}
    with pytest.raises(ingest.ReleaseBlocked):
        ingest.run_release(spark, spec, bad, {}, f"{tmp_path}/d", release_id="rvu25a", batch_id="b2", at=at)
    assert {r["status"] for r in spark.read.parquet(f"{tmp_path}/d/_runs").collect()} == {"started", "failed"}
    quiet = ingest.run_release(spark, spec, bad, {}, f"{tmp_path}/e", release_id="rvu25a", batch_id="b3", at=at, mode="inline", strict=False)
    assert not quiet["valid"] and quiet["paths"] == {} and not (tmp_path / "e").exists()
    with pytest.raises(ValueError):
        ingest.run_release(spark, spec, files, {}, "x", release_id="r", batch_id="b", at=at, mode="other")


def test_addenda_fee_schedule_views_and_overrides(spark):
    a = spark.createDataFrame([("0001", 100.0)], "apc string, rate double")
    b = spark.createDataFrame([("99213", "", "0001", "S")], "hcpcs string, modifier string, apc string, status_indicator string")
    wage = spark.createDataFrame([("31080", 1.25), ("00000", 1.0)], "cbsa string, index double")
    t = ingest.opps_tables(a, b, wage, spark.createDataFrame([("S", "Procedure")], "status_indicator string, si_description string"), "opps_2025q2_r01")
    assert sorted(r["wage_adjusted"] for r in t["opps_rates_enriched"].collect()) == [100.0, 125.0]
    row = t["opps_hcpcs_crosswalk"].first()
    assert (row["si_description"], row["effective_from"], row["effective_to"], row["quarter"]) == ("Procedure", dt.date(2025, 4, 1), dt.date(2025, 6, 30), 2)
    items = spark.createDataFrame([("99213", None, "A", 1.0, 1.0, 0.1, "000", "1", dt.date(2025, 1, 1))], "hcpcs string, modifier string, status_code string, rvu_work double, rvu_pe_nonfac double, rvu_malp double, global_days string, na_indicator string, effective_from date")
    cf = spark.createDataFrame([("physician", "2025", dt.date(2025, 1, 1), 32.3), ("physician", "2025", dt.date(2025, 3, 1), 33.0)], "cf_type string, vintage_date string, effective_from date, cf_value double")
    views = ingest.mpfs_views({"pprrvu": items, "gpci": a, "locco": a, "cf": cf})
    assert len(views) == 6 and [r["cf_value"] for r in views["mpfs_cf_vintage"].collect()] == [33.0]
    assert sorted((r["indicator"], r["value"]) for r in views["mpfs_indicators_all"].collect()) == [("global_days", "000"), ("na_indicator", "1")]
    raw = spark.createDataFrame([("501", " ca", "5"), ("90210", "CA", "18"), (None, "CA", "1"), ("1234567", "NY", "1")], ["ZIP CODE", "STATE", "LOCALITY"])
    got = ingest.zip_locality_table(raw, effective_from=dt.date(2025, 1, 1), effective_to=None, vintage="2025").collect()
    assert sorted((r["zip5"] or "", r["state"], r["locality"], r["reject_rule"]) for r in got) == [("", "CA", "01", "zip5_format"), ("00501", "CA", "05", None), ("1234567", "NY", "01", "zip5_format"), ("90210", "CA", "18", None)]
    with pytest.raises(ValueError):
        ingest.adapted(raw.drop("STATE"), "zip5")
    refs = ingest.reference_tables(spark.createDataFrame([("22", "LA", "Louisiana")], "state_fips string, state_abbr string, state_name string"), spark.createDataFrame([("22", "001", "Acadia Parish", "Parish")], "state_fips string, county_fips string, county_name string, county_type string"), spark.createDataFrame([(None, "St. John", "Saint John"), ("22", "Old", "New")], "state_fips string, alias string, name string"))
    assert refs["counties"].first()["county_key"] == "ACADIA" and sorted(r["county_key"] for r in refs["aliases"].collect()) == ["NEW", "SAINT JOHN"]


def test_snapshots_and_runs(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    log = spark.createDataFrame([("a", "geo", "d1", t(1), ["x"], "created"), ("a", "geo", "d1", t(2), ["x", "pinned"], "pinned"), ("b", "geo", "d2", t(3), ["x"], "created"), ("c", "geo", "d3", t(4), [], "created"), ("c", "geo", "d3", t(5), [], "deleted")], releases.SNAPSHOT_DDL)
    state = releases.snapshots(log)
    assert sorted(r["name"] for r in state.collect()) == ["a", "b"]
    assert [r["name"] for r in releases.expired(state, t(20)).collect()] == ["b"]
    assert [r["name"] for r in releases.snapshots(log, "geo", ["pinned"]).collect()] == ["a"] and releases.snapshot_on(state, t(2)).first()["name"] == "a"
    pins, now = (spark.createDataFrame(x, "zip5 string, locality string") for x in ([("1", "a"), ("2", "b")], [("1", "a"), ("2", "c")]))
    digest = lambda d: spark.createDataFrame([(d,)], "digest string")
    assert releases.verified(state, "a", digest("d1"), pins, now, "zip5", "locality").first()["reproducibility_score"] == 0.5
    assert releases.verified(state, "a", digest("d9"), pins, now, "zip5", "locality").first()["reproducibility_score"] == 0.0
    none = spark.createDataFrame([], "release_id string, overall_status string, total_errors long, started_at timestamp")
    found = alerts.triggered(none, spark.createDataFrame([], "release_id string, severity string"), t(9))
    assert [r["rule"] for r in found.collect()] == ["no_recent_ingestion"]
    history = lambda at, done: spark.createDataFrame([("system_error", at, done)], "alert_type string, created_at timestamp, resolved boolean")
    assert alerts.raised(found, history(dt.datetime(2025, 1, 8, 23), False), t(9)).count() == 0
    assert alerts.raised(found, history(dt.datetime(2025, 1, 8, 23), True), t(9)).count() == 1 and alerts.raised(found, history(t(8), False), t(9)).count() == 1
    plan = spark.createDataFrame([("p", "a"), ("q", "b")], "plan_id string, code string")
    update = spark.createDataFrame([("p", "c"), ("q", None)], "plan_id string, code string")
    assert [tuple(r) for r in releases.replaced(plan, update).collect()] == [("p", "c")]
    assert releases.geography_stats(spark.createDataFrame([], "zip5 string, state string, effective_from date, effective_to date")).first()["n_rows"] == 0


def test_each_domain_rule_passes_and_fails(spark):
    good = ("99213", "A", 1.0, 1.0, 1.0, 0.1, "0", "PPP", "6A")
    df = spark.createDataFrame([good, ("99213", "A", 1.0, 1.0, 1.0, 0.1, "0", "999", "08")], "hcpcs string, status_code string, work_rvu double, pe_rvu_nonfac double, pe_rvu_fac double, mp_rvu double, na_indicator string, global_days string, physician_supervision string")
    failed = {r["rule"]: r["n_failed"] for r in quality.checked(df, quality.rvu_rules()).collect()}
    assert {k for k, v in failed.items() if v} == {"global_days_domain", "supervision_domain"}
    z = spark.createDataFrame([("902100001", "902100009", "CA", "18", f, dt.date(2025, 1, 1), None, "v") for f in ("A", "B", None, "R")], "zip9_low string, zip9_high string, state string, locality string, rural_flag string, effective_from date, effective_to date, vintage string")
    assert {r["rule"]: r["n_failed"] for r in quality.checked(z, quality.zip9_rules()).collect()}["rural_flag"] == 1
    assert quality.metadata_gaps({"a": 1, "b": ""}, ["a", "b", "c"]) == ["b", "c"] and quality.layout_gaps(["a"], ["a", "b", "release_id"]) == ["b"]
    assert quality.row_count_rule(0, 1)["severity"] == "block" and quality.row_count_rule(5, 1)["passed"]
    assert quality.failing(df, quality.contract_rules({"r": "work_rvu < 0.5"})[0]).count() == 2
    empty = quality.zip_locality_results(spark.createDataFrame([], "zip5 string, state string, locality string, effective_from string, vintage string"), dt.date(2025, 1, 1)).collect()
    assert len(empty) == 10 and all(r["passed"] for r in empty)
    wrong = {r["rule"]: r["passed"] for r in quality.zip_locality_results(spark.createDataFrame([(1, "CA")], "zip5 int, state string"), dt.date(2025, 1, 1)).collect()}
    assert not wrong["required_fields"] and not wrong["data_types"] and not wrong["locality_format"]


def test_delimited_files_of_many_columns_and_without_header(spark):
    wide = ",".join(f"c{i}" for i in range(90))
    lines = spark.createDataFrame([("f", "", 0, wide), ("f", "", 1, ",".join(map(str, range(90)))), ("g", "", 0, "no header here"), ("h", "", 0, "c0,c89"), ("h", "", 1, '"a ""b"", c",2')], "path string, member string, line_no long, line string")
    c = layouts.Contract("t", (layouts.Field("c0"), layouts.Field("c89", kind="double"), layouts.Field("more")), ("c0",))
    got = readers.delimited(lines, c, header_words=("c0", "c89"), defaults={"more": "x"}, no_header="reject").collect()
    assert sorted((r["path"], r["c0"], r["c89"], r["more"], r["reject_reason"] is not None) for r in got if r["path"] != "g") == [("f", "0", 89.0, "x", False), ("h", 'a "b", c', 2.0, "x", False)]
    assert [(r["c0"], r["reject_reason"] is not None) for r in got if r["path"] == "g"] == [(None, True)]
    assert [r["path"] for r in readers.headerless(lines, ("c0", "c89")).collect()] == ["g"]


def test_neighbours_across_the_date_line_and_at_poles(spark):
    points = [("a", 10.0, 179.9), ("b", 10.0, -179.9), ("c", 89.9, 0.0), ("d", 89.9, 180.0), ("e", -90.0, 5.0), ("f", -89.9, -120.0), ("g", 10.0, 179.9), ("h", 50.0, 5.0)]
    df = spark.createDataFrame([(*p, "s") for p in points] + [("x", 0.0, 0.0, "alone")], "k string, lat double, lon double, s string")
    miles = lambda p, q: one_distance(p, q)
    for radius in (None, 100.0, 5000.0):
        want = {}
        for p in points:
            near = min(((miles(p, q), q[0]) for q in points if q[0] != p[0]), key=lambda x: (round(x[0], 9), x[1]))
            if radius is None or near[0] <= radius:
                want[p[0]] = near[1]
        assert {r["k"]: r["nearest"] for r in geo.nearest_in_state(df, df, "k", "s", miles=radius).collect()} == want


def one_distance(p, q):
    from math import asin, cos, radians, sin, sqrt

    a = sin((radians(q[1]) - radians(p[1])) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin((radians(q[2]) - radians(p[2])) / 2) ** 2
    return 2 * geo.EARTH_MILES * asin(sqrt(min(1.0, a)))


def test_percentiles_of_large_keys_use_the_bracket(spark, monkeypatch):
    monkeypatch.setattr(windows, "BRACKET_ABOVE", 1000)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 40_007).otherwise(5).cast("double").alias("v"))
    rows = df.toPandas()
    for share in (0.0, 0.3, 0.95, 1.0):
        got = {r["k"]: r["p"] for r in windows.by_percentile_index(df, ["k"], "v", share, "p").collect()}
        for k, own in rows.groupby(rows.k.fillna("")):
            v = sorted(own.v)
            assert got[k or None] == v[min(int(len(v) * share), len(v) - 1)]


def test_negotiated_rates_by_precedence(spark):
    lines = spark.createDataFrame([(1, "f", "c", "p", "q"), (2, "f", "c", "p", "z"), (3, "f", "c", "y", "z"), (4, "f", "x", "p", "q")], "line_id int, ccn string, code string, payer string, plan string")
    day = dt.date(2025, 1, 1)
    rates = spark.createDataFrame([("f", None, None, "c", 1.0, day, None), ("f", "p", None, "c", 2.0, day, None), ("f", "p", "q", "c", 3.0, day, None), ("f", "p", "q", "c", 9.0, dt.date(2020, 1, 1), dt.date(2020, 2, 1))], "ccn string, payer string, plan string, code string, rate double, effective_from date, effective_to date")
    got = {r["line_id"]: (r["facility_rate"], r["facility_rate_by"]) for r in pricing.facility_rates(lines, rates, day, day).collect()}
    assert got == {1: (3.0, "plan"), 2: (2.0, "payer"), 3: (1.0, "facility"), 4: (None, None)}


def test_casts_and_windows(spark):
    df = spark.createDataFrame([(" 99213 ", "", "a", "1.005", "10", "x")], "hcpcs string, modifier string, status_code string, rvu_work string, global_days string, k string")
    r = rvu.rvu_casts(df, dt.date(2025, 1, 1)).first()
    assert (r["hcpcs"], r["modifier"], r["status_code"], r["rvu_work"], r["global_days"]) == ("99213", None, "A", 1.01, 10)
    assert rvu.rvu_casts(df.withColumn("global_days", F.lit("XXX")), dt.date(2025, 1, 1)).first()["global_days"] == 0
    assert rvu.year_windows(spark, 2025).count() == 7
    assert [str(x["d"]) for x in spark.createDataFrame([("2025D",), ("2025",), ("x",)], "v string").select(rvu.vintage_date("v").alias("d")).collect()] == ["2025-10-01", "2025-01-01", "None"]
    m = rvu.remapped(df, {"k": "key"}, transforms={"key": F.upper}, types={"rvu_work": "double"}, required={"more": 7}).first()
    assert (m["key"], m["rvu_work"], m["more"]) == ("X", 1.005, 7)


def test_merging_begins_after_what_is_there(spark, tmp_path):
    schema = "k long, ts long, v string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    put("one", [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")])
    merge = lambda name: traces.merged_latest(traces.event_stream(spark, f"{tmp_path}/{name}", schema), ["k"], "ts", f"{tmp_path}/t", f"{tmp_path}/check-{name}", buckets=4)
    merge("one")
    put("two", [(1, 2, "new"), (2, 0, "old"), (4, 1, "d")])
    merge("two")  # an empty checkpoint over a table that is there
    assert sorted(tuple(r) for r in traces.latest_table(spark, f"{tmp_path}/t").collect()) == [(1, 2, "new"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d")]


def test_builds_quarantine_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files = sinks.publish_build({"t": df}, str(tmp_path), "b1").collect()
    assert files and all(len(r["sha256"]) == 64 and r["table"] == "t" for r in files) and spark.read.parquet(f"{tmp_path}/build_id=b1/t").count() == 2
    assert releases.newest_build(spark, [f"{tmp_path}/build_id=b0/t", f"{tmp_path}/build_id=b1/t"]).count() == 2
    at = dt.datetime(2025, 1, 1)
    for i, when in enumerate((at, dt.datetime(2025, 2, 1))):
        sinks.quarantine(df.withColumns({"reject_rule": F.lit("bad"), "reject_severity": F.lit("error")}), f"{tmp_path}/q", release=f"r{i}", dataset="d", at=when)
    assert sorted((r["release_id"], r["n"]) for r in sinks.quarantine_stats(spark.read.parquet(f"{tmp_path}/q")).collect()) == [("r0", 2), ("r1", 2)]
    kept = sinks.quarantine_cleanup(spark, f"{tmp_path}/q", dt.datetime(2025, 1, 15), 1)
    assert {r["release_id"] for r in spark.read.parquet(kept).collect()} == {"r1"}
    now = dt.datetime.now()
    assert sinks.cached(df, f"{tmp_path}/cache", "d1", now, 60).count() == 2
    assert sinks.cached(df.limit(1), f"{tmp_path}/cache", "d1", now, 60).count() == 2
    assert sinks.cached(df.limit(1), f"{tmp_path}/cache", "d1", now + dt.timedelta(hours=1), 60).count() == 1
    assert json.loads(sinks.contract_json(df, "t", ["k"]))["natural_keys"] == ["k"]


def test_addenda_and_routes(spark):
    lines = spark.createDataFrame([("b.csv", "", 0, "Addendum B"), ("b.csv", "", 1, "HCPCS Code,SI,APC,Payment Rate"), ("b.csv", "", 2, '99213,S,0001,"1,234.50"')], "path string, member string, line_no long, line string")
    row = readers.addendum(lines, "b").first()
    assert (row["hcpcs"], row["status_indicator"], row["apc"], row["modifier"]) == ("99213", "S", "0001", None)
    assert readers.addendum(lines.limit(0), "a").count() == 0 and "relative_weight" in readers.addendum(lines, "a").columns
    r = readers.routing_coverage(spark.createDataFrame([("GPCI25.txt",), ("pprrvu.csv",), ("x.md",), ("gpci.csv",)], "n string"), "n").first()
    assert (r["n_files"], r["n_routed"], r["share"], r["by_dataset"]) == (4, 3, 0.75, {"gpci": 2, "pprrvu": 1})
    assert layouts.precisions(layouts.GPCI)["gpci_work"] == 3


def test_single_prices_and_health(spark):
    day = dt.date(2025, 1, 1)
    clfs = spark.createDataFrame([("80053", 10.0, day, None)], "code string, fee double, effective_from date, effective_to date")
    got = pricing.price_single(spark, {"clfs": clfs}, day, day, code="80053", setting="CLFS", locality="01", cbsa="x", modifiers=["-50"]).first()
    assert got["allowed_cents"] == 1500
    with pytest.raises(ValueError):
        pricing.price_single(spark, {"clfs": clfs}, day, day, code="80053", setting="X", locality="01", cbsa="x")
    geography = spark.createDataFrame([("90210", "CA", day, None)], "zip5 string, state string, effective_from date, effective_to date")
    state = spark.createDataFrame([("s1", "geography", "d", dt.datetime(2025, 1, 2), [], "created")], releases.SNAPSHOT_DDL)
    assert releases.geography_health(geography, state, dt.date(2025, 2, 1)).first()["status"] == "healthy"
    assert releases.geography_health(geography, state, dt.date(2024, 12, 1)).first()["status"] == "degraded"
    assert releases.geography_health(geography.limit(0), state, day).first()["status"] == "critical"
