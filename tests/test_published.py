"""Staged publication, the commit log and the chains that end in it."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from meridia.operators import ingest, quality, releases
from meridia.sources import commits, published, sinks

AT = dt.datetime(2025, 1, 5)


def pprrvu(spark, *rows):
    return spark.createDataFrame(list(rows), ["HCPCS", "MODIFIER", "STATUS", "GLOBAL_DAYS", "WORK_RVU", "PE_NONFAC_RVU", "PE_FAC_RVU", "MALP_RVU", "NA_INDICATOR", "OPPS_CAP"])


def gpci(spark, *rows):
    return spark.createDataFrame(list(rows), ["LOCALITY", "STATE", "WORK_GPCI", "PE_GPCI", "MALP_GPCI"])


GOOD = ("99213", "", "A", "000", "1.3", "0.9", "0.5", "0.1", "", "Y")
AREA = ("5", "06", "1.05", "1.2", "0.6")


def run(spark, spec, tables, folder, batch, release="r1", references=None, at=AT, **options):
    return ingest.run_release(spark, spec, tables, references or {}, str(folder), release_id=release, batch_id=batch, at=at, clock=lambda: at + dt.timedelta(seconds=9), **options)


def test_a_rerun_replaces_the_release_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "CA"), (2, "NY")], "k int, state string")
    for rows in (df, df.filter("state = 'CA'")):
        sinks.publish_snapshot(rows, f"{tmp_path}", ["state"], vintage=AT.date(), release="r1", published_at=AT)
    sinks.publish_snapshot(df.filter("state = 'NY'"), f"{tmp_path}", ["state"], vintage=AT.date(), release="r2", published_at=AT)
    assert sorted((r["k"], r["state"], r["release_id"]) for r in sinks.snapshot(spark, f"{tmp_path}").collect()) == [(1, "CA", "r1"), (2, "NY", "r2")]
    assert published.published(spark, f"{tmp_path}", "snapshot", release="r1", commit=0).count() == 2
    assert published.cleaned(spark, f"{tmp_path}") == []
    assert published.withdrawn(spark, f"{tmp_path}", "r2") == 3 and sinks.snapshot(spark, f"{tmp_path}").count() == 1
    for n in range(12):
        commits.commit(spark, f"{tmp_path}", lambda held: held)
    assert len(commits.numbers(spark, f"{tmp_path}")) == 10 and len(published.cleaned(spark, f"{tmp_path}")) == 2
    assert sinks.snapshot(spark, f"{tmp_path}").count() == 1
    with pytest.raises(ValueError):
        commits.state(spark, f"{tmp_path}", 0)


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_other_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.publish_snapshot(df, f"{tmp_path}", [], vintage=AT.date(), release="r", published_at=AT, kind=kind)
    assert sorted((r["k"], r["v"]) for r in sinks.snapshot(spark, f"{tmp_path}").collect()) == [(1, "a"), (2, None)] or kind == "csv"
    assert sinks.snapshot(spark, f"{tmp_path}").filter("published_at = timestamp'2025-01-05' and vintage_date = date'2025-01-05'").count() == 2


def test_two_writers_of_one_number(spark, tmp_path):
    """Each of many writers at once adds its own name; none is lost."""
    errors = []

    def write(i):
        try:
            commits.commit(spark, f"{tmp_path}", lambda held: {**held, f"w{i}": i}, keep=50, tries=200)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, held = commits.state(spark, f"{tmp_path}")
    assert not errors and number == 7 and len(held) == 8
    assert commits.commit(spark, f"{tmp_path}", lambda held: None) == 7


def test_rejects_are_quarantined_and_good_rows_published(spark, tmp_path):
    spec = ingest.rvu_spec(release_id="r1", batch_id="b1", year=2025, quarter=1)
    files = {"pprrvu": pprrvu(spark, GOOD, ("bad", *GOOD[1:]), ("99214", "", "Q", *GOOD[3:])), "gpci": gpci(spark, AREA)}
    with pytest.raises(ingest.ReleaseBlocked):
        run(spark, spec, files, tmp_path, "b1")
    assert commits.numbers(spark, str(tmp_path)) == [] and not any((tmp_path / "data").iterdir())
    done = run(spark, spec, files, tmp_path, "b2", strict=False)
    assert not done["valid"] and {r["rule"]: r["n_failed"] for r in done["rules"]}["hcpcs_format"] == 1
    assert [r["hcpcs"] for r in published.published(spark, str(tmp_path), "pprrvu").collect()] == ["99213"]
    q = published.quarantined(spark, str(tmp_path), "pprrvu", release="r1")
    assert sorted((r["reason"], r["severity"]) for r in q.collect()) == [("hcpcs_format", "critical"), ("status_domain", "critical")]
    back = sinks.recovered(q, "hcpcs string, rvu_work double", "hcpcs_format").first()
    assert (back["hcpcs"], back["rvu_work"]) == ("BAD", 1.3)
    m = {r["dataset"]: (r["n_rows"], r["n_rejected"], r["commit"]) for r in published.manifest(spark, str(tmp_path)).collect()}
    assert m == {"pprrvu": (1, 2, 0), "gpci": (1, 0, 0)}
    again = run(spark, spec, files | {"pprrvu": pprrvu(spark, GOOD)}, tmp_path, "b3")
    assert again["valid"] and again["commit"] == 1 and published.quarantined(spark, str(tmp_path)).count() == 0
    digests = [published.manifest(spark, str(tmp_path), n).filter("dataset = 'gpci'").first()["digest"] for n in (0, 1)]
    assert digests[0] == digests[1]
    state = {r["batch_id"]: (r["status"], r["message"]) for r in releases.run_state(spark.read.parquet(f"{tmp_path}/_runs")).collect()}
    assert state["b1"] == ("failed", "pprrvu.hcpcs_format, pprrvu.status_domain") and state["b2"][0] == state["b3"][0] == "success"


def test_a_release_that_fails_half_way_leaves_the_old_one(spark, tmp_path):
    spec = ingest.rvu_spec(release_id="r1", batch_id="b", year=2025, quarter=1)
    run(spark, spec, {"pprrvu": pprrvu(spark, GOOD), "gpci": gpci(spark, AREA)}, tmp_path, "b1")
    broken = {"pprrvu": pprrvu(spark, ("99999", *GOOD[1:])), "gpci": gpci(spark, AREA).withColumn("MALP_GPCI", F.raise_error(F.lit("the file is cut off")).cast("string"))}
    with pytest.raises(Exception, match="cut off"):
        run(spark, spec, broken, tmp_path, "b2")
    assert [r["hcpcs"] for r in published.published(spark, str(tmp_path), "pprrvu").collect()] == ["99213"]
    assert len(list((tmp_path / "data").iterdir())) == 1 and published.cleaned(spark, str(tmp_path)) == []
    state = {r["batch_id"]: r["status"] for r in releases.run_state(spark.read.parquet(f"{tmp_path}/_runs")).collect()}
    assert state == {"b1": "success", "b2": "failed"}


def test_run_state_of_equal_times(spark):
    log = spark.createDataFrame([("b", "r", "d", s, AT, 5 if s == "started" else None, None, None, m) for s, m in (("failed", "why"), ("started", None))], releases.RUN_DDL)
    row = releases.run_state(log).first()
    assert (row["status"], row["message"], row["rows_in"], row["started_at"]) == ("failed", "why", 5, AT)


def test_opps_chain(spark, tmp_path):
    tables = {
        "addendum_a": spark.createDataFrame([("0001", 100.0), ("0002", -1.0)], "apc string, rate double"),
        "addendum_b": spark.createDataFrame([("99213", "", "0001", "S"), ("99", "", "0001", "S"), ("99214", "", "0001", "1")], "hcpcs string, modifier string, apc string, status_indicator string"),
        "wage": spark.createDataFrame([("31080", 1.25), ("00000", 9.0)], "cbsa string, index double"),
        "indicators": spark.createDataFrame([("S", "Procedure")], "status_indicator string, si_description string"),
    }
    spec = ingest.SPECS["opps"](batch_id="opps_2025q2_r01")
    quiet = run(spark, spec, tables, tmp_path, "b", mode="inline", strict=False)
    assert sorted((r["apc"], r["wage_adjusted"]) for r in quiet["tables"]["opps_rates_enriched"].collect()) == [("0001", 125.0)] and not (tmp_path / "data").exists()
    run(spark, spec, tables, tmp_path, "b", release="opps_2025q2_r01", strict=False)
    assert [(r["apc"], r["cbsa"], r["wage_adjusted"]) for r in ingest.latest_view(spark, spec.publish["opps_rates_enriched"], str(tmp_path), dt.date(2025, 5, 1)).collect()] == [("0001", "31080", 125.0)]
    assert [r["si_description"] for r in published.published(spark, str(tmp_path), "opps_hcpcs_crosswalk").collect()] == ["Procedure"]
    reasons = sorted((r["dataset"], r["reason"]) for r in published.quarantined(spark, str(tmp_path)).collect())
    assert reasons == [("opps_apc_payment", "payment_rate_band"), ("opps_hcpcs_crosswalk", "hcpcs_format"), ("opps_hcpcs_crosswalk", "status_indicator_domain"), ("opps_rates_enriched", "payment_rate_band"), ("opps_rates_enriched", "payment_rate_band"), ("opps_rates_enriched", "wage_index_band")]


def test_mpfs_chain(spark, tmp_path):
    cf = spark.createDataFrame([("physician", "2025", dt.date(2025, 1, 1), 32.3), ("physician", "2025", dt.date(2025, 3, 1), 33.0), ("anesthesia", "2025", dt.date(2025, 1, 1), -1.0)], "cf_type string, vintage string, effective_from date, cf_value double").withColumnRenamed("vintage", "vintage_date")
    tables = {"pprrvu": pprrvu(spark, GOOD), "gpci": gpci(spark, AREA), "locco": spark.createDataFrame([("5", "06", "037", "LOS ANGELES")], ["LOCALITY", "STATE", "COUNTY", "LOCALITY_NAME"]), "cf": cf}
    spec = ingest.SPECS["mpfs"](release_id="r1", batch_id="b", year=2025, quarter=1)
    done = run(spark, spec, tables, tmp_path, "b", strict=False)
    assert set(done["paths"]) == set(ingest.MPFS_KEYS)
    rows = {n: published.published(spark, str(tmp_path), n).count() for n in ingest.MPFS_KEYS}
    assert rows == {"mpfs_rvu": 1, "mpfs_indicators_all": 3, "mpfs_locality": 1, "mpfs_gpci": 1, "mpfs_cf_vintage": 1, "mpfs_link_keys": 1}
    assert published.published(spark, str(tmp_path), "mpfs_cf_vintage").first()["cf_value"] == 33.0
    assert [r["reason"] for r in published.quarantined(spark, str(tmp_path)).collect()] == ["factor_range"]
    quiet = run(spark, spec, tables, tmp_path, "b", mode="inline", strict=False)
    assert quiet["tables"]["mpfs_link_keys"].count() == 1 and not quiet["valid"]


def test_zip_chains(spark, tmp_path):
    fixed = lambda state, low, flag=" ": f"{state}{low[:5]}00000" + "18" + flag + " " * 5 + "1" + low[5:]
    lines = spark.createDataFrame([("f", "", i, x) for i, x in enumerate((fixed("CA", "902101234"), fixed("XX", "902101235"), fixed("NY", "100011111", "R")))], "path string, member string, line_no long, line string")
    spec = ingest.SPECS["zip9"](effective_from=dt.date(2025, 1, 1), vintage="2025")
    run(spark, spec, {"lines": lines}, tmp_path / "z9", "b", strict=False)
    assert sorted((r["zip9_low"], r["state"]) for r in published.published(spark, f"{tmp_path}/z9", "zip9_overrides").collect()) == [("100011111", "NY"), ("902101234", "CA")]
    assert [r["reason"] for r in published.quarantined(spark, f"{tmp_path}/z9").collect()] == ["state_domain"]
    raw = spark.createDataFrame([("501", " ca", "5"), (None, "CA", "1")], ["ZIP CODE", "STATE", "LOCALITY"])
    spec = ingest.SPECS["zip_locality"](effective_from=dt.date(2025, 1, 1), vintage="2025")
    run(spark, spec, {"rows": raw}, tmp_path / "z5", "b", strict=False)
    assert [(r["zip5"], r["state"], r["locality"]) for r in published.published(spark, f"{tmp_path}/z5", "cms_zip_locality").collect()] == [("00501", "CA", "05")]
    assert quality.failing(published.published(spark, f"{tmp_path}/z5", "cms_zip_locality"), ingest.zip_locality_rules()[0]).count() == 0


def test_enrichment_reads_good_rows_alone(spark, tmp_path):
    from meridia.operators.enrichment import EnrichmentRule

    rule = EnrichmentRule("area", "areas", {"locality_code": "locality_code"}, ("area",), {"area": "none"}, "exact")
    spec = ingest.rvu_spec(release_id="r1", batch_id="b", year=2025, quarter=1, enrich={"gpci": [rule]})
    areas = spark.createDataFrame([("05", "south")], "locality_code string, area string")
    done = run(spark, spec, {"gpci": gpci(spark, AREA, ("6", "06", "9.9", "1", "1"))}, tmp_path, "b", references={"areas": areas}, strict=False)
    assert [(r["locality_code"], r["area"], r["release_id"]) for r in published.published(spark, str(tmp_path), "gpci").collect()] == [("05", "south", "r1")]
    assert done["enrichment"]["gpci"].first()["n_rows"] == 1 and published.manifest(spark, str(tmp_path)).first()["n_rejected"] == 1
