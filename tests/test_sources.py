import datetime as dt
import zipfile

from pyspark.sql import functions as F

from meridia.operators import parsers
from meridia.sources import layouts, readers, sinks
from meridia.streaming import traces


def placed(contract, **values):
    line = [" "] * max(contract.min_length, max(f.end for f in contract.fields))
    for f in contract.fields:
        if f.name in values:
            text = values[f.name][: f.end - f.start]
            line[f.start : f.start + len(text)] = text
    return "".join(line)[: max(contract.min_length, 200)]


def lines_of(spark, texts):
    return spark.createDataFrame([("f", "", i, t) for i, t in enumerate(texts)], "path string, member string, line_no long, line string")


def test_relative_values_are_parsed(spark):
    row = lambda h, m="", s="A", w="1.30": placed(layouts.RVU, hcpcs=h, modifier=m, status_code=s, rvu_work=w, rvu_malp="0.10", global_days="XXX")
    parsed = parsers.parse_rvu(lines_of(spark, ["HDR" + " " * 200, row("99213"), row("99214", "26"), row("99214", "26"), row("bad", s=" "), "short"]), dt.date(2025, 1, 1))
    got = parsed.valid.collect()
    assert [(r["hcpcs"], r["modifier"], r["rvu_work"], r["global_days"]) for r in got] == [("99213", None, 1.3, "XXX")]
    assert sorted(r["reject_rule"] for r in parsed.rejects.collect()) == ["hcpcs_length", "natural_key", "natural_key"]
    assert parsed.metrics.first()["n_rejects"] == 3 and len(got[0]["row_content_hash"]) == 64


def test_geographic_indices_are_parsed(spark):
    row = lambda loc, w="1.000": placed(layouts.GPCI, mac="01112", state="CA", locality_code=loc, locality_name="NAME", gpci_work=w, gpci_pe="1.100", gpci_mp="0.500")
    parsed = parsers.parse_gpci(lines_of(spark, ["Title", row("05"), row("6"), row("00"), row("00"), row("07", "3.000")]), dt.date(2025, 1, 1))
    assert sorted(r["locality_code"] for r in parsed.valid.collect()) == ["05", "06"]
    assert sorted(r["reject_rule"] for r in parsed.rejects.collect()) == ["gpci_hard_band", "natural_key", "natural_key"]


def test_conversion_factors(spark):
    rows = spark.createDataFrame([("Physician ", 32.3465, "d", None, None), ("anesthesia", 250.0, "d", None, None), ("physician", 30.0, "d", dt.date(2025, 7, 1), None), ("x", 1.0, "d", None, None)], "cf_type string, cf_value double, cf_description string, effective_from date, effective_to date")
    parsed = parsers.parse_conversion_factors(rows, 2025, {"physician": 32.3465})
    assert [r["cf_type"] for r in parsed.valid.collect()] == ["physician"]
    assert sorted(r["reject_rule"] for r in parsed.rejects.collect()) == ["cf_known_value", "cf_type_domain", "cf_value_range"]


def test_states_are_carried_down(spark):
    row = lambda **v: placed(layouts.LOCALITY, **v).ljust(160)
    texts = [row(state_name="STATE"), row(mac="10112", locality_code="00", state_name="ALABAMA", county_names="ALL COUNTIES"), "", row(mac="01182", locality_code="18", state_name="CALIFORNIA", county_names="LA"), row(mac="01182", locality_code="5", county_names="SF")]
    got = [(r["state_name"], r["locality_code"]) for r in parsers.parse_localities(lines_of(spark, texts), ["California", "Alabama"]).orderBy("line_no").collect()]
    assert got == [("ALABAMA", "00"), ("CALIFORNIA", "18"), ("CALIFORNIA", "05")]


def test_files_archives_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Title\nLocality Code,GPCI  Work\n05,1.0\n".encode())
    (tmp_path / "b.csv").write_bytes("x\n\nLOCALITY CODE,GPCI Work,Né\n06,bad,é\n".encode("cp1252"))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in/d.csv", "locality code,gpci work\n07,2.5\n")
        z.writestr("in/readme.md", "no")
    lines = readers.numbered_lines(spark, str(tmp_path), r"\.csv$")
    c = layouts.Contract("t", (layouts.Field("locality_code"), layouts.Field("gpci_work", kind="double"), layouts.Field("missing")), ("locality_code",))
    got = sorted((r["locality_code"], r["gpci_work"], r["missing"]) for r in readers.delimited(lines, c, header_words=("locality", "gpci")).collect())
    assert got == [("05", 1.0, None), ("06", None, None), ("07", 2.5, None)]
    assert [readers.decoded(x)[1] for x in (b"\xff\xfea\x00", b"a", b"\xe9", b"\x81\xe9")] == ["utf-16-le", "utf-8", "cp1252", "latin-1"]


def test_json_shapes(spark, tmp_path):
    for name, text in (("a", '[{"x": 1}, {"x": 2}]'), ("b", '{"data": [{"x": 3}]}'), ("c", '{"x": 4}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r["x"] for r in readers.json_records(spark, str(tmp_path), "x: int").collect()) == [1, 2, 3, 4]


def test_routes_and_zip9(spark):
    names = spark.createDataFrame([("PPRRVU25.txt.gz",), ("GPCI2025.csv",), ("25LOCCO.txt",), ("notes.md",)], "n string")
    assert [r["d"] for r in names.select(readers.routed(F.col("n")).alias("d")).collect()] == ["pprrvu", "gpci", "locality", None]
    row = lambda flag, p4: placed(layouts.ZIP9, state="CA", zip5="90210", carrier="01112", locality="18", plus4_flag=flag, plus4=p4)
    got = readers.zip9_ranges(lines_of(spark, [row("1", "1234"), row("0", "1234"), row("1", "0000")]), layouts.ZIP9).collect()
    assert [(r["zip9_low"], r["zip9_high"], r["rural_flag"]) for r in got] == [("902101234", "902101234", None)]
    assert layouts.layout("gpci", 2025, "B") is layouts.GPCI and layouts.layout("gpci", 1999) is None


def test_snapshots_upserts_and_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, "CA", 1.0), (2, "NY", 2.0)], "k int, state string, v double")
    for _ in range(2):
        sinks.publish_snapshot(df, f"{tmp_path}/s", ["state"], vintage=dt.date(2025, 1, 1), release="r1", published_at=dt.datetime(2025, 1, 2))
    sinks.publish_snapshot(df.limit(1), f"{tmp_path}/s", ["state"], vintage=dt.date(2025, 4, 1), release="r2", published_at=dt.datetime(2025, 4, 2))
    got = sinks.snapshot(spark, f"{tmp_path}/s")
    assert got.count() == 3 and got.filter("release_id = 'r1'").count() == 2
    sinks.upsert(spark, f"{tmp_path}/u", df, ["k"], 0)
    path = sinks.upsert(spark, f"{tmp_path}/u", spark.createDataFrame([(2, "NJ", 9.0), (3, "TX", 3.0)], df.schema), ["k"], 1)
    assert sorted((r["k"], r["state"]) for r in spark.read.parquet(path).collect()) == [(1, "CA"), (2, "NJ"), (3, "TX")]
    sinks.quarantine(df.withColumns({"reject_rule": F.lit("bad"), "reject_severity": F.lit("error")}), f"{tmp_path}/q", release="r1", dataset="d", at=dt.datetime(2025, 1, 1))
    assert sorted(r["k"] for r in sinks.recovered(spark.read.parquet(f"{tmp_path}/q"), "k int, state string, v double", "bad").collect()) == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = traces.event_stream(spark, f"{tmp_path}/in", e.schema.simpleString()[7:-1].replace(":", " "))
    traces.run_once(traces.windowed_counts(stream, "ts", "event_type", "value", late="60 days"), f"{tmp_path}/out", f"{tmp_path}/c", "append")
    batch = traces.windowed_counts(e, "ts", "event_type", "value")
    done = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out")
    assert done.exceptAll(batch).count() == 0
    traces.merged_latest(traces.event_stream(spark, f"{tmp_path}/in", e.schema.simpleString()[7:-1].replace(":", " ")), ["user_id"], "ts", f"{tmp_path}/m", f"{tmp_path}/mc")
    assert traces.latest_table(spark, f"{tmp_path}/m").count() == e.select("user_id").distinct().count()
