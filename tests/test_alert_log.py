"""Alerts as keyed state: a stream and a table of the same log raise the same ones."""

import datetime as dt
import random

from meridia.streaming import alert_log as A

START = dt.datetime(2025, 1, 1)
SCHEMA = "key string, at timestamp, holds boolean, severity string"
POLICY = A.Policy({"a": 30}, other_cooldown=60, escalate_after=120)


def minute(n):
    return START + dt.timedelta(minutes=n)


def table(df):
    return sorted((r["key"], r["at"], r["event"], r["severity"] or "", r["raised_at"]) for r in df.collect())


def test_cooldown_escalation_and_resolution(spark):
    rows = [("a", 0, True, "low"), ("a", 30, True, "high"), ("a", 31, True, "high"), ("a", 40, False, None), ("a", 41, True, "medium"), ("a", 200, False, None), ("a", 300, False, None), ("b", 0, True, "critical"), ("b", 120, True, "low"), ("c", 5, False, None), ("c", 5, True, "low"), ("c", 5, True, "medium")]
    log = spark.createDataFrame([(k, minute(m), h, s) for k, m, h, s in rows], SCHEMA)
    got = [(k, int((at - START).total_seconds() // 60), e, s) for k, at, e, s, _ in table(A.raised_alerts(log, POLICY, minute(200)))]
    assert got == [
        ("a", 0, "raised", "low"), ("a", 31, "raised", "high"), ("a", 40, "resolved", "high"), ("a", 41, "raised", "medium"), ("a", 161, "escalated", "high"), ("a", 200, "resolved", "high"),
        ("b", 0, "raised", "critical"), ("b", 120, "escalated", "critical"), ("b", 120, "raised", "low"), ("c", 5, "raised", "medium"), ("c", 125, "escalated", "high"),
    ]
    assert A.raised_alerts(log.limit(0), POLICY, minute(1)).count() == 0
    odd = spark.createDataFrame([(None, START, True, "low"), ("k", None, True, "low"), ("k", START, None, "low"), ("k", START, True, None)], SCHEMA)
    assert table(A.raised_alerts(odd, POLICY, minute(1))) == [("k", START, "raised", "", START)]


def test_a_stream_raises_what_the_table_does(spark, tmp_path):
    """Rows come in several batches, up to nine minutes out of order; a last row of another key moves the watermark past all."""
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(1500), rng.random() < 0.6, rng.choice(["low", "medium", "high", "critical"])) for _ in range(150)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 9))
    log = [(k, minute(m), h, s) for k, m, h, s in rows] + [("end", minute(2010), False, "low")]
    for i in range(0, len(log), 40):
        spark.createDataFrame(log[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        out = A.streamed(stream, POLICY)
        q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = table(A.raised_alerts(spark.createDataFrame(log, SCHEMA), POLICY, minute(2000)))
    assert {r[2] for r in want} == {"raised", "escalated", "resolved"} and len(want) > 50
    assert table(spark.read.schema(A.OUTPUT).parquet(f"{tmp_path}/out")) == want
