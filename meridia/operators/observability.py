"""Anomalies, run statistics, trace summaries, scores, alerts and quarantine, as aggregates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import classified
from .windows import by_percentile_index, first_by

#: Error words and their categories (in order), and each category's severity and handling.
ERROR_CATEGORIES = [(["zip9", "plus4"], "zip9"), (["schema", "column"], "schema"), (["format", "parse"], "format"), (["duplicate", "unique"], "duplicate"), (["range", "bound"], "range"), (["reference", "foreign"], "reference"), (["missing", "null", "required"], "missing")]
TRIAGE = [("schema", "critical", 1, False), ("reference", "high", 2, False), ("missing", "high", 2, True), ("range", "medium", 3, False), ("duplicate", "medium", 3, True), ("format", "low", 4, True), ("zip9", "low", 4, True), ("other", "low", 5, False)]
SEVERITY_ORDER = ("critical", "high", "medium", "low")
HEALTH_WEIGHTS = {"freshness": 0.25, "volume": 0.20, "schema": 0.20, "quality": 0.25, "lineage": 0.10}


def severity_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == s, i) for i, s in enumerate(SEVERITY_ORDER)], F.lit(len(SEVERITY_ORDER)))


def outliers(df: DataFrame, value: str, sigmas: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """Rows farther than `sigmas` sample deviations from the mean (of their key): one aggregate, broadcast or joined."""
    stats = [F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation")]
    with_stats = df.join(df.groupBy(*keys).agg(*stats), keys) if keys else df.crossJoin(F.broadcast(df.agg(*stats)))  # one row
    return with_stats.filter(F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("deviation"))


def shares(df: DataFrame, c: str) -> DataFrame:
    n = df.groupBy(c).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return n.crossJoin(total).withColumn("share", F.col("n") / F.col("total")).drop("total")


def rows_of_conflicting_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """All rows of the keys that have several different values."""
    return df.join(keys_with_several_values(df, key, value).select(key), key, "left_semi")


def keys_with_several_values(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def out_of_band(df: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """column, least, most, n_out for each banded column, in one pass."""
    aggs = [a for c, (lo, hi) in bands.items() for a in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_n"))]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_lo").cast("double").alias("least"), F.col(f"{c}_hi").cast("double").alias("most"), F.col(f"{c}_n").alias("n_out")) for c in bands])))


def domain_violations(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    """column, n_out, n_null, n_distinct of columns against their domains (null is no violation), in one pass."""
    aggs = [a for c, values in domains.items() for a in (F.count_if(~F.col(c).isin(*values)).alias(f"{c}_n"), F.count_if(F.isnull(c)).alias(f"{c}_0"), F.count_distinct(c).alias(f"{c}_d"))]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("n_out"), F.col(f"{c}_0").alias("n_null"), F.col(f"{c}_d").alias("n_distinct")) for c in domains])))


def cross_anomalies(items: DataFrame, indices: DataFrame, localities: DataFrame) -> DataFrame:
    """kind, n: repeated locality-county groups, localities without a name or an index, and payable items without work."""
    groups = localities.groupBy("mac", "locality_code", "county").count().filter("count > 1")
    rows = [
        groups.agg(F.lit("duplicate locality").alias("kind"), F.count("*").alias("n")),
        localities.agg(F.lit("missing name").alias("kind"), F.count_if(F.coalesce(F.trim("locality_name"), F.lit("")) == "").alias("n")),
        localities.select("locality_code").distinct().join(indices.select("locality_code").distinct(), "locality_code", "left_anti").agg(F.lit("missing index").alias("kind"), F.count("*").alias("n")),
        items.agg(F.lit("payable without work").alias("kind"), F.count_if(F.col("status_code").isin("A", "R", "T") & F.col("rvu_work").isNull()).alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def ratio_violations(df: DataFrame, a: str, b: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    r = F.try_divide(F.col(a), F.col(b))
    return df.withColumn("ratio", r).filter((F.col("ratio") < low) | (F.col("ratio") > high))


def trace_summary(traces: DataFrame, level: str, latency: str, extra: list[Column] | None = None) -> DataFrame:
    """Counts by level, mean, and the latency at place floor(0.95 n); one row a level."""
    p95 = by_percentile_index(traces, [level], latency, 0.95, "p95")
    base = traces.groupBy(level).agg(F.count("*").alias("n"), F.avg(latency).alias("mean"), F.min(latency).alias("least"), F.max(latency).alias("most"), *(extra or []))
    return base.join(p95, level, "left")


def run_statistics(runs: DataFrame, now, days: int) -> DataFrame:
    """Runs (status, started_at, seconds, rows_in, rows_rejected) of the last days."""
    recent = runs.filter((F.col("started_at") >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("started_at") <= F.lit(now)))
    return recent.agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "success").alias("n_success"), F.try_divide(F.count_if(F.col("status") == "success"), F.count("*")).alias("success_rate"),
        F.try_divide(F.sum("rows_rejected"), F.sum("rows_in")).alias("rejection_rate"), F.avg("seconds").alias("mean_seconds"), F.sum("rows_in").alias("rows_in"),
    )


def completeness(df: DataFrame, columns: list[str]) -> Column:
    """The share of filled fields, as an aggregate."""
    return F.try_divide(sum((F.count(c) for c in columns), F.lit(0)), F.count("*") * len(columns))


def freshness_status(hours: Column) -> Column:
    return F.when(hours < 1, "fresh").when(hours < 24, "stale").otherwise("outdated")


def volume_status(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n < 1000, "low").when(n < 100_000, "normal").otherwise("high")


def quality_status(score: Column) -> Column:
    return F.when(score >= 0.95, "excellent").when(score >= 0.90, "good").when(score >= 0.80, "fair").otherwise("poor")


def freshness_score(hours: Column, sla_hours: float) -> Column:
    """1 within the agreed time, 0 from twice of it on, straight in between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 - hours / F.lit(float(sla_hours))))


def health(scores: dict[str, Column]) -> Column:
    return sum((scores[k] * F.lit(w) for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))


def system_health(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 100, "critical").when((errors > 10) | (warnings > 100), "degraded").otherwise("healthy")


def mean_positive(scores: list[Column]) -> Column:
    total = sum((F.when(s > 0, s).otherwise(0.0) for s in scores), F.lit(0.0))
    return F.coalesce(F.try_divide(total, sum((F.when(s > 0, 1).otherwise(0) for s in scores), F.lit(0))), F.lit(0.0))


def reproducibility(digest_equal: Column, tested: Column, same: Column) -> Column:
    return F.when(~digest_equal, 0.0).when(tested == 0, 1.0).otherwise(F.round(F.try_divide(same, tested), 3))


def triaged(records: DataFrame, message: str) -> DataFrame:
    """Category by words of the message, and the category's severity, priority and remedy."""
    rules = records.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(p).alias("priority"), F.lit(a).alias("auto")) for c, s, p, a in TRIAGE])))
    return records.withColumn("category", classified(message, ERROR_CATEGORIES, "other")).join(F.broadcast(rules), "category", "left")  # a fixed table


def quarantine_summary(records: DataFrame) -> DataFrame:
    """Counts by status, severity, category and rule in one pass (grouping sets), as (dimension, value, n)."""
    dims = ["status", "severity", "category", "rule"]
    cube = records.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    g = {0b0111: "status", 0b1011: "severity", 0b1101: "category", 0b1110: "rule"}
    name = F.coalesce(*[F.when(F.col("g") == k, F.lit(v)) for k, v in g.items()])
    value = F.coalesce(*[F.when(F.col("g") == k, F.col(v)) for k, v in g.items()])
    return cube.select(name.alias("dimension"), value.alias("value"), "n")


def batch_priority(records: DataFrame, batch: str) -> DataFrame:
    worst = F.min(severity_rank(F.col("severity")))
    return records.groupBy(batch).agg(F.count("*").alias("n"), F.get(F.array(*map(F.lit, (*SEVERITY_ORDER, "low"))), worst).alias("priority"))


def latest_status(events: DataFrame, record: str, at: str, *ties: str) -> DataFrame:
    """The present status of each record from an append-only log."""
    return first_by(events, [record], [F.desc(at), *[F.desc(t) for t in ties]])


def open_alerts(findings: DataFrame, history: DataFrame, now, cooldown_minutes: int) -> DataFrame:
    """Findings (alert_type, value) without an unresolved alert of their type within the cooldown."""
    recent = history.filter(~F.col("resolved") & (F.col("created_at") >= F.lit(now) - F.expr(f"INTERVAL {int(cooldown_minutes)} MINUTES")))
    return findings.join(recent.select("alert_type").distinct(), "alert_type", "left_anti")


def _bucket_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, n, h) of each bucket from its (b, h, n) in order; no bucket is held in memory."""

    def row(b: int, n: int, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["b", "n", "h"])

    at, total, digest = None, 0, None
    for batch in batches:
        for b, h, n in zip(*(batch.column(c).to_pylist() for c in ("b", "h", "n"))):
            if b != at:
                if at is not None:
                    yield row(at, total, digest)
                at, total, digest = b, 0, hashlib.sha256()
            line = ("\n" + h).encode()
            digest.update(line if total else h.encode())
            left = n - 1
            while left:  # copies of a row, some thousands at a time
                some = min(left, 4096)
                digest.update(line * some)
                left -= some
            total += n
    if at is not None:
        yield row(at, total, digest)


def dataset_digest(df: DataFrame, parts: list[Column], buckets: int = 4096) -> DataFrame:
    """An order-free SHA-256 of a table in two levels: rows' hashes in buckets, then the buckets' hashes.

    Copies of a row are counted first, so that they are one pair (hash, count) before they are dealt to buckets; the
    sorted pairs of a bucket stream through its digest. Only the digests of all buckets meet in one place.
    """
    row = df.select(F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), "|", ""), 256).alias("h"))
    bucket = (F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % buckets).cast("int")
    pairs = row.groupBy("h").agg(F.count("*").alias("n")).select(bucket.alias("b"), "h", "n")
    level = pairs.repartition("b").sortWithinPartitions("b", "h").mapInArrow(_bucket_digests, "b int, n long, h string")
    return level.agg(F.sum("n").alias("n_rows"), F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256).alias("digest"))


def small_digest(df: DataFrame, parts: list[Column], most_rows: int = 1_000_000) -> DataFrame:
    """The digest of a small reference table: SHA-256 over its sorted rows, parts joined by | and rows by newlines.

    All rows meet in one place for that, so a table of more than most_rows is an error (see dataset_digest).
    """
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows: use dataset_digest")
    row = F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), "|", "")
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("digest"))
