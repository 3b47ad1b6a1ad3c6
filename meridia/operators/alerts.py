"""Alert rules over manifests and anomalies, as joins of small rule tables with aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .observability import SEVERITY_ORDER, severity_rank

#: Rule, alert type, severity and minutes of cooldown.
ALERT_RULES = (
    ("ingestion_failure", "ingestion_failure", "critical", 30),
    ("high_error_rate", "performance_degradation", "high", 60),
    ("critical_anomaly", "anomaly_detected", "critical", 15),
    ("high_anomaly_count", "anomaly_detected", "medium", 120),
    ("no_recent_ingestion", "system_error", "high", 240),
)
MOST_ERRORS, MOST_ANOMALIES, MOST_HOURS, ANOMALY_RELEASES = 100, 50, 24, 3


def triggered(manifests: DataFrame, anomalies: DataFrame, now) -> DataFrame:
    """rule, alert_type, severity, cooldown of the rules whose condition holds.

    manifests: release_id, overall_status, total_errors, started_at. anomalies: release_id, severity. Anomaly rules look
    at the newest ANOMALY_RELEASES releases. Without any manifest there was no recent ingestion.
    """
    newest = manifests.orderBy(F.desc("started_at"), "release_id").limit(ANOMALY_RELEASES).select("release_id")
    seen = anomalies.join(F.broadcast(newest), "release_id", "left_semi")  # at most three rows
    a = seen.agg((F.count_if(F.col("severity") == "critical") > 0).alias("critical_anomaly"), (F.count("*") > MOST_ANOMALIES).alias("high_anomaly_count"))
    hours = (F.lit(now).cast("timestamp").cast("double") - F.max(F.col("started_at").cast("timestamp")).cast("double")) / 3600
    m = manifests.agg((F.count_if(F.col("overall_status") == "failed") > 0).alias("ingestion_failure"), (F.count_if(F.col("total_errors") > MOST_ERRORS) > 0).alias("high_error_rate"), F.coalesce(hours > MOST_HOURS, F.lit(True)).alias("no_recent_ingestion"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("alert_type"), F.lit(s).alias("severity"), F.lit(c).alias("cooldown"), F.col(r).alias("holds")) for r, t, s, c in ALERT_RULES])
    return m.crossJoin(a).select(F.inline(rules)).filter("holds").drop("holds")  # one row each


def raised(found: DataFrame, history: DataFrame, now) -> DataFrame:
    """Alerts to raise: rules that hold and have no unresolved alert of their type within their own cooldown."""
    open_ = history.filter(~F.col("resolved")).groupBy("alert_type").agg(F.max("created_at").alias("_last"))
    quiet = F.col("_last").isNull() | (F.lit(now).cast("timestamp") - F.make_interval(mins=F.col("cooldown")) > F.col("_last"))
    return found.join(open_, "alert_type", "left").filter(quiet).drop("_last")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts of alerts by state, severity and type: (dimension, value, n)."""
    state = F.when(F.col("resolved"), "resolved").otherwise("active")
    rows = alerts.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("state", state), ("severity", F.col("severity")), ("type", F.col("alert_type")))])).alias("p"))
    return rows.groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def escalated(severity: Column, has_critical_field: Column, size: Column) -> Column:
    """Medium rises to high where a critical field is present; low rises to medium for records of over 1,000 characters."""
    return F.when(has_critical_field & (severity == "medium"), "high").when((size > 1000) & (severity == "low"), "medium").otherwise(severity)


def can_remedy(base: Column, category: Column, n_fields: Column) -> Column:
    """Remedies apply by themselves where the rule says so, the category is neither a business rule nor a schema fault, and three fields are there."""
    return base & ~category.isin("business_rule", "schema") & (n_fields >= 3)


#: What to do about a category of errors.
SUGGESTIONS = {
    "format": ("Check data format and encoding", "Validate field lengths and types"),
    "quality": ("Review null value handling", "Check data completeness"),
    "duplicate": ("Remove duplicate records", "Merge or deduplicate data"),
    "range": ("Validate value ranges", "Check for data entry errors"),
    "missing": ("Fill in missing required fields", "Check data source completeness"),
}
OTHER_SUGGESTIONS = ("Review error details and data context", "Consult business rules documentation")


def suggestions(category: Column) -> Column:
    words = lambda x: F.array(*map(F.lit, x))
    return F.coalesce(*[F.when(category == k, words(v)) for k, v in SUGGESTIONS.items()], words(OTHER_SUGGESTIONS))


def metric_alerts(metrics: DataFrame) -> DataFrame:
    """Metrics (name, pillar, value, low) below what is asked, with a severity by how far: under half of it is critical."""
    r = F.try_divide("value", "low")
    return metrics.withColumn("severity", F.when(r < 0.5, "critical").when(r < 1, "high")).filter("severity is not null")


def pillar_report(metrics: DataFrame) -> DataFrame:
    """Mean value, number of metrics and worst severity of each pillar."""
    r = F.try_divide("value", "low")
    worst = F.min(severity_rank(F.when(r < 0.5, "critical").when(r < 1, "high")))
    return metrics.groupBy("pillar").agg(F.count("*").alias("n"), F.avg("value").alias("score"), F.get(F.array(*map(F.lit, SEVERITY_ORDER)), worst).alias("worst"))
