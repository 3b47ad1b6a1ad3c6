"""Releases, runs, snapshots and discovered files: registries are append-only tables, and the present state is a pick over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .observability import reproducibility
from .windows import first_by

# ---- files


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))


def file_changes(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (filename, sha256) that are new, changed or gone against an earlier manifest; files without a change are left out."""
    both = found.select("filename", F.col("sha256").alias("_new")).join(known.select("filename", F.col("sha256").alias("_old")), "filename", "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_new") != F.col("_old"), "changed")
    return both.select("filename", change.alias("change")).filter("change is not null")


def has_same_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row: whether two manifests hold the same (filename, sha256), repeats counted."""
    a, b = found.select("filename", "sha256"), known.select("filename", "sha256")
    more = a.exceptAll(b).select(F.lit("only here").alias("side")).unionByName(b.exceptAll(a).select(F.lit("only there").alias("side")))
    return more.agg(F.count_if(F.col("side") == "only here").alias("n_added"), F.count_if(F.col("side") == "only there").alias("n_removed"), (F.count("*") == 0).alias("same_files"))


def first_of_each_url(links: DataFrame, url: str, position: str) -> DataFrame:
    return first_by(links, [url], [F.asc(position)])


def newest_year(files: DataFrame, year: str) -> DataFrame:
    """All files of the latest year."""
    return files.join(F.broadcast(files.agg(F.max(year).alias("_last"))), F.col(year) == F.col("_last")).drop("_last")  # one row


def newest_quarters(files: DataFrame, year: str, quarter: str, n: int) -> DataFrame:
    """The files of the latest n quarters that have any: quarters are counted first, so the ranking is over few rows."""
    quarters = files.select(year, quarter).distinct().filter(F.col(year).isNotNull() & F.col(quarter).isNotNull()).orderBy(F.desc(year), F.desc(quarter)).limit(n)
    return files.join(F.broadcast(quarters), [year, quarter], "left_semi")  # n rows


def rvu_release_links(links: DataFrame, base: str, first_year: int, last_year: int, href: str = "href") -> DataFrame:
    """Links to relative-value releases: year (two digits are of this century), quarter letter (A if there is none), absolute URL."""
    name = F.upper(href)
    year = F.regexp_extract(name, r"RVU(\d{2,4})", 1).try_cast("int")
    letter = F.substring(F.regexp_extract(name, r"RVU\d{2,4}([A-Z]*)", 1), 1, 1)
    url = F.when(F.col(href).startswith("http"), F.col(href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(href, "^/+", "")))
    out = links.withColumns({"year": F.when(year < 100, year + 2000).otherwise(year), "quarter": F.when(letter == "", "A").otherwise(letter), "url": url})
    return out.filter(F.col("year").between(first_year, last_year))


#: The words of links to fee-schedule files, and kinds by words in the address (first) and in the text (second).
MPFS_WORDS = ("conversion", "factor", "abstract", "national", "payment", "pfs", "mpfs", "physician", "fee", "schedule")
MPFS_KINDS = (("conversion_factors", ("conversion", "cf"), ("conversion",)), ("abstracts", ("abstract",), ("abstract",)), ("national_payment", ("national",), ("national",)), ("policy_updates", ("policy", "update"), ("policy",)))
MPFS_STEMS = {"conversion_factors": (("conversion-factor", "cf"), ("zip", "xlsx")), "abstracts": (("pfs-abstract", "abstract"), ("zip", "pdf")), "national_payment": (("national-payment", "national"), ("zip", "xlsx")), "policy_updates": (("policy-updates", "updates"), ("zip", "pdf"))}


def _has_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def is_mpfs_link(href: str, text: str, year: int) -> Column:
    h, t = F.lower(href), F.lower(F.coalesce(F.col(text), F.lit("")))
    return (h.contains(str(year)) | t.contains(str(year))) & (_has_any(h, MPFS_WORDS) | _has_any(t, MPFS_WORDS))


def mpfs_kind(href: str, text: str) -> Column:
    h, t = F.lower(href), F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.coalesce(*[F.when(_has_any(h, a) | _has_any(t, b), F.lit(kind)) for kind, a, b in MPFS_KINDS], F.lit("other"))


def expected_names(spark: SparkSession, years: list[int]) -> DataFrame:
    """kind, year, filename by the known naming patterns."""
    return spark.createDataFrame([(k, y, f"{stem}-{y}.{end}") for k, (stems, ends) in MPFS_STEMS.items() for stem in stems for end in ends for y in years], "kind string, year int, filename string")


# ---- runs

RUN_DDL = "batch_id string, release_id string, dataset string, status string, at timestamp, rows_in long, rows_out long, rows_rejected long, message string"


#: The order in which a run passes through states: of rows with one time the later state counts.
RUN_STATES = ("pending", "started", "running", "success", "partial", "failed")


def run_state(events: DataFrame) -> DataFrame:
    """The present state of each run from its log: the last status, and of every other field the last value that was given.

    Rows of one time follow the order of RUN_STATES, so that an end comes after its start; other states come before all.
    """
    fields = [c for c in events.columns if c not in ("batch_id", "at")]
    place = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(RUN_STATES)], F.lit(-1))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", place.alias("place"), F.col("status").alias("status"), F.col(c).cast("string").alias("text"), F.col(c).alias("value")))).alias(c)
    held = events.groupBy("batch_id").agg(F.max("at").alias("updated_at"), *[last(c) for c in fields], F.min("at").alias("started_at"))
    return held.select("batch_id", "updated_at", *[F.col(f"{c}.value").alias(c) for c in fields], "started_at")


def recent(df: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The newest n rows, newest first."""
    return df.orderBy(F.desc(at), *[F.asc(t) for t in ties]).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """source, n_rows of several tables."""
    counts = [t.agg(F.lit(name).alias("source"), F.count("*").alias("n_rows")) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def release_manifest(datasets: dict[str, DataFrame], release_id: str) -> DataFrame:
    """dataset, n_rows, n_failed, n_warnings, success_rate of a release; each table has release_id and reject_severity (null for good rows)."""

    def one(name: str, df: DataFrame) -> DataFrame:
        own = df.filter(F.col("release_id") == release_id)
        bad, warned = F.count_if(F.col("reject_severity").isin("block", "critical", "error")), F.count_if(F.col("reject_severity").isin("warning", "info"))
        return own.agg(F.lit(name).alias("dataset"), F.count("*").alias("n_rows"), bad.alias("n_failed"), warned.alias("n_warnings"), F.round(F.coalesce(F.try_divide(F.count("*") - bad, F.count("*")), F.lit(0.0)), 4).alias("success_rate"))

    return reduce(lambda a, b: a.unionByName(b), [one(n, d) for n, d in datasets.items()])


def manifest_summary(manifest: DataFrame) -> DataFrame:
    status = F.when(F.sum("n_rows") == 0, "failed").when(F.sum("n_failed") > 0, "partial").otherwise("success")
    return manifest.agg(F.count("*").alias("n_datasets"), F.sum("n_rows").alias("n_rows"), F.sum("n_failed").alias("n_failed"), F.sum("n_warnings").alias("n_warnings"), status.alias("overall_status"))


# ---- snapshots

SNAPSHOT_DDL = "name string, dataset string, digest string, created_at timestamp, tags array<string>, event string"


def snapshots(log: DataFrame, dataset: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """The snapshots that exist, by their newest event (created, pinned, unpinned, deleted)."""
    own = log.filter(F.col("dataset") == dataset) if dataset else log
    # the newest event whole; of several at one time a deletion counts, then the greatest digest and tags
    newest = F.max(F.struct("created_at", (F.col("event") == "deleted").alias("gone"), "event", "digest", "dataset", "tags")).alias("e")
    state = own.groupBy("name").agg(newest, F.min("created_at").alias("created_at")).select("name", "e.dataset", "e.digest", "e.tags", "e.event", "created_at")
    state = state.filter("event <> 'deleted'")
    for tag in tags or []:
        state = state.filter(F.array_contains("tags", tag))
    return state


def expired(state: DataFrame, before) -> DataFrame:
    """Snapshots from before a time that are not pinned."""
    return state.filter((F.col("created_at") < F.lit(before)) & ~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "pinned"))


def snapshot_on(state: DataFrame, day) -> DataFrame:
    """The newest snapshot of each data set that was there on a day."""
    return first_by(state.filter(F.col("created_at") <= F.lit(day)), ["dataset"], [F.desc("created_at"), F.asc("name")])


def verified(state: DataFrame, name: str, current_digest: DataFrame, pinned: DataFrame, resolved_now: DataFrame, key: str, value: str) -> DataFrame:
    """One row: does the table still have the snapshot's digest, and do test keys still resolve to what they did.

    current_digest: one row with digest. pinned, resolved_now: key and value of the test keys, then and now.
    """
    same = pinned.select(key, F.col(value).alias("_then")).join(resolved_now.select(key, F.col(value).alias("_now")), key, "left")
    tests = same.agg(F.count("*").alias("n_tested"), F.count_if(F.col("_then").eqNullSafe(F.col("_now"))).alias("n_same"))
    one = state.filter(F.col("name") == name).select("name", F.col("digest").alias("snapshot_digest")).crossJoin(current_digest.select(F.col("digest").alias("current_digest"))).crossJoin(tests)  # one row each
    match = F.col("snapshot_digest") == F.col("current_digest")
    return one.withColumn("digest_match", match).withColumn("reproducibility_score", reproducibility(match, F.col("n_tested"), F.col("n_same")))


# ---- geography


def geography_stats(df: DataFrame) -> DataFrame:
    """Rows, different ZIP codes and states, and the span of dates; where no date is given, the year 2024 stands (fixed values)."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("zip5").alias("n_zips"), F.count_distinct("state").alias("n_states"),
        F.coalesce(F.min("effective_from"), F.lit("2024-01-01").cast("date")).alias("first_day"), F.coalesce(F.max("effective_to"), F.lit("2024-12-31").cast("date")).alias("last_day"),
    )


def pobox_audit(zips: DataFrame, metadata: DataFrame) -> DataFrame:
    """Counts and shares of PO-box flags; null flags count as no PO box and are told apart."""
    n = zips.agg(F.count("*").alias("n_zips"))
    m = metadata.agg(F.count("*").alias("n_metadata"), F.count_if("is_pobox").alias("n_pobox"), F.count_if(~F.col("is_pobox")).alias("n_other"), F.count_if(F.col("is_pobox").isNull()).alias("n_null"))
    percent = lambda a, b: F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(b)), F.lit(0.0)), 2)
    return n.crossJoin(m).withColumns({"coverage_percent": percent("n_metadata", "n_zips"), "pobox_percent": percent("n_pobox", "n_metadata")})  # one row each


def pobox_samples(metadata: DataFrame, n: int = 10) -> DataFrame:
    """The first n ZIP codes of each flag, in order of the code."""
    w = Window.partitionBy("is_pobox").orderBy("zip5")
    return metadata.filter("is_pobox is not null").withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n).select("is_pobox", "sample_no", "zip5")


def default_candidates(candidates: DataFrame, key: str, locality: str) -> DataFrame:
    """Of each key's candidates the one with the smallest locality (null first, as ''), and whether there are several localities."""
    name = F.coalesce(locality, F.lit(""))
    return candidates.groupBy(key).agg(F.min(name).alias(locality), F.count("*").alias("n_candidates"), (F.count_distinct(name) > 1).alias("is_ambiguous"))


def latency_profile(df: DataFrame, value: str, ok: Column) -> DataFrame:
    """Mean, median, p95, p99, least, most and success rate of measured calls; percentiles interpolate between the values around them."""
    return df.agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.95).alias("p95"), F.percentile(value, 0.99).alias("p99"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(ok.cast("int")).alias("success_rate"))


def geography_health(geography: DataFrame, state: DataFrame, today, *, least_rows: int = 1, most_age_days: int = 120) -> DataFrame:
    """One row: counts, the snapshot in force, how many days ago data began, and a status by what is missing."""
    g = geography_stats(geography)
    s = state.filter((F.col("dataset") == "geography") & (F.to_date("created_at") <= F.lit(today))).agg(F.max(F.struct("created_at", "name")).getField("name").alias("active_snapshot"), F.count("*").alias("n_snapshots"))
    out = g.crossJoin(s).withColumn("age_days", F.datediff(F.lit(today), F.col("first_day")))  # one row each
    status = F.when(F.col("n_rows") < least_rows, "critical").when(F.col("active_snapshot").isNull() | (F.col("age_days") > most_age_days), "degraded").otherwise("healthy")
    return out.withColumn("status", status)


def manifest_history(manifests: DataFrame, dataset: str, n: int = 10) -> DataFrame:
    """The newest n manifests of a data set with the change of rows against the one before."""
    w = Window.partitionBy("dataset").orderBy("started_at", "release_id")
    own = manifests.filter(F.col("dataset") == dataset).withColumn("row_change", F.col("n_rows") - F.lag("n_rows").over(w))
    return recent(own, "started_at", n, "release_id")


def newest_build(spark: SparkSession, builds: list[str]) -> DataFrame:
    """The Parquet table of the newest build folder, by name."""
    return spark.read.parquet(max(builds))


def components_in_order(plans: DataFrame, components: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Plans with their components and each component's place, by sequence and then by age."""
    w = Window.partitionBy(plan).orderBy(F.asc_nulls_last("sequence"), F.asc_nulls_last("created_at"), F.asc_nulls_last("code"))
    return plans.join(components, plan).withColumn("place", F.row_number().over(w))


def replaced(components: DataFrame, update: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Plan updates replace all components of the plans they name; a plan in the update without a code has none left."""
    return components.join(update.select(plan).distinct(), plan, "left_anti").unionByName(update.filter("code is not null"))


def trace_of(traces: DataFrame, run_id: str, order: list[str]) -> DataFrame:
    """The steps of one run in order, for a look-up or a replay of its inputs."""
    return traces.filter(F.col("run_id") == run_id).orderBy(*[F.asc_nulls_last(c) for c in order])
