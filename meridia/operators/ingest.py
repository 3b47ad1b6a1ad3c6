"""Ingest chains: land, validate, normalize, enrich and publish, as DataFrame transforms chosen by a specification.

A release is a dict of tables by data set. Every stage maps such a dict to another, so a chain is one plan until it is
published; only the results of the rules come to the driver, to decide whether to go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_key, county_key, strip, zero_pad
from ..sources import published, sinks
from ..sources.layouts import ZIP9
from ..sources.readers import routed, zip9_ranges
from . import quality as Q
from . import rvu
from .enrichment import EnrichmentRule, apply_rules, described, rule_results, wage_adjusted, without_flags
from .windows import latest_effective

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class PublishSpec:
    """Where a table goes: its partitions, its keys and the date that its latest rows are picked by."""

    table: str
    keys: tuple[str, ...]
    partitions: tuple[str, ...] = ()
    effective: str = "effective_from"
    kind: str = "parquet"
    compression: str = "snappy"


#: The views of a fee schedule and their keys.
MPFS_KEYS = {
    "mpfs_rvu": ("hcpcs", "modifier", "effective_from"), "mpfs_indicators_all": ("hcpcs", "modifier", "indicator", "effective_from"), "mpfs_locality": ("locality_code", "state_fips", "county_fips"),
    "mpfs_gpci": ("locality_code", "effective_from"), "mpfs_cf_vintage": ("cf_type", "vintage_date", "effective_from"), "mpfs_link_keys": ("hcpcs", "modifier", "effective_from"),
}
#: The tables that are published, their partitions and keys.
PUBLISH_SPECS = {
    s.table: s
    for s in (
        PublishSpec("cms_zip_locality", ("zip5",), ("state",)), PublishSpec("zip9_overrides", ("zip9_low", "zip9_high"), ("state",)), PublishSpec("zip_to_zcta", ("zip5",), ("state",)), PublishSpec("zcta_coords", ("zcta5",)),
        *(PublishSpec(name, keys) for name, keys in rvu.NATURAL_KEYS.items()),
        *(PublishSpec(name, keys) for name, keys in MPFS_KEYS.items()),
        PublishSpec("opps_apc_payment", ("apc", "effective_from")), PublishSpec("opps_hcpcs_crosswalk", ("hcpcs", "modifier", "effective_from")), PublishSpec("opps_rates_enriched", ("apc", "cbsa", "effective_from")),
    )
}
#: Adapters of outside files, source column -> column, and the columns that must be there.
ADAPTERS = {
    "zip5": ({"ZIP CODE": "zip5", "STATE": "state", "LOCALITY": "locality"}, ("zip5", "state", "locality")),
    "zip9": ({c: c for c in ("state", "zip5", "locality", "rural_flag", "zip9_low", "zip9_high")}, ("state", "zip5", "locality", "zip9_low", "zip9_high")),
    "uds": ({"ZIP_CODE": "zip5", "zcta": "zcta5", "zip_join_type": "relationship", "PO_NAME": "city", "STATE": "state"}, ("zip5", "zcta5", "relationship", "state")),
}


def adapted(df: DataFrame, adapter: str) -> DataFrame:
    """A file's columns under their canonical names, all text; a required column that is absent is an error before any row is read."""
    names, required = ADAPTERS[adapter]
    out = df.withColumnsRenamed(names)
    if gaps := Q.required_columns(out, list(required)):
        raise ValueError(f"{adapter}: no column {', '.join(gaps)}")
    return out.select(*[F.col(c).cast("string").alias(c) for c in dict.fromkeys(names.values()) if c in out.columns])


# ---- the chains of single data sets


def rvu_tables(files: Tables, *, release_id: str, batch_id: str, year: int, quarter: int | None = None) -> Tables:
    """The five files of a relative-value release, mapped, cast and stamped."""
    out = {}
    for name, df in files.items():
        mapped = rvu.mapped(df, name)
        if name == "pprrvu":
            mapped = mapped.withColumns({c: F.nullif(F.upper(strip(c)), F.lit("")) for c in ("hcpcs", "modifier", "status_code") if c in mapped.columns})
        if "locality_code" in mapped.columns:
            mapped = mapped.withColumn("locality_code", zero_pad(strip("locality_code"), 2))
        out[name] = rvu.stamped(mapped, release_id=release_id, batch_id=batch_id, year=year, quarter=quarter)
    return out


def rvu_ingest_rules(dataset: str) -> list[Q.Rule]:
    """The rules that a release's files must meet before they are normalized."""
    number = lambda c, low, high: Q.Rule(f"{c}_range", F.col(c).between(low, high), "critical")
    rules = {
        "pprrvu": [Q.Rule("hcpcs_format", Q.matches("hcpcs", "[A-Z0-9]{5}"), "critical"), Q.Rule("status_domain", Q.in_domain("status_code", Q.INGEST_STATUSES), "critical"), *[number(c, 0, Q.RVU_MAX) for c in ("rvu_work", "rvu_pe_nonfac", "rvu_pe_fac", "rvu_malp")]],
        "gpci": [Q.locality_rule("locality_code"), *[number(c, *Q.GPCI_BAND) for c in ("gpci_work", "gpci_pe", "gpci_malp")]],
        "oppscap": [Q.Rule("hcpcs_format", Q.matches("hcpcs", "[A-Z0-9]{5}"), "critical"), Q.Rule("cap_not_negative", F.col("cap_amount_usd") >= 0, "critical")],
        "anes": [Q.locality_rule("locality_code"), Q.Rule("factor_positive", F.col("anesthesia_cf_usd") > 0, "critical")],
        "locco": [Q.locality_rule("locality_code"), Q.Rule("county_format", Q.matches("county_fips", "[0-9]{3}|[0-9]{5}"), "critical")],
    }
    return rules[dataset]


def mpfs_views(t: Tables) -> Tables:
    """The six curated views of a fee schedule over pprrvu, gpci, locco and conversion factors (cf)."""
    items = rvu.derived_facts(t["pprrvu"])
    keys = ["hcpcs", "modifier"]
    flags = [c for c in items.columns if c.endswith(("_ind", "_indicator", "_applicable")) or c in ("global_days", "physician_supervision")]
    long = items.select(*keys, "effective_from", F.inline(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("string").alias("value")) for c in flags]))) if flags else items.select(*keys, "effective_from", F.lit(None).cast("string").alias("indicator"), F.lit(None).cast("string").alias("value")).limit(0)
    return {
        "mpfs_rvu": items,
        "mpfs_indicators_all": long.filter("value is not null"),
        "mpfs_locality": t["locco"],
        "mpfs_gpci": t["gpci"],
        "mpfs_cf_vintage": latest_effective(t["cf"], ["cf_type", "vintage_date"], "effective_from"),
        "mpfs_link_keys": items.select(*keys, "effective_from").distinct(),
    }


def opps_tables(a: DataFrame, b: DataFrame, wage: DataFrame, indicators: DataFrame, batch_id: str) -> Tables:
    """Addenda A and B of a batch (opps_YYYYqN_rNN) with its dates, wage-adjusted rates and status descriptions.

    wage: cbsa, index; every rate meets every area, as the feature asks (both are small tables; the areas are broadcast).
    """
    from .rvu import batch_parts

    dated = lambda df: df.withColumn("_b", batch_parts(F.lit(batch_id))).withColumns({"year": F.col("_b.year"), "quarter": F.col("_b.quarter"), "effective_from": F.col("_b.effective_from"), "effective_to": F.col("_b.effective_to"), "release_id": F.lit(batch_id), "batch_id": F.lit(batch_id)}).drop("_b")
    payment = dated(a)
    areas = payment.sparkSession.createDataFrame([], "cbsa string") if "cbsa" in a.columns else wage.select("cbsa").distinct()
    rates = payment if "cbsa" in a.columns else payment.crossJoin(areas)
    return {"opps_apc_payment": payment, "opps_hcpcs_crosswalk": described(dated(b), indicators, "status_indicator", "si_description"), "opps_rates_enriched": wage_adjusted(rates, wage, ["cbsa"])}


def zip9_table(lines: DataFrame, *, effective_from, effective_to, vintage: str) -> DataFrame:
    """Overrides of the ZIP9 file with their dates, tagged with the first rule that a row breaks."""
    rows = zip9_ranges(lines, ZIP9).withColumns({"effective_from": F.lit(effective_from), "effective_to": F.lit(effective_to).cast("date"), "vintage": F.lit(vintage)})
    return Q.tagged(rows, [r for r in Q.zip9_rules() if r.name != "completeness"])


def zip_locality_table(raw: DataFrame, *, effective_from, effective_to, vintage: str) -> DataFrame:
    """ZIP-to-locality rows in canonical form, tagged with the first rule that a row breaks."""
    rows = adapted(raw, "zip5") if "ZIP CODE" in raw.columns else raw
    text = {"zip5": zero_pad(strip("zip5"), 5), "state": F.upper(strip("state")), "locality": zero_pad(strip("locality"), 2)}
    more = {"rural_flag": rvu.rural("rural_flag")} if "rural_flag" in rows.columns else {}
    rows = rows.withColumns({**text, **more, "effective_from": F.lit(effective_from), "effective_to": F.lit(effective_to).cast("date"), "vintage": F.lit(vintage)})
    return Q.tagged(rows, zip_locality_rules())


def zip_locality_rules() -> list[Q.Rule]:
    given = lambda good: F.coalesce(good, F.lit(False))
    return [
        Q.Rule("zip5_format", given(Q.matches("zip5", "[0-9]{5}")), "critical"),
        Q.Rule("state_codes", given(Q.in_domain("state", Q.STATES)), "critical"),
        Q.Rule("locality_format", given(Q.matches("locality", "[0-9]+")), "critical"),
    ]


def reference_tables(states: DataFrame, counties: DataFrame, aliases: DataFrame) -> Tables:
    """States, counties and aliases for matching: upper-case names, and county and alias keys.

    states: state_fips, state_abbr, state_name. counties: state_fips, county_fips, county_name, county_type.
    aliases: state_fips (null: of every state), alias, name.
    """
    named = aliases.withColumns({"alias_key": ascii_key("alias"), "county_key": ascii_key("name")})
    every = named.filter("state_fips is null").drop("state_fips").crossJoin(F.broadcast(states.select("state_fips")))  # a state table has some fifty rows
    return {
        "states": states.withColumn("state_name", F.upper("state_name")),
        "counties": counties.withColumn("county_key", county_key("county_name", "state_fips")),
        "aliases": named.filter("state_fips is not null").select("state_fips", "alias_key", "county_key").unionByName(every.select("state_fips", "alias_key", "county_key")).distinct(),
    }


# ---- the driver of a chain


@dataclass(frozen=True)
class IngestSpec:
    """A data set's chain: its rules by table, its normalization, its enrichment rules by table, and where tables go."""

    name: str
    rules: dict[str, list[Q.Rule]] = field(default_factory=dict)
    normalize: Callable[[Tables], Tables] = dict
    enrich: dict[str, list[EnrichmentRule]] = field(default_factory=dict)
    publish: dict[str, PublishSpec] = field(default_factory=dict)
    sla_hours: float = 24.0


class ReleaseBlocked(Exception):
    """A rule of severity critical, error or block failed. results has all rules."""

    def __init__(self, name: str, results: list):
        super().__init__(f"{name}: {', '.join(r['rule'] for r in results if not r['passed'])}")
        self.results = results


def landed(lines: DataFrame, datasets: list[str]) -> Tables:
    """Lines of a release's files by data set, told by the file's name (the archive member's if there is one)."""
    name = F.when(F.col("member") != "", F.col("member")).otherwise(F.col("path"))
    kind = routed(F.regexp_extract(name, r"([^/]+)$", 1))
    return {d: lines.filter(kind == d) for d in datasets}


def validated(tables: Tables, rules: dict[str, list[Q.Rule]]) -> DataFrame | None:
    """The results of all rules of all tables: dataset and the columns of checked()."""
    out = None
    for name, own in rules.items():
        if name in tables and own:
            one = Q.checked(tables[name], own).withColumn("dataset", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out


def _log(spark: SparkSession, folder: str, row: tuple) -> None:
    sinks.append_log(spark.createDataFrame([row], "batch_id string, release_id string, dataset string, status string, at timestamp, message string"), f"{folder}/_runs")


def _blocking(rules: list[Q.Rule]) -> list[Q.Rule]:
    return [r for r in rules if r.severity in published.BLOCKING]


def _enriched(rows: DataFrame, name: str, spec: IngestSpec, references: Tables, reports: dict) -> DataFrame:
    if not (rules := spec.enrich.get(name)):
        return rows
    out = apply_rules(rows, references, rules)
    reports[name] = rule_results(out, rules)
    return without_flags(out, rules)


def run_release(spark: SparkSession, spec: IngestSpec, tables: Tables, references: Tables, folder: str, *, release_id: str, batch_id: str, at, mode: str = "curated", strict: bool = True, clock: Callable | None = None) -> dict:
    """Normalize, split, validate, enrich and publish a release; returns its paths, rule and enrichment results and counts.

    Rows are split once: each table is written with its good and its rejected rows apart, and all that follows reads what
    was written. Rules of severity warning or info do not reject. A failed blocking rule stops a strict release; else its
    good rows go on and its rejects are quarantined by reason. One commit publishes all tables of the release together;
    a release that stops before it leaves the folder as it was, and what it had staged is deleted. The run's log gets its
    start (at) and its end (by the clock; at, where none is given). mode inline computes the same and writes nothing.
    """
    if mode not in ("inline", "curated"):
        raise ValueError(f"mode must be inline or curated, not {mode}")
    now = clock or (lambda: at)
    normal = spec.normalize(tables)
    tagged = {n: Q.tagged(df, own) if (own := _blocking(spec.rules.get(n, []))) else df.withColumns({"reject_rule": F.lit(None).cast("string"), "reject_severity": F.lit(None).cast("string")}) for n, df in normal.items()}
    reports: dict[str, DataFrame] = {}
    judge = lambda rows: [] if (checks := validated(rows, spec.rules)) is None else checks.collect()  # noqa: E731  # one row a rule
    failed = lambda results: [r for r in results if not r["passed"] and r["severity"] in published.BLOCKING]
    if mode == "inline":
        results = judge(normal)
        if (bad := failed(results)) and strict:
            raise ReleaseBlocked(spec.name, results)
        good = {n: df.filter("reject_rule is null").drop(*published.REJECT_COLUMNS) for n, df in tagged.items()}
        return {"tables": {n: _enriched(df, n, spec, references, reports) for n, df in good.items()}, "paths": {}, "rules": results, "enrichment": reports, "valid": not bad, "commit": None}

    _log(spark, folder, (batch_id, release_id, spec.name, "started", at, None))
    stage = published.Stage(spark, folder, release_id, at, at.date())
    try:
        good, rejected, parts = {}, {}, {}
        for name, df in tagged.items():
            p = spec.publish.get(name)
            parts[name] = list(p.partitions) if p else []
            good[name], rejected[name] = stage.split(p.table if p else name, df, parts[name])
        results = judge({n: good[n].unionByName(rejected[n].drop(*published.REJECT_COLUMNS)) for n in good})
        if (bad := failed(results)) and strict:
            raise ReleaseBlocked(spec.name, results)
        for name in good:
            p = spec.publish.get(name)
            stage.reject(p.table if p else name, rejected[name])
            if name in spec.enrich or (p and (p.kind != "parquet" or p.compression != "snappy")):
                good[name] = stage.write(p.table if p else name, _enriched(good[name], name, spec, references, reports), parts[name], p.kind if p else "parquet", p.compression if p else "snappy")
        for name in [t for t in stage.tables if t not in {p.table for p in spec.publish.values()}]:
            del stage.tables[name]  # tables that are only steps on the way are not published
        number = stage.commit()
    except Exception as error:
        stage.discard()
        why = ", ".join(sorted(f"{r['dataset']}.{r['rule']}" for r in failed(error.results))) if isinstance(error, ReleaseBlocked) else f"{type(error).__name__}: {error}"[:2000]
        _log(spark, folder, (batch_id, release_id, spec.name, "failed", now(), why))
        raise
    _log(spark, folder, (batch_id, release_id, spec.name, "success", now(), None))
    paths = {n: f"{folder}/{stage.tables[p.table]['path']}" for n, p in spec.publish.items() if n in good}
    return {"tables": good, "paths": paths, "rules": results, "enrichment": reports, "valid": not bad, "commit": number}


def latest_view(spark: SparkSession, spec: PublishSpec, folder: str, today) -> DataFrame:
    """The newest row in force of each key of a published table."""
    return latest_effective(published.published(spark, folder, spec.table), list(spec.keys), spec.effective, "vintage_date", as_of=today)


def missing_vintages(known: DataFrame, spark: SparkSession, first_year: int, last_year: int, letters: str = rvu.QUARTER_LETTERS) -> DataFrame:
    """year, quarter of the vintages in a span that a registry (year, quarter) lacks: what a historical load has to fetch."""
    every = spark.createDataFrame([(y, q) for y in range(first_year, last_year + 1) for q in letters], "year int, quarter string")
    return every.join(known.select(F.col("year").cast("int").alias("year"), "quarter").distinct(), ["year", "quarter"], "left_anti")


def is_stale(files: DataFrame, now, most_days: int) -> DataFrame:
    """dataset, newest file, and whether it is older than most_days."""
    age = F.datediff(F.lit(now), F.max("modified_at"))
    return files.groupBy("dataset").agg(F.max("modified_at").alias("newest"), age.alias("age_days"), (age > most_days).alias("is_stale"))


def rvu_spec(*, release_id: str, batch_id: str, year: int, quarter: int | None = None, enrich: dict[str, list[EnrichmentRule]] | None = None) -> IngestSpec:
    return IngestSpec("rvu", {d: rvu_ingest_rules(d) for d in rvu.COLUMN_MAPS}, lambda t: rvu_tables(t, release_id=release_id, batch_id=batch_id, year=year, quarter=quarter), enrich or {}, {d: PUBLISH_SPECS[d] for d in rvu.COLUMN_MAPS})


def mpfs_spec(*, release_id: str, batch_id: str, year: int, quarter: int | None = None, enrich: dict[str, list[EnrichmentRule]] | None = None) -> IngestSpec:
    """pprrvu, gpci, locco and cf (cf_type, cf_value, vintage_date, effective_from) to the six views of a fee schedule."""
    rules = {"mpfs_rvu": rvu_ingest_rules("pprrvu"), "mpfs_gpci": rvu_ingest_rules("gpci"), "mpfs_locality": rvu_ingest_rules("locco"), "mpfs_cf_vintage": [Q.Rule("factor_range", F.coalesce((F.col("cf_value") > 0) & (F.col("cf_value") <= Q.FACTOR_MAX), F.lit(False)), "critical")]}

    def normalize(t: Tables) -> Tables:
        return mpfs_views(rvu_tables({d: t[d] for d in ("pprrvu", "gpci", "locco")}, release_id=release_id, batch_id=batch_id, year=year, quarter=quarter) | {"cf": t["cf"]})

    return IngestSpec("mpfs", rules, normalize, enrich or {}, {n: PUBLISH_SPECS[n] for n in MPFS_KEYS})


def opps_rules() -> dict[str, list[Q.Rule]]:
    """The rules of both addenda and the rates: formats, known status indicators, and amounts inside their bands."""
    apc = Q.Rule("apc_format", F.coalesce(Q.matches("apc", "[0-9]{4,5}"), F.lit(False)), "critical")
    rate = Q.Rule("payment_rate_band", F.coalesce(F.col("rate").between(*Q.OPPS_BANDS["payment_rate_usd"]), F.lit(False)), "critical")
    return {
        "opps_apc_payment": [apc, rate],
        "opps_hcpcs_crosswalk": [Q.Rule("hcpcs_format", F.coalesce(Q.matches("hcpcs", "[A-Z0-9]{5}"), F.lit(False)), "critical"), Q.Rule("status_indicator_domain", F.coalesce(F.substring("status_indicator", 1, 1).isin(*Q.STATUS_INDICATORS), F.lit(False)), "critical")],
        "opps_rates_enriched": [apc, rate, Q.Rule("wage_index_band", F.col("wage_index").between(*Q.OPPS_BANDS["wage_index"]), "critical"), Q.Rule("adjusted_not_negative", F.col("wage_adjusted") >= 0, "critical")],
    }


def opps_spec(*, batch_id: str, enrich: dict[str, list[EnrichmentRule]] | None = None, **_) -> IngestSpec:
    """addendum_a, addendum_b, wage (cbsa, index) and indicators (status_indicator, si_description) of a batch opps_YYYYqN_rNN."""
    return IngestSpec("opps", opps_rules(), lambda t: opps_tables(t["addendum_a"], t["addendum_b"], t["wage"], t["indicators"], batch_id), enrich or {}, {n: PUBLISH_SPECS[n] for n in ("opps_apc_payment", "opps_hcpcs_crosswalk", "opps_rates_enriched")})


def _untagged(df: DataFrame) -> DataFrame:
    return df.drop(*published.REJECT_COLUMNS)


def zip9_spec(*, effective_from, effective_to=None, vintage: str, enrich: dict[str, list[EnrichmentRule]] | None = None, **_) -> IngestSpec:
    """lines of the ZIP9 file (see readers) to overrides by state."""
    rules = [r for r in Q.zip9_rules() if r.name != "completeness"]
    return IngestSpec("zip9", {"zip9_overrides": rules}, lambda t: {"zip9_overrides": _untagged(zip9_table(t["lines"], effective_from=effective_from, effective_to=effective_to, vintage=vintage))}, enrich or {}, {"zip9_overrides": PUBLISH_SPECS["zip9_overrides"]})


def zip_locality_spec(*, effective_from, effective_to=None, vintage: str, enrich: dict[str, list[EnrichmentRule]] | None = None, **_) -> IngestSpec:
    """rows of the ZIP-to-locality file, under its own or the canonical column names, by state."""
    return IngestSpec("zip_locality", {"cms_zip_locality": zip_locality_rules()}, lambda t: {"cms_zip_locality": _untagged(zip_locality_table(t["rows"], effective_from=effective_from, effective_to=effective_to, vintage=vintage))}, enrich or {}, {"cms_zip_locality": PUBLISH_SPECS["cms_zip_locality"]})


#: The chains that a name can ask for.
SPECS: dict[str, Callable[..., IngestSpec]] = {"rvu": rvu_spec, "mpfs": mpfs_spec, "opps": opps_spec, "zip9": zip9_spec, "zip_locality": zip_locality_spec}
