"""Enrichment by rules: each rule joins one reference table, fills defaults, and reports its rate and quality.

A rule is applied in one join on all its keys. Results are one row a rule, computed from the enriched rows in one pass,
so a chain of rules is one plan and no row is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import covers
from .joins import enriched

STRATEGIES = ("exact", "fuzzy", "nearest", "interpolation", "fallback", "default")
#: The quality of rows that only have defaults, and the factor where completeness misses its gate.
DEFAULT_QUALITY, MISSED_GATE = 0.5, 0.8


@dataclass(frozen=True)
class EnrichmentRule:
    """keys: left name -> right name. columns: what the reference adds. confidence: text kept beside the first key."""

    name: str
    reference: str
    keys: dict[str, str]
    columns: tuple[str, ...]
    defaults: dict[str, object] = field(default_factory=dict)
    strategy: str = "exact"
    threshold: float = 0.0
    completeness_gate: float = 0.0
    confidence: str = "high"


#: The rule sets for geography and codes, with the defaults of rows without a partner.
GEOGRAPHY_RULES = (
    EnrichmentRule("zip_to_zcta", "zip_to_zcta", {"zip5": "zip5"}, ("zcta5", "relationship"), {"relationship": "unknown"}),
    EnrichmentRule("zcta_centroids", "zcta_coords", {"zcta5": "zcta5"}, ("lat", "lon", "population"), {"population": 0}),
    EnrichmentRule("state_crosswalk", "states", {"state": "state_code"}, ("state_name", "state_fips", "region")),
    EnrichmentRule("locality_info", "localities", {"locality": "locality_code"}, ("locality_name", "carrier", "rural_flag")),
)
RVU_RULES = (
    EnrichmentRule("zip_to_locality", "cms_zip_locality", {"zip5": "zip5"}, ("locality_code", "state_fips", "rural_flag"), {"locality_code": "99", "state_fips": "00", "rural_flag": "U"}, "fallback", 0.95, 0.95),
    EnrichmentRule("locality_to_gpci", "cms_gpci", {"locality_code": "locality_code", "state_fips": "state_fips"}, ("gpci_work", "gpci_pe", "gpci_malp"), {"gpci_work": 1.0, "gpci_pe": 1.0, "gpci_malp": 1.0}, "fallback", 0.90, 0.90),
    EnrichmentRule("hcpcs_descriptions", "cms_hcpcs_codes", {"hcpcs": "hcpcs"}, ("description", "category"), {"description": "Unknown", "category": "Unknown"}, "fallback", 0.98, 0.98),
    EnrichmentRule("modifier_descriptions", "cms_modifiers", {"modifier": "modifier"}, ("modifier_description",), {"modifier_description": "Unknown"}, "fallback", 0.95, 0.95),
)

Reference = Callable[[DataFrame, DataFrame, EnrichmentRule], DataFrame]


def _found(rule: EnrichmentRule) -> str:
    return f"_found_{rule.name}"


def _joined(df: DataFrame, reference: DataFrame, rule: EnrichmentRule) -> DataFrame:
    """df with the rule's columns and its flag; the reference must be unique by the rule's keys, or rows multiply as in any join."""
    kept = reference.select(*dict.fromkeys([*rule.keys.values(), *rule.columns]))
    return enriched(df.drop(*[c for c in rule.columns if c not in rule.keys]), kept, rule.keys, "left", flag=_found(rule)).withColumn(f"{next(iter(rule.keys))}_mapping_confidence", F.lit(rule.confidence))


def apply_rule(df: DataFrame, references: dict[str, DataFrame], rule: EnrichmentRule, own: dict[str, Reference] | None = None) -> DataFrame:
    """df with the rule's columns and a flag of the rows that found a partner.

    exact joins on the keys. fuzzy, nearest and interpolation join by the function given for them in `own`, else on the
    keys. fallback joins on the keys and fills defaults where the share of partners is below the threshold, default
    fills them without a join. A reference that is absent leaves the columns null and the flag false.
    """
    if rule.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {rule.strategy}")
    fill = lambda x: x.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in rule.defaults.items()})
    if rule.strategy == "default" or rule.reference not in references:
        absent = {c: F.lit(None).cast("string") for c in rule.columns if c not in df.columns and rule.defaults.get(c) is None}
        given = {c: F.lit(v) if c not in df.columns else F.coalesce(c, F.lit(v)) for c, v in rule.defaults.items()} if rule.strategy == "default" else {c: F.lit(None).cast("string") for c in rule.columns if c not in df.columns}
        return df.withColumns({**absent, **given, _found(rule): F.lit(False)})
    join = (own or {}).get(rule.strategy, _joined)
    out = join(df, references[rule.reference], rule)
    if rule.strategy != "fallback":
        return out
    # the share of partners is one row, so the rows are not read back to the driver to decide
    rate = F.broadcast(out.agg((F.coalesce(F.avg(F.col(_found(rule)).cast("int")), F.lit(0.0)) < rule.threshold).alias("_fill")))
    decided = out.crossJoin(rate)
    return decided.withColumns({c: F.when(F.col("_fill"), F.coalesce(c, F.lit(v))).otherwise(F.col(c)) for c, v in rule.defaults.items()}).drop("_fill")


def apply_rules(df: DataFrame, references: dict[str, DataFrame], rules: list[EnrichmentRule], own: dict[str, Reference] | None = None) -> DataFrame:
    for rule in rules:
        df = apply_rule(df, references, rule, own)
    return df


def rule_results(enriched_rows: DataFrame, rules: list[EnrichmentRule]) -> DataFrame:
    """rule, n_rows, n_enriched, rate, quality_score of each rule, in one pass over the enriched rows."""
    aggs = []
    for i, r in enumerate(rules):
        full = [F.col(c).isNotNull().cast("int") for c in r.columns]
        aggs += [F.count_if(_found(r)).alias(f"n{i}"), F.avg(sum(full, F.lit(0)) / max(1, len(full))).alias(f"q{i}")]
    one = enriched_rows.agg(F.count("*").alias("n_rows"), *aggs)
    score = lambda i, r: F.lit(DEFAULT_QUALITY) if r.strategy == "default" else F.when(F.col(f"q{i}") < r.completeness_gate, F.col(f"q{i}") * MISSED_GATE).otherwise(F.col(f"q{i}"))
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("n_enriched"), F.coalesce(score(i, r), F.lit(0.0)).alias("quality_score")) for i, r in enumerate(rules)])
    out = one.select("n_rows", F.inline(rows))
    return out.select("rule", "n_rows", "n_enriched", F.coalesce(F.try_divide("n_enriched", "n_rows"), F.lit(0.0)).alias("rate"), "quality_score")


def without_flags(df: DataFrame, rules: list[EnrichmentRule]) -> DataFrame:
    return df.drop(*[_found(r) for r in rules])


def tie_broken(df: DataFrame, tie_breaker: str) -> DataFrame:
    """Of rows that differ in the tie-breaker alone, the one where it is least (null last)."""
    others = [c for c in df.columns if c != tie_breaker]
    w = Window.partitionBy(*others).orderBy(F.asc_nulls_last(tie_breaker))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_force(reference: DataFrame, day) -> DataFrame:
    """The rows of a reference table that hold on a day, and of each table all where it has no dates."""
    if "effective_from" not in reference.columns:
        return reference
    end = F.col("effective_to") if "effective_to" in reference.columns else F.lit(None).cast("date")
    return reference.filter(covers(day, "effective_from", end))


def registered(registry: DataFrame, day) -> DataFrame:
    """Of registered reference sources (source, version, effective_from, effective_to) the newest version of each that holds on a day."""
    w = Window.partitionBy("source").orderBy(F.desc("effective_from"), F.desc("version"))
    return in_force(registry, day).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def wage_adjusted(rates: DataFrame, wage: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    """Rates with the wage index of their area and the adjusted rate; 1 where an area has no index."""
    out = rates.join(wage.select(*keys, F.col("index").alias("wage_index")), keys, "left")
    return out.withColumn("wage_index", F.coalesce("wage_index", F.lit(1.0))).withColumn("wage_adjusted", F.col(rate) * F.col("wage_index"))


def described(rows: DataFrame, lookup: DataFrame, key: str, description: str, unknown: str | Column = "Unknown") -> DataFrame:
    return rows.join(lookup.select(key, description), key, "left").withColumn(description, F.coalesce(description, F.lit(unknown) if isinstance(unknown, str) else unknown))
