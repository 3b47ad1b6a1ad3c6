"""Parsers: raw lines to typed rows, rejects and metrics, as one chain of transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code, row_hash, row_id, strip, zero_pad
from ..sources.layouts import CONVERSION_FACTOR, GPCI, LOCALITY, RVU, Contract
from ..sources.readers import fixed_width
from .quality import Rule, factor_rules, gpci_rules, rvu_rules, tagged


@dataclass
class Parsed:
    """valid and rejected rows come from one tagged plan; metrics has one row."""

    rows: DataFrame
    contract: Contract

    @property
    def valid(self) -> DataFrame:
        return self.rows.filter("reject_rule is null").drop("reject_rule", "reject_severity")

    @property
    def rejects(self) -> DataFrame:
        return self.rows.filter("reject_rule is not null")

    @property
    def metrics(self) -> DataFrame:
        n = F.count("*")
        numbers = [a for f in self.contract.fields if f.kind == "double" for a in (F.min(f.name).alias(f"{f.name}_min"), F.max(f.name).alias(f"{f.name}_max"), F.avg(f.name).alias(f"{f.name}_mean"))]
        return self.rows.agg(n.alias("n_rows"), F.count("reject_rule").alias("n_rejects"), F.try_divide(F.count("reject_rule"), n).alias("reject_rate"), *numbers)


def _duplicates(df: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """All members of a repeated natural key get the rule natural_key, unless another rule rejected them."""
    repeated = df.filter("reject_rule is null").groupBy(*keys).count().filter("count > 1").withColumn("_dup", F.lit(True)).drop("count")
    renamed = repeated.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = one if cond is None else cond & one
    hit = F.col("_dup") & F.col("reject_rule").isNull()
    marked = df.join(renamed, cond, "left")
    return marked.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("reject_rule", F.when(F.col("_hit"), "natural_key").otherwise(F.col("reject_rule"))).withColumn("reject_severity", F.when(F.col("_hit"), severity).otherwise(F.col("reject_severity"))).drop("_hit", "_dup", *[f"_k_{k}" for k in keys])


def finished(df: DataFrame, contract: Contract, keys: list[str]) -> DataFrame:
    """Content hash and row id; sort with sorted_by_key where a file needs an order."""
    columns = [f.name for f in contract.fields if f.name in df.columns]
    places = {f.name: f.places for f in contract.fields if f.places is not None}
    return df.withColumn("row_content_hash", row_hash(df, columns, places)).withColumn("row_id", row_id(df, [k for k in keys if k in df.columns]))


def sorted_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys], "row_content_hash")


def parse_rvu(lines: DataFrame, effective_from, *, rules: list[Rule] | None = None) -> Parsed:
    """Relative-value items of fixed-width lines. Duplicate keys block; rules default to the code and status formats."""
    rows = fixed_width(lines, RVU).withColumns({"hcpcs": code("hcpcs"), "modifier": code("modifier"), "status_code": code("status_code"), "effective_from": F.lit(effective_from)})
    names = {"rvu_work": "work_rvu", "rvu_pe_nonfac": "pe_rvu_nonfac", "rvu_pe_fac": "pe_rvu_fac", "rvu_malp": "mp_rvu"}
    own = rules if rules is not None else [r for r in rvu_rules() if r.name in ("hcpcs_length", "hcpcs_format", "status_present", "rvu_not_negative")]
    checked = tagged(rows.withColumnsRenamed(names), own).withColumnsRenamed({v: k for k, v in names.items()})
    keys = list(RVU.keys)
    return Parsed(_duplicates(finished(checked, RVU, keys), keys, "block"), RVU)


def parse_gpci(lines: DataFrame, effective_from, *, keys: list[str] | None = None) -> Parsed:
    """Geographic indices: lines that begin with five digits; hard band rejects; duplicate keys are warnings."""
    rows = fixed_width(lines.filter(F.col("line").rlike("^\\d{5}")), GPCI)
    rows = rows.withColumns({"locality_code": zero_pad(strip("locality_code"), 2), "effective_from": F.lit(effective_from)})
    named = {"gpci_work": "work", "gpci_pe": "pe", "gpci_mp": "mp", "locality_code": "locality"}
    own = [r for r in gpci_rules() if r.name in ("gpci_hard_band", "locality_format")]
    checked = tagged(rows.withColumnsRenamed(named), own).withColumnsRenamed({v: k for k, v in named.items()})
    keys = keys or list(GPCI.keys)
    return Parsed(_duplicates(finished(checked, GPCI, keys), keys, "warning"), GPCI)


def parse_conversion_factors(rows: DataFrame, year: int, known: dict[str, float]) -> Parsed:
    """Conversion factors already split into columns; a missing date is the first of the year."""
    import datetime as dt

    given = rows.withColumns({"cf_type": F.lower(strip("cf_type")), "effective_from": F.coalesce("effective_from", F.lit(dt.date(year, 1, 1)))})
    keys = list(CONVERSION_FACTOR.keys)
    return Parsed(_duplicates(finished(tagged(given, factor_rules(year, known)), CONVERSION_FACTOR, keys), keys, "block"), CONVERSION_FACTOR)


def parse_localities(lines: DataFrame, states: list[str]) -> DataFrame:
    """Locality lines with the state carried down to its continuation lines, in file order. Longest state name wins."""
    rows = fixed_width(lines.filter(F.trim("line") != ""), LOCALITY)
    named = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper("state_name"), "STATEWIDE", ""), "WIDE", ""), "STATE", ""))
    state = F.coalesce(*[F.when(named.startswith(s), F.lit(s)) for s in sorted((s.upper() for s in states), key=lambda s: (-len(s), s))])
    w = Window.partitionBy("path", "member").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("state_name", F.last(state, ignorenulls=True).over(w))
    return filled.filter(F.col("mac").rlike("^\\d{5}") & F.col("locality_code").isNotNull()).withColumn("locality_code", zero_pad("locality_code", 2))
