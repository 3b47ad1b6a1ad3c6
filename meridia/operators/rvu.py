"""Relative-value files: column maps, indicator maps, derived facts, dates by vintage and inference of factor types."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import quarter_bounds
from ..functions.text import canonical_number, number, strip, zero_pad

#: Source column -> column and type, for the five files of a release.
COLUMN_MAPS: dict[str, dict[str, tuple[str, str]]] = {
    "pprrvu": {
        "HCPCS": ("hcpcs", "string"), "MODIFIER": ("modifier", "string"), "STATUS": ("status_code", "string"), "GLOBAL_DAYS": ("global_days", "string"), "WORK_RVU": ("rvu_work", "double"),
        "PE_NONFAC_RVU": ("rvu_pe_nonfac", "double"), "PE_FAC_RVU": ("rvu_pe_fac", "double"), "MALP_RVU": ("rvu_malp", "double"), "NA_INDICATOR": ("na_indicator", "string"), "OPPS_CAP": ("opps_cap_applicable", "yes_no"),
    },
    "gpci": {"LOCALITY": ("locality_code", "string"), "STATE": ("state_fips", "string"), "WORK_GPCI": ("gpci_work", "double"), "PE_GPCI": ("gpci_pe", "double"), "MALP_GPCI": ("gpci_malp", "double")},
    "oppscap": {"HCPCS": ("hcpcs", "string"), "MODIFIER": ("modifier", "string"), "CAP_APPLIES": ("opps_cap_applies", "yes_no"), "CAP_AMOUNT": ("cap_amount_usd", "double"), "CAP_METHOD": ("cap_method", "string")},
    "anes": {"LOCALITY": ("locality_code", "string"), "STATE": ("state_fips", "string"), "CF_AMOUNT": ("anesthesia_cf_usd", "double")},
    "locco": {"LOCALITY": ("locality_code", "string"), "STATE": ("state_fips", "string"), "COUNTY": ("county_fips", "string"), "LOCALITY_NAME": ("locality_name", "string")},
}
#: The natural keys of the five files.
NATURAL_KEYS = {"pprrvu": ("hcpcs", "modifier", "effective_from"), "gpci": ("locality_code", "state_fips", "effective_from"), "oppscap": ("hcpcs", "modifier", "effective_from"), "anes": ("locality_code", "state_fips", "effective_from"), "locco": ("locality_code", "state_fips", "county_fips", "effective_from")}
PAYABLE, QUARTER_LETTERS = ("A", "R", "T"), "ABCD"


def yes_no(c: str | Column) -> Column:
    """True for Y, false for N, null for anything else."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x == "Y", True).when(x == "N", False)


def rural(c: str | Column) -> Column:
    """True for A and B, null for anything else."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin("A", "B"), True)


def _cast(c: str, kind: str) -> Column:
    return yes_no(c) if kind == "yes_no" else number(c) if kind == "double" else F.col(c)


def mapped(df: DataFrame, dataset: str) -> DataFrame:
    """The columns of a release file under their canonical names and types; other columns stay, absent ones are not made."""
    names = COLUMN_MAPS[dataset]
    return df.select(*[_cast(c, names[c][1]).alias(names[c][0]) if c in names else F.col(c) for c in df.columns])


def remapped(df: DataFrame, columns: dict[str, str], *, transforms: dict[str, Callable[[Column], Column]] | None = None, types: dict[str, str] | None = None, required: dict[str, object] | None = None) -> DataFrame:
    """Adapter mapping: rename, transform, cast (null where it fails), and a default for required columns that are absent.

    columns: source -> name. transforms: name -> function of a column. types: name -> Spark type.
    """
    out = df.withColumnsRenamed(columns)
    for name, f in (transforms or {}).items():
        if name in out.columns:
            out = out.withColumn(name, f(F.col(name)))
    for name, kind in (types or {}).items():
        if name in out.columns:
            out = out.withColumn(name, F.col(name).try_cast(kind))
    for name, value in (required or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out


def derived_facts(items: DataFrame) -> DataFrame:
    """total_rvu (null unless all three parts are there), is_payable and payment_category of relative-value items."""
    work, status = F.col("rvu_work"), F.col("status_code")
    category = F.when(status == "A", F.when(work > 0, "surgery").otherwise("evaluation")).when(status == "R", "radiology").when(status == "T", "therapy").otherwise("other")
    return items.withColumns({"total_rvu": work + F.col("rvu_pe_nonfac") + F.col("rvu_malp"), "is_payable": F.coalesce(status.isin(*PAYABLE) & (work > 0), F.lit(False)), "payment_category": category})


def vintage_date(vintage: str | Column) -> Column:
    """The first day of a vintage such as 2025A: the letters A to D are quarters, and a year alone begins in January."""
    v = F.upper(strip(vintage))
    year, letter = F.regexp_extract(v, r"(20\d{2})", 1).try_cast("int"), F.regexp_extract(v, r"20\d{2}[_ -]?([A-D])", 1)
    month = F.when(letter == "", 1).otherwise((F.ascii(letter) - 65) * 3 + 1)
    return F.when(year.isNotNull(), F.make_date(year, month, F.lit(1)))


def gpci_casts(df: DataFrame, vintage: str) -> DataFrame:
    """Indices as text of three decimals, localities of two digits, and the vintage's date where none is given."""
    out = df.withColumns({c: canonical_number(c, 3) for c in ("gpci_work", "gpci_pe", "gpci_mp") if c in df.columns})
    day = vintage_date(F.lit(vintage))
    return out.withColumns({"locality_code": zero_pad(strip("locality_code"), 2), "effective_from": F.coalesce("effective_from", day) if "effective_from" in df.columns else day})


def rvu_casts(df: DataFrame, effective_from) -> DataFrame:
    """Codes stripped and in upper case, an empty modifier null, amounts of two decimals, global days a number or 0, and the date."""
    out = df.withColumns({c: F.nullif(F.upper(strip(c)), F.lit("")) for c in ("hcpcs", "modifier", "status_code") if c in df.columns})
    out = out.withColumns({c: number(c).cast("decimal(18,6)").cast("decimal(18,2)").cast("double") for c in ("rvu_work", "rvu_pe_nonfac", "rvu_pe_fac", "rvu_malp") if c in df.columns})
    days = {"global_days": F.coalesce(strip("global_days").try_cast("int"), F.lit(0))} if "global_days" in df.columns else {}
    return out.withColumns({**days, "effective_from": F.lit(effective_from)})


def factor_type(df: DataFrame, filename: Column, *, given: str | None = None, description: str | None = "cf_description") -> Column:
    """The type of a conversion-factor file: what is given, else hints in the file name, else in its descriptions, else physician."""
    if given:
        return F.lit(given)
    name = F.lower(filename)
    out = F.when(name.contains("anes"), "anesthesia").when(name.contains("phys"), "physician")
    if description and description in df.columns:
        out = out.when(F.lower(description).contains("anes"), "anesthesia")
    return out.otherwise("physician")


def year_windows(spark: SparkSession, year: int) -> DataFrame:
    """dataset, effective_from, effective_to of the data sets that come out by a fixed calendar."""
    rows = [(f"ZIP_LOCALITY_Q{q}", *quarter_bounds(year, q)) for q in (1, 2, 3, 4)]
    rows += [(name, dt.date(year, 1, 1), dt.date(year, 12, 31)) for name in ("GPCI_ANNUAL", "CONVERSION_FACTOR_ANNUAL", "MPFS_ANNUAL")]
    return spark.createDataFrame(rows, "dataset string, effective_from date, effective_to date")


def batch_parts(batch_id: str | Column) -> Column:
    """year, quarter, release, effective_from, effective_to of ids such as opps_2025q1_r02; null where an id is none."""
    c = F.col(batch_id) if isinstance(batch_id, str) else batch_id
    pattern = r"^opps_(\d{4})q([1-4])_r(\d+)$"
    part = lambda i: F.regexp_extract(c, pattern, i).try_cast("int")
    first = F.make_date(part(1), part(2) * 3 - 2, F.lit(1))
    return F.when(c.rlike(pattern), F.struct(part(1).alias("year"), part(2).alias("quarter"), part(3).alias("release"), first.alias("effective_from"), F.last_day(F.add_months(first, 2)).alias("effective_to")))


def stamped(df: DataFrame, *, release_id: str, batch_id: str, year: int, quarter: int | None = None, source_file: str | None = None, parsed_at=None) -> DataFrame:
    """df with the metadata that every table of a release carries."""
    low, high = quarter_bounds(year, quarter) if quarter else (dt.date(year, 1, 1), dt.date(year, 12, 31))
    more = {"release_id": F.lit(release_id), "batch_id": F.lit(batch_id), "product_year": F.lit(year), "quarter_vintage": F.lit(f"{year}{QUARTER_LETTERS[quarter - 1] if quarter else ''}"), "vintage_date": F.lit(low)}
    if "effective_from" not in df.columns:
        more |= {"effective_from": F.lit(low), "effective_to": F.lit(high)}
    if source_file:
        more["source_filename"] = F.lit(source_file)
    more["parsed_at"] = F.lit(parsed_at) if parsed_at else F.current_timestamp()
    return df.withColumns(more)
