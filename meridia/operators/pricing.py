"""Pricing of claim lines under seven payment systems, as one plan for all lines.

Amounts are binary doubles, evaluated in a fixed order, and each amount is cut to whole cents on its own; totals add
cents. A line that finds no fee becomes a row with a reject reason, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import overlaps
from ..functions.text import strip
from .windows import first_by

#: Factors of modifiers, statuses whose payment is part of another line, coinsurance, the inpatient
#: deductible in dollars, the mark-up on average sales prices.
MODIFIER_FACTORS = {"-50": 1.5, "-51": 0.5}
PACKAGED_STATUSES = ("N", "J1", "Q1", "Q2", "Q3")
COINSURANCE, INPATIENT_DEDUCTIBLE, SALES_PRICE_FACTOR = 0.20, 1600.0, 1.06
SETTINGS = ("MPFS", "OPPS", "ASC", "IPPS", "CLFS", "DMEPOS", "DRUGS")
RURAL_FLAGS = ("R", "B")


def dbl(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def cents(amount: Column) -> Column:
    """Whole cents, cut towards zero."""
    return (amount * 100).cast("long")


def modifier_factor(modifiers: Column) -> Column:
    """The product over an array of modifiers; unknown ones count 1 and repeated ones count each time."""
    given = F.coalesce(modifiers, F.array().cast("array<string>"))
    # occurrences are counted by sizes, which compile, and not by a lambda, which is interpreted; the factors' powers are exact
    out = dbl(1)
    for name, x in MODIFIER_FACTORS.items():
        out = out * F.pow(dbl(x), (F.size(given) - F.size(F.array_remove(given, name))).cast("double"))
    return out


def modifiers_of(c: str | Column) -> Column:
    """An array of upper-case modifiers from an array or a comma-separated text."""
    x = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(x, ","), lambda m: F.upper(strip(m))), lambda m: m != "")


def practice_expense(pos: Column, nonfacility: Column, facility: Column) -> Column:
    """Non-facility expense where the place of service is 11 to 21 as text; the facility one elsewhere and where it is missing."""
    return F.when(pos.between("11", "21"), nonfacility).otherwise(facility)


def component_amount(work: Column, pe: Column, mp: Column, gw: Column, gp: Column, gm: Column, factor: Column) -> Column:
    zero = lambda c: F.coalesce(c, dbl(0))
    return ((zero(work) * gw) + (zero(pe) * gp) + (zero(mp) * gm)) * factor


def is_packaged(status: Column) -> Column:
    return F.coalesce(status.isin(*PACKAGED_STATUSES), F.lit(False))


def cost_shares(allowed: Column, deductible: Column, coinsurance: float = COINSURANCE) -> tuple[Column, Column, Column, Column]:
    """(deductible, coinsurance, beneficiary, program) amounts of an allowed amount."""
    ded = F.least(deductible, allowed)
    coins = (allowed - ded) * dbl(coinsurance)
    return ded, coins, ded + coins, allowed - (ded + coins)


def with_cents(df: DataFrame, allowed: str, deductible: Column | float = 0.0, coinsurance: Column | None = None) -> DataFrame:
    """Add allowed, deductible, coinsurance, beneficiary and program cents; df has the allowed amount in dollars."""
    ded = F.least(deductible if isinstance(deductible, Column) else dbl(deductible), F.col(allowed))
    coins = (F.col(allowed) - ded) * (coinsurance if coinsurance is not None else dbl(COINSURANCE))
    return df.withColumns(
        {
            "allowed_cents": cents(F.col(allowed)),
            "beneficiary_deductible_cents": cents(ded),
            "beneficiary_coinsurance_cents": cents(coins),
            "beneficiary_total_cents": cents(ded + coins),
            "program_payment_cents": cents(F.col(allowed) - (ded + coins)),
        }
    )


def components(raw: DataFrame, line_no: str) -> DataFrame:
    """Plan components with defaults: stripped codes, upper-case settings, units 1, weight 1, both parts."""
    flag = lambda c, default: F.coalesce(F.when(F.lower(F.col(c).cast("string")).isin("true", "1", "yes", "y", "t"), True).when(F.lower(F.col(c).cast("string")).isin("false", "0", "no", "n", "f"), False), F.lit(default))
    return raw.withColumns(
        {
            "code": strip("code"),
            "setting": F.upper(strip("setting")),
            "units": F.coalesce(F.col("units").cast("string").try_cast("double"), dbl(1)),
            "utilization_weight": F.coalesce(F.col("utilization_weight").cast("string").try_cast("double"), dbl(1)),
            "professional_component": flag("professional_component", True),
            "facility_component": flag("facility_component", True),
            "sequence": F.coalesce(F.col("sequence").cast("string").try_cast("int"), F.col(line_no).cast("int") + 1),
        }
    )


#: The schedule of each setting: its table, the values that its formula names (in order), and the other tables that it needs.
SCHEDULES = {
    "MPFS": ("mpfs", ("work_rvu", "pe_nonfacility_rvu", "pe_facility_rvu", "malpractice_rvu"), ("gpci", "cf")),
    "OPPS": ("opps", ("rate",), ("wage",)),
    "ASC": ("asc", ("rate",), ()),
    "IPPS": ("ipps", ("weight",), ("wage", "ipps_base")),
    "CLFS": ("clfs", ("fee",), ()),
    "DMEPOS": ("dmepos", ("fee",), ()),
    "DRUGS": ("asp", ("per_unit",), ()),
}
_VALUES = max(len(v) for _, v, _ in SCHEDULES.values())


def in_period(fees: DataFrame, keys: list[str], low, high) -> DataFrame:
    """Of the rows of each key that overlap a period the one that began last (then by all other columns upwards)."""
    others = [F.asc_nulls_last(c) for c in fees.columns if c not in ("effective_from", *keys)]
    return first_by(fees.filter(overlaps(low, high, "effective_from", "effective_to")), keys, [F.desc_nulls_last("effective_from"), *others]).drop("effective_from", "effective_to")


def schedule_table(refs: dict[str, DataFrame], low, high) -> DataFrame | None:
    """All schedules as one table: setting, code, rural ('' where a schedule has no such key), status, v0, v1, ...; a row for each key.

    A setting whose own or needed tables are absent has no rows; None where none has.
    """
    out = None
    for setting, (table, values, needed) in SCHEDULES.items():
        if not {table, *needed} <= refs.keys():
            continue
        fees = refs[table]
        rural = F.col("rural").cast("string") if "rural" in fees.columns else F.lit("")
        status = F.col("status").cast("string") if "status" in fees.columns else F.lit(None).cast("string")
        own = [F.col(values[i]).cast("double") if i < len(values) else F.lit(None).cast("double") for i in range(_VALUES)]
        one = fees.select(F.lit(setting).alias("setting"), "code", rural.alias("rural"), "effective_from", "effective_to", status.alias("status"), *[c.alias(f"v{i}") for i, c in enumerate(own)])
        out = one if out is None else out.unionByName(one)
    return None if out is None else in_period(out, ["setting", "code", "rural"], low, high)


def _globals(refs: dict[str, DataFrame], low, high) -> DataFrame | None:
    """setting, g0, g1: the conversion factor and the base rates, a row for each of the two settings that have one."""
    out = None
    if "cf" in refs:
        kind = "source" if "source" in refs["cf"].columns else "cf_type"
        out = in_period(refs["cf"].filter(F.col(kind) == "MPFS").select(F.lit("MPFS").alias("setting"), F.col("value").cast("double").alias("g0"), F.lit(None).cast("double").alias("g1"), "effective_from", "effective_to"), ["setting"], low, high)
    if "ipps_base" in refs:
        base = in_period(refs["ipps_base"].select(F.lit("IPPS").alias("setting"), F.col("operating").cast("double").alias("g0"), F.col("capital").cast("double").alias("g1"), "effective_from", "effective_to"), ["setting"], low, high)
        out = base if out is None else out.unionByName(base)
    return out


def _by_setting(values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("setting") == s, v) for s, v in values.items()])


PRICED = ("allowed_cents", "beneficiary_deductible_cents", "beneficiary_coinsurance_cents", "beneficiary_total_cents", "program_payment_cents", "professional_allowed_cents", "facility_allowed_cents")


def priced(lines: DataFrame, refs: dict[str, DataFrame], low, high, *, deductible: float = 0.0) -> DataFrame:
    """Price every line. refs: mpfs, gpci, cf, opps, wage, asc, ipps, ipps_base, clfs, dmepos, asp (any may be missing).

    lines: line_id, setting, code, locality, cbsa, rural_flag, pos, units, utilization_weight, modifiers (array),
    professional_component. Each reference table has effective_from, effective_to and the columns its formula names.
    Lines are read once: all schedules are one table keyed by setting, code and rural flag, picked once for the period,
    and a line meets its fee, its locality's and area's indexes and its setting's factor by equal keys. Every line comes
    out once: without a fee, of a setting whose tables are absent, or of none that is known, it has a reject reason and
    null amounts.
    """
    given = [s for s, (table, _, needed) in SCHEDULES.items() if {table, *needed} <= refs.keys()]
    df = lines.withColumn("_rural", F.when(F.col("setting") == "DMEPOS", F.coalesce(F.col("rural_flag").isin(*RURAL_FLAGS), F.lit(False)).cast("string")).otherwise(""))

    def met(df: DataFrame, right: DataFrame | None, keys: dict[str, str], values: dict[str, str]) -> DataFrame:
        """df with the values of the one row of right that has its keys; null where there is none, or no table."""
        if right is None:
            return df.withColumns({name: F.lit(None).cast("string" if name == "_status" else "boolean" if name == "_found" else "double") for name in values})
        r = right.select(*[F.col(b).alias(f"_key_{b}") for b in keys.values()], *[F.col(c).alias(name) for name, c in values.items()])
        on = [F.col(a) == F.col(f"_key_{b}") for a, b in keys.items()]
        return df.join(r, on, "left").drop(*[f"_key_{b}" for b in keys.values()])

    fees = schedule_table(refs, low, high)
    df = met(df, None if fees is None else fees.withColumn("found", F.lit(True)), {"setting": "setting", "code": "code", "_rural": "rural"}, {"_found": "found", "_status": "status", **{f"_v{i}": f"v{i}" for i in range(_VALUES)}})
    df = met(df, in_period(refs["gpci"], ["locality"], low, high) if "gpci" in refs else None, {"locality": "locality"}, {"_gw": "work", "_gp": "pe", "_gm": "mp"})
    df = met(df, in_period(refs["wage"], ["cbsa"], low, high) if "wage" in refs else None, {"cbsa": "cbsa"}, {"_wage": "index"})
    df = met(df, _globals(refs, low, high), {"setting": "setting"}, {"_g0": "g0", "_g1": "g1"})

    v, wage = [F.col(f"_v{i}") for i in range(_VALUES)], F.col("_wage")
    amount = _by_setting({
        "MPFS": component_amount(v[0], practice_expense(F.col("pos"), v[1], v[2]), v[3], F.col("_gw"), F.col("_gp"), F.col("_gm"), F.col("_g0")),
        "OPPS": v[0] * wage, "ASC": v[0], "IPPS": v[0] * (F.col("_g0") * wage + F.col("_g1") * wage), "CLFS": v[0], "DMEPOS": v[0], "DRUGS": v[0] * dbl(SALES_PRICE_FACTOR),
    })
    packaged = (F.col("setting") == "OPPS") & is_packaged(F.col("_status"))
    inpatient = F.col("setting") == "IPPS"
    scaled = F.when(F.col("_found"), amount) * modifier_factor(F.col("modifiers")) * F.col("units") * F.col("utilization_weight")
    df = df.withColumn("packaged", packaged).withColumn("allowed", F.when(packaged, dbl(0)).otherwise(scaled))
    df = with_cents(df, "allowed", F.when(inpatient, dbl(INPATIENT_DEDUCTIBLE)).otherwise(dbl(deductible)), F.when(inpatient, dbl(0)).otherwise(dbl(COINSURANCE)))
    professional = F.col("setting").isin("MPFS", "CLFS", "DMEPOS", "DRUGS")
    nothing = F.when(F.col("allowed_cents").isNotNull(), F.lit(0).cast("long"))

    ref = lambda *parts: F.concat_ws("_", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    year, code = F.year(F.lit(high)), F.col("code")
    traces = {
        "MPFS": [ref("mpfs", year, F.col("locality"), code), ref("gpci", year, F.col("locality")), ref("cf", year, "MPFS")],
        "OPPS": [ref("opps", year, code), ref("wage_index", year, F.col("cbsa"))], "ASC": [ref("asc", year, code)],
        "IPPS": [ref("ipps", year, code), ref("ipps_base", year), ref("wage_index", year, F.col("cbsa"))], "CLFS": [ref("clfs", year, code)],
        "DMEPOS": [ref("dmepos", year, code, F.col("_rural"))], "DRUGS": [ref("asp", year, code)],
    }
    known, with_table = (F.coalesce(F.col("setting").isin(*names), F.lit(False)) if names else F.lit(False) for names in (SETTINGS, given))
    reason = F.when(~known, "unknown setting").when(~with_table, "no table for this setting").when(F.col("allowed").isNull(), "no fee for this code and period")
    df = df.withColumns({
        "professional_allowed_cents": F.when(professional & F.col("professional_component"), F.col("allowed_cents")).otherwise(nothing),
        "facility_allowed_cents": F.when(~professional, F.col("allowed_cents")).otherwise(nothing),
        "trace_refs": F.when(with_table, _by_setting({s: F.array(*x) for s, x in traces.items()})), "reject_reason": reason,
    })
    return df.select(*lines.columns, "packaged", *PRICED, "trace_refs", "reject_reason")


TOTALS = ("allowed_cents", "beneficiary_deductible_cents", "beneficiary_coinsurance_cents", "beneficiary_total_cents", "program_payment_cents")


def plan_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the lines' cents, which are already whole; and whether any line is priced for its facility, where that is told."""
    more = [F.coalesce(F.bool_or("facility_specific"), F.lit(False)).alias("facility_specific")] if "facility_specific" in lines.columns else []
    return lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), *[F.sum(c).alias(c) for c in TOTALS], *more)


def price_single(spark, refs: dict[str, DataFrame], low, high, *, code: str | int, setting: str, locality, cbsa, rural_flag: str | None = None, pos: str = "11", units: float = 1.0, modifiers: list[str] | None = None) -> DataFrame:
    """The one row of a single code; an unknown setting is an error."""
    if setting not in SETTINGS:
        raise ValueError(f"unknown setting {setting}")
    row = [(1, setting, locality, cbsa, rural_flag, pos, float(units), 1.0, list(modifiers or []), True)]
    kinds = {int: "int", str: "string"}
    line = spark.createDataFrame(row, f"line_id int, setting string, locality {kinds[type(locality)]}, cbsa {kinds[type(cbsa)]}, rural_flag string, pos string, units double, utilization_weight double, modifiers array<string>, professional_component boolean")
    return priced(line.withColumn("code", F.lit(code)), refs, low, high)


def percent_change(a: Column, b: Column) -> Column:
    """(b - a) / a in percent: 0 if both are 0, infinite if only a is."""
    return F.when((a == 0) & (b == 0), dbl(0)).when(a == 0, dbl(float("inf"))).otherwise((b - a) * dbl(100) / a)


def compared(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """b against a, key by key; a side without the key counts 0, and both_present tells."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in measures], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in measures], F.lit(True).alias("_b"))
    out = left.join(right, keys, "full").withColumn("both_present", F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for m in measures:
        out = out.withColumn(f"{m}_delta", zero(f"{m}_b") - zero(f"{m}_a")).withColumn(f"{m}_percent", percent_change(zero(f"{m}_a"), zero(f"{m}_b")))
    return out


def compared_sides(df: DataFrame, keys: list[str], side: Column, measures: list[str]) -> DataFrame:
    """compared() of the sums of two sides of one table (side: 'a', 'b', or null for neither), in one aggregate."""
    own = df.withColumn("_side", side).filter(F.col("_side").isin("a", "b"))
    sums = [F.sum(F.when(F.col("_side") == x, F.col(m))).alias(f"{m}_{x}") for m in measures for x in "ab"]
    out = own.groupBy(*keys).agg(*sums, (F.count_if(F.col("_side") == "a") * F.count_if(F.col("_side") == "b") > 0).alias("both_present"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for m in measures:
        out = out.withColumn(f"{m}_delta", zero(f"{m}_b") - zero(f"{m}_a")).withColumn(f"{m}_percent", percent_change(zero(f"{m}_a"), zero(f"{m}_b")))
    return out


def facility_rates(lines: DataFrame, rates: DataFrame, low, high) -> DataFrame:
    """Lines with the negotiated rate of their facility, payer and plan where one is in force, and what it was found by.

    rates: ccn, payer, plan, code, rate, effective_from, effective_to. A rate of the plan comes before one of the payer
    (plan null), and that before one of the facility (both null).
    """
    keys = ["ccn", "code"]
    held = rates.filter(overlaps(low, high, "effective_from", "effective_to"))
    level = F.when(F.col("_plan").isNotNull(), 0).when(F.col("_payer").isNotNull(), 1).otherwise(2)
    r = held.select(*keys, F.col("payer").alias("_payer"), F.col("plan").alias("_plan"), F.col("rate").alias("_rate"), F.col("effective_from").alias("_from"))
    fits = (F.col("_payer").isNull() | (F.col("_payer") == F.col("payer"))) & (F.col("_plan").isNull() | (F.col("_plan") == F.col("plan")))
    # the rate depends on these four alone, so it is looked up once for each different set of them
    asked = [*keys, "payer", "plan"]
    met = lines.select(*asked).distinct().join(r, keys).filter(fits)
    best = met.groupBy(*asked).agg(F.min(F.struct(level.alias("level"), (-F.unix_date("_from")).alias("age"), F.col("_rate").alias("rate"))).alias("b"))
    name = F.get(F.array(F.lit("plan"), F.lit("payer"), F.lit("facility")), F.col("b.level"))
    found = best.select(*[F.col(c).alias(f"_k_{c}") for c in asked], F.col("b.rate").alias("facility_rate"), name.alias("facility_rate_by"))
    same = [F.col(c) == F.col(f"_k_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("payer", "plan")]
    return lines.join(found, same, "left").drop(*[f"_k_{c}" for c in asked])


def drug_reference_price(lines: DataFrame, nadac: DataFrame, conversion: DataFrame) -> DataFrame:
    """Add nadac_reference: the newest unit price of the line's NDC times units per code, units and weight."""
    # of two prices of one day the higher
    newest = nadac.groupBy("ndc11").agg(F.max(F.struct("as_of", "unit_price")).alias("n")).select("ndc11", F.col("n.unit_price").alias("unit_price"), F.col("n.as_of").alias("nadac_as_of"))
    out = lines.join(newest, "ndc11", "left").join(conversion.select("ndc11", "code", "units_per_hcpcs"), ["ndc11", "code"], "left")
    return out.withColumn("nadac_reference", F.col("unit_price") * F.col("units_per_hcpcs") * F.col("units") * F.col("utilization_weight"))
