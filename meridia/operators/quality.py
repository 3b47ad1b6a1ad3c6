"""Data-quality rules. A rule is a predicate for good rows; all rules of a table are counted in one aggregate pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: The states, the district and the territories that a locality may be in.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY "
    "DC PR VI GU AS MP"
).split()
#: Domains and bands of fee-schedule fields.
GLOBAL_DAYS = ("000", "010", "090", "XXX", "YYY", "ZZZ", "MMM", "PPP", "QQQ", "RRR", "SSS", "TTT", "UUU", "VVV", "WWW")
SUPERVISION_CODES = ("01", "02", "03", "04", "05", "06", "09", "21", "22", "66", "6A", "77", "7A")
STATUS_INDICATORS = tuple("ABCDEFGHJKLMNPQRSTUVWXYZ")
OPPS_BANDS = {"payment_rate_usd": (0, 100_000), "relative_weight": (0, 1_000), "wage_index": (0.3, 2.0)}
PAYABLE_STATUSES = ("A", "R", "T")
INGEST_STATUSES = ("A", "R", "T", "I", "N")
GPCI_HARD_BAND, GPCI_BAND, WORK_GPCI_BAND, FACTOR_MAX, RVU_MAX = (0.20, 2.50), (0.3, 2.0), (0.1, 3.0), 200.0, 100.0
ZIP9_RURAL_FLAGS = ("A", "B")
MAX_NULL_RATE, MAX_DRIFT, MIN_COMPLETENESS = 0.05, 0.15, 0.99


@dataclass(frozen=True)
class Rule:
    """good: true, or null where a rule does not apply. A rule passes if the share of good rows reaches threshold."""

    name: str
    good: Column
    severity: str = "error"
    threshold: float = 1.0


def checked(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a rule: rule, severity, n_rows, n_failed, score, passed; one pass over df for all rules."""
    counts = [F.count_if(~r.good).alias(f"r{i}") for i, r in enumerate(rules)]
    one = df.agg(F.count("*").alias("n_rows"), *counts)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"r{i}").alias("n_failed")) for i, r in enumerate(rules)])
    score = F.coalesce(F.try_divide(F.col("n_rows") - F.col("n_failed"), F.col("n_rows").cast("double")), F.lit(1.0))
    return one.select("n_rows", F.inline(rows)).select("rule", "severity", "n_rows", "n_failed", score.alias("score"), (score >= F.col("threshold")).alias("passed"))


def failing(df: DataFrame, rule: Rule) -> DataFrame:
    return df.filter(~rule.good)


def tagged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with the first rule that a row breaks (or null) and its severity: one plan for good rows and rejects."""
    first = F.coalesce(*[F.when(~r.good, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules])
    return df.withColumn("_reject", first).withColumn("reject_rule", F.col("_reject.rule")).withColumn("reject_severity", F.col("_reject.severity")).drop("_reject")


def split(tagged_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tagged_rows.filter("reject_rule is null").drop("reject_rule", "reject_severity"), tagged_rows.filter("reject_rule is not null")


def overall(results: DataFrame) -> DataFrame:
    """Valid if no rule of severity error or critical fails; score is the share of rules that pass."""
    return results.agg(F.count("*").alias("n_rules"), F.count_if("passed").alias("n_passed"), F.round(F.try_divide(F.count_if("passed"), F.count("*")), 6).alias("score"), F.coalesce(F.bool_and(F.col("passed") | ~F.col("severity").isin("error", "critical")), F.lit(True)).alias("valid"))


def matches(c: str, pattern: str) -> Column:
    return F.col(c).rlike(f"^(?:{pattern})$")


def in_domain(c: str, values) -> Column:
    return F.col(c).isin(*values)


def zip5_rule(c: str) -> Rule:
    return Rule("zip5_format", matches(c, "[0-9]{5}"))


def state_rule(c: str) -> Rule:
    return Rule("state_domain", in_domain(c, STATES))


def locality_rule(c: str) -> Rule:
    return Rule("locality_format", matches(c, "[0-9]{2}"))


def date_rule(c: str) -> Rule:
    return Rule("date_format", F.col(c).isNull() | F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull(), "critical")


def window_rule(start: str, end: str) -> Rule:
    return Rule("window_order", F.col(end) >= F.col(start), "critical")


def future_rule(c: str, today) -> Rule:
    return Rule("no_future_date", F.col(c) <= F.lit(today), "warning", 0.95)


def zip_locality_rules(df: DataFrame, today) -> list[Rule]:
    """ZIP-to-locality files: zip5, state, locality, effective_from, effective_to (dates or ISO text), vintage.

    A missing required column, or one of another type, fails every row.
    """
    required = ("zip5", "state", "locality", "effective_from", "vintage")
    kinds = dict(df.dtypes)
    columns = F.lit(all(c in kinds for c in required))
    texts = F.lit(all(kinds.get(c, "string") == "string" for c in ("zip5", "state", "locality")))
    has = lambda c: c in kinds
    day = lambda c: F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd")
    dates = [c for c in ("effective_from", "effective_to") if has(c)]
    filled = [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in ("zip5", "state", "locality", "effective_from") if has(c)]
    given = lambda name, c, good, *more: Rule(name, F.coalesce(good, F.lit(False)) if has(c) else F.lit(False), *more)
    return [
        Rule("required_fields", columns, "critical"), Rule("data_types", texts, "critical"),
        given("zip5_format", "zip5", matches("zip5", "[0-9]{5}"), "critical"), given("state_codes", "state", F.upper("state").isin(*STATES), "critical"), given("locality_format", "locality", matches("locality", "[0-9]+"), "critical"),
        Rule("date_formats", _all([F.col(c).isNull() | day(c).isNotNull() for c in dates]), "critical"),
        Rule("effective_date_range", day("effective_to") >= day("effective_from") if len(dates) == 2 else F.lit(True), "critical"),
        Rule("future_dates", _all([day(c) <= F.lit(today) for c in dates if c == "effective_from"]), "warning", 0.95),
        Rule("completeness", _all(filled), "critical", MIN_COMPLETENESS),
    ]


def _all(goods: list[Column]) -> Column:
    out = F.lit(True)
    for g in goods:
        out = out & g
    return out


def zip_locality_results(df: DataFrame, today) -> DataFrame:
    """The results of all ten rules of ZIP-to-locality files; the tenth, unique zip5 codes in a vintage, needs a grouping."""
    rules = zip_locality_rules(df, today)
    repeats = uniqueness(df, [c for c in ("zip5", "vintage") if c in df.columns])
    score = F.coalesce(F.try_divide(F.col("n_rows") - F.col("n_duplicates"), F.col("n_rows").cast("double")), F.lit(1.0))
    one = repeats.select(F.lit("uniqueness").alias("rule"), F.lit("critical").alias("severity"), "n_rows", F.col("n_duplicates").alias("n_failed"), score.alias("score"), (score >= 1.0).alias("passed"))
    return checked(df, rules).unionByName(one)


def zip9_rules() -> list[Rule]:
    """ZIP9 ranges: zip9_low, zip9_high, state, locality, rural_flag, effective_from, effective_to."""
    filled = F.lit(True)
    for c in ("zip9_low", "zip9_high", "state", "locality", "effective_from", "vintage"):
        filled = filled & F.col(c).isNotNull()
    return [
        Rule("zip9_digits", matches("zip9_low", "[0-9]{9}") & matches("zip9_high", "[0-9]{9}"), "critical"), Rule("zip9_order", F.col("zip9_low") <= F.col("zip9_high"), "critical"), Rule("state_domain", in_domain("state", STATES), "critical"),
        Rule("locality_format", matches("locality", "[0-9]{2}"), "critical"), Rule("rural_flag", F.col("rural_flag").isNull() | in_domain("rural_flag", ZIP9_RURAL_FLAGS), "warning"), Rule("window_order", F.col("effective_to").isNull() | (F.col("effective_from") <= F.col("effective_to")), "warning"),
        Rule("one_prefix", F.substring("zip9_low", 1, 5) == F.substring("zip9_high", 1, 5), "warning"), Rule("completeness", filled, "critical"),
    ]


def rvu_rules() -> list[Rule]:
    """Relative-value items: hcpcs, status_code, work_rvu, pe_rvu_nonfac, pe_rvu_fac, mp_rvu, na_indicator, global_days, physician_supervision."""
    amounts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("work_rvu", "pe_rvu_nonfac", "pe_rvu_fac", "mp_rvu")]
    most, least = F.greatest(*amounts), F.least(*amounts)
    return [
        Rule("hcpcs_length", F.length("hcpcs") == 5), Rule("hcpcs_format", matches("hcpcs", "[A-Z0-9]{5}"), "critical"), Rule("status_present", F.col("status_code").isNotNull() & (strip("status_code") != "")), Rule("status_domain", in_domain("status_code", INGEST_STATUSES), "critical"),
        Rule("not_payable_without_rvu", in_domain("status_code", PAYABLE_STATUSES) | (most <= 0)), Rule("na_means_no_nonfacility", (F.col("na_indicator") != "1") | (amounts[1] <= 0)), Rule("global_days_domain", in_domain("global_days", GLOBAL_DAYS), "warning"),
        Rule("supervision_domain", (F.col("physician_supervision") == "") | in_domain("physician_supervision", SUPERVISION_CODES)),
        Rule("rvu_not_negative", least >= 0), Rule("rvu_range", most <= RVU_MAX, "critical"),
    ]


def gpci_rules() -> list[Rule]:
    band = lambda c, b: F.col(c).between(*b)
    every = lambda b: band("work", b) & band("pe", b) & band("mp", b)
    return [Rule("gpci_hard_band", every(GPCI_HARD_BAND), "block"), Rule("gpci_range", every(GPCI_BAND), "critical"), Rule("work_gpci_content", band("work", WORK_GPCI_BAND)), locality_rule("locality")]


def factor_rules(year: int, known: dict[str, float]) -> list[Rule]:
    """Conversion factors: cf_type, cf_value, effective_from."""
    import datetime as dt

    close = F.coalesce(*[F.when(F.col("cf_type") == k, F.abs(F.col("cf_value") - v) <= 0.0001) for k, v in known.items()], F.lit(True))
    return [Rule("cf_type_domain", in_domain("cf_type", ("physician", "anesthesia")), "block"), Rule("cf_value_range", (F.col("cf_value") > 0) & (F.col("cf_value") <= FACTOR_MAX), "block"), Rule("cf_known_value", close, "warning"), Rule("cf_date", F.col("effective_from") <= F.lit(dt.date(year + 1, 3, 31)), "warning")]


def opps_rules(columns: list[str] | None = None) -> list[Rule]:
    """Row rules of addenda A and B: hcpcs, apc, status_indicator, rate and the banded columns, of those that a table has."""
    has = lambda c: columns is None or c in columns
    rules = [("hcpcs", Rule("hcpcs_code_format", matches("hcpcs", "[A-Z0-9]{5}"), "critical")), ("apc", Rule("apc_code_format", matches("apc", "[0-9]{4}"), "critical")), ("status_indicator", Rule("status_indicator_valid", in_domain("status_indicator", STATUS_INDICATORS), "critical")), ("rate", Rule("payment_rates_positive", F.col("rate") >= 0, "critical"))]
    bands = [(c, Rule(f"{c}_range", F.col(c).between(*b), "warning")) for c, b in OPPS_BANDS.items() if columns is not None]
    return [r for c, r in [*rules, *bands] if has(c)]


#: Kinds of files that an addendum release must hold, and the endings that can be read.
OPPS_FILES, OPPS_ENDINGS = ("addendum_a", "addendum_b"), ("csv", "xls", "xlsx", "txt", "zip")


def opps_release_results(files: DataFrame, a: DataFrame, b: DataFrame, codes: DataFrame, before_a: DataFrame, before_b: DataFrame, *, columns_a: dict[str, str], columns_b: dict[str, str], most_drift: float = MAX_DRIFT) -> DataFrame:
    """All fourteen rules of an addendum release, one row each: rule, severity, n_rows, n_failed, score, passed.

    files: name, kind. a: apc, rate. b: hcpcs, modifier, apc, status_indicator, effective_from, effective_to. codes: hcpcs.
    before_a, before_b: the quarter before. columns_a, columns_b: the types that the contract asks for. The drift rules
    count a failure for each table or code whose rows, mean rate or code count changed by more than most_drift.
    """

    def one(name: str, severity: str, counts: DataFrame) -> DataFrame:
        score = F.coalesce(F.try_divide(F.col("n_rows") - F.col("n_failed"), F.col("n_rows").cast("double")), F.lit(1.0))
        return counts.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("n_rows").cast("long").alias("n_rows"), F.col("n_failed").cast("long").alias("n_failed"), score.alias("score"), (F.col("n_failed") == 0).alias("passed"))

    spark = a.sparkSession
    fixed = lambda n, failed: spark.range(1).select(F.lit(n).alias("n_rows"), F.lit(failed).alias("n_failed"))
    found = files.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in OPPS_FILES])
    present = found.select(F.lit(len(OPPS_FILES)).alias("n_rows"), sum((F.when(F.col(k) == 0, 1).otherwise(0) for k in OPPS_FILES), F.lit(0)).alias("n_failed"))
    ending = files.agg(F.count("*").alias("n_rows"), F.count_if(~F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*OPPS_ENDINGS)).alias("n_failed"))
    lacking = len(required_columns(a, list(columns_a))) + len(required_columns(b, list(columns_b)))
    mistyped = len(type_mismatches(a, columns_a)) + len(type_mismatches(b, columns_b))
    n_columns = len(columns_a) + len(columns_b)
    n_b = b.agg(F.count("*").alias("n_rows"))
    anti = lambda other, key: n_b.crossJoin(b.join(other.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_failed")))  # noqa: E731  # one row each
    windows = n_b.crossJoin(overlapping_windows(b, ["hcpcs", "modifier"], "effective_from", "effective_to").agg(F.count("*").alias("n_failed")))
    changed = lambda now, before: F.abs(now - before) > F.lit(most_drift) * F.abs(before)
    rows = drift(a, before_a, most_drift).unionByName(drift(b, before_b, most_drift)).agg(F.count("*").alias("n_rows"), F.count_if("over_limit").alias("n_failed"))
    mean = lambda df, name: df.groupBy("apc").agg(F.avg("rate").alias(name))
    rates = mean(a, "now").join(mean(before_a, "before"), "apc").agg(F.count("*").alias("n_rows"), F.count_if(changed(F.col("now"), F.col("before"))).alias("n_failed"))
    codes_of = lambda df, name: df.agg(F.count_distinct("hcpcs").alias(name))
    coverage = codes_of(b, "now").crossJoin(codes_of(before_b, "before")).select(F.lit(1).alias("n_rows"), F.coalesce(changed(F.col("now"), F.col("before")).cast("int"), F.lit(0)).alias("n_failed"))
    results = [
        one("required_files_present", "critical", present), one("file_format_valid", "critical", ending), one("required_columns_present", "critical", fixed(n_columns, lacking)), one("data_types_valid", "critical", fixed(n_columns, mistyped)),
        one("apc_referenced_in_b_exists_in_a", "critical", anti(a, "apc")), one("hcpcs_exists_for_quarter", "warning", anti(codes, "hcpcs")), one("no_overlapping_effective_ranges", "critical", windows),
        one("row_count_drift", "warning", rows), one("rate_bounded_drift", "warning", rates), one("coverage_drift", "warning", coverage),
    ]
    out = checked(b, [r for r in opps_rules(b.columns) if r.name in ("hcpcs_code_format", "apc_code_format", "status_indicator_valid")]).unionByName(checked(a, [r for r in opps_rules(a.columns) if r.name == "payment_rates_positive"]))
    for r in results:
        out = out.unionByName(r)
    return out


def mpfs_rules() -> list[Rule]:
    """Fee-schedule items: hcpcs and status formats, non-negative amounts, totals that add up."""
    amounts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("work_rvu", "pe_rvu_nonfac", "mp_rvu")]
    return [Rule("hcpcs_code_format", matches("hcpcs", "[A-Z0-9]{5}"), "critical"), Rule("status_present", F.coalesce(strip("status_code") != "", F.lit(False)), "critical"), Rule("rvu_not_negative", F.least(*amounts) >= 0), Rule("total_adds_up", F.abs(F.col("total_nonfac") - (amounts[0] + amounts[1] + amounts[2])) <= 0.015, "warning")]


def sign_rules(columns: list[str]) -> list[Rule]:
    return [Rule(f"{c}_not_negative", F.col(c) >= 0) for c in columns]


def contract_rules(texts: dict[str, str], severity: str = "error") -> list[Rule]:
    """Rules of a contract file: a name and a SQL predicate that holds for good rows."""
    return [Rule(name, F.expr(text), severity) for name, text in texts.items()]


def metadata_gaps(metadata: dict[str, object], required: list[str]) -> list[str]:
    """The required metadata that is absent or empty."""
    return [k for k in required if metadata.get(k) in (None, "")]


def layout_gaps(layout_columns: list[str], schema_columns: list[str], injected: tuple[str, ...] = ("effective_from", "release_id", "vintage_date", "row_content_hash")) -> list[str]:
    """Columns of a schema that neither the layout nor the injected metadata provides."""
    return [c for c in schema_columns if c not in layout_columns and c not in injected]


def row_count_rule(n_rows: int, low: int, high: int | None = None) -> dict[str, object]:
    """No rows is an error; a count outside the usual band is only told."""
    usual = n_rows >= low and (high is None or n_rows <= high)
    return {"rule": "row_count", "severity": "block" if n_rows == 0 else "info", "passed": n_rows > 0 and usual, "n_rows": n_rows}


def failure_samples(tagged_rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rejected rows of each rule in a total order."""
    w = Window.partitionBy("reject_rule").orderBy(*[F.asc_nulls_last(c) for c in order])
    return tagged_rows.filter("reject_rule is not null").withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n)


def ordered_rejects(rejects: DataFrame, row_id: str) -> DataFrame:
    """Rejects by column, rule and row; a rule's column is its name up to the last word where it has none of its own."""
    by = [c for c in ("reject_column", "reject_rule", row_id) if c in rejects.columns]
    return rejects.orderBy(*[F.asc_nulls_last(c) for c in by])


def overlapping_windows(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose window reaches the next one of their key (a null end reaches all)."""
    w = Window.partitionBy(*keys).orderBy(start, F.asc_nulls_last(end))
    after = df.withColumn("_next", F.lead(start).over(w))
    return after.filter(F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col("_next")))).withColumnRenamed("_next", "next_start")


def over_cap(items: DataFrame, caps: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose total is over the cap of their key; every cap row counts."""
    return items.join(caps, keys).filter(F.col("total") > F.col("cap"))


def null_rates(df: DataFrame, columns: list[str] | None = None, most: float = MAX_NULL_RATE) -> DataFrame:
    """column, null_rate and whether it is over the limit, for all columns in one pass."""
    columns = columns or df.columns
    one = df.agg(*[F.avg(F.isnull(c).cast("int")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0.0)).alias("null_rate")) for c in columns]))).withColumn("over_limit", F.col("null_rate") > most)


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def drift(df: DataFrame, reference: DataFrame, most: float = MAX_DRIFT) -> DataFrame:
    """Row counts of both and their relative difference."""
    n = df.agg(F.count("*").alias("n")).crossJoin(reference.agg(F.count("*").alias("n_reference")))  # one row each
    d = F.try_divide(F.abs(F.col("n") - F.col("n_reference")), F.col("n_reference"))
    return n.withColumn("drift", d).withColumn("over_limit", F.coalesce(d > most, F.lit(True)))


def profile(df: DataFrame, columns: list[str], domain_below: int = 50) -> DataFrame:
    """column, n_distinct, least, most (as text) and, for few distinct values, their sorted list."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(c).cast("string").try_cast("double").alias("number")) for c in columns])))
    values = long.filter("value is not null").groupBy("column", "value").agg(F.first("number").alias("number"))
    stats = values.groupBy("column").agg(F.count("*").alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("most"), F.min("number").alias("least_number"), F.max("number").alias("most_number"))
    few = stats.filter(F.col("n_distinct") < domain_below).select("column")
    domain = values.join(few, "column", "left_semi").groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("domain"))
    return stats.join(domain, "column", "left")


def required_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def type_mismatches(df: DataFrame, expected: dict[str, str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c, t in expected.items() if c in kinds and kinds[c] != t]


def column_drift(current: list[str], expected: list[str]) -> float:
    """Jaccard distance of two sets of column names."""
    a, b = set(current), set(expected)
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


TableRule = Callable[[DataFrame], DataFrame]


def run_table_rules(df: DataFrame, rules: dict[str, TableRule]) -> DataFrame:
    """Rules that need the whole table: each gives its failing rows; the result has their counts."""
    out = None
    for name, rule in rules.items():
        one = rule(df).agg(F.lit(name).alias("rule"), F.count("*").alias("n_failed"))
        out = one if out is None else out.unionByName(one)
    return out
