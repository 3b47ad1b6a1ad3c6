"""Enrichment, range, as-of, pair and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def enriched(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "left", *, defaults: dict[str, object] | None = None, null_keys_match: bool = False, flag: str | None = None) -> DataFrame:
    """Join on all key pairs at once (left name -> right name) and fill defaults into what found no partner.

    Columns of the right side keep their names; its keys are dropped unless their names differ. flag: a boolean
    column that says whether a partner was found.
    """
    r = right.withColumn(flag, F.lit(True)) if flag else right
    r = r.withColumnsRenamed({b: f"_r_{b}" for b in keys.values()})
    same = [(F.col(a).eqNullSafe(F.col(f"_r_{b}")) if null_keys_match else F.col(a) == F.col(f"_r_{b}")) for a, b in keys.items()]
    out = left.join(r, reduce(lambda x, y: x & y, same), how)
    for a, b in keys.items():
        if how in ("right", "outer", "full"):
            out = out.withColumn(a, F.coalesce(a, f"_r_{b}"))
        out = out.withColumnRenamed(f"_r_{b}", b) if a != b and b not in left.columns else out.drop(f"_r_{b}")
    if flag:
        out = out.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out.fillna(defaults) if defaults else out


def match_rate(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(flag).alias("n_matched"), F.try_divide(F.count_if(flag), F.count("*")).alias("rate"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, *, prefix: int | None = None, width: int | None = None) -> DataFrame:
    """points joined to the ranges that hold them (both ends inclusive), as an equi-join with a residual filter.

    prefix: text ranges within one prefix of that length join on it; the ranges that cross prefixes (few) are joined
    apart, on each prefix between their ends being a number. width: numeric ranges are cut into buckets of that width.
    """
    inside = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    if prefix:
        ends = F.substring(F.col(low), 1, prefix), F.substring(F.col(high), 1, prefix)
        first, last = (e.try_cast("long") for e in ends)
        keys = F.when(ends[0] == ends[1], F.array(ends[0])).otherwise(F.transform(F.sequence(first, last), lambda x: F.lpad(x.cast("string"), prefix, "0")))
        return points.withColumn("_key", F.substring(point, 1, prefix)).join(ranges.filter(ends[0] <= ends[1]).withColumn("_key", F.explode(keys)), "_key").filter(inside).drop("_key")
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = ranges.filter(F.col(low) <= F.col(high)).withColumn("_key", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("_key", bucket(point)).join(cut, "_key").filter(inside).drop("_key")


#: Days of a bucket of an as-of join by finer times: what falls into one bucket of a key is walked by one task.
BUCKET_DAYS = 64


def as_of(facts: DataFrame, records: DataFrame, keys: list[str], day: str, start: str, end: str | None, fact_id: list[str], *ties: str, strict: bool = False) -> DataFrame:
    """For each fact the newest record that covers its day; if none does, the newest that began (strict: no record).

    The record depends on the keys and the day alone, so it is looked up once for each different day of a key, and
    records are first brought down to the best of each key and start. Both are walked in order of time: the last record
    that came up is the newest that began, and the greatest end that came up tells whether any can hold. So versions and
    days never meet as pairs, and a key has at most two rows a day however many versions and facts it has. Times finer
    than days are not so few; they are cut into buckets of BUCKET_DAYS that are walked by themselves, with what holds at
    the beginning of a bucket carried over from those before it. Only days that the newest record has left and an older,
    longer one may cover are looked up among the records that hold.
    Records with a null start, and facts with a null day or key, find nothing. fact_id is not needed; it stays for
    callers that name it.
    """
    own = [c for c in records.columns if c not in keys]
    far = F.lit("9999-12-31").cast(records.schema[start].dataType)
    order = [start, *[t for t in ties if t != start], *[c for c in own if c not in (start, *ties)]]
    given = records.filter(F.col(start).isNotNull())
    until = F.coalesce(end, far) if end else far
    best = given.groupBy(*keys, F.col(start).alias("_at")).agg(F.max(F.struct(*order)).alias("_r"), F.max(until).alias("_until"))
    asked = facts.select(*keys, F.col(day).alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    daily = {records.schema[start].dataType, facts.schema[day].dataType} == {DateType()}
    nothing = [F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("_r", "_until")]
    walk = best.select(*keys, "_at", F.lit(0).alias("_kind"), "_r", "_until").unionByName(asked.select(*keys, "_at", F.lit(1).alias("_kind"), *nothing))
    by = list(keys)
    if not daily:
        by.append("_bucket")
        walk = walk.withColumn("_bucket", F.floor(F.unix_date(F.to_date("_at")) / BUCKET_DAYS))
    so_far = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = walk.withColumns({"_r": F.last("_r", ignorenulls=True).over(so_far), "_until": F.max("_until").over(so_far)}).filter("_kind = 1")
    if not daily:
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = walk.groupBy(*by).agg(F.max("_r").alias("_r"), F.max("_until").alias("_until")).select(*[F.col(k).alias(f"_k_{k}") for k in by], F.max("_r").over(before).alias("_r0"), F.max("_until").over(before).alias("_until0"))
        held = held.join(carried, [F.col(k) == F.col(f"_k_{k}") for k in by]).withColumns({"_r": F.coalesce("_r", "_r0"), "_until": F.greatest("_until", "_until0")})
    held = held.select(*keys, "_at", "_r", "_until").filter("_r is not null")

    covers_day = F.coalesce(F.col(f"_r.{end}"), far) >= F.col("_at") if end else F.lit(True)
    none_does = F.col("_until") < F.col("_at")
    picked = held.filter(covers_day if strict else covers_day | none_does).select(*keys, "_at", "_r")
    if end:
        open_ = held.filter(~covers_day & ~none_does).select(*keys, "_at")
        older = open_.join(given, keys).filter((F.col(start) <= F.col("_at")) & (until >= F.col("_at"))).groupBy(*keys, "_at").agg(F.max(F.struct(*order)).alias("_r"))
        picked = picked.unionByName(older)
    return facts.join(picked.select(*keys, F.col("_at").alias(day), *[F.col(f"_r.{c}").alias(c) for c in own]), [*keys, day], "left")


def pair_lookup(pairs: DataFrame, known: DataFrame, a: str, b: str, ka: str, kb: str, value: str, name: str) -> DataFrame:
    """A symmetric table looked up in either direction: both sides are put in order, so it stays an equi-join."""
    keyed = known.select(F.least(ka, kb).alias("_lo"), F.greatest(ka, kb).alias("_hi"), F.col(value).alias(name)).groupBy("_lo", "_hi").agg(F.min(name).alias(name))
    return pairs.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b)).join(keyed, ["_lo", "_hi"], "left").drop("_lo", "_hi")


def first_found(df: DataFrame, sources: list[tuple[DataFrame, str]], key: str, values: list[str], source: str = "source") -> DataFrame:
    """Values from the first source that has the key; `source` names it. Each source is unique by key."""
    flags = []
    for i, (other, name) in enumerate(sources):
        other = other.select(key, *[F.col(v).alias(f"_{i}_{v}") for v in values], F.lit(name).alias(f"_{i}"))
        df, flags = df.join(other, key, "left"), [*flags, F.col(f"_{i}")]
    picked = [F.coalesce(*[F.when(F.col(f"_{j}").isNotNull(), F.col(f"_{j}_{v}")) for j in range(len(sources))]).alias(v) for v in values]
    kept = [c for c in df.columns if not c.startswith("_")]
    return df.select(*kept, *picked, F.coalesce(*flags).alias(source))


def missing(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(reference.select(*keys).distinct(), keys, "left_anti")


def missing_pairs(df: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """The different (a, b) of df that are no pair of left (a, on) joined to right (b, on), without making those pairs.

    Each pair asked for takes what its own a says of `on`, and looks that up with its b.
    """
    known = right.select(b, *on).distinct().withColumn("_known", F.lit(True))
    asked = df.select(a, b).distinct().join(left.select(a, *on).distinct(), a, "left").join(known, [b, *on], "left")
    return asked.groupBy(a, b).agg(F.max("_known").alias("_known")).filter("_known is null").select(a, b)


def conflicts(left: DataFrame, right: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Rows of equal key that differ in a compared column, with the first that differs."""
    r = right.select(key, *[F.col(c).alias(f"{c}_other") for c in compared])
    kind = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"{c}_other")), F.lit(c)) for c in compared])
    return left.join(r, key).withColumn("conflict_type", kind).filter(F.col("conflict_type").isNotNull())


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def key_parity(authority: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """How far the key sets of two tables agree."""
    a, b = authority.select(*keys).distinct().withColumn("_a", F.lit(1)), other.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(
        F.count_if(F.col("_a").isNotNull()).alias("n_authority"), F.count_if(F.col("_b").isNotNull()).alias("n_other"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_missing"), F.count_if(F.col("_a").isNull()).alias("n_extra"),
    )


def optional_filters(df: DataFrame, given: dict[str, object]) -> DataFrame:
    """The rows that meet every given equality; a value of None asks nothing, a list asks for any of its values."""
    return df.filter(all_of([F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == F.lit(v) for c, v in given.items() if v is not None]))


def json_list_has(c: str | Column, value: str) -> Column:
    """Whether a JSON list of texts holds a value; false for null and for text that is no list."""
    return F.coalesce(F.array_contains(F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>"), value), F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
