"""Locality rows to county FIPS codes: expand set phrases, infer states, match names, quarantine the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import county_key, exception_list, set_logic, split_list

FUZZY_LEAST, FUZZY_GAP = 0.95, 0.02


#: Characters of a q-gram, and the least likeness that a match or its closest rival can have.
GRAM, RIVAL_LEAST = 2, FUZZY_LEAST - FUZZY_GAP


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, with one whole number for a row of the table."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 LCS / (|a| + |b|) of pairs: the share of characters that insertions and deletions leave.

    All pairs go side by side: a row of the table of one pair is the bits of one word, and a step takes the next character
    of every b. Names of over 64 characters have more than a word and go one by one.
    """
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    total = size_a + size_b
    common = np.zeros(len(a), np.int64)
    word = (size_a > 0) & (size_b > 0) & (size_a <= 64)
    for i in np.flatnonzero(size_a > 64):
        common[i] = _common(a[i], b[i])
    if word.any():
        own = np.flatnonzero(word)
        codes = lambda x: np.array([x[i] for i in own]).view(np.uint32).reshape(len(own), -1)
        x, y = codes(a), codes(b)
        bits = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
        v = np.full(len(own), 2**64 - 1, np.uint64)
        for j in range(y.shape[1]):
            met = ((x == y[:, j : j + 1]) & (x != 0)) @ bits
            u = v & met
            v = (v + u) | (v - u)
        low = np.where(size_a[own] == 64, np.uint64(2**64 - 1), (np.uint64(1) << (size_a[own] % 64).astype(np.uint64)) - np.uint64(1))
        common[own] = np.bitwise_count(~v & low)
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def grams(name: str) -> Column:
    """The q-grams of a name that a name like it must share one of.

    Two names of m characters together with a likeness of r differ by (1 - r) m insertions and deletions, and each of
    them spoils GRAM q-grams at most. So in any one order of q-grams the first GRAM * (1 - r) m + 1 of either name have one
    in common. Repeated q-grams of a name are told apart by their number; the order is that of their hashes.
    """
    n = F.char_length(name)
    # a name of length r' = (2 - l) / l times as long is the longest that the lengths allow at the likeness l
    most = F.floor((1 - RIVAL_LEAST) * (1 + (2 - FUZZY_LEAST) / FUZZY_LEAST) * n + 1e-9).cast("int")
    own = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(name, i, F.lit(GRAM)))
    numbered = F.transform(own, lambda g, i: F.concat(g, F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda h: h == g)).cast("string")))
    ordered = F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    return F.when(n >= GRAM, F.transform(F.slice(ordered, F.lit(1), GRAM * most + 1), lambda x: x.g)).otherwise(F.array().cast("array<string>"))


def type_rank(kind: Column, city_hint: Column) -> Column:
    """Order of county kinds for one name: counties before cities, unless the area speaks of a city."""
    order = ["County", "Parish", "Borough", "Municipality", "Census Area", "city"]
    plain = F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(order)], F.lit(len(order)))
    return F.when(city_hint, F.when(kind == "city", -1).otherwise(plain)).otherwise(plain)


def expanded(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """row_id, state_fips, locality_code, fee_area, county_names to one row per county name, set phrases resolved.

    'REST OF' takes the counties of the state that no other row lists.
    """
    kind = rows.withColumn("logic", set_logic("county_names"))
    own = ["row_id", "state_fips", "locality_code", "fee_area", "logic"]
    c = counties.select("state_fips", F.col("county_key").alias("key"))
    listed = kind.filter("logic = 'list'").select(*own, F.explode(split_list("county_names")).alias("name")).select(*own, county_key("name", "state_fips").alias("key"))
    every = kind.filter("logic <> 'list'").join(c.distinct(), "state_fips")
    cut = every.filter("logic = 'all_except'").select("row_id", "state_fips", F.explode(exception_list("county_names")).alias("name")).select("row_id", county_key("name", "state_fips").alias("key")).distinct()
    taken = listed.select("state_fips", "key").distinct().withColumn("rest", F.lit("rest"))
    whole = every.filter("logic = 'all'").select(*own, "key").unionByName(every.filter("logic = 'all_except'").join(cut, ["row_id", "key"], "left_anti").select(*own, "key"))
    rest = every.filter("logic = 'rest'").join(taken.drop("rest"), ["state_fips", "key"], "left_anti").select(*own, "key")
    return listed.unionByName(whole).unionByName(rest)


def inferred_states(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """row_id and the only state that has all counties of its list (null where none or several have)."""
    names = rows.select("row_id", F.posexplode(split_list("county_names")).alias("at", "name")).withColumn("key", county_key("name", F.lit("")))
    needed = names.groupBy("row_id").agg(F.count_distinct("at").alias("n"))
    hits = names.join(counties.select("state_fips", F.col("county_key").alias("key")).distinct(), "key").groupBy("row_id", "state_fips").agg(F.count_distinct("at").alias("m"))
    full = hits.join(needed, "row_id").filter("m = n").groupBy("row_id").agg(F.count("*").alias("k"), F.min("state_fips").alias("s"))
    return rows.select("row_id").distinct().join(full, "row_id", "left").select("row_id", F.when(F.col("k") == 1, F.col("s")).alias("state_fips"))


def matched(names: DataFrame, counties: DataFrame, aliases: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """names (…, state_fips, key, fee_area) with county_fips and method: exact, alias, fuzzy, or a reject reason.

    counties: state_fips, county_key, county_fips, county_type. aliases: state_fips, alias_key, county_key.
    Fuzzy matching needs a score of 0.95 and a lead of 0.02. A name meets the counties of its state that it shares one of
    its first q-grams with and whose lengths allow the score; both the match and any rival within the lead are among them.
    """
    # what a name finds depends on its state, the name and the hint alone: each is looked up once, however many rows ask
    c = counties.select("state_fips", F.col("county_key").alias("key"), "county_fips", "county_type")
    ranked = c.withColumn("_hint", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_rank", type_rank(F.col("county_type"), F.col("_hint")))
    best = lambda df, name, out: df.groupBy("state_fips", F.col(name).alias("key"), "_hint").agg(F.min(F.struct("_rank", "county_fips", "county_type")).alias(out))
    said = aliases.select("state_fips", "alias_key", F.col("county_key").alias("key")).join(ranked, ["state_fips", "key"])
    told = names.withColumn("_hint", F.upper(F.coalesce("fee_area", F.lit(""))).contains("CITY"))
    told = told.join(best(ranked, "key", "_exact"), ["state_fips", "key", "_hint"], "left").join(best(said, "alias_key", "_alias"), ["state_fips", "key", "_hint"], "left")
    found = [(f"{m}", F.col(f"_{m}")) for m in ("exact", "alias")]
    if fuzzy:
        left = told.filter("_exact is null and _alias is null").select("state_fips", "key").distinct()
        told = told.join(_alike(left, c), ["state_fips", "key"], "left")
        found.append(("fuzzy", F.col("_fuzzy")))
    own = [F.coalesce(*[x[f] for _, x in found]).alias(f) for f in ("county_fips", "county_type")]
    method = F.coalesce(*[F.when(x.isNotNull(), m) for m, x in found]).alias("method")
    out = told.select(*names.columns, *own, method)
    return out.withColumn("reject_reason", F.when(F.col("county_fips").isNull(), "no county of this name in the state"))


def _alike(names: DataFrame, c: DataFrame) -> DataFrame:
    """state_fips, key, _fuzzy of the names (once each) that one county of their state is like, with a lead over all others."""
    side = lambda df, name: df.select("state_fips", F.col("key").alias(name)).distinct().withColumn("gram", F.explode(grams(name)))
    pairs = side(names, "key").join(side(c, "_to"), ["state_fips", "gram"]).select("state_fips", "key", "_to").distinct()
    pairs = pairs.filter(2 * F.least(F.length("key"), F.length("_to")) >= FUZZY_LEAST * (F.length("key") + F.length("_to"))).withColumn("score", _ratio("key", "_to")).filter(F.col("score") >= RIVAL_LEAST)
    near = pairs.join(c.withColumnRenamed("key", "_to"), ["state_fips", "_to"])
    w = Window.partitionBy("state_fips", "key").orderBy(F.desc("score"), "county_fips")
    first = near.withColumn("_lead", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1) & (F.col("score") >= FUZZY_LEAST) & (F.col("_lead") >= FUZZY_GAP))
    return first.select("state_fips", "key", F.struct(F.lit(0).alias("_rank"), "county_fips", "county_type").alias("_fuzzy"))


def normalized(rows: DataFrame, counties: DataFrame, aliases: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """Locality rows to county rows with FIPS codes, one for each locality and county, and rejects with a reason."""
    names = expanded(rows, counties).distinct()
    names = names.withColumn("name_id", F.xxhash64("row_id", "key"))
    return matched(names, counties, aliases, fuzzy=fuzzy)
