"""Picks, fills, duplicates and top rows. Every pick has a total order, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first row of each key in the given order; rank keeps its number (1) as a column."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) == 1)
    return out if rank else out.drop(name)


def latest_effective(df: DataFrame, keys: list[str], day: str, *ties: str, as_of=None) -> DataFrame:
    """The newest row of each key (by `day`, then by the tie columns downwards), not after as_of if that is given."""
    if as_of is not None:
        df = df.filter(F.col(day) <= F.lit(as_of))
    return first_by(df, keys, [F.desc_nulls_last(c) for c in (day, *ties)])


def latest_day(df: DataFrame, day: str) -> DataFrame:
    """All rows of the newest day: an aggregate of one row, broadcast."""
    return df.join(F.broadcast(df.agg(F.max(day).alias("_last"))), F.col(day) == F.col("_last")).drop("_last")


def forward_filled(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def in_duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.join(df.groupBy(*keys).count().filter("count > 1").drop("count"), keys, "left_semi") if keys else df.limit(0)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, counted without gathering any key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def top_counts(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc_nulls_last(key)).limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: Keys of more values than this are cut down to a bracket around the percentile before their values are ordered.
BRACKET_ABOVE, BRACKET_ACCURACY = 100_000, 10_000


def by_percentile_index(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at 0-based place floor(n * share) of each key's sorted values (at most the last); no interpolation.

    A sketch of each key gives two values that hold the place between them for certain: its rank error is at most
    n / BRACKET_ACCURACY, and they lie three times that to both sides. Only the values between them are ordered, those
    below are counted; so of a key with a third of all rows some ten-thousandths meet in a task.
    """
    given = df.filter(F.col(value).isNotNull())
    ends = [max(0.0, share - 3 / BRACKET_ACCURACY), min(1.0, share + 3 / BRACKET_ACCURACY)]
    sketch = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, ends, BRACKET_ACCURACY).alias("_p"))
    hot = F.col("_n") > BRACKET_ABOVE
    bounds = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.when(hot & F.lit(ends[0] > 0), F.col("_p")[0]).alias("_lo"), F.when(hot & F.lit(ends[1] < 1), F.col("_p")[1]).alias("_hi"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = given.select(*keys, value).join(bounds, same).filter(F.col("_hi").isNull() | (F.col(value) <= F.col("_hi")))
    kept = F.when(F.col("_lo").isNull() | (F.col(value) >= F.col("_lo")), F.col(value))
    counts = inside.groupBy(*keys, "_n", kept.alias("_v")).agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v"))
    placed = counts.withColumn("_run", F.sum("_c").over(run))
    at = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    return placed.filter((F.col("_run") > at) & (F.col("_run") - F.col("_c") <= at)).select(*keys, F.col("_v").alias(name))


def distinct_with_null(df: DataFrame, c: str) -> DataFrame:
    """How many different values a column has, null being one of them."""
    return df.select(c).distinct().agg(F.count("*").alias("n"))
