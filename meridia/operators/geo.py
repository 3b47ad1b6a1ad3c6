"""Distances, nearest neighbours within a state, and the cascade from a ZIP code to a pricing locality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digits
from .joins import first_found, pair_lookup
from .windows import first_by

EARTH_MILES = 3959.0
MILES_PER_DEGREE = EARTH_MILES * 3.141592653589793 / 180
#: Levels of the grid of a search without a radius: from one cell around the globe to cells of a third of a mile.
LEVELS = 9
#: Miles added to a measured distance before it bounds a search: more than the rounding of any distance.
BOUND_SLACK = 0.001
#: Fixed values of the search: first radius, step and last radius in miles; how far a table distance may be off; flags.
FIRST_RADIUS, RADIUS_STEP, LAST_RADIUS, TABLE_TOLERANCE, COINCIDENT_MILES, FAR_MILES = 25, 10, 95, 1.0, 1.0, 10.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def zip_parts(c: str) -> tuple[Column, Column]:
    """(zip5, plus4) of a ZIP code of 5 or 9 digits with any separators; null otherwise."""
    d = digits(c)
    good = F.length(d).isin(5, 9)
    return F.when(good, F.substring(d, 1, 5)), F.when(F.length(d) == 9, F.substring(d, 6, 4))


def _cells(lat: Column, lon: Column, size: Column, around: Column, miles: Column) -> Column:
    """The grid cells (y, x) of a size, `around` of which go around the globe, within some miles of a point, each once.

    Longitude wraps, and where the circle holds a pole all cells of a row count.
    """
    reach = miles / MILES_PER_DEGREE * (1 + 1e-9)
    rows = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((lat + 90 - reach) / size)), F.floor(F.least(F.lit(180.0), lat + 90 + reach) / size))
    # the widest longitude of a circle: asin(sin(reach) / cos(lat))
    ratio = F.sin(F.radians(F.least(reach, F.lit(90.0)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    wide = F.when((F.abs(lat) + reach >= 90) | (ratio >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    first, last = F.floor((lon + 180 - wide) / size), F.floor((lon + 180 + wide) / size)
    columns = F.when(last - first >= around - 1, F.sequence(F.lit(0).cast("long"), around - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, around)))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda x: F.struct(r.alias("y"), x.alias("x")))))


def _cell(lat: Column, lon: Column, size: Column, around: Column) -> list[Column]:
    return [F.floor((lat + 90) / size).alias("_y"), F.pmod(F.floor((lon + 180) / size), around).alias("_x")]


def nearest_in_state(sources: DataFrame, candidates: DataFrame, key: str, state: str, *, miles: float | None = None, beyond: float = 0.0) -> DataFrame:
    """For each source the nearest other candidate of its state: key, nearest, distance. Ties go to the smaller key.

    beyond: candidates within so many miles do not count (none are left out at 0).

    Both sides are put into grid cells, and a source meets only the cells within a radius. The grid has LEVELS of cells,
    each a quarter as wide as those of the level before; a source uses the finest level where its own cell holds another
    candidate, whose diagonal bounds the distance to the nearest one, as does the distance to any candidate: those of the
    smallest and largest key of its cells are measured, so that few cells are left to look into. With `miles`, levels begin
    where cells are about as large, a source alone in its cell uses that one, and no radius is larger. Of candidates at one
    place the two smallest keys are enough. With `beyond`, a cell counts if a candidate in it is surely far enough north or
    south; the coarsest level is there for the rest: it holds all, or all within `miles`. Joins with rows of cells are by
    shuffle: their size is reckoned from the tables', which have a row where these have many.
    """
    c = candidates.select(F.col(state).alias("_s"), F.col(key).alias("nearest"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).filter("_lat is not null and _lon is not null")
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_lat", "_lon").orderBy("nearest"))).filter("_n <= 2").drop("_n")
    s = sources.select(key, F.col(state).alias("_s"), "lat", "lon").filter("lat is not null and lon is not null")
    first = max(0, min(LEVELS - 1, int(math.log(max(1.0, 360 * MILES_PER_DEGREE / miles), 4)))) if miles else 0
    levels = F.explode(F.sequence(F.lit(first), F.lit(LEVELS - 1))).alias("_level")
    around = F.pow(F.lit(4.0), F.col("_level")).cast("long")
    size = F.lit(360.0) / around
    c = c.select("*", levels)
    own = ["_s", "_level", "_y", "_x"]
    by_key, by_lat = F.struct("nearest", "_lat", "_lon"), F.struct("_lat", "_lon", "nearest")
    held = c.select("*", *_cell(F.col("_lat"), F.col("_lon"), size, around)).groupBy(*own).agg(F.min(by_key).alias("_lo"), F.max(by_key).alias("_hi"), *([F.min(by_lat).alias("_south"), F.max(by_lat).alias("_north")] if beyond else []))
    others = (F.col("_lo.nearest") != F.col(key)) | (F.col("_hi.nearest") != F.col(key))
    told = [F.when(F.col(f"{r}.nearest") != F.col(key), haversine(F.col("lat"), F.col("lon"), F.col(f"{r}._lat"), F.col(f"{r}._lon"))) for r in ("_lo", "_hi", *(["_south", "_north"] if beyond else []))]
    bound = F.least(*[F.when(d > beyond, d) for d in told] if beyond else told)
    if beyond:
        far = F.greatest(F.col("lat") - F.col("_south._lat"), F.col("_north._lat") - F.col("lat")) * MILES_PER_DEGREE * (1 - 1e-9) > beyond
        others = others & (far | (F.col("_level") == 0))
    if miles:
        others = F.coalesce(others, F.lit(False)) | (F.col("_level") == first)
    s = s.select("*", levels).select("*", *_cell(F.col("lat"), F.col("lon"), size, around)).join(held.hint("merge"), own, "left" if miles else "inner").filter(others)
    s = s.withColumn("_bound", bound + BOUND_SLACK).groupBy(key, "_s", "lat", "lon").agg(F.max("_level").alias("_level"), F.min("_bound").alias("_bound"))
    radius = F.least(size * (2**0.5 * MILES_PER_DEGREE), F.col("_bound"), *([F.lit(float(miles))] if miles else []))
    at = c.select("*", *_cell(F.col("_lat"), F.col("_lon"), size, around))
    near = s.select("*", F.inline(F.transform(_cells(F.col("lat"), F.col("lon"), size, around, radius), lambda x: F.struct(x["y"].alias("_y"), x["x"].alias("_x")))))
    d = near.drop("_bound").join(at.hint("merge"), own).filter(F.col("nearest") != F.col(key)).withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    if beyond:
        d = d.filter(F.col("distance") > beyond)
    best = (d.filter(F.col("distance") <= miles) if miles else d).groupBy(key).agg(F.min(F.struct("distance", "nearest")).alias("b"))
    return best.select(key, F.col("b.nearest").alias("nearest"), F.col("b.distance").alias("distance"))


def within_radius(sources: DataFrame, candidates: DataFrame, key: str, state: str) -> DataFrame:
    """Pairs of each source (key, lat, lon, miles) with the other candidates of its state (under their columns) within its own radius, and their distance.

    A source meets the cells of the grid level whose cells are about as large as its radius.
    """
    radius = F.greatest(F.col("miles"), F.lit(1e-6))
    own_level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(F.log(F.lit(360 * MILES_PER_DEGREE) / radius) / F.log(F.lit(4.0))))).cast("int")
    around = F.pow(F.lit(4.0), F.col("_level")).cast("long")
    size = F.lit(360.0) / around
    s = sources.select(key, F.col(state).alias("_s"), "lat", "lon", "miles").filter("lat is not null and lon is not null").withColumn("_level", own_level)
    cells = F.transform(_cells(F.col("lat"), F.col("lon"), size, around, F.col("miles")), lambda x: F.struct(x["y"].alias("_y"), x["x"].alias("_x")))
    near = s.select(F.col(key).alias("_key"), "_s", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "miles", "_level", F.inline(cells))
    c = candidates.filter("lat is not null and lon is not null").withColumnRenamed(state, "_s").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    c = c.select("*", *_cell(F.col("lat"), F.col("lon"), size, around))
    d = near.join(c.hint("merge"), ["_s", "_level", "_y", "_x"]).filter(F.col("_key") != F.col(key)).withColumn("distance", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")))
    return d.filter(F.col("distance") <= F.col("miles")).drop("_s", "_level", "_y", "_x", "miles")


def zip_candidates(mapping: DataFrame, localities: DataFrame, metadata: DataFrame, coordinates: DataFrame) -> DataFrame:
    """zip5, state, lat, lon, zcta5, locality, has_locality, is_pobox, population: what a search among ZIP codes looks at, a row each.

    mapping: zip5, zcta5, relationship, weight, state. localities: zip5, locality. metadata: zip5, is_pobox, population.
    coordinates: zcta5, lat, lon.
    """
    c = preferred_zcta(mapping).select("zip5", "state", "zcta5").join(coordinates.select("zcta5", "lat", "lon"), "zcta5").join(localities.groupBy("zip5").agg(F.min("locality").alias("locality")), "zip5", "left")
    return c.join(metadata.select("zip5", F.coalesce("is_pobox", F.lit(False)).alias("is_pobox"), "population"), "zip5", "left").withColumns({"is_pobox": F.coalesce("is_pobox", F.lit(False)), "has_locality": F.col("locality").isNotNull()})


def zcta_coordinates(zctas: DataFrame, gazetteer: DataFrame, centroids: DataFrame) -> DataFrame:
    """Coordinates of ZCTAs from the gazetteer, else from the centroids, and which of them had them."""
    return first_found(zctas, [(gazetteer.filter("lat is not null and lon is not null"), "gazetteer"), (centroids.filter("lat is not null and lon is not null"), "centroid")], "zcta5", ["lat", "lon"])


def radius_step(distance: Column) -> Column:
    """The number of the search radius that first holds a distance."""
    return F.greatest(F.lit(0), F.ceil((distance - FIRST_RADIUS) / RADIUS_STEP)).cast("int")


def nearest_by_radius(pairs: DataFrame, key: str) -> DataFrame:
    """The pick of a widening search, without searching again.

    pairs: key, candidate, distance, is_pobox, has_locality. At each radius the nearest candidate that is no PO box
    is taken, else the nearest PO box; a candidate without a locality row makes the search go on.
    """
    inside = pairs.filter(F.col("distance") <= LAST_RADIUS).withColumn("is_pobox", F.coalesce("is_pobox", F.lit(False)))
    return _picked(inside.groupBy(key).agg(F.min(F.when(~F.col("is_pobox"), F.struct("distance", "candidate", "has_locality"))).alias("z"), F.min(F.when(F.col("is_pobox"), F.struct("distance", "candidate", "has_locality"))).alias("p")), key)


def _picked(kinds: DataFrame, key: str) -> DataFrame:
    """kinds: key and the nearest candidate that is no PO box (z) and that is one (p), as structs of distance, candidate, has_locality."""
    earlier = F.col("p").isNotNull() & F.col("p.has_locality") & (F.col("z").isNull() | (radius_step(F.col("p.distance")) < radius_step(F.col("z.distance"))))
    pick = F.when(earlier, F.col("p")).when(F.col("z").isNotNull() & F.col("z.has_locality"), F.col("z"))
    return kinds.withColumn("k", pick).filter("k is not null").select(key, F.col("k.candidate").alias("nearest"), F.col("k.distance").alias("distance"), F.coalesce(F.col("k.candidate") == F.col("p.candidate"), F.lit(False)).alias("is_pobox"))


def nearest_with_boxes(sources: DataFrame, candidates: DataFrame, key: str, state: str) -> DataFrame:
    """nearest_by_radius without pairs: the pick needs only the nearest candidate of either kind, and each is a search on the grid.

    sources: key, state, lat, lon. candidates: the same, is_pobox and has_locality.
    """
    flagged = candidates.withColumn("is_pobox", F.coalesce("is_pobox", F.lit(False)))
    told = candidates.select(F.col(key).alias("candidate"), "has_locality")
    kinds = None
    for name, own in (("z", flagged.filter(~F.col("is_pobox"))), ("p", flagged.filter("is_pobox"))):
        found = nearest_in_state(sources, own, key, state).filter(F.col("distance") <= LAST_RADIUS).withColumnRenamed("nearest", "candidate")
        one = found.join(told.hint("merge"), "candidate").select(key, F.struct("distance", "candidate", "has_locality").alias(name))
        kinds = one if kinds is None else kinds.join(one, key, "full")
    return _picked(kinds, key)


def nearest_by_table_search(sources: DataFrame, candidates: DataFrame, known: DataFrame, key: str, state: str) -> DataFrame:
    """nearest_by_table without pairs of a state. sources, candidates: key, state, lat, lon, zcta, population. known: a, b, miles.

    A table's distance counts only where it is within TABLE_TOLERANCE of the great circle's. So if a candidate beyond the
    tolerance lies at d, whatever is nearest lies within d and two tolerances on the circle: d is found on the grid, and
    only candidates within that radius are looked up in the table. A source with none beyond the tolerance looks so far.
    """
    bound = nearest_in_state(sources, candidates, key, state, beyond=TABLE_TOLERANCE).select(key, F.col("distance").alias("_d"))
    reach = sources.join(bound, key, "left").withColumn("miles", (F.coalesce("_d", F.lit(TABLE_TOLERANCE)) + 2 * TABLE_TOLERANCE) * (1 + 1e-9))
    near = within_radius(reach, candidates, key, state)
    pairs = near.join(sources.select(F.col(key).alias("_key"), F.col("zcta").alias("zcta_a")).hint("merge"), "_key").withColumnsRenamed({key: "zip", "zcta": "zcta_b", "lat": "lat_b", "lon": "lon_b"}).withColumnRenamed("_key", key).drop("distance")
    return nearest_by_table(pairs.hint("merge"), known, key)


def nearest_by_table(pairs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Nearest ZIP by ZCTA: a table's distance unless it is missing or more than a mile off the great circle.

    pairs: key, zip, zcta_a, zcta_b, lat/lon of both, population. known: a, b, miles. Distance 0 is no neighbour;
    ties go to the smaller population, then the smaller ZIP.
    """
    d = pair_lookup(pairs, known, "zcta_a", "zcta_b", "a", "b", "miles", "_table")
    circle = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    use_table = F.col("_table").isNotNull() & (circle.isNull() | (F.abs(F.col("_table") - circle) <= TABLE_TOLERANCE))
    d = d.withColumn("distance", F.when(use_table, F.col("_table")).otherwise(circle)).withColumn("method", F.when(use_table, "table").otherwise("great circle"))
    best = d.filter(F.col("distance") > 0).groupBy(key).agg(F.min(F.struct("distance", F.coalesce("population", F.lit(0)).alias("population"), "zip", "method")).alias("b"))
    return best.select(key, F.col("b.zip").alias("nearest"), F.col("b.distance").alias("distance"), F.col("b.method").alias("method"), (F.col("b.distance") < COINCIDENT_MILES).alias("is_coincident"), (F.col("b.distance") > FAR_MILES).alias("is_far"))


def asymmetric(nearest: DataFrame, key: str) -> DataFrame:
    """Whether the neighbour of a key's neighbour is another key."""
    back = nearest.select(F.col(key).alias("nearest"), F.col("nearest").alias("_back"))
    return nearest.join(back, "nearest", "left").withColumn("is_asymmetric", F.col("_back").isNotNull() & (F.col("_back") != F.col(key))).drop("_back")


def preferred_zcta(mapping: DataFrame) -> DataFrame:
    """One ZCTA a ZIP: a direct match first, then the largest weight (nulls last), then the smaller ZCTA."""
    return first_by(mapping, ["zip5"], [F.desc(F.col("relationship") == "Zip matches ZCTA"), F.desc_nulls_last("weight"), F.asc("zcta5")])


def resolved(zips: DataFrame, plus4: DataFrame, zip5: DataFrame, nearest: DataFrame, *, strict: bool = False, default: str = "01") -> DataFrame:
    """Locality of each row by the first level that has one: zip+4, zip5, nearest ZIP, default.

    zips: id, zip5, plus4. plus4: zip5, plus4, locality, state. zip5: zip5, locality, state. nearest: zip5, locality,
    state (of the nearest ZIP). Each is unique by its key. strict: the last two levels are refused with a reason.
    """
    name = lambda df, p, *k: df.select(*k, F.col("locality").alias(f"_{p}l"), F.col("state").alias(f"_{p}s"))
    out = zips.join(name(plus4, "a", "zip5", "plus4"), ["zip5", "plus4"], "left").join(name(zip5, "b", "zip5"), "zip5", "left").join(name(nearest, "c", "zip5"), "zip5", "left")
    level = F.when(F.col("_al").isNotNull(), "zip+4").when(F.col("_bl").isNotNull(), "zip5")
    level = (level if strict else level.when(F.col("_cl").isNotNull(), "nearest")).otherwise("error" if strict else "default")
    values = [F.col("_al"), F.col("_bl")] + ([] if strict else [F.col("_cl"), F.lit(default)])
    states = [F.col("_as"), F.col("_bs")] + ([] if strict else [F.col("_cs")])
    return out.select(*zips.columns, F.coalesce(*values).alias("locality"), F.coalesce(*states).alias("state"), level.alias("match_level"), F.when(level == "error", "no exact match").alias("reject_reason"))
