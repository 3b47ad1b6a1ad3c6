"""Periodic runs of words in whole texts, by tiles for each octave of periods.

Words stand between white space. Two words q apart match; a stretch of words has period q if all of it that can match
does. A run is a stretch with smallest period q and at least max(min_words, 2 q) words that no neighbouring word extends.
The places that match q words on form intervals, and a run is an interval of at least max(q, min_words - q) places; of
intervals that give the same stretch the smallest period is the run's (the others are its multiples).

For the octave of periods from S to 2 S - 1, boundaries stand S / 2 words apart (4 for the smallest two octaves), so
that each interval of a run holds a whole block from one boundary to the next. At a boundary, the Z-function gives for
each period of the octave how far the words from the boundary match those a period later; only periods whose first
block matches are extended, forwards and backwards, by halving steps over hashes of 1, 2, 4, ... words. So an octave
costs twice the words of a text, and all octaves of it n log n.

A text of up to `tile` * CHARS characters is one tile and is solved where it is read. A longer text is cut: tiles of
`tile` words, half overlapping, for periods up to an eighth of them, then tiles of eight times that for the next three
octaves, and so on. Tiles are dealt over the cluster and solved by themselves; what they find is clipped at their ends.
The fragments of a text and period are then brought together, sorted and stitched where they touch. Copies of a long
text are solved once.

Cases: a null text has no runs and a null collapsed text; one without words none and an empty one; a text of one word
repeated is one run of period 1; repeated rows each come back; an empty table gives none; all other columns pass
through, and those named runs or collapsed keep their names, the operator's then get a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import free_name, frugal, parts, small_batches, text_bytes, written

#: Characters of a text for each word of a tile that are still solved in one piece.
CHARS = 8
#: Comparisons of one step in memory.
STEP = 2_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_TILES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int64()), ("ids", pa.binary())])
_TILES_DDL = "k1 long, k2 long, first int, last int, at long, ids binary"
_PIECES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_PIECES_DDL = "k1 long, k2 long, period long, lo long, hi long"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _alone(n: int, seed: int) -> np.ndarray:
    """n values that equal nothing else."""
    return W.mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))


def _levels(h: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... values from each place, up to `most` of them; those that reach beyond the end equal nothing."""
    out, size = [h], 1
    while 2 * size <= most:
        later = np.concatenate([out[-1][size:], _alone(min(size, len(h)), len(out) + 77)])
        out.append(W.mixed(out[-1] * np.uint64(0x9E3779B97F4A7C15) + later))
        size *= 2
    return out


def matches(h: np.ndarray, text: np.ndarray, longest: int, first: int = 0, last: int = 63) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, lo, hi): the maximal intervals of places that match a period of the octaves first..last on, where they hold a block.

    h: hashes of the words of several texts one after the other, with one value between them that equals nothing.
    text: the text of each place. longest: words of the longest.
    """
    found: list[tuple[np.ndarray, ...]] = []
    n, levels = len(h), _levels(h, longest)
    for k in range(first, min(last, longest.bit_length() - 2) + 1):
        size = 1 << k
        block = 2 if size <= 2 else k - 1  # blocks of 4 words for the periods 1 to 3, else of half the octave's least
        if block >= len(levels):
            break
        own = levels[block]
        later = np.lib.stride_tricks.sliding_window_view(np.concatenate([own[size:], _alone(2 * size, 991)]), size)
        places = np.arange(0, n, 1 << block)
        rows = max(1, STEP // size)
        before = np.zeros(size, bool)
        for lo in range(0, len(places), rows):
            b = places[lo : lo + rows]
            equal = later[b] == own[b][:, None]
            new = equal.copy()
            new[1:] &= ~equal[:-1]
            new[0] &= ~before
            before = equal[-1]
            at, q = np.nonzero(new)
            at, q = b[at], q + size
            same = (at + q < n) & (text[at] == text[np.minimum(at + q, n - 1)])
            if same.any():
                found.append((at[same], q[same]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    b, q = (np.concatenate(x) for x in zip(*found))
    ahead, back = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = b + ahead, b + ahead + q
        ahead += np.where(y < n, levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)], False) << j
        x = b - back - (1 << j)
        back += np.where(x >= 0, levels[j][np.maximum(x, 0)] == levels[j][np.maximum(x, 0) + q], False) << j
    return q, b - back, b + ahead


def _smallest(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The order of runs by text and start, and of equal stretches only the smallest period."""
    order = np.lexsort((period, length, start, text))
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[1:] = np.all([x[order][1:] == x[order][:-1] for x in (text, start, length)], axis=0)
    order = order[~again]
    return order[np.lexsort((period[order], start[order], text[order]))]


def runs_of(words: W.Words, n_texts: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of some texts, by text, start and period."""
    sizes = np.diff(words.bounds)
    long_enough = np.flatnonzero(sizes >= min_words)
    kept = np.repeat(sizes >= min_words, sizes)
    n, own = sizes[long_enough], words.hash[kept]
    if not len(own):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    ends = np.cumsum(n)
    h = np.insert(own, ends, _alone(len(n), 13))
    text = np.repeat(np.arange(len(n)), n + 1)
    q, lo, hi = matches(h, text, int(n.max()))
    good = hi - lo >= np.maximum(q, min_words - q)
    q, lo, hi = q[good], lo[good], hi[good]
    t = text[lo]
    start, length = lo - (ends - n)[t] - t, hi - lo + q
    order = _smallest(t, start, length, q)
    return long_enough[t[order]], start[order], length[order], q[order]


def _listed(n_texts: int, text, start, length, period) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_texts))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (start, length, period)], fields=list(_RUN.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=_RUN)


def _collapsed(data: np.ndarray, words: W.Words, nulls: np.ndarray, text, start, length, period) -> pa.Array:
    """The words that no run has after its first period, joined by spaces."""
    n = len(words.start)
    step = np.zeros(n + 1, np.int64)
    at = words.bounds[text] + start
    np.add.at(step, at + period, 1)
    np.add.at(step, at + length, -1)
    kept = np.cumsum(step[:-1]) == 0
    s, size = words.start[kept], words.end[kept] - words.start[kept] + 1
    ends = np.cumsum(size)
    out = data[np.minimum(np.arange(ends[-1] if len(ends) else 0) + np.repeat(s - (ends - size), size), max(0, len(data) - 1))]
    out[ends - 1] = 32
    per = np.zeros(len(words.bounds) - 1, np.int64)
    np.add.at(per, words.row[kept], size)
    offsets = np.concatenate([[0], np.cumsum(per)])
    whole = out.tobytes()
    return pa.array([None if null else whole[a : max(a, b - 1)].decode() for a, b, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), nulls.tolist())], pa.string())


def _short(names: list[str], min_words: int):
    @frugal
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                column = batch.column("text")
                nulls = np.asarray(column.is_null())
                data, offsets = text_bytes(column)
                w = W.words(data, offsets, W.BLANKS, lower=False)
                found = runs_of(w, len(column), min_words)
                yield pa.RecordBatch.from_arrays([*batch.columns, _listed(len(column), *found), _collapsed(data, w, nulls, *found)], names=names)

    return solve


def _cut(n: int, tile: int) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, last octave, from, to) of the tiles of n words."""
    first, size = 0, tile
    while (1 << first) * 2 <= n:
        last = size.bit_length() - 4  # the largest S of the tiles is an eighth of them
        at = 0
        while True:
            yield first, last, at, min(at + size, n)
            if at + size >= n:
                break
            at += size // 2
        first, size = last + 1, size * 8


def _tiles(tile: int):
    @frugal
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets = text_bytes(batch.column("text").slice(i, 1))
                w = W.words(data, offsets, W.BLANKS, lower=False)
                _, ids = np.unique(w.hash, return_inverse=True)
                ids = ids.astype(np.int32)
                k1, k2 = batch.column("k1")[i], batch.column("k2")[i]
                for first, last, a, b in _cut(len(ids), tile):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k1.as_py(), k2.as_py(), first, last, a, ids[a:b].tobytes()), _TILES)], schema=_TILES)

    return tiles


def _solve(min_words: int):
    @frugal
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, first, last, at, ids in zip(*(batch.column(c).to_pylist() for c in _TILES.names)):
                h = W.mixed(np.frombuffer(ids, np.int32).astype(np.uint64) + np.uint64(1))
                n = len(h)
                q, lo, hi = matches(h, np.zeros(n, np.int8), n, first, last)
                # an interval that ends inside the tile is whole there; one that meets an end of it may go on
                kept = (hi - lo >= np.maximum(q, min_words - q)) | (lo == 0) | (hi + q == n)
                q, lo, hi = q[kept], lo[kept] + at, hi[kept] + at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), k1)), pa.array(np.full(len(q), k2)), *map(pa.array, (q, lo, hi))], schema=_PIECES)

    return solve


def _collapse(names: list[str]):
    @frugal
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                runs = batch.column(batch.num_columns - 1)
                data, offsets = text_bytes(batch.column("text"))
                w = W.words(data, offsets, W.BLANKS, lower=False)
                sizes = np.asarray(runs.value_lengths().fill_null(0))
                flat = runs.flatten()
                found = (np.repeat(np.arange(len(runs)), sizes), *(np.asarray(x) for x in flat.flatten()))
                collapsed = _collapsed(data, w, np.zeros(len(runs), bool), *found)
                yield pa.RecordBatch.from_arrays([*batch.columns, collapsed], names=names)

    return collapse


def stitched(pieces: DataFrame) -> DataFrame:
    """Fragments (k1, k2, period, lo, hi) joined where they overlap or touch."""
    w = Window.partitionBy("k1", "k2", "period").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    part = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = pieces.withColumn("opens", opens).withColumn("part", part)
    return numbered.groupBy("k1", "k2", "period", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def long_text_runs(texts: DataFrame, *, tile: int, min_words: int) -> DataFrame:
    """k1, k2, runs of texts (k1, k2, text): tiles solved over the cluster and stitched. Texts without runs have no row."""
    tiles = texts.dropDuplicates(["k1", "k2"]).select("k1", "k2", "text").mapInArrow(_tiles(tile), _TILES_DDL)
    pieces = tiles.repartition(F.col("k1"), F.col("k2"), F.col("first"), F.col("at")).mapInArrow(_solve(min_words), _PIECES_DDL)
    whole = stitched(pieces).filter(F.col("hi") - F.col("lo") >= F.greatest(F.col("period"), min_words - F.col("period")))
    runs = whole.groupBy("k1", "k2", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + F.col("period")).alias("length")).agg(F.min("period").alias("period"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    return runs.groupBy("k1", "k2").agg(F.transform(ordered, lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period"))).alias("runs"))


def with_runs(docs: DataFrame, *, min_words: int = 12, tile: int = 8192) -> DataFrame:
    """docs with runs (start, length, period in words, by start and period) and collapsed: the text without the words that repeat a run's first period."""
    if tile < 64 or tile & (tile - 1):
        raise ValueError("tile must be a power of 2 of at least 64")
    small_batches(docs.sparkSession)
    runs, collapsed = free_name("runs", docs), free_name("collapsed", docs)
    fields = T.StructType([*docs.schema.fields, T.StructField(runs, T._parse_datatype_string(RUNS)), T.StructField(collapsed, T.StringType())])
    is_long = F.coalesce(F.char_length("text") > CHARS * tile, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(_short(fields.names, min_words), fields)

    # the runs of a text depend on nothing else, so texts are their own key; the salt deals many copies of one text
    k1, k2, salt = (free_name(c, docs) for c in ("_k1", "_k2", "_salt"))
    longer = docs.filter(is_long)
    found = written(long_text_runs(longer.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text"), tile=tile, min_words=min_words), "runs")
    salted = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("runs").alias(runs), F.explode(F.sequence(F.lit(0), F.lit(15))).alias(salt))
    keyed = longer.withColumns({k1: F.xxhash64("text"), k2: F.xxhash64(F.lit(1), "text"), salt: F.pmod(F.spark_partition_id(), F.lit(16))})
    joined = keyed.join(salted, [k1, k2, salt], "left").select(*docs.columns, F.coalesce(F.col(runs), F.expr(f"cast(array() as {RUNS})")).alias(runs))
    return short.unionByName(joined.mapInArrow(_collapse(fields.names), fields))
