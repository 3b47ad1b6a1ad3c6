"""Phrase collocations by count streams in prefix and suffix order.

A text is split into pieces at punctuation and line breaks and these into words at blanks; A-Z counts as a-z. A phrase is
1 to `longest` consecutive words of a piece; its count in a group (a language) is f. Phrases of two words and more with
f of at least `least` are candidates. Cut after its first k words, a candidate scores floor(scale f / (f(first part) +
f(rest))); its lowest cut counts (of equal ones the smallest k). A candidate inside a longer one that has at least
`percent` of its count is dropped; as counts only fall when a phrase grows, it is enough to look at those one word longer.

Counting: a first pass counts words. A second one counts hashes of pairs of frequent words: a hash that several pairs
share only counts higher. A third one counts phrases all of whose pairs may be frequent, by their words, batch by batch
before anything is shuffled. Bitmaps of bounded size tell frequent words and pairs (a false hit costs time and changes
nothing). Phrases below `least` are then left out: no part of a candidate is among them.

Estimation: the remaining counts are one stream in prefix order, as arrays of words. There, the parts of a phrase come
just before it: the last count of k words that was passed is the count of its first k words. The stream is dealt into
ranges of equal size, each range is walked once with the last counts of 1, 2, ... words in hand, and what a range starts
with is carried over from those before it (a row for each range). The same walk in suffix order, over the words
reversed, gives the counts of the last words. So no count is looked up by hash or sent to its many extensions, and a
word that a third of all phrases start with is many ranges. A phrase has at most one extension on either side that
holds `percent` of it (over half), so what is dropped meets the candidates one to one in a merge join.

Cases: a null text is empty, an empty one has no words; a null group is `und`; repeated rows each count; a piece of one
word has no phrase; an empty table gives no rows; columns beside the group and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import Bitmap, bitmap, dropped, frugal, parts, small_batches, text_bytes, written

#: Bits of the largest bitmap of frequent words or pairs: 16 MB.
WORD_BITS = 27
_BYTES = np.arange(256)
BREAKS = np.isin(_BYTES, [ord(c) for c in ".,;:!?"]) | ((_BYTES >= 0x0A) & (_BYTES <= 0x0D))
KEPT = ~(BREAKS | (_BYTES == 0x20) | (_BYTES == 0x09))
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
_COUNTS_DDL = "lang string, phrase string, key long, n long"


class Pieces:
    """The words of some texts with their group, a key for each word in its group, and whether the next word is of the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        w = W.words(data, offsets, KEPT)
        groups = batch.column("lang").dictionary_encode()
        self.names = groups.dictionary.to_pylist()
        code = np.asarray(groups.indices)
        seeds = np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.names], np.uint64)
        self.group = code[w.row] if len(w.row) else np.zeros(0, np.int64)
        self.key = W.mixed(w.hash ^ seeds[self.group]) if len(w.row) else np.zeros(0, np.uint64)
        self.row = w.row
        breaks = np.concatenate([[0], np.cumsum(BREAKS[data])])
        self.next = np.zeros(len(w.start), bool)
        self.next[:-1] = (w.row[1:] == w.row[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]])
        # the words in lower case, each followed by one blank
        size = w.end - w.start + 1
        self.end = np.cumsum(size)
        self.start = self.end - size
        at = np.arange(self.end[-1] if len(size) else 0) + np.repeat(w.start - self.start, size)
        self.text = W.LOWER[data[np.minimum(at, max(0, len(data) - 1))]] if len(at) else np.zeros(0, np.uint8)
        self.text[self.end - 1] = 0x20

    def keys(self, first: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each of the words `first` on."""
        key = self.key[first]
        for j in range(1, n):
            key = W.mixed(key * np.uint64(0x9E3779B97F4A7C15) + self.key[first + j])
        return key

    def counted(self, first: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases of n words that start at the words `first`, a million at a time."""
        for lo in range(0, len(first), 1_000_000):
            yield self._counted(first[lo : lo + 1_000_000], n)

    def _counted(self, first: np.ndarray, n: int) -> pa.RecordBatch:
        key = self.keys(first, n)
        _, one, count = np.unique(key, return_index=True, return_counts=True)
        a, b = self.start[first[one]], self.end[first[one] + n - 1] - 1
        size = b - a
        offsets = np.concatenate([[0], np.cumsum(size)])
        text = self.text[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)]
        phrases = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
        names = pa.array(self.names, pa.string()).take(pa.array(self.group[first[one]]))
        return pa.RecordBatch.from_arrays([names, phrases, pa.array(key[one].view(np.int64)), pa.array(count)], schema=_COUNTS)


@frugal
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, "text"):
            p = Pieces(batch)
            yield from p.counted(np.arange(len(p.key)), 1)


def _pairs(shared):
    @frugal
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Bitmap = shared.value
        for whole in batches:
            for batch in parts(whole, "text"):
                p = Pieces(batch)
                kept = frequent.has(p.key.view(np.int64))
                first = np.flatnonzero(kept & p.next)
                key, n = np.unique(p.keys(first[kept[first + 1]], 2), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return pairs


def _phrases(shared, longest: int):
    @frugal
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Bitmap = shared.value
        for whole in batches:
            for batch in parts(whole, "text"):
                p = Pieces(batch)
                pair = np.zeros(len(p.key), bool)
                first = np.flatnonzero(p.next)
                pair[first] = frequent.has(p.keys(first, 2).view(np.int64))
                first = np.flatnonzero(pair)
                for n in range(2, longest + 1):
                    first = first[pair[first + n - 2]]
                    yield from p.counted(first, n)

    return phrases


def _bitmap(frequent: DataFrame) -> Bitmap:
    return bitmap(frequent, "key", min(WORD_BITS, max(16, (16 * frequent.count()).bit_length())))


def counts(docs: DataFrame, *, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, words, f of all phrases with f of at least `least`; lang, n of all words."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = written(read.mapInArrow(_words, _COUNTS_DDL).groupBy("lang", "phrase").agg(F.first("key").alias("key"), F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    pairs = read.mapInArrow(_pairs(share(_bitmap(frequent))), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = written(pairs.filter(F.col("n") >= least).select("key"), "pairs")
    longer = read.mapInArrow(_phrases(share(_bitmap(pairs)), longest), _COUNTS_DDL).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    all_of = frequent.select("lang", "phrase", "f").unionByName(longer)
    phrases = written(all_of.withColumn("words", F.split("phrase", " ")), "phrases")
    dropped(pairs)
    return phrases, totals


def walked(stream: DataFrame, order: str, name: str, longest: int) -> DataFrame:
    """stream with name1, name2, ...: in the order of its arrays, the count of the last phrase of 1, 2, ... words that came up to each row.

    For a phrase of more than k words that is the count of its own first k words, which is in the stream as it is no
    smaller. Rows are dealt into ranges, and what stands before a range is carried over from the ranges before it.
    """
    ranged = written(stream.repartitionByRange("lang", order).withColumn("range", F.spark_partition_id()), f"{name}-order")
    size = F.size(order)
    at = F.struct("lang", order, "f")
    ends = ranged.groupBy("range").agg(*[F.max(F.when(size == k, at)).alias(f"_{k}") for k in range(1, longest)])
    # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", *[F.last(F.col(f"_{k}.f"), ignorenulls=True).over(before).alias(f"_{k}") for k in range(1, longest)])
    w = Window.partitionBy("range").orderBy("lang", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = ranged.withColumns({f"{name}{k}": F.last(F.when(size == k, F.col("f")), ignorenulls=True).over(w) for k in range(1, longest)})
    out = passed.join(F.broadcast(carried), "range", "left")  # as many rows as ranges
    return out.withColumns({f"{name}{k}": F.coalesce(f"{name}{k}", f"_{k}") for k in range(1, longest)}).drop("range", *[f"_{k}" for k in range(1, longest)])


def _by_size(size: Column, longest: int, of) -> Column:
    return F.coalesce(*[F.when(size == n, of(n)) for n in range(2, longest + 1)])


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one replaces."""
    if percent <= 50:
        raise ValueError("percent must be over 50: two longer phrases may hold a half each")
    phrases, totals = counts(docs, least=least, longest=longest)
    left = walked(phrases, "words", "left", longest)
    both = written(walked(left.withColumn("reversed", F.reverse("words")), "reversed", "right", longest).filter(F.size("words") > 1), "walked")
    size, f = F.size("words"), F.col("f")

    # decimals, as products may pass 64 bits
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(n: int, k: int) -> Column:
        l, r = F.col(f"left{k}"), F.col(f"right{n - k}")
        score = F.call_function("div", wide(f) * F.lit(scale).cast("decimal(18,0)"), (l + r).cast("decimal(38,0)"))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    lowest = _by_size(size, longest, lambda n: F.array_min(F.array(*[cut(n, k) for k in range(1, n)])))
    best = both.select("lang", "phrase", F.col("f").alias("a"), lowest.alias("cut"))

    holds = lambda of: wide(f) * 100 >= wide(of) * percent
    inside = lambda part, whole: both.filter((size > 2) & holds(_by_size(size, longest, lambda n: F.col(f"{part}{n - 1}")))).select("lang", F.array_join(whole, " ").alias("phrase"))
    replaced = inside("left", F.slice("words", F.lit(1), size - 1)).unionByName(inside("right", F.slice("words", F.lit(2), size - 1))).distinct()
    kept = best.join(replaced.hint("merge"), ["lang", "phrase"], "left_anti")
    out = kept.join(totals, "lang")
    dropped(phrases)
    return out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def leading(scored: DataFrame, most: int = 2000) -> DataFrame:
    """Each group's first `most` by score, count and phrase, with their rank. Groups are first cut down in parts, so a large one is never one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = scored
    for salts in (int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8):
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")
    w = Window.partitionBy("lang").orderBy(*order)
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
