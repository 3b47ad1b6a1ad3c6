"""Benchmark decontamination: a broadcast hash set of test n-grams against all windows of training words.

Windows are 13 consecutive item words (an item of fewer words is one window). Their hashes are broadcast as sorted
arrays while these take at most max_broadcast_bytes, reckoned from the benchmark's words and bytes before anything is
collected; a larger benchmark is cut into blocks of about that size (an item is never cut), and all documents are
scanned once for each block: they are first written with a key for each row, by which the hits of the blocks meet, so
that both ways give the same rows. Every hash hit is verified on the words themselves; a window that stands in many
items is kept, and verified, once.

Cases: a null or empty text has no words and is never contaminated; null or empty items are left out; an
item_id that occurs twice counts once, and a null item_id marks words but is not listed; rows that repeat
a doc_id, or have none, are judged each on their own; an empty benchmark or document table gives no hits or
no rows; other columns of either table are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import free_name, frugal, parts, small_batches, text_bytes, written

WINDOW = 13
#: Bytes of a broadcast hash set, which the driver and every worker hold.
MAX_BYTES = 128_000_000
_SPANS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_SPANS_DDL = "doc_id long, n_words long, spans array<long>, bytes array<long>, items array<string>"


#: Bytes that a benchmark word takes in an NgramSet besides its text: its place, a hash, and its window's place and items.
WORD_BYTES = 28


class NgramSet:
    """Hashes of all benchmark windows, by window length, as sorted arrays, with the item words to verify hits.

    Windows of equal words form a group: a hash, a place in the words, and the items that have the window.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.ids = [i for i, _ in items]
        texts = [t.encode() for _, t in items]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        w = W.words(data, offsets, W.ALNUM)
        size = w.end - w.start
        end = np.cumsum(size + 1)
        #: Word i of all items is text[begin[i]:begin[i + 1] - 1]; a blank stands between two words.
        self.begin = np.concatenate([[0], end]).astype(np.int32 if not len(end) or end[-1] < 2**31 else np.int64)
        at = np.repeat(w.start - self.begin[:-1], size + 1) + np.arange(end[-1] if len(end) else 0)
        text = W.LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(at) else np.zeros(0, np.uint8)
        text[end - 1] = 32
        self.text = text.tobytes()
        n = np.diff(w.bounds)
        self.groups: dict[int, tuple[np.ndarray, ...]] = {}
        self.filters = {}
        for k in sorted({min(window, x) for x in n.tolist() if x}):
            ends = np.repeat(w.bounds[1:], n)
            own = np.flatnonzero((np.minimum(n, window)[w.row] == k) & (np.arange(len(w.hash)) + k <= ends))
            h = W.windows(w.hash, k)[own]
            order = np.argsort(h, kind="stable")
            h, place = h[order], own[order].astype(np.int32)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first = 0
            for i in np.flatnonzero(~new).tolist():  # windows of one hash: the same words, or a group of their own
                first = i - 1 if new[i - 1] else first
                new[i] = self.words(place[i], k) != self.words(place[first], k)
            group = np.cumsum(new) - 1
            item = w.row[place].astype(np.int32)
            once = np.concatenate([[True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])])
            starts = np.searchsorted(group[once], np.arange(group[-1] + 2)).astype(np.int32)
            self.groups[k] = (h[new], place[new], starts, item[once])
            self.filters[k] = np.zeros(1 << 20, bool)
            self.filters[k][(h >> np.uint64(44)).astype(np.int64)] = True

    def words(self, at: int, n: int) -> bytes:
        return self.text[self.begin[at] : self.begin[at + n] - 1]

    def hits(self, data: np.ndarray, w: W.Words) -> list[tuple[int, int, int]]:
        """(first word, length, group) of every window that occurs, all within one text."""
        out = []
        for size, (known, place, _, _) in self.groups.items():
            h = W.windows(w.hash, size)
            at = np.flatnonzero(self.filters[size][(h >> np.uint64(44)).astype(np.int64)])
            at = at[w.row[at] == w.row[at + size - 1]]
            near = np.searchsorted(known, h[at])
            for i, g in zip(at.tolist(), near.tolist()):
                while g < len(known) and known[g] == h[i]:
                    own = b" ".join(W.LOWER[data[a:b]].tobytes() for a, b in zip(w.start[i : i + size].tolist(), w.end[i : i + size].tolist()))
                    if self.words(place[g], size) == own:
                        out.append((i, size, g))
                    g += 1
        return out

    def items(self, found: set[tuple[int, int]]) -> list[str]:
        """The ids of the items that have any of some windows (length, group), sorted."""
        items = {k for size, g in found for _, _, starts, item in [self.groups[size]] for k in item[starts[g] : starts[g + 1]].tolist()}
        return sorted({self.ids[k] for k in items if self.ids[k] is not None})


def _scan(shared, id_col: str, text_col: str, row_col: str | None = None):
    schema = _SPANS if row_col is None else _SPANS.append(pa.field("row", pa.int64()))

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: NgramSet = shared.value
        for whole in batches:
            for batch in parts(whole, text_col):
                data, offsets = text_bytes(batch.column(text_col))
                w = W.words(data, offsets, W.ALNUM)
                n = len(offsets) - 1
                hit = np.zeros(len(w.hash), bool)
                found: list[set] = [set() for _ in range(n)]
                for i, size, g in grams.hits(data, w):
                    hit[i : i + size] = True
                    found[w.row[i]].add((size, g))
                spans, places = [[] for _ in range(n)], [[] for _ in range(n)]
                for r in {int(x) for x in w.row[hit]}:
                    a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    spans[r] = edge.tolist()
                    places[r] = [int(x) for s, e in zip(edge[::2], edge[1::2]) for x in (w.start[a + s] - offsets[r], w.end[a + e - 1] - offsets[r])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).cast(pa.int64()), pa.array(np.diff(w.bounds), pa.int64()), pa.array(spans, _SPANS.field(2).type), pa.array(places, _SPANS.field(3).type), pa.array([grams.items(x) for x in found], _SPANS.field(4).type), *([] if row_col is None else [batch.column(row_col)])], schema=schema
                )

    return scan


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, max_bytes: int) -> tuple[DataFrame, int]:
    """(i, t) of all items with a text, and in how many blocks their hash sets keep to max_bytes."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("t is not null")
    built = F.octet_length("t") + WORD_BYTES * F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = items.agg(F.coalesce(F.sum(built), F.lit(0))).first()[0]
    return items, max(1, -(-size // max_bytes))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans (flat [first, past-last) word places), bytes (the same as UTF-8 offsets), items."""
    small_batches(docs.sparkSession)
    items, n_blocks = _items(benchmark, item_col, item_text_col, max_broadcast_bytes)
    if n_blocks > 1:
        keyed, row = _keyed(docs.select(id_col, text_col))
        return _in_blocks(keyed, items, n_blocks, id_col, text_col, row, window).drop("row")
    shared = docs.sparkSession.sparkContext.broadcast(NgramSet([tuple(r) for r in items.collect()], window))
    return docs.select(id_col, text_col).mapInArrow(_scan(shared, id_col, text_col), _SPANS_DDL)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a key of each row, and the key's name."""
    row = free_name("_row", docs)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-documents"), row


def _in_blocks(keyed: DataFrame, items: DataFrame, n_blocks: int, id_col: str, text_col: str, row: str, window: int) -> DataFrame:
    """contamination() of keyed rows with the benchmark in blocks, and each row's key as row."""
    out = []
    for b in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        shared = keyed.sparkSession.sparkContext.broadcast(NgramSet([tuple(r) for r in own.collect()], window))
        out.append(written(keyed.select(id_col, text_col, row).mapInArrow(_scan(shared, id_col, text_col, row), f"{_SPANS_DDL}, row long"), "contamination-block"))
    return _merged(out)


def _merged(blocks: list[DataFrame]) -> DataFrame:
    """One row for each row key from its rows of all blocks; spans are joined where they overlap."""
    rows = blocks[0]
    for x in blocks[1:]:
        rows = rows.unionByName(x)

    def join(pairs):
        step = lambda acc, p: F.when((F.size(acc) > 0) & (p[0] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(p[1], F.element_at(acc, -1))))).otherwise(F.concat(acc, p))
        return F.aggregate(F.array_sort(F.array_distinct(pairs)), F.expr("cast(array() as array<bigint>)"), step)

    def paired(c):
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i < F.size(c))), lambda i: F.array(F.get(c, i), F.get(c, i + 1)))

    got = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *[F.flatten(F.collect_list(paired(F.col(c)))).alias(c) for c in ("spans", "bytes")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return got.select("doc_id", "n_words", join(F.col("spans")).alias("spans"), join(F.col("bytes")).alias("bytes"), "items", "row")


def judged(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of contamination()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)
    # alternating sum: each span adds last minus first, so fold from the left as x - a
    return (
        found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))
    )


def _clean_only(shared, text_col: str):
    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: NgramSet = shared.value
        for whole in batches:
            for batch in parts(whole, text_col):
                data, offsets = text_bytes(batch.column(text_col))
                w = W.words(data, offsets, W.ALNUM)
                hit = np.zeros(len(w.hash) + 1, np.int64)
                for i, size, _ in grams.hits(data, w):
                    hit[i : i + size] = 1
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.bounds])
                yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= np.diff(w.bounds)))))

    return scan


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, max_broadcast_bytes: int = MAX_BYTES, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, unchanged, in one pass without a shuffle (blocks need a join)."""
    small_batches(docs.sparkSession)
    items, n_blocks = _items(benchmark, "item_id", "text", max_broadcast_bytes)
    if n_blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(NgramSet([tuple(r) for r in items.collect()], window))
        return docs.mapInArrow(_clean_only(shared, "text"), docs.schema)
    keyed, row = _keyed(docs)
    found = _in_blocks(keyed, items, n_blocks, "doc_id", "text", row, window)
    bad = judged(found.withColumn("doc_id", F.col("row"))).filter("contaminated").select(F.col("doc_id").alias(row))
    return keyed.join(bad, row, "left_anti").select(*docs.columns)


def spans_removed(docs: DataFrame, benchmark: DataFrame, *, max_broadcast_bytes: int = MAX_BYTES, window: int = WINDOW) -> DataFrame:
    """doc_id and text with every hit word span cut out (the other way to use the hits)."""
    small_batches(docs.sparkSession)
    keyed, row = _keyed(docs.select("doc_id", "text"))
    items, n_blocks = _items(benchmark, "item_id", "text", max_broadcast_bytes)
    found = _in_blocks(keyed, items, n_blocks, "doc_id", "text", row, window).filter(F.size("bytes") > 0).select(F.col("row").alias(row), F.col("bytes").alias("_spans"))
    raw = F.encode("text", "utf-8")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("_spans"), F.array(F.octet_length("text").cast("long")))
    pieces = F.transform(F.filter(F.sequence(F.lit(0), F.size(edges) - 1), lambda i: i % 2 == 0), lambda i: F.decode(F.substring(raw, (F.get(edges, i) + 1).cast("int"), (F.get(edges, i + 1) - F.get(edges, i)).cast("int")), "utf-8"))
    joined = keyed.join(found, row, "left")
    return joined.select("doc_id", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))
