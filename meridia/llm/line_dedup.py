"""Line deduplication with a log-template tree of fixed depth.

A line's tokens stand between white space; those with a digit are fields, <*>. Its leaf in the tree is its token count
and its leading tokens: `depth` of them, or half of a line of fewer tokens than twice that. A leaf holds any number of
templates. First, a token is constant at a place where it stands in at least min_docs and constant_percent of the leaf's
lines (each counted once a document). The lines that get no template this way are then told apart by what stands around
a place: a token of theirs is constant, too, where it has that share of those among them with the same two neighbours,
as NEIGHBOURS lists them. Other templates and single lines of the leaf have other neighbours, so they do not change
these shares however many there are; a share means the same for few documents and for many.
All other places are fields too. A line
whose fields are at most 100 - percent of its tokens (or one, of three tokens and more) has as template its tokens with
<*> for each field; any other line, and one without fields, stands for itself, by its own tokens. A template recurs if
min_docs documents have a line of it (short_min_docs for lines of under short_tokens tokens, which meet by chance). The
document with the smallest doc_id keeps its lines of a recurring template, as the collection's one copy; every other
document loses them. Lines of under short_tokens tokens that are all fields (a year, a cell of a table) say nothing of
where they come from: they are kept and not counted.

The tree is not grown line by line: leaves are hash keys. A first pass over the texts finds the leaves of several
documents, and a bitmap of bounded size tells them in a second pass, so that lines whose leaf is one document's own
never leave the task that reads them (a false hit of the bitmap costs time and changes nothing). Counts are aggregated
before each shuffle: a line that a third of all documents share is one row from the first aggregation on.

Cases: a null text stays null and an empty one empty; blank lines are kept and never counted; a line repeated inside
one document counts once, and only other documents lose it; rows that repeat a doc_id count as one document and are
each cleaned, exact repeats alike; rows with a null doc_id are returned unchanged and not counted; a text without line
breaks is one line; an empty table gives no rows; other columns pass through whatever their names; where one is named
n_lines or n_dropped, the operator's own, which stand last, get leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Bitmap, bitmap, dropped, free_name, frugal, parts, small_batches, text_bytes, written

FIELD = "<*>"
_LINES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("leaf", pa.int64()), ("n_tokens", pa.int32()), ("masked", pa.string())])
_LINES_DDL = "doc_id long, row long, line int, k1 long, k2 long, leaf long, n_tokens int, masked string"
#: Bits of the largest bitmap of leaves with several documents: 4 MB.
LEAF_BITS = 25
#: Places of two neighbours, counted from a token's own. Past the ends of a line stands nothing, which is a neighbour too.
NEIGHBOURS = ((-2, -1), (1, 2), (-1, 1), (-2, 2))
_FIELD_HASH = W.words(np.frombuffer(FIELD.encode(), np.uint8), np.array([0, len(FIELD)]), W.BLANKS, lower=False).hash[0]


class Lines:
    """The lines of some texts that count: their row, place in it, token count and leaf; keys() and masked() give more."""

    def __init__(self, texts: pa.Array, depth: int, short_tokens: int):
        self.data, offsets = text_bytes(texts)
        breaks = np.flatnonzero(self.data == 10)
        w = self.words = W.words(self.data, np.unique(np.concatenate([offsets, breaks + 1])), W.BLANKS, lower=False)
        some = np.flatnonzero(np.diff(w.bounds))
        first, n = w.bounds[some], np.diff(w.bounds)[some]
        digits = np.concatenate([[0], np.cumsum((self.data >= 48) & (self.data <= 57), dtype=np.int32)])
        self.field = digits[w.end] > digits[w.start]
        if not len(some):
            self.first = self.n = self.row = self.place = self.leaf = np.zeros(0, np.int64)
            return
        counts = np.flatnonzero((n >= short_tokens) | (np.add.reduceat(self.field, first, dtype=np.int64) < n))
        self.first, self.n = first[counts], n[counts]
        begin = w.start[self.first]
        self.row = np.searchsorted(offsets, begin, "right") - 1
        self.place = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[self.row])
        size = self.n.astype(np.uint64)
        shown = np.where(self.field, _FIELD_HASH, w.hash)
        leaf, lead = W.mixed(size), np.minimum(depth, (self.n + 1) // 2)
        for j in range(depth):
            own = np.flatnonzero(lead > j)
            leaf[own] = W.mixed(leaf[own] * np.uint64(0x9E3779B97F4A7C15) + shown[self.first[own] + j])
        self.leaf = leaf.view(np.int64)

    def keys(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of all tokens of each of the lines kept."""
        n = self.n[kept]
        if not len(kept):
            return n, n
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        h = self.words.hash[np.repeat(self.first[kept], n) + place]
        spread = W.powers(int(n.max()))[place]
        return tuple(W.mixed(np.add.reduceat(x * spread, begin) + n.astype(np.uint64)).view(np.int64) for x in (h, W.mixed(h ^ np.uint64(0xA5A5A5A55A5A5A5A))))

    def masked(self, i: int) -> str:
        """The tokens of line i with <*> for those that have a digit."""
        a = int(self.first[i])
        b = a + int(self.n[i])
        tokens = self.data[self.words.start[a] : self.words.end[b - 1]].tobytes().split()
        return " ".join(FIELD if f else t.decode() for t, f in zip(tokens, self.field[a:b].tolist()))


def _leaves(depth: int, short_tokens: int):
    @frugal
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                lines = Lines(batch.column("text"), depth, short_tokens)
                order = np.argsort(lines.leaf, kind="stable")
                leaf, doc = lines.leaf[order], np.asarray(batch.column("doc_id"))[lines.row[order]]
                at = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else order
                lo, hi = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(leaf) else (doc, doc)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["leaf", "lo", "hi"])

    return leaves


def _lines(shared, depth: int, short_tokens: int):
    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several: Bitmap = shared.value
        for whole in batches:
            for batch in parts(whole, "text"):
                lines = Lines(batch.column("text"), depth, short_tokens)
                kept = np.flatnonzero(several.has(lines.leaf))
                k1, k2 = lines.keys(kept)
                # one line of each key brings its text
                order = np.lexsort((k2, k1))
                new = np.ones(len(order), bool)
                new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
                texts: list[str | None] = [None] * len(kept)
                for i in order[new].tolist():
                    texts[i] = lines.masked(kept[i])
                row = lines.row[kept]
                columns = [np.asarray(batch.column("doc_id"))[row], np.asarray(batch.column("row"))[row], lines.place[kept], k1, k2, lines.leaf[kept], lines.n[kept], texts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES)], schema=_LINES)

    return read


def recurring_lines(docs: DataFrame, *, depth: int = 4, min_docs: int = 2, percent: int = 70, constant_percent: int = 10, short_tokens: int = 5, short_min_docs: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lines, again): the lines of leaves with several documents, and of those that recur by key their template (null: the line itself) and its first document.

    lines: doc_id, row (a hash of the text), line (its place), k1, k2. again: k1, k2, template, t_docs, t_first.
    """
    small_batches(docs.sparkSession)
    read = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    leaves = read.select("doc_id", "text").mapInArrow(_leaves(depth, short_tokens), "leaf long, lo long, hi long")
    several = written(leaves.groupBy("leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("leaf"), "several")
    bits = min(LEAF_BITS, max(16, (16 * several.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(several, "leaf", bits))
    lines = written(read.mapInArrow(_lines(shared, depth, short_tokens), _LINES_DDL), "lines")

    distinct = written(lines.groupBy("k1", "k2", "doc_id").agg(F.min("leaf").alias("leaf"), F.min("n_tokens").alias("n_tokens")).groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.min("leaf").alias("leaf"), F.min("n_tokens").alias("n_tokens")), "distinct-lines")
    needed = F.when(F.col("n_tokens") < short_tokens, short_min_docs).otherwise(min_docs)
    mixed = distinct.groupBy("leaf").agg(F.count("*").alias("n_lines"), F.sum("n_docs").alias("leaf_docs")).filter("n_lines > 1").select("leaf", "leaf_docs")
    counted = distinct.select("k1", "k2", "n_docs", "n_tokens", "leaf").join(mixed, "leaf")
    texts = lines.filter("masked is not null").select("k1", "k2", "masked").dropDuplicates(["k1", "k2"])
    texts = written(texts.join(counted, ["k1", "k2"]).withColumn("token", F.split("masked", " ")).drop("masked").withColumn("lead", F.least(F.lit(depth), F.floor((F.col("n_tokens") + 1) / 2)).cast("int")), "line-texts")

    # the leading tokens are the leaf's own; only the places after them can differ in a leaf
    after = F.sequence("lead", F.col("n_tokens") - 1)
    own = F.get("token", F.col("at"))
    here = F.when(own != FIELD, F.xxhash64(own)).alias("own")
    rest = texts.filter("lead < n_tokens").withColumn("at", F.explode(after)).select("leaf", "leaf_docs", "k1", "k2", "n_docs", "at", here).filter("own is not null")
    alike = rest.groupBy("leaf", "at", "own").agg(F.sum("n_docs").alias("n"), F.max("leaf_docs").alias("leaf_docs")).filter(F.col("n") >= min_docs)
    alike = written(alike.select("leaf", "at", "own", (F.col("n") * 100 >= F.col("leaf_docs") * constant_percent).alias("often")), "token-counts")

    def shaped(lines: DataFrame) -> DataFrame:
        fixed = F.coalesce("places", F.array().cast("array<int>"))
        at = lambda p, token: F.struct(p.alias("at"), token.alias("own"))
        tail = F.array_sort(F.concat(F.transform(fixed, lambda p: at(p, F.get("token", p))), F.transform(F.array_except(after, fixed), lambda p: at(p, F.lit(FIELD)))))
        name = F.when(F.col("lead") < F.col("n_tokens"), F.concat(F.slice("token", 1, F.col("lead")), F.transform(tail, lambda x: x["own"]))).otherwise(F.col("token"))
        fields = F.size(F.filter("name", lambda t: t == FIELD))
        fits = (F.col("fields") * 100 <= F.col("n_tokens") * (100 - percent)) | ((F.col("fields") == 1) & (F.col("n_tokens") >= 3))
        return lines.withColumn("name", name).withColumn("fields", fields).withColumn("fits", fits).filter("fields > 0")

    places = written(rest.join(alike.filter("often"), ["leaf", "at", "own"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("places")), "places")
    first = shaped(texts.join(places, ["k1", "k2"], "left"))
    others = written(first.filter("not fits").select(*texts.columns, "places"), "other-lines")
    near = [F.xxhash64(F.lit(a), F.lit(b), "leaf", "at", *(F.coalesce(F.get("token", F.col("at") + k), F.lit("")) for k in (a, b))) for a, b in NEIGHBOURS]
    beside = others.filter("lead < n_tokens").withColumn("at", F.explode(after)).select("k1", "k2", "n_docs", "at", here, F.explode(F.array(*near)).alias("around"))
    counts = written(beside.groupBy("around", "own").agg(F.sum("n_docs").alias("n")), "neighbour-counts")
    around = counts.groupBy("around").agg(F.sum("n").alias("of")).filter(F.col("of") >= min_docs)
    constant = counts.filter(F.col("own").isNotNull() & (F.col("n") >= min_docs)).join(around, "around")
    constant = written(constant.filter(F.col("n") * 100 >= F.col("of") * constant_percent).select("around", "own"), "constants")
    more = beside.join(constant, ["around", "own"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("more"))
    none = F.array().cast("array<int>")
    second = shaped(others.join(more, ["k1", "k2"], "left").withColumn("places", F.array_union(F.coalesce("places", none), F.coalesce("more", none))).drop("more"))
    general = first.filter("fits").unionByName(second.filter("fits")).withColumn("template", F.array_join("name", " "))
    general = written(general.select("k1", "k2", F.xxhash64("template").alias("t1"), F.xxhash64(F.lit(1), "template").alias("t2"), "template", "n_tokens"), "general")
    dropped(texts, alike, places, others, counts, constant, several)

    # documents of a template: several lines of it in one document count once
    of = lines.select("k1", "k2", "doc_id").join(general.select("k1", "k2", "t1", "t2", "n_tokens"), ["k1", "k2"])
    totals = of.groupBy("t1", "t2", "doc_id").agg(F.min("n_tokens").alias("n_tokens")).groupBy("t1", "t2").agg(F.count("*").alias("t_docs"), F.min("doc_id").alias("t_first"), F.min("n_tokens").alias("n_tokens"))
    totals = written(totals.filter(F.col("t_docs") >= needed).select("t1", "t2", "t_docs", "t_first"), "templates")
    alone = distinct.filter(F.col("n_docs") >= needed).join(general.select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(None).cast("string").alias("template"), F.col("n_docs").alias("t_docs"), F.col("first_doc").alias("t_first"))
    again = written(alone.unionByName(general.join(totals, ["t1", "t2"]).select("k1", "k2", "template", "t_docs", "t_first")), "recurring")
    dropped(distinct, general, totals)
    return lines, again


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the lines of recurring templates dropped from their texts, plus n_lines and n_dropped as the last columns."""
    lines, again = recurring_lines(docs, **options)
    lost = lines.select("doc_id", "row", "line", "k1", "k2").join(again.select("k1", "k2", "t_first"), ["k1", "k2"]).filter(F.col("doc_id") != F.col("t_first"))
    # exact repeats of a row share their doc_id and hash, so their places form one set
    gone, doc, row = (free_name(n, docs) for n in ("_gone", "_doc", "_hash"))
    lost = written(lost.groupBy("doc_id", "row").agg(F.collect_set("line").alias(gone)).withColumnsRenamed({"doc_id": doc, "row": row}), "lost-lines")
    dropped(lines, again)
    joined = docs.join(lost, (docs["doc_id"].cast("long") == lost[doc]) & (F.xxhash64(docs["text"]) == lost[row]), "left")
    own = F.split("text", "\n")
    # many lost lines are searched once a line: places as a map
    places = F.map_from_arrays(F.col(gone), F.array_repeat(F.lit(True), F.size(gone)))
    kept = F.filter(own, lambda x, i: ~F.coalesce(F.element_at(places, i), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(own)).cast("long")
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*columns, n_lines.alias(free_name("n_lines", docs)), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(free_name("n_dropped", docs)))
