"""Token counts that follow edits: a tree of pre-token segments kept for each document, updated where an edit touches.

A text is cut into leaves of about `leaf_chars` characters at places where no token can cross (a blank between two
other characters, see subwords). kept_trees() encodes the leaves once and returns a table of them with their token
counts; written down, it is what later edits start from. edited() reads that table: a binary tree over the leaves holds
sums of their counts and characters; an edit replaces characters; only the leaves within two characters of it are
encoded again, together, since a cut at least two characters away from every change is still a cut. The sums on the way
to the root are then corrected. It returns the trees after the edits in the same form, for the next edits.

A leaf that insertions have made longer than four leaves is cut again; the sums are then laid out anew without any
encoding.

Cases: a null or empty text has one empty leaf and no tokens; edits beyond the end are moved to the end; null
edits or none leave the counts; edits of a document apply in their order, each to the text that the last one left;
repeated rows are counted each; a text without blanks is one leaf; an empty table gives no rows; other
columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import frugal, parts, small_batches

_TREES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("leaves", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
_TREES_DDL = "doc_id long, n_chars long, leaves array<string>, counts array<int>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_leaves", pa.int64()), ("n_encoded_again", pa.int64()), *list(_TREES)[1:]])
_OUT_DDL = "doc_id long, n_tokens_before long, n_tokens long, n_edits long, n_leaves long, n_encoded_again long, n_chars long, leaves array<string>, counts array<int>"


def leaves(text: str, size: int) -> list[str]:
    """Cut a text into leaves of at least `size` characters (the last may be shorter)."""
    out, begin, at = [], 0, size
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(text[begin:at])
            begin, at = at, at + size
        else:
            at += 1
    return [*out, text[begin:]]


class CountTree:
    """Leaves of one document and the sums over them; n_encoded counts the characters that edits had encoded again."""

    def __init__(self, leaf: list[str], counts: list[int], encode, size: int = 512):
        self.encode, self.size, self.n_encoded = encode, size, 0
        self._lay_out(leaf or [""], counts or [0])

    @classmethod
    def of(cls, text: str, encode, size: int = 512) -> "CountTree":
        cut = leaves(text, size)
        return cls(cut, [len(x) for x in encode(cut)], encode, size)

    def _lay_out(self, leaf: list[str], counts: list[int]) -> None:
        self.leaf = list(leaf)
        self.width = 1 << max(0, (len(leaf) - 1).bit_length())
        self.sums, self.chars = [0] * (2 * self.width), [0] * (2 * self.width)
        self.sums[self.width : self.width + len(leaf)] = counts
        self.chars[self.width : self.width + len(leaf)] = map(len, leaf)
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def counts(self) -> list[int]:
        return self.sums[self.width : self.width + len(self.leaf)]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _set(self, i: int, text: str, count: int) -> None:
        self.leaf[i] = text
        node = i + self.width
        by, longer = count - self.sums[node], len(text) - self.chars[node]
        while node:
            self.sums[node] += by
            self.chars[node] += longer
            node //= 2

    def edit(self, start: int, n_delete: int, insert: str) -> None:
        n = self.chars[1]
        start = min(max(start, 0), n)
        stop = min(start + max(n_delete, 0), n)
        first, begin = self._leaf_at(max(start - 2, 0))
        last, _ = self._leaf_at(min(stop + 2, max(n - 1, 0)))
        old = "".join(self.leaf[first : last + 1])
        new = old[: start - begin] + insert + old[stop - begin :]
        self.n_encoded += len(new)
        cut, room = leaves(new, self.size), last - first + 1
        if len(cut) > room and len("".join(cut[room - 1 :])) > 4 * self.size:  # a leaf would outgrow the rest
            fresh = [len(ids) for ids in self.encode(cut)]
            counts = self.counts
            self._lay_out([*self.leaf[:first], *cut, *self.leaf[last + 1 :]], [*counts[:first], *fresh, *counts[last + 1 :]])
            return
        cut = [*cut[: room - 1], "".join(cut[room - 1 :])] if len(cut) > room else [*cut, *[""] * (room - len(cut))]
        for i, (text, ids) in enumerate(zip(cut, self.encode(cut))):
            self._set(first + i, text, len(ids))


def _grow(tokenizer: str, size: int):
    @frugal(encodes=True)
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .subwords import encoder

        enc = encoder(tokenizer, "byte")
        for whole in batches:
            for batch in parts(whole, "text", 1_000_000):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                cut = [leaves(t, size) for t in texts]
                n = iter([len(x) for x in enc.ids([leaf for own in cut for leaf in own])])
                counts = [[next(n) for _ in own] for own in cut]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(([len(t) for t in texts], cut, counts), list(_TREES)[1:]))], schema=_TREES)

    return grow


def kept_trees(docs: DataFrame, tokenizer: str, *, leaf_chars: int = 512) -> DataFrame:
    """doc_id, n_chars, leaves and counts (tokens of each leaf) of every document: the table that edits start from."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(_grow(tokenizer, leaf_chars), _TREES_DDL)


def _apply(tokenizer: str, size: int):
    @frugal(encodes=True)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .subwords import encoder

        enc = encoder(tokenizer, "byte")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc_id, leaf, counts, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "leaves", "counts", "edits"))):
                    tree = CountTree(leaf, counts, enc.ids, size)
                    before, todo = tree.total, [e for e in edits or [] if e is not None]
                    for e in todo:
                        tree.edit(e["start"] or 0, e["n_delete"] or 0, e["insert"] or "")
                    rows.append((doc_id, before, tree.total, len(todo), len(tree.leaf), tree.n_encoded, tree.chars[1], tree.leaf, tree.counts))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return apply


def edited(trees: DataFrame, edits: Column, tokenizer: str, *, leaf_chars: int = 512) -> DataFrame:
    """The kept trees after their edits, with token counts before and after, in one pass and without a shuffle.

    edits: array<struct<start int, n_delete int, insert string>>, of columns of trees (see attached for a table of edits).
    """
    small_batches(trees.sparkSession)
    read = trees.select("doc_id", "leaves", "counts", edits.alias("edits"))
    return read.mapInArrow(_apply(tokenizer, leaf_chars), _OUT_DDL)


def attached(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the column edits, from a table (doc_id, edit_no, start, n_delete, insert); ties in edit_no go by start."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("edit_no", "start", "n_delete", "insert"))).alias("edits"))
    return trees.join(own, "doc_id", "left").withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["n_delete"].alias("n_delete"), e["insert"].alias("insert"))))
