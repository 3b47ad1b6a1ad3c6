"""Best-fit packing of documents into sequences under several capacities at once.

Texts are encoded where they are read; documents longer than a sequence are cut into full pieces and a rest. Pieces
(their lengths, and their ids if asked for) are dealt by a hash of their place into groups of about `group_rows`, which
are even however the documents are keyed or repeated, and each group is packed on its own: pieces from long to short, each into the open
sequence where the weighted norm of what remains (tokens, documents, attention cost, each as a share of its
capacity) is least, or where the weighted dot product of piece and residual is largest, among the sequences where
no capacity is exceeded. A group leaves at most about one sequence unfilled, a share of 1 in thousands.

Cases: a null or empty text is a piece of the end id alone; documents of exactly the capacity stay whole; repeated
rows are packed each; a null doc_id keeps its pieces; equal lengths are ordered by doc_id and piece, so results are
the same on every run over the same parts of the input; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, frugal, parts, small_batches, written
from .subwords import KEEP_PIECES

TOKENS = 4096


def _pieces(tokenizer: str, end_id: int, capacity: int, with_ids: bool, keep_pieces: int):
    @frugal(encodes=True)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .subwords import encoder

        enc = encoder(tokenizer, "word")
        enc.keep_pieces = keep_pieces
        for whole in batches:
            for batch in parts(whole, "text", 1_000_000):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.ids(batch.column("text").to_pylist())):
                    ids = np.append(ids, end_id).astype("<u4")
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        rows.append((doc_id, piece, at, len(own), zlib.crc32(own.tobytes()), own.tobytes() if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    return cut


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = TOKENS, with_ids: bool = False, keep_pieces: int = KEEP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids] of every piece of every document.

    keep_pieces: the sub-word pieces that a worker remembers; fewer take less memory and more time, for the same rows.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids, keep_pieces), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def vector_best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths must descend. rule: 'norm' or 'dot'."""
    cap, w = np.array(capacities, float), np.array(weights, float)
    left = np.empty((len(lengths), 3))
    name = np.empty(len(lengths), np.int64)
    n_open = n_bins = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = float(lengths[-1]) if len(lengths) else 0
    for i, t in enumerate(lengths.tolist()):
        need = np.array([t, 1.0, float(t) * t])
        if (need > cap).any():
            raise ValueError("a piece exceeds a capacity by itself")
        rest = left[:n_open] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            share = rest[fits] / cap
            j = int(fits[np.argmin((share * share) @ w)] if rule == "norm" else fits[np.argmax((left[fits] / cap * (need / cap)) @ w)])
        else:
            j = n_open
            left[j], name[j] = cap, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = name[j], cap[0] - left[j, 0]
        left[j] -= need
        if left[j, 0] < least or left[j, 1] < 1 or left[j, 2] < least * least:  # nothing can follow
            n_open -= 1
            left[j], name[j] = left[n_open], name[n_open]
    return bins, offsets


def packed(cut: DataFrame, *, capacity: int = TOKENS, max_documents: int = TOKENS, max_attention: int = TOKENS * TOKENS, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", group_rows: int = 8_000) -> DataFrame:
    """Add sequence_id and offset to pieces. max_attention bounds the sum of squared lengths in a sequence."""
    columns, place, group = cut.columns, free_name("_place", cut), free_name("_group", cut)
    # rows are dealt by their place in the written table: any number of equal rows is spread over all groups
    cut = written(cut.withColumn(place, F.monotonically_increasing_id()), "pieces")
    n_groups = max(1, -(-cut.count() // group_rows))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = vector_best_fit(rows["length"].to_numpy(), (capacity, max_documents, max_attention), weights, rule)
        return rows[columns].assign(sequence_id=bins + (int(rows[group].iloc[0]) << 32), offset=offsets)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != place)
    dealt = cut.withColumn(group, F.pmod(F.xxhash64(place), F.lit(n_groups))).drop(place)
    return dealt.groupBy(group).applyInPandas(pack, f"{kinds}, sequence_id long, offset long")
