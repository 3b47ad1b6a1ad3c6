"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is then coded: the list of its nearest centroid
and one byte for each part of its residual. The number of lists is about twice the square root of the number of vectors,
as far as the sample holds list_sample vectors for each. A query probes the lists whose centroids have the largest inner
product with it; how many is measured on the sample. The asymmetric distance table of the query (its inner products with
all codewords) scores the coded vectors of its lists; the best `rerank` of them in a cell are scored exactly, in double
precision on the original vectors, and the best k go on, to be merged over the cells.

A cell is a task's work: a run of small lists, or a part of a large one, of at most about cell_rows vectors; its queries
are dealt in groups of about cell_queries. So a list that holds a third of all vectors, or that all queries probe, is
many tasks' work; a query is sent to each cell once, with the lists it probes there. Centroids and codebooks (their
sizes are parameters) are broadcast; vectors and queries are shuffled by cell.

Cases: vectors that are null, zero, of a length other than the most common one, or with null or non-finite parts are neither
candidates nor queries; a query is no candidate for itself; ties go to the smaller vec_id; with fewer candidates than
k in its lists a query probes all lists; repeated vec_ids are candidates each, and ask once, with their least vector;
a null vec_id takes no part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, small_batches, written


@dataclass
class Index:
    centroids: np.ndarray
    n_probe: int  #: lists a query probes
    codebooks: np.ndarray  #: parts x codewords x width


def _means(data: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = data[rng.choice(len(data), min(k, len(data)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(data, c)
        total, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, data)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(data: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(data[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(data), 8192)]) if len(data) else np.zeros(0, np.int64)


def fitted(vectors: DataFrame, n: int, width: int, *, sample_rows: int = 32_768, list_sample: int = 16, n_parts: int = 16, codewords: int = 64, rounds: int = 8, target: float = 0.97, k: int = 20) -> Index:
    """Fit on about sample_rows vectors (by a hash of vec_id), in lists of at least list_sample of them.

    How many lists to probe is measured: enough for the share `target` of the k nearest sample vectors of sample
    queries. Clustered vectors need few lists, vectors without structure most.
    """
    share = min(1.0, sample_rows / max(n, 1))
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < F.lit(share) * 1_000_003).select("vec_id", "v").toArrow()
    data = _matrix(rows["v"].combine_chunks(), width)
    data = data[np.lexsort((*data.T[::-1], np.asarray(rows["vec_id"])))].astype(np.float32)
    if not len(data):  # a sample of hashes may miss a table of few vectors
        data = _matrix(vectors.orderBy("vec_id", "v").limit(1).toArrow()["v"].combine_chunks(), width).astype(np.float32)
    rng = np.random.default_rng(5)
    lists = int(max(1, min(2 * n**0.5, len(data) // list_sample)))
    c = _means(data, lists, rounds, rng)
    rest = data - c[_nearest(data, c)]
    n_parts = max(p for p in range(1, n_parts + 1) if width % p == 0)
    books = [_means(part, codewords, rounds, rng) for part in np.split(rest, n_parts, axis=1)]
    return Index(c, _probes_needed(data, c, target, k), np.array(books))


def _probes_needed(data: np.ndarray, c: np.ndarray, target: float, k: int) -> int:
    asked = data[:: max(1, len(data) // 300)]
    k = min(k + 1, len(data))
    near = np.argpartition(-(asked @ data.T), k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], 1)
    places = np.sort(np.take_along_axis(place, _nearest(data, c)[near], 1).ravel())
    return int(places[min(len(places) - 1, int(target * len(places)))]) + 1


def coded(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, v, list, codes of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    @frugal
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for b in batches:
            data = _matrix(b.column("v"), ix.centroids.shape[1]).astype(np.float32)
            own = _nearest(data, ix.centroids)
            rest = data - ix.centroids[own]
            codes = np.stack([_nearest(part, book) for part, book in zip(np.split(rest, len(ix.codebooks), axis=1), ix.codebooks)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(own, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "list", "codes"])

    return vectors.mapInArrow(code, "vec_id long, v array<double>, list long, codes binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _probes(queries: DataFrame, index: Index, sizes: dict[int, int], k: int) -> DataFrame:
    """vec_id, v, lists: the lists that each query probes, most promising first; so many that they hold k other vectors."""
    held = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, held))

    @frugal
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                order = np.argsort(-(_matrix(b.column("v"), c.shape[1]) @ c.T.astype(np.float64)), axis=1, kind="stable")
                enough = np.argmax(np.cumsum(held[order], axis=1) >= min(k + 1, held.sum()), axis=1) + 1
                near = [o[: max(index.n_probe, e)] for o, e in zip(order, enough.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.list_(pa.int64()))], names=["vec_id", "v", "lists"])

    return queries.mapInArrow(probe, "vec_id long, v array<double>, lists array<long>")


def cells_of(sizes: dict[int, int], cell_rows: int) -> list[tuple[int, int, int]]:
    """(list, first cell, number of cells) of every list: small lists share a cell in turn, large ones have several."""
    out, cell, room = [], 0, cell_rows
    for name in sorted(sizes):
        n = sizes[name]
        if n > room and room < cell_rows:
            cell, room = cell + 1, cell_rows
        if n > cell_rows:
            many = -(-n // cell_rows)
            out.append((name, cell, many))
            cell += many
        else:
            out.append((name, cell, 1))
            room -= n
    return out


def _searched(shared, k: int, rerank: int):
    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index: Index = shared.value
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(asked):
            own = own.sort_values(["list", "vec_id"], kind="stable")
            data, ids, lists = np.array(own["v"].tolist(), np.float64), own["vec_id"].to_numpy(), own["list"].to_numpy()
            codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1).astype(np.int64)
            names, begin = np.unique(lists, return_index=True)
            runs = {int(l): (int(a), int(b)) for l, a, b in zip(names, begin, [*begin[1:], len(lists)])}
            n_parts = len(index.codebooks)
            at_code = codes + np.arange(n_parts) * index.codebooks.shape[1]
            for query, vector, probed in zip(asked["vec_id"].tolist(), asked["v"], asked["lists"]):
                q = np.asarray(vector, np.float64)
                rows = np.concatenate([np.arange(*runs[int(l)]) for l in probed if int(l) in runs] or [np.zeros(0, np.int64)])
                rows = rows[ids[rows] != query]
                if len(rows) > rerank:
                    table = np.einsum("pw,pcw->pc", q.reshape(n_parts, -1), index.codebooks).ravel()
                    center = index.centroids[names] @ q
                    score = table[at_code[rows]].sum(axis=1) + center[np.searchsorted(names, lists[rows])]
                    floor = -np.partition(-score, rerank - 1)[rerank - 1]
                    above, equal = rows[score > floor], rows[score == floor]
                    # of the ties of the last kept score the smaller vec_ids stay
                    rows = np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")][: rerank - len(above)]])
                exact = data[rows] @ q
                top = np.lexsort((ids[rows], -exact))[:k]
                out["query_id"] += [query] * len(top)
                out["vec_id"] += ids[rows][top].tolist()
                out["score"] += exact[top].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )


def nearest(embeddings: DataFrame, is_query: Column, *, k: int = 20, rerank: int = 400, cell_rows: int = 8_000, cell_queries: int = 1_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row."""
    small_batches(embeddings.sparkSession)
    spark, vectors = embeddings.sparkSession, usable(embeddings)
    common = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width, n = (common[0]["w"], common[0]["count"]) if common else (1, 0)
    vectors = vectors.filter(F.size("v") == width)
    if not n:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index = fitted(vectors, n, width, k=k)
    lists = written(coded(vectors, index), "lists")
    # one row a list: at most the number of centroids, which is bounded
    sizes = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}
    cells = F.broadcast(spark.createDataFrame(cells_of(sizes, cell_rows), "list long, first int, many int"))
    asked = written(_probes(vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), index, sizes, k), "probes")
    probes = asked.select("vec_id", F.explode("lists").alias("list")).join(cells, "list").select("vec_id", "list", F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)).alias("cell"))
    probes = written(probes.groupBy("vec_id", "cell").agg(F.collect_list("list").alias("lists")), "probed-cells")
    groups = probes.groupBy("cell").agg(F.ceil(F.count("*") / cell_queries).cast("int").alias("groups"))
    groups = written(groups, "cell-groups")
    own = lists.join(cells, "list").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("many")).cast("int")).join(groups, "cell")
    own = own.select("cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "list", "vec_id", "v", "codes")
    probes = probes.join(groups, "cell").join(asked.select("vec_id", "v"), "vec_id").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int").alias("part"), "vec_id", "v", "lists")
    shared = spark.sparkContext.broadcast(index)
    found = own.groupBy("cell", "part").cogroup(probes.groupBy("cell", "part")).applyInPandas(_searched(shared, k, rerank), "query_id long, vec_id long, score double")
    # k best of each query from at most k rows a cell
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
