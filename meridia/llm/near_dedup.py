"""Near duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts gives each document its distinct word shingles' count, a 128-bit key of the whole
   set, band keys of its minima, and the low bits of all minima packed into a few integers.
2. Documents with equal sets form a class at once; only the class's smallest doc_id goes on.
3. Band keys that several classes share give candidates. First each class meets the leader it shares most bands
   with, and confirmed links are merged into components. A band inside one component is settled: a group of
   thousands of copies costs one test for each copy.
4. In bands that still hold several components, all pairs across components are compared by packed bits, corrected
   for chance agreement of b-bit values, down to five standard errors below the threshold. This happens inside tasks:
   a band is cut into blocks of bounded size, and each pair of blocks that can hold such a pair is a group (members
   of the band's largest component meet the others only). A group gives at most as many pairs as it has members, a
   forest that connects all plausible ones.
5. What these forests connect are clusters: documents that are nearly alike, wherever their bands chain on to. Their
   full sets are compared in blocks too, all pairs across components, and only links that join components leave a
   task. So no list of all pairs is ever made, and no plausible pair of a band is left out.

With 64 bands of 7 minima a pair at the threshold 0.8 is no candidate with probability 3e-7, at 0.85 with 1e-11.

Cases: documents with fewer words than a shingle have one shingle, all their words; those without words are in a
class of their own; a null doc_id is returned with its count, without a component, and kept; rows that repeat a
doc_id are one document, linked by any of their texts; an empty table gives no rows; ties go to the smaller doc_id;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import Bitmap, bitmap, dropped, frugal, parts, small_batches, text_bytes, written

BANDS, ROWS, BITS = 64, 7, 2
_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
#: Rows and bytes of a block of a band or cluster; a task holds two blocks.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 12_000_000
#: Bits of the largest bitmap of candidates: 16 MB.
MOST_BITS = 27

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_SIGNATURE_DDL = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.binary())])


def shingle_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    data, offsets = text_bytes(batch.column("text"))
    w = W.words(data, offsets, W.BLANKS)
    full = W.windows(w.hash, size)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        else:
            out.append(W.windows(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if n.sum():
        flat, begin = np.concatenate(sets), (np.cumsum(n) - n)[n > 0]
        k1[n > 0] = np.add.reduceat(W.mixed(flat), begin)
        k2[n > 0] = np.add.reduceat(W.mixed(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), begin)
    return n, k1.view(np.int64), k2.view(np.int64)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS minima for each non-empty set."""
    out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    n = np.array([len(s) for s in sets])
    run = np.cumsum(n) // 60_000
    for r in np.unique(run):  # blocks that stay in the processor's cache
        own = np.flatnonzero(run == r)
        h = (np.concatenate([sets[i] for i in own]) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum(n[own]) - n[own]
        value = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.multiply(h, _MULTIPLY[k], out=value)
            np.add(value, _ADD[k], out=value)
            out[k, own] = np.minimum.reduceat(value, begin)
    return out.T


def _signatures(size: int):
    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text", 1_000_000):
                sets = shingle_sets(batch, size)
                n, k1, k2 = _keys(sets)
                some = np.flatnonzero(n > 0)
                minima = _minima([sets[i] for i in some]) if len(some) else np.zeros((0, BANDS * ROWS), np.uint32)
                keys = np.zeros((len(some), BANDS), np.uint64)
                wide = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
                for j in range(ROWS):
                    keys = keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j]
                keys = W.mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                per = 64 // BITS
                low = (minima & ((1 << BITS) - 1)).astype(np.uint64).reshape(len(some), BANDS * ROWS // per, per)
                bits = (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)
                bands, packed = [None] * len(sets), [None] * len(sets)
                for j, i in enumerate(some.tolist()):
                    bands[i], packed[i] = keys[j], bits[j]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), pa.array(bands, _SIGNATURE.field(4).type), pa.array(packed, _SIGNATURE.field(5).type)], schema=_SIGNATURE)

    return sign


def _full_sets(size: int, shared):
    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Bitmap = shared.value
        for every in batches:
            whole = every.filter(pa.array(wanted.has(np.asarray(every.column("place")))))
            for batch in parts(whole, "text", 1_000_000):
                sets = shingle_sets(batch, size)
                _, k1, k2 = _keys(sets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sets], pa.binary())], schema=_SETS)

    return read


@frugal
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("sa", "sb")]
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([len(x) + len(y) for x, y in zip(*sets)], pa.int64()), pa.array(both, pa.int64())], names=["a", "b", "n", "both"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    s = sets.select("doc_id", "shingles")
    wide = pairs.join(s.toDF("b", "sb"), "b").join(s.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
    counted = wide.mapInArrow(_overlaps, "a long, b long, n long, both long")
    return counted.filter(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("a", "b").distinct()


def _least_agreement(percent: int) -> float:
    """How many of all minima must agree in their low bits: J + (1 - J) / 2^b of them at the threshold, less five errors."""
    total, chance = BANDS * ROWS, 1 / 2**BITS
    share = percent / 100 * (1 - chance) + chance
    return total * share - 5 * (total * share * (1 - share)) ** 0.5


_FIELDS = int.from_bytes(b"\x55" * 8, "big")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose packed bits allow the threshold."""
    s = classes.select("rep", "bits", "n_shingles")
    both = pairs.join(s.toDF("a", "ba", "na"), "a").join(s.toDF("b", "bb", "nb"), "b")
    unlike = lambda x, y: F.bit_count((x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(F.lit(_FIELDS)))
    agree = F.lit(BANDS * ROWS) - F.aggregate(F.zip_with("ba", "bb", unlike), F.lit(0), lambda acc, v: acc + v)
    return both.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (agree >= _least_agreement(percent))).select("a", "b").distinct()


def plausible_forest(rep: np.ndarray, component: np.ndarray, block: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int, within: bool) -> list[tuple[int, int]]:
    """Pairs that connect all members that packed bits allow to be linked across components, as a forest.

    within: all members are one block; else only pairs of different blocks are compared.
    """
    root = list(range(len(rep)))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out, least = [], _least_agreement(percent)
    for i in range(1, len(rep)):
        other = np.flatnonzero((component[:i] != component[i]) & (np.minimum(size[:i], size[i]) * 100 >= np.maximum(size[:i], size[i]) * percent))
        if not within:
            other = other[block[other] != block[i]]
        if len(other):
            x = bits[other] ^ bits[i]
            for j in other[BANDS * ROWS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_FIELDS)).sum(axis=1) >= least].tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(rep[j]), int(rep[i])))
    return out


def _forests(percent: int):
    """Rows sorted by key, i and j (a group) to the forest of each group; a group that goes on in the next batch waits for it."""

    def forests(table: pa.Table) -> pa.RecordBatch:
        name = np.stack([np.asarray(table[c], np.int64) for c in ("key", "i", "j")])
        begin = np.flatnonzero(np.concatenate([[True], (name[:, 1:] != name[:, :-1]).any(axis=0)]))
        rep, component, block, size = (np.asarray(table[c], np.int64) for c in ("rep", "component", "block", "n_shingles"))
        bits = np.asarray(pc.list_flatten(table["bits"])).view(np.uint64).reshape(len(rep), -1)
        found = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rep)]):
            if (component[a:b] != component[a]).any():
                found += plausible_forest(rep[a:b], component[a:b], block[a:b], size[a:b], bits[a:b], percent, bool(name[1, a] == name[2, a]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
                last = held.slice(held.num_rows - 1)
                cut = np.flatnonzero(np.stack([np.asarray(held[c]) != last[c][0].as_py() for c in ("key", "i", "j")]).any(axis=0))
                if len(cut):
                    yield forests(held.slice(0, int(cut[-1]) + 1))
                    held = held.slice(int(cut[-1]) + 1)
        if held is not None:
            yield forests(held)

    return run


def _nearly_alike(placed: DataFrame, classes: DataFrame, percent: int, rows: int) -> DataFrame:
    """Pairs (a, b) that connect the members of open bands (key, rep, component) whose bits allow a link across components."""
    sizes = placed.groupBy("key", "component").count().groupBy("key").agg(F.count("*").alias("n_components"), F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("most")).filter("n_components > 1")
    few = F.col("n") <= BLOCK_ROWS
    sizes = sizes.select("key", F.when(~few, F.col("most.component")).alias("major"), F.when(few, 1).otherwise(F.ceil((F.col("n") - F.col("most.count")) / BLOCK_ROWS)).cast("int").alias("n_minor"), F.when(few, 0).otherwise(F.ceil(F.col("most.count") / BLOCK_ROWS)).cast("int").alias("n_major"))
    cut = placed.join(written(sizes, "open-bands", rows), "key").withColumn("minor", F.coalesce(F.col("component") != F.col("major"), F.lit(True)))
    h = F.xxhash64("rep")
    cut = cut.withColumn("block", F.when(F.col("minor"), F.pmod(h, F.col("n_minor"))).otherwise(F.col("n_minor") + F.pmod(h, F.greatest("n_major", F.lit(1)))).cast("int"))
    partners = F.when(F.col("minor"), F.col("n_minor") + F.col("n_major")).otherwise(F.col("n_minor"))
    groups = cut.withColumn("with", F.explode(F.sequence(F.lit(0), partners - 1))).select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rep", "component", "block")
    full = groups.join(classes.select("rep", "n_shingles", "bits"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return full.mapInArrow(_forests(percent), "a long, b long").distinct()


def links_across(rep: np.ndarray, component: np.ndarray, block: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], percent: int, within: bool) -> list[tuple[int, int]]:
    """Links between members of different components that suffice to join all that are linked.

    within: all members are one block; else only pairs of different blocks are compared.
    """
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    end = np.cumsum(size)
    own = [flat[e - n : e] for e, n in zip(end.tolist(), size.tolist())]
    root = {c: c for c in component.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    mark, out, least = np.zeros(len(names), np.int32), [], _least_agreement(percent)
    for i in range(len(rep)):
        other = np.arange(i) if within else np.flatnonzero(block[:i] != block[i])
        other = other[(component[other] != component[i]) & (np.minimum(size[other], size[i]) * 100 >= np.maximum(size[other], size[i]) * percent)]
        if len(other):
            x = bits[other] ^ bits[i]
            other = other[BANDS * ROWS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_FIELDS)).sum(axis=1) >= least]
        if len(other):
            mark[own[i]] = 1
            n = size[other]
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in other])], np.cumsum(n) - n)
            mark[own[i]] = 0
            for j in other[both * 100 >= (n + size[i] - both) * percent].tolist():
                a, b = top(component[i].item()), top(component[j].item())
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(rep[j]), int(rep[i])))
    return out


def _joined(percent: int):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep").reset_index(drop=True)
        bits = np.array(rows["bits"].tolist(), np.int64).view(np.uint64).reshape(len(rows), -1)
        found = links_across(rows["rep"].to_numpy(), rows["component"].to_numpy(), rows["block"].to_numpy(), bits, [np.frombuffer(x, np.uint64) for x in rows["shingles"]], percent, rows["i"].iloc[0] == rows["j"].iloc[0])
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return join


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(read.mapInArrow(_signatures(shingle), _SIGNATURE_DDL), "signatures")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = written(linked.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "bits")).alias("s")).select("k1", "k2", F.col("s.doc_id").alias("rep"), "s.n_shingles", "s.bands", "s.bits"), "classes")

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1").select("key", "leader"), "buckets")
    members = written(keyed.join(buckets, "key"), "members")
    dropped(buckets)

    wanted = written(members.select("rep").distinct().join(classes.select("rep", "k1", "k2"), "rep"), "wanted")
    # texts stay where they are read: a bitmap of bounded size tells nearly all that are not wanted, the join below the rest
    bits = min(MOST_BITS, max(16, (16 * wanted.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("rep").alias("place")), "place", bits))
    texts = read.filter("doc_id is not null").withColumn("place", F.xxhash64("doc_id"))
    sets = written(texts.mapInArrow(_full_sets(shingle, shared), "doc_id long, k1 long, k2 long, shingles binary").join(wanted.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]), "sets")

    n = members.count()
    best = members.filter("rep <> leader").groupBy("rep", "leader").count().groupBy("rep").agg(F.max(F.struct("count", -F.col("leader"))).alias("s")).select((-F.col("s.col2")).alias("a"), F.col("rep").alias("b"))
    tried = written(best, "tried", n)
    edges = written(_confirmed(_plausible(tried, classes, percent), sets, percent), "edges", n)
    found = components(edges, n)
    placed = written(members.join(found.toDF("rep", "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "placed", n)
    alike = written(_nearly_alike(placed, classes, percent, n), "nearly-alike", n)
    n_left = alike.count()
    if n_left:
        clusters = components(alike, n_left)
        reps = alike.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        open_reps = reps.join(placed.select("rep", "component").distinct(), "rep").join(clusters.toDF("rep", "cluster"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
        open_reps = written(open_reps.join(sets.select(F.col("doc_id").alias("rep"), F.octet_length("shingles").alias("size")), "rep"), "open-reps", n_left)
        blocks = open_reps.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("n_blocks"))
        cut = open_reps.join(written(blocks, "blocks", n_left), "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
        tasks = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rep", "component", "block")
        full = tasks.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep").join(classes.select("rep", "bits"), "rep")
        new = written(full.groupBy("cluster", "i", "j").applyInPandas(_joined(percent), "a long, b long"), "edges", n_left)
        if new.limit(1).count():
            found = components(edges.unionByName(new), n)
    dropped(placed, alike)
    by_set = written(classes.select("k1", "k2", "rep").join(found.toDF("rep", "component"), "rep", "left").groupBy("k1", "k2").agg(F.min(F.coalesce("component", "rep")).alias("component")), "by-set")
    dropped(sets, members, wanted)
    joined = signed.select("doc_id", "n_shingles", "k1", "k2").join(by_set, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when((F.col("n_shingles") == 0) | F.col("component").isNull(), F.col("doc_id")).otherwise(F.least("component", "doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def near_deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents, unchanged, less those that have a smaller doc_id in their component."""
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
