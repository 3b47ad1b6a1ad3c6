"""Tables that executors and the driver share, and small helpers for Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
GIVE_BACK_BYTES = 16_000_000
#: Bytes that are handed to Python at once. Spark's own default holds several times 64 MB in each task's buffers.
BATCH_BYTES = 4_000_000
#: Paths of the tables written inside each open scratch(), innermost last.
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a local master may go without that setting (tests): executors do not share this machine's folders."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault("base", "file://" + tempfile.mkdtemp(prefix="meridia-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python about BATCH_BYTES at a time, unless the session has a setting of its own: a task's buffers hold whole batches."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def scratch(spark: SparkSession):
    """Delete all intermediate tables written inside this block when it ends: read or write the results inside it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: its lineage ends here and survives lost executors.

    rows: about how many rows there are, where that is known: few rows are then written by few tasks.
    """
    path = shared_folder(df.sparkSession, name)
    if rows is not None:
        tasks = 6 + rows // 50_000
        df = df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            _delete(t.sparkSession, path)


def free_name(name: str, *taken: DataFrame) -> str:
    """name, or name with leading underscores, such that none of the tables has such a column in any case of letters."""
    known = {c.lower() for t in taken for c in t.columns}
    while name.lower() in known:
        name = "_" + name
    return name


def give_back() -> None:
    """Return freed memory of this Python worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without malloc_trim keeps what it has


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(step: Step | None = None, *, encodes: bool = False) -> Step:
    """The same function of batches for workers that live on between tasks: freed memory goes back every GIVE_BACK_BYTES of input and at the end.

    encodes: the function uses the worker's table of sub-words; every other one lets go of such a table that an earlier
    stage has left in the worker.
    """
    if step is None:
        return functools.partial(frugal, encodes=encodes)

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            seen = 0
            for b in batches:
                if seen > GIVE_BACK_BYTES:
                    give_back()
                    seen = 0
                seen += b.nbytes
                yield b

        if not encodes:
            from .subwords import forget

            forget()
        yield from step(counted())
        give_back()

    return run


class Bitmap:
    """Which of 2**bits places some hashes fall on. A place that is set may be another hash's; one that is not set is nobody's."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(hashes: DataFrame, column: str, bits: int) -> Bitmap:
    """The bitmap of a column of 64-bit hashes. Executors join the bits; the driver gets 2**bits / 64 words at most, however many rows there are."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    words[np.asarray(rows["word"])] = np.asarray(rows["bits"]).view(np.uint64)
    return Bitmap(words, bits)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = np.diff(text_bytes(batch.column(column))[1])
    run = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def no_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
