"""Token ids as length-delimited binary records in shard files, with a separate offset index.

A record: payload length (8 bytes), masked checksum of those bytes (4), payload, masked checksum of the payload (4);
all little-endian. A payload: doc_id (8), flags (1: bit 0, the document has an id), bytes per id (1: 2 or 4), ids.
Checksums are CRC-32 rotated by 15 bits plus a constant, so that a checksum stored inside data it covers does not
look valid. The index is a Parquet table with a row for each record: shard file, record number, offset, size,
doc_id, n_tokens; a reader may fetch records in any order from it.

Documents are sorted across the cluster by range partitions of doc_id; shard files are named by partition and roll
at shard_bytes, written under another name and moved when whole; a repeated task finds the same files and leaves them. Folders
are reached through pyarrow's file systems (local or mounted paths, HDFS, object stores).

Cases: a null or empty text gives a record with the end id alone; a null doc_id sorts first; rows that repeat a
doc_id each give a record, ordered by text; an empty table writes no shard; other columns are not read; a text of
any length is one record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, parts, shared_folder, small_batches, written

_INDEX = pa.schema([("path", pa.string()), ("shard", pa.int64()), ("record", pa.int64()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_INDEX_DDL = "path string, shard long, record long, offset long, n_bytes long, doc_id long, n_tokens long"
_READ_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, record long"
_READ = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "record")])


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    if len(ids) and (ids.min() < 0 or ids.max() >> (8 * width)):
        raise ValueError(f"an id does not fit in {width} bytes")
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_checksum(size)), payload, struct.pack("<I", masked_checksum(payload))))


def frames(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every record of an open shard; a wrong checksum or a cut record is an error."""
    while head := stream.read(12):
        size, check = struct.unpack("<QI", head)
        if masked_checksum(head[:8]) != check:
            raise ValueError("the length of a record is damaged")
        body = stream.read(size + 4)
        if len(body) != size + 4 or masked_checksum(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("a record is damaged")
        doc_id, has_id, width = struct.unpack("<qBB", body[:10])
        yield (doc_id if has_id else None), np.frombuffer(body[10:size], f"<u{width}")


def _writer(folder: str, tokenizer: str, end_id: int, width: int, shard_bytes: int):
    @frugal(encodes=True)
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        from .subwords import encoder

        enc = encoder(tokenizer, "byte")
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, rows, roll, at = None, [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal out, rows, roll, at
            out.close()
            final = f"{base}/shard-{task.partitionId():06d}-{roll:05d}.bin"
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(f"{final}.{task.taskAttemptId()}", final)
            else:  # an earlier attempt of this task has moved the same records
                store.delete_file(f"{final}.{task.taskAttemptId()}")
            path = f"{folder}/{final.rpartition('/')[2]}"
            got = pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([(task.partitionId() << 24) + roll] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], schema=_INDEX)
            out, rows, roll, at = None, [], roll + 1, 0
            return got

        for whole in batches:
            for batch in parts(whole, "text", 1_000_000):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.ids(batch.column("text").to_pylist())):
                    if out is None:
                        out = store.open_output_stream(f"{base}/shard-{task.partitionId():06d}-{roll:05d}.bin.{task.taskAttemptId()}")
                    record = frame(doc_id, np.append(ids, end_id), width)
                    out.write(record)
                    rows.append((len(rows), at, len(record), doc_id, len(ids) + 1))
                    at += len(record)
                    if at >= shard_bytes:
                        yield closed()
        if out is not None:
            yield closed()

    return write


def largest_id(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 0, id_bytes: int | None = None, shard_bytes: int = 64_000_000, folder: str | None = None) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; returns the offset index (already written).

    id_bytes: 2 where the tokenizer's ids and end_id are below 65,536, else 4, unless given; an id that does not fit is an error.
    """
    if id_bytes is None:
        id_bytes = 2 if max(largest_id(tokenizer), end_id) < 1 << 16 else 4
    small_batches(docs.sparkSession)
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows of one doc_id (or of none) are dealt by how their texts begin, so that they are not one task's
    ordered = read.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_writer(folder, tokenizer, end_id, id_bytes, shard_bytes), _INDEX_DDL), "token-index")


@frugal
def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path, shard, start in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "start"))):
            store, at = fs.FileSystem.from_uri(path)
            rows = []
            with store.open_input_stream(at, buffer_size=1 << 20) as stream:
                for n, (doc_id, ids) in enumerate(frames(stream)):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, n))
                    start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_READ)


def read_token_files(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens, ids_crc32, shard, record, read from the shard files."""
    shards = index.groupBy("path", "shard").agg(F.sum("n_tokens").alias("n"))
    # one row a shard file: their running total is small
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(shards.select("path", "shard", before.alias("start")), "shards")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "path").mapInArrow(_reader, _READ_DDL)


def read_records(index: DataFrame) -> DataFrame:
    """doc_id and ids of the records that the index rows name, in any order (shuffled reads)."""

    @frugal
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "n_bytes"))))
            ids, docs = [None] * len(rows), [None] * len(rows)
            by_path: dict[str, list[int]] = {}
            for i, (path, _, _) in enumerate(rows):
                by_path.setdefault(path, []).append(i)
            for path, own in by_path.items():  # a shard is opened once a batch, its records are read where they lie
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    for i in sorted(own, key=lambda i: rows[i][1]):
                        docs[i], got = next(frames(pa.BufferReader(f.read_at(rows[i][2], rows[i][1]))))
                        ids[i] = got.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return index.select("path", "offset", "n_bytes").mapInArrow(fetch, "doc_id long, ids array<int>")
