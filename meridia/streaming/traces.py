"""Structured Streaming over the trace log: windowed summaries, and merging of corrected rows."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import commits

DATA = "data"


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by window and key; on a stream, rows later than `late` are dropped and state is bounded."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time, late)
    out = timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "mean")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop: the same result as a batch over the same rows."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
    q.awaitTermination()


def run_polling(stream: DataFrame, folder: str, checkpoint: str, every: str = "60 seconds"):
    """Look for new files at fixed times until stopped; returns the query (stop() ends it, and a restart goes on where it was)."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).format("parquet").start(folder)


def merged_latest(stream: DataFrame, keys: list[str], newest: str, folder: str, checkpoint: str, *, buckets: int = 64, keep: int = 3) -> None:
    """Keep the newest row of each key, as a table of buckets by a hash of the key; a micro-batch rewrites those that it touches.

    What a bucket's rows are is said by the newest commit (see sources.commits), which names a folder for each bucket: no
    data file is listed or read to find it, however many batches there have been. A batch writes the buckets that it
    touches to a folder of its own and then commits. A batch that is repeated after its commit is told by the stream's id
    and the batch's number and does nothing; one that was cut off before it writes to a new folder. After a commit the
    folders go that none of the last `keep` commits names; readers of those are not disturbed.
    """
    from ..operators.windows import latest_effective

    spark = stream.sparkSession
    started, running = threading.Event(), []

    def merge(batch: DataFrame, number: int) -> None:
        started.wait()
        own, stream_id = batch.sparkSession, running[0].id
        if commits.state(own, folder)[1].get("streams", {}).get(stream_id, -1) >= number:
            return
        held = commits.state(own, folder)[1].get("buckets", {})
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        # at most `buckets` numbers
        touched = [str(r["bucket"]) for r in rows.select("bucket").distinct().collect()]
        known = _rows(own, folder, {b: held[b] for b in touched if b in held}, rows.schema)
        ties = [c for c in batch.columns if c not in (*keys, newest)]
        latest = latest_effective(rows if known is None else known.unionByName(rows), keys, newest, *ties)
        name = f"{DATA}/{number:09d}-{uuid.uuid4().hex[:12]}"
        latest.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}")

        def change(now: dict) -> dict:
            moved = {b for b in touched if now.get("buckets", {}).get(b) != held.get(b)}
            if moved:
                raise RuntimeError(f"{folder}: another stream changed buckets {sorted(moved)} meanwhile")
            return {"schema": batch.schema.jsonValue(), "buckets": {**now.get("buckets", {}), **{b: f"{name}/bucket={b}" for b in touched}}, "streams": {**now.get("streams", {}), stream_id: number}}

        commits.commit(own, folder, change, keep=keep)
        _compacted(own, folder)

    running.append(stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start())
    started.set()
    running[0].awaitTermination()


def _rows(spark: SparkSession, folder: str, at: dict[str, str], schema) -> DataFrame | None:
    """The rows of some buckets, with their number as a column. Buckets that one batch wrote are read together."""
    out = None
    for base in sorted({p.rsplit("/", 1)[0] for p in at.values()}):
        own = [f"{folder}/{p}" for p in at.values() if p.rsplit("/", 1)[0] == base]
        one = spark.read.schema(schema).option("basePath", f"{folder}/{base}").parquet(*own)
        out = one if out is None else out.unionByName(one)
    return out


def _compacted(spark: SparkSession, folder: str) -> None:
    """Delete what no kept commit names: folders of batches, and of a folder that is still named the buckets that are not."""
    held = [commits.state(spark, folder, n)[1] for n in commits.numbers(spark, folder)]
    needed = {p for h in held for p in h["buckets"].values()}
    commits.removed(spark, folder, DATA, needed)
    for base in {p.rsplit("/", 1)[0] for p in needed}:
        part = base.split("/", 1)[1]
        commits.removed(spark, f"{folder}/{DATA}", part, {p.split("/", 1)[1] for p in needed if p.startswith(base + "/")} | {f"{part}/_SUCCESS"})


def latest_table(spark: SparkSession, folder: str, commit: int | None = None) -> DataFrame:
    """The table that merged_latest keeps, as of the newest commit or one that is still kept."""
    _, held = commits.state(spark, folder, commit)
    if not held:
        raise ValueError(f"{folder} has no table yet")
    schema = StructType.fromJson(held["schema"])
    rows = _rows(spark, folder, held["buckets"], StructType([*schema.fields, StructField("bucket", IntegerType())]))
    return spark.createDataFrame([], schema) if rows is None else rows.drop("bucket")
