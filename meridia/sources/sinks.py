"""Writers: snapshots, upserts, quarantine, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .published import Stage, published


def publish_snapshot(df: DataFrame, folder: str, partitions: list[str], *, vintage, release: str, published_at, kind: str = "parquet", compression: str = "snappy") -> int:
    """Publish one snapshot with its vintage, release and time as columns; its commit. Publishing a release again replaces it whole."""
    stage = Stage(df.sparkSession, folder, release, published_at, vintage)
    stage.write("snapshot", df, partitions, kind, compression)
    return stage.commit()


def snapshot(spark: SparkSession, folder: str, release: str | None = None) -> DataFrame:
    """What publish_snapshot has published."""
    return published(spark, folder, "snapshot", release=release)


def upserted(current: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """The update's rows and the current rows of other keys."""
    return current.join(update.select(*keys).distinct(), keys, "left_anti").unionByName(update, allowMissingColumns=True)


def upsert(spark: SparkSession, folder: str, update: DataFrame, keys: list[str], version: int) -> str:
    """Merge into a versioned table: the merged rows go to a new version folder, so readers of the old one are not disturbed."""
    path = f"{folder}/version={version:06d}"
    merged = update if version == 0 else upserted(spark.read.parquet(f"{folder}/version={version - 1:06d}"), update, keys)
    merged.write.parquet(path)
    return path


def quarantine(rejects: DataFrame, folder: str, *, release: str, dataset: str, at) -> None:
    """Append rejected rows, with the row as JSON, by release, data set and reason."""
    data = F.to_json(F.struct(*[c for c in rejects.columns if c not in ("reject_rule", "reject_severity")]))
    rejects.select(data.alias("raw"), F.col("reject_rule").alias("reason"), F.col("reject_severity").alias("severity"), F.lit(release).alias("release_id"), F.lit(dataset).alias("dataset"), F.lit(at).alias("quarantined_at")).write.mode("append").partitionBy("release_id", "dataset", "reason").parquet(folder)


def recovered(quarantined: DataFrame, schema: str, reason: str | None = None) -> DataFrame:
    """Quarantined rows as they were."""
    rows = quarantined.filter(F.col("reason") == reason) if reason else quarantined
    return rows.select(F.from_json("raw", F.lit(schema)).alias("r")).select("r.*")


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def report(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def upsert_manifest(current: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """What an upsert does: rows kept, replaced and added, as one row."""
    a, b = current.select(*keys).distinct().withColumn("_a", F.lit(1)), update.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("n_kept"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_replaced"), F.count_if(F.col("_a").isNull()).alias("n_added"), F.lit(",".join(keys)).alias("natural_keys"), F.lit("merge").alias("strategy"))


def publish_build(tables: dict[str, DataFrame], folder: str, build_id: str) -> DataFrame:
    """One folder for each table of a build, and the files that hold it with their size and SHA-256 (also written, as _files)."""
    from ..operators.releases import file_digests

    spark = next(iter(tables.values())).sparkSession
    path = f"{folder}/build_id={build_id}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    files = None
    for name in tables:
        own = file_digests(spark, f"{path}/{name}").filter(F.col("path").endswith(".parquet")).withColumn("table", F.lit(name))
        files = own if files is None else files.unionByName(own)
    files.write.mode("overwrite").parquet(f"{path}/_files")
    return spark.read.parquet(f"{path}/_files")


def quarantine_stats(quarantined: DataFrame) -> DataFrame:
    """Batches in quarantine: rows by release, data set, reason and severity, and the first and last time."""
    return quarantined.groupBy("release_id", "dataset", "reason", "severity").agg(F.count("*").alias("n"), F.min("quarantined_at").alias("first_at"), F.max("quarantined_at").alias("last_at"))


def quarantine_cleanup(spark: SparkSession, folder: str, before, version: int) -> str:
    """The quarantine without rows from before a time, in a new folder beside it; nothing is deleted in place."""
    path = f"{folder.rstrip('/')}-kept-{version:06d}"
    spark.read.parquet(folder).filter(F.col("quarantined_at") >= F.lit(before)).write.partitionBy("release_id", "dataset", "reason").parquet(path)
    return path


def contract_json(df: DataFrame, name: str, keys: list[str]) -> str:
    """The contract of a table as JSON text: its columns with their types, and its natural keys."""
    import json

    return json.dumps({"dataset": name, "columns": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema], "natural_keys": keys}, indent=1)


def cached(df: DataFrame, folder: str, digest: str, now, ttl_seconds: int) -> DataFrame:
    """df from a store of written results that is keyed by a digest of its inputs; written if it is absent or older than the time to live."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{digest}/_SUCCESS")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at) or store.getFileStatus(at).getModificationTime() / 1000 + ttl_seconds < now.timestamp():
        df.write.mode("overwrite").parquet(f"{folder}/{digest}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{digest}")
