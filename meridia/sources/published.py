"""Staged publication: rows go to folders of their own, and one commit makes all of them the release's rows at once.

A folder of publications holds _commits (see commits), staged data under data/ and rejected rows under rejects/. The
state of a commit says for each table and release where its rows are, how many, their digest, and the counts of its
rejects by reason. Readers go through the newest commit: a release that failed half-way is in none, a release that is
published again replaces its earlier self whole, partitions that it no longer has included, and a reader of an earlier
commit still finds that one's rows until they are cleaned away.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import commits

DATA, REJECTS = "data", "rejects"
#: Severities of rules whose rows are not published.
BLOCKING = ("critical", "error", "block")
#: Columns that tell when a row was handled.
TIMES = ("parsed_at", "published_at")
REJECT_COLUMNS = ("reject_rule", "reject_severity")


def digest(df: DataFrame) -> DataFrame:
    """n_rows and digest of a table: a sum of row hashes, the same in any order and with any partitioning; repeats count, times of processing do not."""
    names = sorted(c for c in df.columns if c not in TIMES)
    row = F.xxhash64(*[F.when(F.col(c).isNull(), F.lit("\0")).otherwise(F.col(c).cast("string")) for c in names])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


@dataclass
class Stage:
    """Tables of one release on their way: written, not yet published."""

    spark: SparkSession
    folder: str
    release: str
    at: object
    vintage: object = None
    name: str = ""
    tables: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        self.name = f"{self.release}-{uuid.uuid4().hex[:12]}"

    def split(self, table: str, tagged: DataFrame, partitions: list[str] | tuple[str, ...] = (), **options) -> tuple[DataFrame, DataFrame]:
        """(good, rejected) rows of a tagged table (reject_rule, reject_severity), both written by one pass.

        Rows with a severity below error are good. Good rows are stamped with vintage_date, release_id and published_at.
        """
        path = f"{DATA}/{self.name}/{table}"
        bad = F.coalesce(F.col("reject_severity").isin(*BLOCKING), F.lit(False))
        self._write(self._stamped(tagged.withColumn("_rejected", bad)), path, ["_rejected", *partitions], **options)
        schema = self._stamped(tagged).schema
        whole = self.spark.read.schema(StructType([*schema.fields])).option("basePath", f"{self.folder}/{path}")
        # both folders are there only if they have rows
        read = lambda flag: self._read(whole, f"{path}/_rejected={flag}", schema)
        good, rejected = read("false").drop(*REJECT_COLUMNS), read("true")
        self.publish(table, f"{path}/_rejected=false", good)
        return good, rejected

    def _read(self, reader, path: str, schema: StructType) -> DataFrame:
        at, store = commits._path(self.spark, f"{self.folder}/{path}")
        return reader.schema(schema).option("basePath", f"{self.folder}/{path}").parquet(f"{self.folder}/{path}") if store.exists(at) else self.spark.createDataFrame([], schema)

    def _stamped(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"vintage_date": F.lit(self.vintage), "release_id": F.lit(self.release), "published_at": F.lit(self.at)})

    def _write(self, df: DataFrame, path: str, by: list[str], kind: str = "parquet", compression: str = "snappy") -> None:
        out = df.repartition(*[F.col(c) for c in by], F.pmod(F.xxhash64(*df.columns[:8]), F.lit(8))) if by else df
        writer = out.write.mode("errorifexists").format(kind)
        if kind == "parquet":
            writer = writer.option("compression", compression)
        if kind == "csv":
            writer = writer.option("header", "true")
        (writer.partitionBy(*by) if by else writer).save(f"{self.folder}/{path}")

    def write(self, table: str, rows: DataFrame, partitions: list[str] | tuple[str, ...] = (), kind: str = "parquet", compression: str = "snappy") -> DataFrame:
        """Stage a whole table of good rows (instead of split(), or after more work on what split() gave)."""
        path = f"{DATA}/{self.name}/{table}-{uuid.uuid4().hex[:6]}"
        stamped = rows if {"vintage_date", "release_id", "published_at"} <= set(rows.columns) else self._stamped(rows)
        self._write(stamped, path, list(partitions), kind, compression)
        reader = self.spark.read.schema(stamped.schema).format(kind)
        out = (reader.option("header", "true") if kind == "csv" else reader).load(f"{self.folder}/{path}")
        self.publish(table, path, out, kind)
        return out

    def publish(self, table: str, path: str, rows: DataFrame, kind: str = "parquet") -> None:
        """Name the rows at a path as the release's rows of a table."""
        self.tables[table] = {**self.tables.get(table, {"rejects": {}, "rejects_path": None}), "path": path, "kind": kind, "schema": rows.schema.jsonValue(), **digest(rows).first().asDict(), "vintage": str(self.vintage), "published_at": str(self.at)}

    def reject(self, table: str, rejected: DataFrame) -> None:
        """Stage the quarantine of a table: rows as JSON by reason, and their counts."""
        path = f"{REJECTS}/{self.name}/{table}"
        own = [c for c in rejected.columns if c not in REJECT_COLUMNS]
        rows = rejected.select(F.to_json(F.struct(*own)).alias("raw"), F.col("reject_rule").alias("reason"), F.col("reject_severity").alias("severity"), F.lit(self.release).alias("release_id"), F.lit(table).alias("dataset"), F.lit(self.at).alias("quarantined_at"))
        # a row for each reason
        counts = {r["reject_rule"]: r["count"] for r in rejected.groupBy("reject_rule").count().collect()}
        if counts:
            rows.write.partitionBy("reason").parquet(f"{self.folder}/{path}")
        self.tables.setdefault(table, {}).update({"rejects": counts, "rejects_path": path if counts else None, "rejects_schema": rows.schema.jsonValue()})

    def commit(self, keep: int = 10) -> int:
        """Make the staged tables the release's: all at once, and other releases stay as they are."""

        def change(held: dict) -> dict:
            new = {t: dict(r) for t, r in held.get("tables", {}).items()}
            for name, entry in self.tables.items():
                new.setdefault(name, {})[self.release] = entry
            return {**held, "tables": new}

        return commits.commit(self.spark, self.folder, change, keep=keep)

    def discard(self) -> None:
        """Delete what was staged and not committed."""
        for part in (DATA, REJECTS):
            commits.deleted(self.spark, f"{self.folder}/{part}/{self.name}")


def _union(spark: SparkSession, folder: str, entries: list[dict], path: str, schema: str) -> DataFrame | None:
    """The rows of several releases, read together where their columns and format are the same."""
    alike: dict[tuple, list[dict]] = {}
    for e in entries:
        if e.get(path):
            alike.setdefault((str(e[schema]), e.get("kind", "parquet") if path == "path" else "parquet"), []).append(e)
    out = None
    for (_, kind), own in alike.items():
        for e in own:  # each release has a base path of its own, as its partition columns are folder names
            at, store = commits._path(spark, f"{folder}/{e[path]}")
            if not store.exists(at):
                continue
            reader = spark.read.schema(StructType.fromJson(e[schema])).format(kind)
            one = (reader.option("header", "true") if kind == "csv" else reader).load(f"{folder}/{e[path]}")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def published(spark: SparkSession, folder: str, table: str, *, release: str | None = None, commit: int | None = None) -> DataFrame:
    """The published rows of a table: of all releases or one, as of the newest commit or a kept one."""
    _, held = commits.state(spark, folder, commit)
    entries = held.get("tables", {}).get(table, {})
    if release is not None:
        entries = {k: v for k, v in entries.items() if k == release}
    if not entries:
        raise ValueError(f"{folder} has no {table}" + (f" of {release}" if release else ""))
    out = _union(spark, folder, list(entries.values()), "path", "schema")
    return out if out is not None else spark.createDataFrame([], StructType.fromJson(next(iter(entries.values()))["schema"]))


def quarantined(spark: SparkSession, folder: str, table: str | None = None, *, release: str | None = None, commit: int | None = None) -> DataFrame:
    """The rejected rows: raw (JSON), reason, severity, release_id, dataset, quarantined_at."""
    _, held = commits.state(spark, folder, commit)
    entries = [e for t, own in held.get("tables", {}).items() for r, e in own.items() if (table is None or t == table) and (release is None or r == release)]
    out = _union(spark, folder, entries, "rejects_path", "rejects_schema")
    return out if out is not None else spark.createDataFrame([], "raw string, reason string, severity string, release_id string, dataset string, quarantined_at timestamp")


def manifest(spark: SparkSession, folder: str, commit: int | None = None) -> DataFrame:
    """One row for each table and release of a commit: commit, dataset, release_id, n_rows, n_rejected, digest, path."""
    number, held = commits.state(spark, folder, commit)
    rows = [(number, t, r, e["n_rows"], sum(e["rejects"].values()), e["digest"], e["path"], e["vintage"], e["published_at"]) for t, own in held.get("tables", {}).items() for r, e in own.items()]
    return spark.createDataFrame(rows, "commit long, dataset string, release_id string, n_rows long, n_rejected long, digest string, path string, vintage string, published_at string")


def withdrawn(spark: SparkSession, folder: str, release: str) -> int:
    """A commit without a release."""

    def change(held: dict) -> dict:
        return {**held, "tables": {t: rest for t, own in held.get("tables", {}).items() if (rest := {r: e for r, e in own.items() if r != release})}}

    return commits.commit(spark, folder, change)


def cleaned(spark: SparkSession, folder: str) -> list[str]:
    """Delete the data that no kept commit refers to: of releases that were replaced, and of those that failed.

    Not to be run beside a release that is being staged.
    """
    held = [commits.state(spark, folder, n)[1] for n in commits.numbers(spark, folder)]
    needed = [e[k] for h in held for own in h.get("tables", {}).values() for e in own.values() for k in ("path", "rejects_path") if e.get(k)]
    return [f"{part}/{name}" for part in (DATA, REJECTS) for name in commits.removed(spark, folder, part, needed)]
