"""A pipeline of text operators over the table documents.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the packed pieces.
1. language: texts whose language is rejected go. 2. lines: recurring line templates are dropped from all documents but
the first; documents that lose all their text go. 3. near_duplicates: one document of each group stays. 4. benchmark:
contaminated documents go. 5. pack: what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from meridia.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fitted(docs.filter(~language_id.held_out("doc_id")))
    return language_id.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.without_repeats(docs)
    n_dropped = F.col(clean.columns[-1])
    kept = clean.filter(~((n_dropped > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(n_dropped > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_deduplicated(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # four stages have left their memory in the executors, so that workers remember fewer pieces than in a job of their own
    return packing.packed(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, keep_pieces=600_000))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: Tokenizing and clustered centroids are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.shared import written

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
