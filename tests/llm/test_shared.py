"""Shared tables, token-file writers that run twice, and the bounds of batches."""

import os
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridia.llm import near_dedup, shared, subwords, token_files
from meridia.llm.queries import tokenizer_path

from . import brute


def session(**conf):
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)))


def test_only_a_local_master_may_use_its_own_folder():
    assert shared.shared_folder(session(spark_master="local[4]"), "x").startswith("file://")
    assert shared.shared_folder(session(spark_master="yarn", spark_checkpoint_dir="hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            shared.shared_folder(session(spark_master=master), "x")


def test_scratch_deletes_what_is_written_inside(spark):
    with shared.scratch(spark):
        t = shared.written(spark.range(5), "t")
        path = t._shared_path.removeprefix("file://")
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    kept = shared.written(spark.range(3), "t")
    shared.dropped(kept)
    assert not os.path.exists(kept._shared_path.removeprefix("file://"))


def test_names_are_free_in_any_case(spark):
    df = spark.range(1).select(F.col("id").alias("_Row"), F.lit(1).alias("__row"))
    assert shared.free_name("_row", df) == "___row" and shared.free_name("x", df) == "x"


def test_workers_let_go_of_tables_they_do_not_use():
    e = subwords.encoder(tokenizer_path("word_bpe_49k.json"), "word")
    seen = []
    keep = shared.frugal(encodes=True)(lambda batches: (seen.append(len(subwords._LOADED)) or b for b in batches))
    drop = shared.frugal(lambda batches: (seen.append(len(subwords._LOADED)) or b for b in batches))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(keep(iter([batch]))) == [batch] and list(drop(iter([batch]))) == [batch]
    assert seen == [1, 0] and subwords.encoder(tokenizer_path("word_bpe_49k.json"), "word") is not e


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    assert token_files.largest_id(tokenizer_path("byte_bpe_50k.json")) == 50_256
    with pytest.raises(ValueError):
        token_files.frame(1, np.array([70_000]), 2)
    assert list(token_files.frames(pa.BufferReader(token_files.frame(1, np.array([70_000]), 4))))[0][1].tolist() == [70_000]
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    index = token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=70_000, folder=f"file://{tmp_path}/wide")
    assert token_files.read_records(index).first()["ids"][-1] == 70_000


def test_a_repeated_task_leaves_the_same_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    write = lambda: token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), shard_bytes=300, folder=f"file://{tmp_path}/t")
    first = write()
    before = {f: (tmp_path / "t" / f).read_bytes() for f in os.listdir(tmp_path / "t")}
    again = write()  # the same tasks, with their shards there already
    assert {f: (tmp_path / "t" / f).read_bytes() for f in os.listdir(tmp_path / "t")} == before and all(f.endswith(".bin") for f in before)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_pairs_at_the_threshold_are_found(spark):
    """Pairs of 0.80 to 0.85 alone, each in a group of its own: none of them is lost."""
    rng, rows = np.random.default_rng(4), []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        other = list(words)
        for j in rng.choice(120, int(rng.integers(2, 7)), replace=False):
            other[j] = f"z{i}x{j}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = {i: brute.shingles(t, 2) for i, t in rows}
    close = [i for i in range(150) if 0.8 <= len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) < 0.86]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert len(close) > 40 and got == brute.components(sets)


@pytest.mark.parametrize("rows", [2, 5])
def test_hot_bands_in_blocks_lose_nothing(spark, monkeypatch, rows):
    """Many near copies of one text share bands; small blocks cut these bands apart."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    rng, base, texts = np.random.default_rng(1), [f"b{i}" for i in range(100)], []
    for i in range(40):
        own = list(base)
        for j in rng.choice(100, int(rng.integers(0, 8)), replace=False):
            own[j] = f"c{i}x{j}"
        texts.append((i, " ".join(own)))
    sets = {i: brute.shingles(t, 2) for i, t in texts}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute.components(sets)
