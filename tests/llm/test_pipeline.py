import corpus_pipeline
from meridia.llm import language_id

from . import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    spoken = stage["language"](spark, docs, SF).cache()
    model = language_id.fitted(docs.filter(~language_id.held_out("doc_id")))
    kept = {r["doc_id"] for r in language_id.predicted(docs, model).collect() if not r["rejected"]}
    assert set(rows(spoken)) == kept and spoken.columns == docs.columns

    lines = stage["lines"](spark, spoken, SF).cache()
    before = rows(spoken)
    plain = {d: t for d, t in brute.line_templates(sorted(before.items())) if t == before[d] or (t or "").strip()}
    assert rows(lines) == plain and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = stage["near_duplicates"](spark, lines, SF).cache()
    group = brute.components({i: brute.shingles(t, 5) for i, t in plain.items()})
    assert rows(single) == {i: t for i, t in plain.items() if group[i] == i}

    clean = stage["benchmark"](spark, single, SF).cache()
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for i, t in rows(single).items():
        n, hit, _ = brute.contamination(t, items)
        if not (hit and 20 * len(hit) >= n):
            want[i] = t
    assert rows(clean) == want

    packed = stage["pack"](spark, clean, SF).toPandas()
    assert set(packed.doc_id) == set(want) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_whole_run_keeps_the_same_documents(spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 100


def test_lines_keep_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(i, f"{['alpha beta', 'gamma delta epsilon', 'zeta'][i]}\na line that all of them have here", "mine", True) for i in range(3)], "doc_id long, text string, n_lines string, n_dropped boolean")
    got = corpus_pipeline.lines(spark, docs, SF)
    rows = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"].count("\n")) for r in got.collect()}
    assert got.columns == docs.columns and rows == {0: ("mine", True, 1), 1: ("mine", True, 0), 2: ("mine", True, 0)}
