import base64
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import edit_counts, language_id, packing, page_text, subwords, token_files, vector_search
from meridia.llm.queries import tokenizer_path

ODD = ["", "a  b", "<|endoftext|> x", "a\x01b  \x01", " lead", "trail ", "\n\n a\n b\t c", " \x1c x\x85y é é İ", "don't 'RE x's", "　a b", "12 345 6.7", "x" * 3000, "é " * 200, "a  b  c"]
DOCS = "doc_id long, text string, edits string, length int, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "e", 7, None) for i, t in rows], DOCS)


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_ids_equal_the_library(name, kind, monkeypatch):
    monkeypatch.setattr(subwords, "KEEP_PIECES", 30)
    e = subwords.SubwordEncoder(tokenizer_path(name), kind)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab é\n\t.,'9", k=rng.randint(1, 60))) for _ in range(200)]
    for t, got in zip(texts, e.ids(texts)):
        assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark, tmp_path):
    rows = [(5, "five words are in here"), (2, None), (9, ""), (-3, "x y"), (7, "again " * 2000), (7, "again"), (None, "no id")] + [(20 + i, t) for i, t in enumerate(ODD)]
    path = tokenizer_path("byte_bpe_50k.json")
    index = token_files.write_token_files(table(spark, rows), path, shard_bytes=2000, folder=f"file://{tmp_path}/t")
    e = subwords.encoder(path, "byte").tokenizer
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_token_files(index).collect()
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r["start"])] == want
    some = {r["doc_id"]: list(r["ids"]) for r in token_files.read_records(index.filter("doc_id in (5, 7)").orderBy(F.desc("offset"))).collect()}
    assert some[5] == [*e.encode("five words are in here", add_special_tokens=False).ids, 0]
    assert token_files.read_token_files(token_files.write_token_files(table(spark, []), path)).count() == 0


def test_damaged_records_are_found(tmp_path):
    record = token_files.frame(4, np.arange(9), 2)
    (tmp_path / "x").write_bytes(record[:20] + b"\xff" + record[21:])
    with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError):
        list(token_files.frames(f))


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.choice([0, 3, 50, 400, 900])) for i in range(300)] + [(1000, None), (1001, "many words " * 5000), (1001, "many words " * 5000), (None, "x")]
    got = packing.packed(packing.pieces(table(spark, rows), tokenizer_path("word_bpe_49k.json")), group_rows=100).toPandas()
    e = subwords.encoder(tokenizer_path("word_bpe_49k.json"), "word").tokenizer
    want = []
    for i, t in rows:
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(got.assign(doc_id=got.doc_id.fillna(-1))[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 4
    assert packing.packed(packing.pieces(table(spark, []), tokenizer_path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_binding_capacities(spark, rule):
    rng = random.Random(9)
    rows = [(i, "word " * rng.choice([0, 2, 40, 90])) for i in range(200)]
    cut = packing.pieces(table(spark, rows), tokenizer_path("word_bpe_49k.json")).toPandas()
    top = int(cut.length.max()) ** 2 + 50
    for most in ({"max_documents": 3}, {"max_attention": top}, {"max_documents": 3, "max_attention": top}):
        got = packing.packed(packing.pieces(table(spark, rows), tokenizer_path("word_bpe_49k.json")), weights=(1.0, 1.0, 1.0), rule=rule, **most).toPandas()
        own = got.assign(cost=got.length**2).groupby("sequence_id").agg(n=("doc_id", "size"), tokens=("length", "sum"), cost=("cost", "sum"))
        assert sorted(got.doc_id) == list(range(200)) and own.tokens.max() <= 4096
        assert own.n.max() <= most.get("max_documents", 4096) and own.cost.max() <= most.get("max_attention", 4096**2)
        assert len(own) > -(-got.length.sum() // 4096) + 1  # more sequences than tokens alone need


def plain_best_fit(lengths, caps, weights, rule):
    """Every open sequence is tried in order; the first of the best takes the piece."""
    left, bins = [], []
    for t in lengths:
        need, best = (t, 1, t * t), None
        for i, own in enumerate(left):
            if all(a >= b for a, b in zip(own, need)):
                rest = [(a - b) / c for a, b, c in zip(own, need, caps)]
                worth = sum(w * r * r for w, r in zip(weights, rest)) if rule == "norm" else -sum(w * a / c * b / c for w, a, b, c in zip(weights, own, need, caps))
                if best is None or worth < best[0] - 1e-12:
                    best = (worth, i)
        if best is None:
            left.append(list(caps))
            best = (0, len(left) - 1)
        left[best[1]] = [a - b for a, b in zip(left[best[1]], need)]
        bins.append(best[1])
    return bins, left


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 3_700), (100, 5, 4_000)])
def test_bins_are_those_of_a_plain_best_fit(rule, caps):
    """The same number of sequences, each step as good: ties may go to another sequence of equal residuals, so residuals are compared."""
    lengths = sorted(random.Random(caps[1]).choices(range(1, 60), k=300), reverse=True)
    weights = (1.0, 0.7, 0.4)
    _, left = plain_best_fit(lengths, caps, weights, rule)
    bins, _ = packing.vector_best_fit(np.array(lengths), caps, weights, rule)
    got = [[caps[0], caps[1], caps[2]] for _ in range(max(bins) + 1)]
    for b, t in zip(bins.tolist(), lengths):
        got[b] = [a - x for a, x in zip(got[b], (t, 1, t * t))]
    assert sorted(map(tuple, got)) == sorted(map(tuple, left))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.array(sorted(random.Random(1).choices(range(1, 60), k=400), reverse=True))
    bins, offsets = packing.vector_best_fit(lengths, (100, 5, 4000), (1, 1, 1), rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 5 and (own**2).sum() <= 4000


def test_edited_counts_equal_new_counts(spark):
    rng = random.Random(6)
    path = tokenizer_path("byte_bpe_50k.json")
    e = subwords.encoder(path, "byte")
    for _ in range(150):
        text = "".join(rng.choices(["ab", "c", " ", " ", "\n", "é", "42", "'s", "  "], k=rng.randint(0, 120)))
        tree = edit_counts.CountTree.of(text, e.ids, size=rng.choice([4, 16, 64]))
        for _ in range(6):
            at, n, new = rng.randint(0, len(text) + 2), rng.randint(0, 9), "".join(rng.choices(["x", " ", "yz ", "\n", "7"], k=rng.randint(0, 5)))
            tree.edit(at, n, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + n :]
            assert "".join(tree.leaf) == text
            assert tree.total == len(e.tokenizer.encode(text, add_special_tokens=False).ids)
    rows = [(1, "some plain words here"), (2, None), (3, ""), (4, "long words " * 3000), (None, "a b")]
    edits = F.array(F.struct(F.lit(5).alias("start"), F.lit(2).alias("n_delete"), F.lit("new").alias("insert")))
    count = lambda t: len(e.tokenizer.encode(t, add_special_tokens=False).ids)
    trees = edit_counts.kept_trees(table(spark, rows), path).cache()
    got = {r["doc_id"]: r for r in edit_counts.edited(trees, edits, path).collect()}
    for i, t in rows:
        t = t or ""
        assert got[i]["n_tokens_before"] == count(t)
        assert got[i]["n_tokens"] == count(t[:5] + "new" + t[7:]) == sum(got[i]["counts"])
        assert "".join(got[i]["leaves"]) == t[:5] + "new" + t[7:]
    assert got[4]["n_encoded_again"] < 3000
    # what comes out is what the next edits start from
    again = {r["doc_id"]: r for r in edit_counts.edited(edit_counts.edited(trees, edits, path), edits, path).collect()}
    step = lambda t: t[:5] + "new" + t[7:]
    assert all(again[i]["n_tokens"] == count(step(step(t or ""))) for i, t in rows)
    more = edit_counts.attached(trees, spark.createDataFrame([(1, 2, 0, 1, "b"), (1, 1, 0, 0, "a")], "doc_id long, edit_no int, start int, n_delete int, insert string"))
    assert [x["insert"] for x in more.filter("doc_id = 1").first()["edits"]] == ["a", "b"]
    assert edit_counts.edited(edit_counts.kept_trees(table(spark, []), path), edits, path).count() == 0


def test_a_leaf_that_grows_is_cut_again():
    e = subwords.encoder(tokenizer_path("byte_bpe_50k.json"), "byte")
    tree, text = edit_counts.CountTree.of("one two three", e.ids, size=32), "one two three"
    for i in range(400):
        tree.edit(7, 0, f" word{i}")
        text = text[:7] + f" word{i}" + text[7:]
    assert "".join(tree.leaf) == text and tree.total == len(e.tokenizer.encode(text, add_special_tokens=False).ids)
    assert max(map(len, tree.leaf)) <= 4 * 32 + 16 and tree.n_encoded < 400 * 300


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fitted(docs.filter(~language_id.held_out("doc_id")), per_language=80)
    got = language_id.predicted(docs, model).join(docs.select("doc_id", "lang", language_id.held_out("doc_id").alias("h")), "doc_id").filter("h and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    odd = language_id.predicted(table(spark, [(1, None), (2, ""), (3, "12 !? ☂"), (4, "é"), (None, "the words of the land")]), model)
    by = {r["doc_id"]: r for r in odd.collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[4]["lang_pred"] != "und" and by[1]["rejected"]
    assert language_id.fitted(table(spark, [(1, "text")])) is None
    assert language_id.predicted(table(spark, [(1, "text")]), None).first()["lang_pred"] == "und"
    assert language_id.accepted(docs, model).count() >= 0.99 * docs.count()
    assert language_id.predicted(table(spark, []), model).count() == 0


def plain_vector(text, idf):
    """TF-IDF of hashed bigrams and trigrams, one n-gram at a time."""
    m = [(b | 0x20 if b < 0x80 else b) if b >= 0x80 or chr(b).isalpha() else 0x20 for b in text.encode()]
    counts = {}
    for i in range(len(m) - 1):
        two = ((m[i] * 0x9E3779B1 % 2**32) ^ (m[i + 1] * 0x85EBCA6B % 2**32)) * 0x2C1B3C6D % 2**32
        counts[two >> 20] = counts.get(two >> 20, 0) + 1
        if i + 2 < len(m):
            three = (two ^ (m[i + 2] * 0xC2B2AE35 % 2**32)) * 0x27D4EB2F % 2**32
            counts[three >> 20] = counts.get(three >> 20, 0) + 1
    v = {g: np.log1p(n) * float(idf[g]) for g, n in counts.items()}
    norm = sum(x * x for x in v.values()) ** 0.5
    return {g: x / norm for g, x in v.items()} if norm else {}


def test_predictions_equal_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fitted(docs.filter(~language_id.held_out("doc_id")), per_language=40)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = [r for r in docs.filter(~language_id.held_out("doc_id")).collect() if r["lang"] and language_id.has_letter(r["text"])]
    df = np.zeros(language_id.DIMENSIONS)
    for r in train:
        df[list(plain_vector(r["text"], np.ones(language_id.DIMENSIONS)))] += 1
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + df)) + 0.05, atol=1e-5)
    for r in language_id.predicted(docs, model).collect():
        v = plain_vector(texts[r["doc_id"]] or "", model.idf)
        cos = [sum(x * float(c[g]) for g, x in v.items()) for c in model.matrix]
        if language_id.has_letter(texts[r["doc_id"]]):
            best = max(cos)
            assert abs(r["score"] - best) < 1e-4 and r["lang_pred"] in {model.languages[i] for i, x in enumerate(cos) if x > best - 1e-4}
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_random_letters_are_rejected_and_short_texts_are_not(spark):
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(-1 - i, t, lang) for i, t in enumerate(["", " ", "12 !? ☂", "\n\n", "2024-01-01"] * 8) for lang in ("de", "en", "es", "fr")]
    model = language_id.fitted(docs.filter(~language_id.held_out("doc_id")).unionByName(spark.createDataFrame(junk, docs.schema)), per_language=80)
    words = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200)) for _ in range(20)]
    held = docs.filter(language_id.held_out("doc_id") & F.col("lang").isNotNull()).collect()
    short = [" ".join(r["text"].split()[:n]) for r in held if len(r["text"].split()) >= 30 for n in (3, 6, 12)]
    rows = [(i, t) for i, t in enumerate(words + [base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)] + short)]
    got = {r["doc_id"]: r["rejected"] for r in language_id.predicted(table(spark, rows), model).collect()}
    assert all(got[i] for i in range(40))
    assert sum(got[i] for i in range(40, len(rows))) <= 0.02 * len(short)
    assert language_id.accepted(docs, model).count() >= 0.99 * docs.count()


def test_gram_counts_do_not_depend_on_windows(monkeypatch):
    data = np.frombuffer("Ab cé, the end".encode() * 40, np.uint8)
    offsets = np.array([0, 5, 5, 200, len(data)])
    whole = language_id.gram_counts(data, offsets)
    monkeypatch.setattr(language_id, "_WINDOW", 11)
    assert (language_id.gram_counts(data, offsets) == whole).all()


def brute_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    return {q: sorted(((-float(good[q] @ x), i) for i, x in good.items() if i != q))[:k] for q in good if q % 20 == 0}


def test_recall_against_all_pairs(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = vector_search.nearest(e, F.col("vec_id") % 20 == 0, k=20).toPandas()
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in e.collect()], 20)
    hit = sum(len({i for _, i in want[q]} & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert hit >= 0.93 * sum(map(len, want.values()))
    for q, own in got.groupby("query_id"):
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 21))


def test_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 0.0, 0.0, 1.0]), (280, [float("inf"), 0.0, 0.0, 1.0]), (300, [1.0])]
    e = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, list int")
    got = vector_search.nearest(e, F.col("vec_id") % 20 == 0, k=5, cell_rows=10, cell_queries=2).toPandas()
    want = brute_nearest([r for r in rows if r[0] != 300], 5)
    assert {q: own.sort_values("rank").vec_id.tolist() for q, own in got.groupby("query_id")} == {q: [i for _, i in w] for q, w in want.items()}
    assert vector_search.nearest(e.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy</div><article><header><h1>A  &amp;\n title</h1></header><p><b>Bold<br>text <script>x()</script>more<p>Second &copy; &lt;b&gt;<div class="comments"><p>Nice!</p></div><form><input>Name</form><ul><li>one<li>two</ul>tail</article><aside>Side</aside><footer>&copy; end</footer></body></html>'


def test_article_text(spark):
    rows = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", None), (3, None, ""), (4, "x", "<p>no article<p>here"), (4, "x", "<p>no article<p>here"), (5, "http://b.com", PAGE[:380]), (6, "http://b.com/", "plain &amp text")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, valid int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in page_text.main_texts(df).collect())
    want = "A & title\n\nBold text more\n\nSecond © <b>\n\none\n\ntwo\n\ntail"
    assert got[0] == (1, want, len(want))
    assert [g[1] for g in got[1:5]] == ["", "", "no article\n\nhere", "no article\n\nhere"]
    assert got[5][1].startswith("A & title\n\nBold text") and got[6][1] == "plain & text"
    assert page_text.main_texts(df.filter("page_id < 0")).count() == 0


def test_template_text_of_a_host_without_articles_goes(spark):
    rows = [(i, f"http://h.org/{i}", f"<div><p>Welcome to our site</p><p>Story {i} is told here</p></div><p>All pages end so</p>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in page_text.main_texts(df).collect()} == {f"Story {i} is told here" for i in range(6)}


def test_template_text_inside_articles_goes_and_copies_are_no_template(spark):
    line = "<p>Read all our other stories too</p>"
    rows = [(i, f"http://a.org/{i}", f"<article><p>Story {i} is told here</p>{line}</article>") for i in range(6)]
    rows += [(100 + i, f"http://b.org/{i}", f"<p>The very same story is on pages</p><p>It has {'two' if i < 8 else i} parts</p>") for i in range(10)]
    word = lambda i: "<p>Chapter</p>" if i % 4 else "<p>Once</p>"
    rows += [(200 + i, f"http://c.org/{i}", f"<div>{word(i)}<p>Tale {i}</p></div>{'<div><ul><li>Our weekly tale letter</li></ul></div>' if i % 5 else ''}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.main_texts(df).collect()}
    assert all(got[i] == f"Story {i} is told here" for i in range(6))
    assert got[100] == "The very same story is on pages\n\nIt has two parts"
    assert got[201] == "Chapter\n\nTale 1"


def test_classes_are_judged_by_size_in_their_slots():
    t = lambda token, parent, n, size=1, total=None, f=None: {"token": token, "parent": parent, "n": n, "total": total or n, "size": size, "f1": str(f or n), "f2": "0"}
    page = [t(1, 0, 10), t(2, 1, 10), t(3, 1, 10), t(4, 2, 10, total=30), t(5, 3, 10, total=20)]
    parts = lambda more: sorted(sorted(p) for p in page_text.valid_parts(page + more, 3))
    assert parts([]) == [[1, 2, 3]]
    # two words in two slots are too few in each, though together enough
    assert parts([t(6, 4, 8, 2), t(7, 5, 8, 2)]) == [[1, 2, 3]]
    assert parts([t(6, 4, 8, 2), t(7, 4, 8, 2), t(8, 5, 8, 1)]) == [[1, 2, 3], [6, 7]]
    # an element of a rejected class holds no slot of its own
    assert parts([t(6, 4, 8, 1), t(7, 6, 7, 2), t(8, 4, 7, 1)]) == [[1, 2, 3], [7, 8]]


def test_equal_rows_are_many_groups(spark):
    """20,000 equal pieces are dealt as evenly as different ones, and packed without loss."""
    cut = spark.range(20_000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "1000L as length", "5L as ids_crc32")
    got = packing.packed(cut, group_rows=2_000)
    sizes = [r["count"] for r in got.groupBy((got["sequence_id"] / 2**32).cast("long").alias("g")).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 20_000 and max(sizes) < 2 * min(sizes)
    assert got.select("sequence_id").distinct().count() <= 5_010 and got.columns == [*cut.columns, "sequence_id", "offset"]


def test_rows_of_one_doc_id_are_many_tasks(spark):
    from meridia.llm import token_files
    from meridia.llm.queries import tokenizer_path

    docs = spark.range(400).selectExpr("cast(if(id % 4 = 0, null, 3) as long) as doc_id", "concat('text ', id) as text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.select("path").distinct().count() > 2
    rows = token_files.read_token_files(index).orderBy("start").collect()
    assert len(rows) == 400 and [r["doc_id"] is None for r in rows] == [True] * 100 + [False] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_ids_do_not_depend_on_what_a_worker_remembers(monkeypatch):
    """Calls of one text, odd pieces among plain ones, and tables with no room: the library's own ids."""
    from tokenizers import Tokenizer

    from meridia.llm import subwords
    from meridia.llm.queries import tokenizer_path

    texts = ["", " ".join(f"word{i} number {i * 7919 % 1013}" for i in range(3000)), "a \x01 b  <|x|> \n c" * 40, "word1 number again " + "z" * 5000]
    monkeypatch.setattr(subwords, "CALL", 2)
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        plain = Tokenizer.from_file(tokenizer_path(name))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        for keep in (1, 500, 1_000_000):
            enc = subwords.SubwordEncoder(tokenizer_path(name), kind)
            enc.keep_pieces = keep
            for _ in range(2):
                assert [x.tolist() for x in enc.ids(texts)] == want
