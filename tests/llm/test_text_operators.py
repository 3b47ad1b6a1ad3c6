import hashlib
import random

import numpy as np
import pytest

from meridia.llm import decontaminate, license_scan, line_dedup, near_dedup
from meridia.llm import words as W

from . import brute

DOCS = "doc_id long, text string, lang string, k1 long, label string, token string"


def table(spark, rows, more=(None, 1, "x", "y")):
    """doc_id and text, with other columns whose names the operators use too."""
    return spark.createDataFrame([(*r, *more) for r in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéßø") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(rng.randint(1, 120)) for _ in range(60)]
    base = say(150).split()
    for i in range(40):  # a group of near copies, all near the base but not all near each other
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = say(1)
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["one", "one", "One two", "", None, " \n\t ", "word " * 5000, "x" * 100_000]
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, corpus, size):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, corpus), shingle=size).collect()}
    sets = {i: brute.shingles(t, size) for i, t in corpus}
    want = brute.components(sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i, _ in corpus}


def test_near_duplicates_of_few_and_odd_rows(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    got = near_dedup.near_duplicates(table(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    kept = near_dedup.near_deduplicated(table(spark, [(1, "q w e r t y"), (2, "q w e r t y"), (3, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == table(spark, []).columns


def test_blocks_of_a_cluster_are_all_compared(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    sets = {i: brute.shingles(t, 2) for i, t in corpus}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, corpus), shingle=2).collect()}
    assert got == brute.components(sets)


ITEMS = [(1, "alpha beta gamma"), (2, " ".join(f"w{i}" for i in range(20))), (10, "Alpha BETA gamma"), (3, ""), (4, None), (5, " ".join(f"w{i}" for i in range(5, 25)))]


def contaminated_rows():
    run = " ".join(f"w{i}" for i in range(20))
    return [(0, f"start {run} end"), (1, run.replace("w7", "W7")), (2, "alpha, beta\n\n gamma! " + "z " * 100), (3, None), (4, ""), (5, "alpha beta delta"), (6, "alpha beta gamma"), (7, "alpha beta gamma" + " z" * 57), (8, "alpha beta gamma" + " z" * 58), (9, "alpha beta alpha beta gamma é w0"), (10, "y " * 30000 + run)]


@pytest.mark.parametrize("bound", [10**9, 100])
def test_contamination_equals_window_search(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    known = {str(i): t for i, t in ITEMS}
    got = decontaminate.judged(decontaminate.contamination(table(spark, contaminated_rows()), items, max_broadcast_bytes=bound)).collect()
    for r in got:
        n, hit, ids = brute.contamination(dict(contaminated_rows())[r["doc_id"]], known)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert tuple(r) == (r["doc_id"], n, len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= n)
    assert len(got) == len(contaminated_rows())
    clean = decontaminate.decontaminated(table(spark, contaminated_rows()), items, max_broadcast_bytes=bound)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in got if not r["contaminated"])
    assert clean.columns == table(spark, []).columns


def test_a_large_benchmark_gives_the_rows_of_a_small_one(spark):
    run = " ".join(f"w{i}" for i in range(20))
    rows = [(None, "alpha beta gamma"), (None, "a clean text"), (None, None), (1, run), (1, "a clean text of the same id"), (1, run), (2, "alpha beta gamma " + "z " * 100), (2, "x " * 500)]
    docs, items = table(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    order = lambda r: str(tuple(r))
    for way in (lambda n: decontaminate.contamination(docs, items, max_broadcast_bytes=n), lambda n: decontaminate.decontaminated(docs, items, max_broadcast_bytes=n)):
        small, large = (sorted(way(n).collect(), key=order) for n in (10**9, 60))
        assert small == large
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in large) == sorted((d or -1, t or "") for d, t in rows if t not in (run, "alpha beta gamma"))


def test_spans_are_removed_from_texts(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = dict(map(tuple, decontaminate.spans_removed(table(spark, [(1, "é Alpha beta, gamma é"), (2, "none"), (3, None), (4, "alpha beta gamma")]), items).collect()))
    assert got == {1: "é  é", 2: "none", 3: None, 4: ""}
    same_id = decontaminate.spans_removed(table(spark, [(1, "x alpha beta gamma"), (1, "yy alpha beta gamma z"), (1, "clean")]), items).collect()
    assert sorted(r["text"] for r in same_id) == ["clean", "x ", "yy  z"]


def test_windows_of_many_items_are_kept_once(spark):
    items = [(str(i), "one two three four") for i in range(500)] + [("x", "one two three four five"), (None, "one two three four")]
    grams = decontaminate.NgramSet(items, 13)
    assert [len(grams.groups[k][0]) for k in (4, 5)] == [1, 1]
    assert grams.items({(4, 0), (5, 0)}) == sorted([*map(str, range(500)), "x"])
    assert decontaminate.NgramSet([], 13).hits(np.zeros(0, np.uint8), W.words(np.zeros(0, np.uint8), np.array([0]), W.ALNUM)) == []


def test_equal_hashes_of_unlike_windows_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(W, "windows", lambda h, k: np.full(max(len(h) - k + 1, 0), 7, np.uint64))
    grams = decontaminate.NgramSet([("a", "one two"), ("b", "three four"), ("c", "one two")], 13)
    data = np.frombuffer(b"zero One-two three four", np.uint8)
    found = grams.hits(data, W.words(data, np.array([0, len(data)]), W.ALNUM))
    assert {(i, size, tuple(grams.items({(size, g)}))) for i, size, g in found} >= {(1, 2, ("a",)), (3, 2, ("b",))} and {i for i, _, _ in found} == {1, 3}


def test_contamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(table(spark, []), none).count() == 0
    assert decontaminate.judged(decontaminate.contamination(table(spark, [(1, "a")]), none)).first()["n_hit"] == 0


LICENSES = [
    (1, "Licensed under CC BY-NC 4.0.\nAll rights reserved. All Rights\nReserved"), (2, None), (3, ""), (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "word " * 63 + "all rights reserved " + "word " * 61 + "cc by " + "general public license"), (6, "reserved rights all"), (7, "released under the MIT license"), (8, "ccby cc-by CC_BY c c b y"), (8, "cc by"),
    (9, "é all rights reservedé"), (10, " ".join(["all rights reserved"] * 500)),
]


def test_license_phrases_equal_a_search(spark):
    got = license_scan.license_report(table(spark, LICENSES)).collect()
    want = []
    for i, t in LICENSES:
        found = {label: brute.places(t, p) for p, label in license_scan.PHRASES.items()}
        at = sum(found.values(), [])
        want.append((i, len(brute.words(t)), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(x for x, p in found.items() if p))))
    order = lambda r: (r[0], r[1])
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted(want, key=order)
    by = {r["doc_id"]: r["labels"].split(",") for r in got if r["doc_id"] != 8}
    assert "mit" in by[7] and "gpl-3.0" in by[4] and by[3] == [""]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_whole_license_texts_are_met(spark):
    rng = random.Random(2)
    words = " ".join(license_scan.TEMPLATES["mit-license"].split())
    broken = " ".join(w for w in words.split() if rng.random() > 0.03)
    half = " ".join(words.split()[: len(words.split()) // 2])
    rows = [(1, "x " * 500 + words + " y" * 300), (2, broken), (3, half), (4, "z " * 199 + words)]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.license_report(table(spark, rows)).collect()}
    assert all("mit-license" in got[i] for i in (1, 2, 4)) and "mit-license" not in got[3]


def test_license_matches_equal_containment(spark):
    rng = random.Random(1)
    templates = {f"t{i}": " ".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for i in range(12)}
    rows = [(i, " ".join(rng.choices("abcdefghijxyz", k=rng.randint(0, 30)))) for i in range(80)]
    got = license_scan.license_matches(table(spark, rows), templates=templates, phrases={}, containment=0.7, step=8)
    met = {(r["doc_id"], r["begin"], r["label"]) for r in got.collect() if r["begin"] >= 0}
    size = 8 + max(len(t.split()) for t in templates.values())
    want = set()
    for i, t in rows:
        w = t.split()
        for b in range(0, len(w), 8):
            for label, x in templates.items():
                if len(set(x.split()) & set(w[b : b + size])) >= 0.7 * len(set(x.split())) - 1e-9:
                    want.add((i, b, label))
    assert met == want
    assert license_scan.license_report(table(spark, [])).count() == 0
    assert license_scan.license_report(table(spark, [(1, "all rights reserved")]), templates={}, phrases={}).first()["labels"] == ""


def test_repeated_line_templates_go(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        own = [" ".join(f"{c}{'' if rng.random() < .9 else rng.randint(0, 9)}" for c in rng.choices("mnopqrstuvw", k=rng.randint(1, 9))) for _ in range(3)]
        rows.append((i, "\n".join([*own, f"user {rng.choice(['ann', 'bob', 'cy'])} logged in from host {rng.randint(1, 99)} at noon", "a shared line that says the same everywhere" if i % 3 else "", f"Page {i} of 40", f"Seen by {rng.choice(['ann', 'bob', 'cy'])}{'abcdefghij'[i % 10]}"])))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, rows[0][1]), (43, "new words in this row only"), (None, "a shared line that says the same everywhere")]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.without_repeats(table(spark, rows)).collect()]
    want = brute.line_templates([r for r in rows if r[0] is not None]) + [rows[-1]]
    order = lambda r: (r[0] or -1, r[1] or "")
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = [t for _, t in got if t and "user" in t]
    assert len(kept) < 5
    assert line_dedup.without_repeats(table(spark, [])).count() == 0


def test_repeated_rows_and_clashing_columns_of_lines(spark):
    line = "a shared line that says the same everywhere"
    rows = [(1, f"own one\n{line}"), (2, f"{line}\nown two\n{line}"), (2, f"{line}\nown two\n{line}"), (2, f"other text\n{line}"), (3, None)]
    docs = spark.createDataFrame([(*r, "x", True, 7, 8, "t") for r in rows], "doc_id long, text string, _hash string, _gone boolean, n_lines int, _doc int, line string")
    got = line_dedup.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "_hash", "_gone", "n_lines", "_doc", "line", "_n_lines", "n_dropped"] and {r["n_lines"] for r in got.collect()} == {7}
    want = [(1, rows[0][1], 2, 0), (2, "own two", 3, 2), (2, "own two", 3, 2), (2, "other text", 2, 1), (3, None, 0, 0)]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r["doc_id"], r["text"], r["_n_lines"], r["n_dropped"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r["_hash"] == "x" and r["_gone"] and r["_doc"] == 8 and r["line"] == "t" for r in got.collect())


def test_documents_of_a_short_line_are_counted_once(spark):
    """Short lines recur in five documents; five rows of two documents are two."""
    rows = [(1, f"row {i}\nback to top") for i in range(4)] + [(2, "x\nback to top")]
    assert all(r["n_dropped"] == 0 for r in line_dedup.without_repeats(table(spark, rows)).collect())
    rows = [(i, f"row {'abcde'[i]}\nback to top") for i in range(5)]
    assert sorted(r["n_dropped"] for r in line_dedup.without_repeats(table(spark, rows)).collect()) == [0, 1, 1, 1, 1]
    # several lines of one template in one document count once as well
    rows = [(1, "\n".join(f"posted by u{c}" for c in "vwxyz")), (2, "posted by ua")]
    assert all(r["n_dropped"] == 0 for r in line_dedup.without_repeats(table(spark, rows)).collect())


@pytest.mark.parametrize("n", [50, 10_000])
def test_the_same_boilerplate_goes_at_any_size(spark, n):
    """Fields are told by their share of the leaf, so a value that many documents have stays a field."""
    name = lambda i: f"name{chr(97 + i % 10)}{chr(97 + i // 10 % 10)}"
    city = lambda i: f"city{chr(97 + i // 100 % 10)}{chr(97 + i * 7 % 10)}{chr(97 + i // 10 % 10)}"
    rows = [(i, f"this notice was filed by {name(i)} for the {city(i)} office today\nPosted by {name(i)}\n{i} {i + 1} {i + 2} {i + 3} {i + 4}\n{i % 100 + 1900}") for i in range(n)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(table(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == "\n".join(rows[i][1].split("\n")[2:4]) for i in range(1, n)), "numbers alone are no template"


@pytest.mark.parametrize("templates,strangers", [(1, 0), (1, 600), (12, 0), (12, 3_000), (200, 0), (3, 100_000)])
def test_templates_of_one_leaf_go_whatever_else_is_in_it(spark, templates, strangers):
    """Templates that begin alike and are of one length, each of 20 documents, beside other lines of that beginning and length."""
    rng = random.Random(templates + strangers)
    word = lambda: "".join(rng.choices("abcdefgh", k=2))
    kinds = [[word() for _ in range(9)] for _ in range(templates)]
    names = ["".join(rng.choices("klmnop", k=4)) for _ in range(20)]
    rows = []
    for d in range(20):
        for k, kind in enumerate(kinds):
            line = list(kind)
            line[4] = names[(d + k) % 20]
            rows.append((k * 20 + d, "please note that the " + " ".join(line)))
    if templates > 1:  # the first has most of the leaf
        rows += [(10**5 + d, rows[0][1].replace(names[0], f"more{'abcdefghij'[d % 10]}{'abcdefghij'[d // 10 % 10]}{'abcdefghij'[d // 100]}")) for d in range(5 * strangers // 10 % 1000)]
    rows += [(10**6 + i, "please note that the " + " ".join(word() for _ in range(9))) for i in range(strangers)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(table(spark, rows)).collect()}
    assert {i for i, t in got.items() if t == ""} == {i for i in range(templates * 20) if i % 20} | {i for i, _ in rows if 10**5 <= i < 10**6}
    if templates * 20 + strangers < 700:
        assert sorted(got.items()) == sorted(brute.line_templates(rows))


def test_words_across_windows(monkeypatch):
    monkeypatch.setattr(W, "WINDOW", 7)
    text = "Ab cdé--fgh " + "x" * 40 + " 12\n"
    assert [w.decode() for w in W.text_words(text, W.ALNUM)] == brute.words(text)
