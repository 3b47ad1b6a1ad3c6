"""Periodic runs, URL filters and collocations against plain versions, and their edges."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridia.llm import collocations, periodic_runs, url_filter
from meridia.llm.collocation_queries import op13_collocations
from meridia.llm.periodic_queries import op11_periodic_runs
from meridia.llm.url_queries import op12_url_filter

# ---- periodic runs


def plain_runs(words, min_words=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_words, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_order(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = periodic_runs.with_runs(docs, **options).collect()
    return {r["doc_id"]: ([(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in rows}


def periodic_text(rng, n, alphabet):
    """Words with runs of many periods side by side, one inside another, and overlapping."""
    words = []
    while len(words) < n:
        unit = [rng.choice(alphabet) for _ in range(rng.randint(1, max(2, n // 6)))]
        part = unit * rng.randint(1, 5)
        words += part[: rng.randint(1, len(part))]
        words += [rng.choice(alphabet) for _ in range(rng.randint(0, 6))]
    return " ".join(words[:n])


def test_runs_against_a_plain_version_in_one_piece_and_in_tiles(spark):
    rng = random.Random(5)
    texts = [periodic_text(rng, n, alphabet) for n in (11, 12, 13, 40, 150, 700, 1500) for alphabet in ("ab", "abcdefgh", [f"w{i}" for i in range(400)])]
    whole, tiled = found(spark, texts), found(spark, texts, tile=64)
    for i, text in enumerate(texts):
        words = text.split()
        want = plain_order(plain_runs(words))
        assert whole[i] == (want, plain_collapsed(words, want)), i
        assert tiled[i] == whole[i], i


def test_a_run_across_many_tiles_is_stitched(spark):
    rng = random.Random(9)
    unit = [f"u{rng.randint(0, 10**9)}" for _ in range(7)]
    strange = [f"s{i}" for i in range(3000)]
    text = " ".join(strange[:1000] + unit * 400 + strange[1000:])
    assert found(spark, [text], tile=64)[0] == ([(1000, 2800, 7)], " ".join(strange[:1000] + unit + strange[1000:]))
    long_unit = strange[:1300]
    assert found(spark, [" ".join(long_unit * 2 + ["end"])], tile=64)[0][0] == [(0, 2600, 1300)]


def test_run_edges(spark):
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, "\x0b".join("a" * 12), "é " * 30, "A a " * 12, "x" * 70000]
    got = found(spark, texts)
    assert got[0] == ([], None) and got[1] == ([], "") and got[2] == ([], "")
    assert got[3] == ([], " ".join("a" * 11)) and got[4] == ([(0, 12, 1)], "a") and got[5] == ([(0, 12, 1)], "a")
    assert got[6] == ([(0, 30, 1)], "é") and got[7] == ([(0, 24, 2)], "A a") and got[8] == ([], "x" * 70000)


def test_runs_of_repeated_rows_clashing_columns_and_empty_tables(spark):
    text = " ".join(["p q r"] * 2000)
    docs = spark.createDataFrame([(1, text, "mine", "c")] * 40 + [(None, "b " * 12, None, None)], "doc_id long, text string, runs string, collapsed string")
    rows = periodic_runs.with_runs(docs, tile=64).collect()
    assert len(rows) == 41 and {(r["runs"], r["collapsed"], len(r["_runs"]), r["_collapsed"]) for r in rows} == {("mine", "c", 1, "p q r"), (None, None, 1, "b")}
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0 and op11_periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.with_runs(docs, tile=100)
    null = op11_periodic_runs(docs.filter("doc_id is null").withColumn("text", docs["text"])).first()
    assert null["n_runs"] == 1 and null["exponent_milli"] == 12000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.sampled_from([12, 4]))
def test_any_words(values, min_words):
    import numpy as np

    from meridia.llm import words as W

    text = " ".join(map(str, values))
    data = np.frombuffer(text.encode(), np.uint8)
    w = W.words(data, np.array([0, len(data)]), W.BLANKS, lower=False)
    _, start, length, period = periodic_runs.runs_of(w, 1, 12)
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == plain_order(plain_runs(text.split()))


# ---- URL filters

URLS = [
    "https://example.org/es/1", "http://a.example.org/en/17?x=/es/", "http://badexample.org/es/", "HTTP://WWW.Example.COM/de/x#y", "https://example.com/fr", "https://example.com/fr/", "https://org/", "https://org", "https://com/de/",
    "https://user@spam-farm.example.net:443/a/?q=1", "http://spam-farm.example.net./a", "http://spam-farm.example.net/A", "no url", "", None, "://", "https://", "https:///de/", "x://é.org/é/", "http://example.com?://other.org/es/",
]
LISTED = [("org", "/", "allow", "prefix"), ("example.org", "/es/", "block", "prefix"), ("example.org", "/en/1", "block", "prefix"), ("com", "/fr/", "allow", "prefix"), ("com", "/de/", "block", "prefix"), ("Spam-Farm.example.net", "/a/", "block", "exact"), ("spam-farm.example.net", "/a", "allow", "exact")]


def plain_verdict(url, listed, default="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v, kind in listed if host and kind == "prefix" and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], None, max(fits)[4]
    canonical = re.sub(r"\.?(:(80|443))?$", "", re.sub("^.*@", "", host)), re.sub("/+$", "", path)
    same = [v for h, p, v, kind in listed if host and kind == "exact" and (h.lower(), re.sub("/+$", "", p)) == canonical]
    return host, path, None, "".join(canonical) if same else None, ("block" if "block" in same else "allow") if same else default


def judged(spark, urls, listed=LISTED, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judged(pages, spark.createDataFrame(listed, url_filter.LISTED_DDL), **options).collect()
    assert len(rows) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["listed_url"], r["verdict"]) for r in rows}


def test_urls_against_a_plain_version(spark):
    got = judged(spark, URLS)
    assert got == {i: plain_verdict(u, LISTED) for i, u in enumerate(URLS)}
    assert got[1][2:] == ("example.org/en/1", None, "block") and got[9][3:] == ("spam-farm.example.net/a", "block") and got[19][1] == ""


def test_long_lists_and_hot_urls(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.net" for i in range(50)] + [f"s{i}.h{i}.net" for i in range(50)]
    listed = [(rng.choice(hosts), "/" + "x" * rng.randint(0, 5), rng.choice(["allow", "block"]), rng.choice(["prefix", "exact"])) for _ in range(600)]
    strictest = {}
    for h, p, v, k in listed:
        strictest[h, p if k == "prefix" else p.rstrip("/"), k] = max(v, strictest.get((h, p if k == "prefix" else p.rstrip("/"), k), v))
    listed = [(h, p, v, k) for (h, p, k), v in strictest.items()]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{'x' * rng.randint(0, 9)}" for _ in range(500)] + ["http://h1.net/x"] * 500
    assert judged(spark, urls, listed, default="block") == {i: plain_verdict(u, listed, "block") for i, u in enumerate(urls)}


def test_the_bloom_filter_has_all_keys_and_few_others(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) as key")
    bloom = url_filter.Bloom(keys, 20000)
    assert keys.filter(~bloom.may_have(keys["key"])).count() == 0
    other = spark.range(20000).selectExpr("concat('o', id) as key")
    assert other.filter(bloom.may_have(other["key"])).count() < 400
    full = url_filter.Bloom(keys, 20000, most=2)
    assert full.n_blocks == 2 and keys.filter(~full.may_have(keys["key"])).count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x", "H", "R")] * 3, "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame(LISTED, url_filter.LISTED_DDL)
    rows = url_filter.judged(pages, listed).collect()
    assert [(r["host"], r["_host"], r["rule"], r["_rule"], r["verdict"]) for r in rows] == [("H", "a.org", "R", "org/", "allow")] * 3
    assert url_filter.judged(pages.limit(0), listed).count() == 0 and op12_url_filter(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages, listed.limit(0), default="block").collect()} == {"block"}
    with pytest.raises(Exception, match="host"):
        url_filter.judged(pages, spark.createDataFrame([("", "/", "block", "prefix")], url_filter.LISTED_DDL)).collect()


def test_url_filter_has_no_python_on_its_path(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x")], "page_id long, url string")
    text = op12_url_filter(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text and "InPandas" not in text and "CartesianProduct" not in text


# ---- collocations


def plain_collocations(rows, least=30, longest=4, percent=80):
    count, total = Counter(), Counter()
    for lang, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang or "und", tuple(words[i : i + n])] += 1
    cands = {k: v for k, v in count.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, p), a in cands.items():
        longer = [f for (g, q), f in cands.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * f >= percent * a for f in longer):
            continue
        score, k = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    return out


def plain_leading(rows, most):
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def test_collocations_against_a_plain_version(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = [rng.choice("abcdé") if rng.random() < 0.7 else rng.choice(["New York", "x\ty z", "Q\x01", "one two three four"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", ", ", "\n", ".", "  "]) for w in words)))
    docs = spark.createDataFrame(rows + [("en", None), ("en", ""), ("empty", " ,")], "lang string, text string")
    want = plain_collocations(rows)
    assert len(want) > 100
    got = collocations.collocations(docs).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    top = collocations.leading(collocations.collocations(docs), 20).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, top)) == plain_leading(want, 20)


def test_counts_are_carried_over_range_borders(spark):
    """One word starts and ends most phrases, so its count is needed in ranges far from its own."""
    rows = [("en", f"the w{i} the") for i in range(60) for _ in range(31)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(map(tuple, collocations.collocations(docs, percent=81).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(plain_collocations(rows, percent=81)) and len(got) == 60


def test_collocation_edges(spark):
    docs = spark.createDataFrame([("en", "a b")] * 30 + [(None, "c d")] * 29, "lang string, text string")
    assert list(map(tuple, op13_collocations(docs).collect())) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]
    assert op13_collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, percent=50)
