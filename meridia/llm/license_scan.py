"""License scans: an exact set-similarity join between blocks of text and license templates, in DataFrame functions only.

A block is a window of words that steps by `step` words and overlaps the next one by the longest template, so
every run of up to that many words lies whole in a block. A template is met by a block that holds at least
`containment` of its distinct words. Candidates come from an inverted index of template prefixes: template
words are ordered from rare to frequent by the documents that hold them, over the whole table, and a block that
reaches the threshold must hold one of the template's first n - ceil(c n) + 1 words. A length filter (the block's
template words) and a positional filter (what can still follow the shared word in both orders) then prune, and
the overlap of what is left is counted exactly. Words outside all templates cannot add to an overlap, so
dropping them first changes nothing.

A phrase is a template with containment 1 whose words must also stand consecutively; its places are read off the
matching blocks, each place in the block where it begins.

Cases: a null or empty text has no words and no labels; repeated rows (also of one doc_id) give one row each;
without templates every document has no label; template ties in frequency are ordered by the word; columns
other than the two named are neither read nor changed, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases and labels that every scan reports.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices to look for, by label. They are parameters of license_matches; these are the defaults.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "all-rights-reserved": "all rights reserved",
    "mit-license": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-license": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    containment: float
    phrase: bool


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def words_needed(t: Template) -> int:
    """How many of its distinct words a block must hold."""
    return math.ceil(t.containment * len(set(t.words)) - 1e-9)


def templates_of(templates: dict[str, str], phrases: dict[str, str], containment: float) -> list[Template]:
    """Templates and phrases as words; those without words are left out."""
    import re

    cut = lambda t: tuple(w for w in re.split(NOT_WORD, t.translate(str.maketrans(UPPER, LOWER))) if w)
    out = [Template(label, cut(text), containment, False) for label, text in templates.items()] + [Template(label, cut(text), 1.0, True) for text, label in phrases.items()]
    return [t for t in out if t.words]


def step_of(known: list[Template], step: int | None) -> int:
    """How many words a block steps: at least as many as the longest template has, so that a word stands in two blocks at most."""
    return step or max([64, *(len(t.words) for t in known)])


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Documents that hold each vocabulary word; at most as many rows as template words come to the driver."""
    shared = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(shared).alias("w")).groupBy("w").count().collect()
    return {w: n for w, n in rows}


def license_matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, containment: float = 0.9, step: int | None = None) -> DataFrame:
    """One row per document and matching (block, template), and one without a label for each document.

    Columns: _row, doc_id, n_words, label, phrase (boolean), begin (first word of the block), overlap (of distinct
    words), n_template, places (word positions of a phrase, else null).
    """
    known = templates_of(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, containment)
    step = step_of(known, step)
    vocabulary = sorted({w for t in known for w in t.words}) or [""]
    seen = word_frequencies(docs, vocabulary, text_col)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}

    index, sizes, need = [], [], {}
    for t in known:
        own = sorted(set(t.words), key=rank.__getitem__)
        need[t] = words_needed(t)
        sizes.append(len(t.words))
        for at, w in enumerate(own[: len(own) - need[t] + 1]):
            index.append(F.struct(F.lit(w).alias("w"), F.lit(at).alias("t_at"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.array(*map(F.lit, own)).alias("own"), F.lit(need[t]).alias("need"), F.array(*map(F.lit, t.words)).alias("t_words")))
    block = step + max(sizes, default=1)
    order = F.array(*map(F.lit, sorted(vocabulary, key=rank.__getitem__)))
    first_words = F.array(*map(F.lit, sorted({w for t in known for w in sorted(set(t.words), key=rank.__getitem__)[: len(set(t.words)) - need[t] + 1]}) or [""]))

    read = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("_words"))
    n = F.size("_words")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda b: F.struct(b.alias("begin"), F.slice("_words", b + 1, F.lit(block)).alias("words")))
    # a document's own row (begin -1) stands beside its candidate blocks, so no join back to the documents is needed
    own_row = F.array(F.struct(F.lit(-1).alias("begin"), F.array().cast("array<string>").alias("words")))
    rows = read.select("_row", "doc_id", n.cast("long").alias("n_words"), F.explode(F.concat(own_row, F.filter(blocks, lambda b: F.arrays_overlap(b["words"], first_words)))).alias("b"))
    in_order = rows.select("_row", "doc_id", "n_words", F.col("b.begin").alias("begin"), F.col("b.words").alias("words"), F.array_intersect(order, F.col("b.words")).alias("known"))
    shared = in_order.select("*", F.posexplode_outer("known").alias("b_at", "w"))
    if not index:
        return in_order.filter("begin = -1").select("_row", "doc_id", "n_words", F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"), F.col("begin"), F.lit(0).alias("overlap"), F.lit(0).alias("n_template"), F.lit(None).cast("array<int>").alias("places"))
    prefixes = docs.sparkSession.range(1).select(F.inline(F.array(*index)))
    if len(index) <= 20_000:  # the index is a parameter, not data: its size is known here
        prefixes = F.broadcast(prefixes)
    found = (
        shared.join(prefixes, "w", "left")
        .filter((F.col("begin") == -1) | (F.col("label").isNotNull() & (F.size("known") >= F.col("need")) & (1 + F.least(F.size("own") - F.col("t_at") - 1, F.size("known") - F.col("b_at") - 1) + F.least("t_at", "b_at") >= F.col("need"))))
        .withColumn("overlap", F.size(F.array_intersect("own", "known")))
        .filter((F.col("begin") == -1) | (F.col("overlap") >= F.col("need")))
    )
    k = F.size("t_words")
    stands = lambda i: (F.get("words", i) == F.get("t_words", F.lit(0))) & (F.slice("words", i + 1, k) == F.col("t_words"))
    places = F.when(F.col("phrase") & (F.col("begin") >= 0), F.transform(F.filter(F.sequence(F.lit(0), F.least(F.size("words"), F.lit(step)) - 1), stands), lambda i: i + F.col("begin")))
    return found.select("_row", "doc_id", "n_words", "label", "phrase", "begin", "overlap", F.size("own").alias("n_template"), places.alias("places"))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: its phrase places and labels. score is the largest share of a template found in a block."""
    m = license_matches(docs, **options)
    real = F.col("begin") >= 0
    base = real & F.col("phrase") & (F.size("places") > 0)
    # a phrase may share several prefix words with a block: its block counts once
    once = m.groupBy("_row", "begin", "label", "phrase").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("places").alias("places"), F.max(F.try_divide(F.col("overlap"), F.col("n_template"))).alias("share"))
    met = F.when(real & (~F.col("phrase") | (F.size("places") > 0)), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        once.groupBy("_row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.coalesce(F.sum(F.when(base, F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
            F.min(F.when(base, F.array_min("places"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.array_max("places"))).cast("long").alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(met).alias("labels"),
            F.coalesce(F.max(F.when(met.isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
        ).drop("_row")
    )
