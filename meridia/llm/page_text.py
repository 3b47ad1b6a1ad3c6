"""Main text of web pages by deducing the template of each host.

Each page is read into blocks of text with the path of elements around them. Pages of a host that show the same
blocks are copies and count as one content, so that copies of a page are no template. Tokens (an element path, or a
path with its whole text) that stand once in each of at least `share` of the host's contents (and of min_pages) and
whose occurrence vectors over the contents are equal form an equivalence class. A class is judged in the parts that
lie in one slot each: the slot of a token is the nearest element around it that a valid class of more contents holds
(or the page). A part is valid if it has min_size tokens, a text counting its words; larger classes are judged first,
and elements of parts that are not valid hold no slot. Text in a valid part is template, inside an article too; what
remains are slots. If the page has an article or main element, the slots in it are the main text; elsewhere the slots
outside menus, headers, footers, sidebars, notices, adverts, forms and comments remain.

Occurrence vectors are never gathered: a token's vector is summed up as a 128-bit fingerprint over contents, so a host
with a third of all pages is aggregated before the shuffle. A host's frequent tokens, which meet in one place to be
judged, are at most the tokens of an average page divided by `share`.

Cases: null, empty or text-free html gives ''; markup that ends early is read as far as it goes; repeated page_ids give a row
each; a null url is a host of its own name ''; ties do not arise; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, parts, small_batches, written

#: Fixed values of HTML: elements without content, elements that begin a new block, and elements whose text is never shown as prose.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template iframe object canvas svg math button select option textarea title".split())
#: Elements, ARIA roles and words of class or id that mark what stands beside an article.
ASIDE = frozenset("nav menu aside footer form dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices banner popup modal newsletter subscribe share sharing social related recommended comment comments disqus replies login signup pagination pager".split())
#: The same outside an article only: inside one they hold its title.
OUTER_WORDS = frozenset("header masthead topbar".split())

_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("has_article", pa.bool_()), ("zones", pa.list_(pa.int8())), ("keys", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("content", pa.int64()), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("parents", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
_PAGE_DDL = "page_id long, url string, host string, has_article boolean, zones array<tinyint>, keys array<long>, texts array<string>, content long, tokens array<long>, counts array<int>, parents array<long>, sizes array<int>"
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Blocks(HTMLParser):
    """Blocks of a page: (zone, path, text); zone 2: in an article, 1: elsewhere, 0: beside the content or hidden."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int]] = []  #: tag, path, zone
        self.found: list[tuple[int, str, str]] = []
        self.paths: dict[str, int] = {}
        self.words: list[str] = []
        self.at = (1, "")
        self.has_article = False

    def _end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.found.append((*self.at, text))

    def _here(self) -> tuple[int, str]:
        return (self.open[-1][2], self.open[-1][1]) if self.open else (1, "")

    def _zone(self, tag: str, attrs: list, outer: int) -> int:
        if outer == 0 or tag in HIDDEN or tag in ASIDE:
            return 0
        given = {k: (v or "").lower() for k, v in attrs}
        names = set(re.split(r"[^a-z0-9]+", given.get("class", "") + " " + given.get("id", "")))
        if given.get("role") in ROLES or names & WORDS or "hidden" in given or given.get("aria-hidden") == "true":
            return 0
        if outer < 2 and tag not in ("body", "html") and (tag == "header" or names & OUTER_WORDS):
            return 0
        return 2 if tag in ("article", "main") or outer == 2 else 1

    def _close(self, i: int) -> None:
        if any(t in BLOCK for t, _, _ in self.open[i:]):
            self._end_block()
        del self.open[i:]
        if not self.words:
            self.at = self._here()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ())
            for i in range(len(self.open) - 1, -1, -1):
                t = self.open[i][0]
                if t == "p" or t in closes:
                    self._close(i)
                    break
                if t in BLOCK and t != "p":
                    break
            self._end_block()
            self.at = self._here()
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.words.append(" ")
            return
        zone, path = self._here()
        inner = self._zone(tag, attrs, zone)
        path = f"{path}/{tag}"
        self.has_article |= inner == 2
        self.paths[path] = self.paths.get(path, 0) + 1
        self.open.append((tag, path, inner))
        if tag in BLOCK:
            self.at = self._here()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in HIDDEN:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                below = self.open[i - 1][2] if i else 1
                if self.at[0] == 0 and below != 0:
                    self._end_block()
                self._close(i)
                return
            if self.open[i][0] in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                return

    def handle_data(self, data):
        here = self._here()
        if here[0] == 0 and self.at[0] and "".join(self.words).strip():
            return  # a script, a button or the like in the midst of a block
        if not self.words or here[0] == 0:
            self.at = here
        self.words.append(data)

    def finish(self) -> "Blocks":
        self.close()
        self._end_block()
        return self


def parsed(html: str | None) -> Blocks:
    p = Blocks()
    p.feed(html or "")
    return p.finish()


@frugal
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, "html"):
            rows = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                p = parsed(html)
                shown = [(z, f"{path}\n{text}", text) for z, path, text in p.found]
                tokens: dict[int, int] = {}
                around: dict[int, tuple[int, int]] = {}
                for path, n in p.paths.items():
                    tokens[h] = tokens.get(h := _hash(path), 0) + n
                    around[h] = (_hash(path.rpartition("/")[0]), 1)
                for z, path, text in p.found:
                    tokens[h] = tokens.get(h := _hash(f"{path}\n{text}"), 0) + 1
                    around[h] = (_hash(path), len(text.split()))
                shown = [x for x in shown if x[0]]
                content = _hash("\n\n".join(k for _, k, _ in shown))
                host = m[1].lower() if (m := _HOST.match(url or "")) else ""
                rows.append((page_id, url, host, p.has_article, [x[0] for x in shown], [_hash(x[1]) for x in shown], [x[2].encode("utf-8", "replace").decode() for x in shown], content, list(tokens), list(tokens.values()), *map(list, zip(*(around[h] for h in tokens)))) if tokens else (page_id, url, host, p.has_article, [], [], [], content, [], [], [], []))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE)], schema=_PAGE)


def valid_parts(tokens: list[dict], min_size: int) -> list[list[int]]:
    """The tokens of each valid part of a host's equivalence classes.

    tokens: token, parent, n (contents), total (occurrences), size, f1 and f2 of every frequent token of the host.
    """
    parent = {t["token"]: t["parent"] for t in tokens}
    classes: dict[tuple, list[dict]] = {}
    for t in tokens:
        if t["n"] == t["total"]:
            classes.setdefault((-t["n"], t["f1"], t["f2"]), []).append(t)
    valid: set[int] = set()
    out = []
    for key in sorted(classes):
        found: dict[int | None, list[dict]] = {}
        for t in classes[key]:
            slot = t["parent"]
            while slot in parent and slot not in valid:
                slot = parent[slot]
            found.setdefault(slot if slot in valid else None, []).append(t)
        new = [[t["token"] for t in part] for part in found.values() if sum(t["size"] for t in part) >= min_size]
        valid.update(t for part in new for t in part)
        out += new
    return out


def _judge(min_size: int):
    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts_of = [valid_parts(t, min_size) for t in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("n_pages"), pa.array([len(x) for x in parts_of], pa.int64()), pa.array([[t for part in x for t in part] for x in parts_of], pa.list_(pa.int64()))], names=["host", "n_pages", "classes", "valid"])

    return judge


def host_templates(pages: DataFrame, *, share: float = 0.6, min_pages: int = 4, min_size: int = 3) -> DataFrame:
    """host, n_pages (different contents), classes, valid: the tokens of the valid parts of its equivalence classes.

    pages: rows of parsed pages. classes counts the valid parts.
    """
    vector = [F.sum((F.xxhash64(F.lit(s), "content") * 1).cast("decimal(38,0)") * F.col("count")).alias(f"f{s}") for s in (1, 2)]
    # of the copies of a page, which may differ in what is beside the content, the least stands for all
    once = pages.groupBy("host", "content").agg(F.min(F.struct("tokens", "counts", "parents", "sizes")).alias("p"))
    each = once.select("host", "content", F.inline(F.arrays_zip(F.col("p.tokens").alias("token"), F.col("p.counts").alias("count"), F.col("p.parents").alias("parent"), F.col("p.sizes").alias("size"))))
    tokens = each.groupBy("host", "token").agg(F.count("*").alias("n"), F.sum("count").alias("total"), F.min("parent").alias("parent"), F.min("size").alias("size"), *vector)
    n_pages = written(pages.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n_pages")), "host-pages")
    often = written(tokens.filter(F.col("n") >= min_pages), "frequent-tokens").join(n_pages, "host").filter(F.col("n") >= share * F.col("n_pages"))
    token = F.struct("token", "parent", "n", "total", "size", F.col("f1").cast("string").alias("f1"), F.col("f2").cast("string").alias("f2"))
    hosts = often.groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.collect_list(token).alias("tokens"))
    return hosts.mapInArrow(_judge(min_size), "host string, n_pages long, classes long, valid array<long>")


def main_texts(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, text, n_chars, n_slots of every page."""
    small_batches(pages.sparkSession)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    seen = written(read.mapInArrow(_read, _PAGE_DDL), "pages")
    templates = written(host_templates(seen, **options), "host-templates")
    joined = seen.drop("content", "tokens", "counts", "parents", "sizes").join(templates.select("host", "valid"), "host", "left")
    slots = F.filter(F.arrays_zip("zones", "keys", "texts"), lambda b: (~F.col("has_article") | (b["zones"] == 2)) & (F.col("valid").isNull() | ~F.array_contains("valid", b["keys"])))
    text = F.array_join(F.col("slots.texts"), "\n\n")
    return joined.withColumn("slots", slots).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.size("slots").cast("long").alias("n_slots"))
