"""Readers: every column has a declared type and no type is inferred. Lines keep their number, since order can matter."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, number
from .layouts import ROUTES, Contract

_LINES = "path string, member string, line_no long, line string"


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def decoded(content: bytes) -> tuple[str, str]:
    """(text, encoding): a byte-order mark decides; else UTF-8, else CP1252, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name
    for name in ("utf-8", "cp1252"):
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1"), "latin-1"


def _members(path: str, content: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    if not zipfile.is_zipfile(io.BytesIO(content)):
        yield "", content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist():
            if not name.endswith("/") and re.search(pattern, name, re.IGNORECASE):
                yield name, archive.read(name)


def _to_lines(pattern: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for member, data in _members(path, content, pattern):
                    lines = decoded(data)[0].splitlines()
                    for at in range(0, len(lines), 50_000):
                        own = lines[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(own)), pa.array([member] * len(own)), pa.array(range(at, at + len(own)), pa.int64()), pa.array(own, pa.string())], names=["path", "member", "line_no", "line"])

    return read


def numbered_lines(spark: SparkSession, path: str, member_pattern: str = "") -> DataFrame:
    """path, member, line_no, line of text files and of text members of ZIP archives, in any of the known encodings.

    A file is read by one task (its encoding and archive need the whole file); many files are read in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_to_lines(member_pattern), _LINES)


_RAW = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("utf8", pa.string()), ("cp1252", pa.string()), ("latin1", pa.string()), ("wide", pa.bool_())])


def _one_byte(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines numbered inside their part of a file, in all encodings they could have; of plain ASCII lines only the first."""
    at, n = None, 0
    for batch in batches:
        paths, blocks, raws = (batch.column(c).to_pylist() for c in ("path", "block", "raw"))
        rows = []
        for path, block, raw in zip(paths, blocks, raws):
            n = n + 1 if at == (path, block) else 0
            at = (path, block)
            wide = block == 0 and n == 0 and raw[:2] in (b"\xff\xfe", b"\xfe\xff")
            if raw.isascii():
                rows.append((path, block, n, raw.decode("ascii"), None, None, wide))
            else:
                rows.append((path, block, n, _one_byte(raw, "utf-8"), _one_byte(raw, "cp1252"), raw.decode("latin-1"), wide))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_RAW), _RAW)], schema=_RAW)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, member (''), line_no, line, encoding of plain text files that many tasks read, however large a file is.

    A file is cut into parts at line ends (LF, CR LF or CR). Lines are numbered inside their part; the parts' line counts
    (a row for each) add up to what comes before each. UTF-8 holds for a file if all its lines are valid, else CP1252, else
    Latin-1. Line ends of two-byte encodings are no bytes of their own: such a file is an error here and one for
    numbered_lines, as archives are. A byte-order mark of UTF-8 is dropped.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    lines = raw.mapInArrow(_in_blocks, "path string, block long, n long, utf8 string, cp1252 string, latin1 string, wide boolean")
    odd = F.col("latin1").isNotNull()
    parts = lines.groupBy("path", "block").agg((F.max("n") + 1).alias("n"), F.bool_and(F.col("utf8").isNotNull()).alias("u"), F.bool_and(~odd | F.col("cp1252").isNotNull()).alias("c"), F.bool_or("wide").alias("w"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    encoding = F.when(F.bool_and("u").over(whole), "utf-8").when(F.bool_and("c").over(whole), "cp1252").otherwise("latin-1")
    named = F.when(F.bool_or("w").over(whole), F.raise_error(F.concat(F.lit("two-byte encoding, use numbered_lines: "), "path"))).otherwise(encoding)
    told = parts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"), named.alias("encoding"))
    joined = lines.join(told, ["path", "block"], "left")
    # both passes cut the files alike unless the cluster's size changed between them: then a part has no count
    before = F.when(F.col("_before").isNull(), F.raise_error(F.lit("files were cut in another way; read them again"))).otherwise(F.col("_before"))
    text = F.when(~odd, F.col("utf8")).when(F.col("encoding") == "utf-8", F.col("utf8")).when(F.col("encoding") == "cp1252", F.col("cp1252")).otherwise(F.col("latin1"))
    return joined.select("path", F.lit("").alias("member"), (before + F.col("n")).alias("line_no"), text.alias("line"), "encoding")


def fixed_width(lines: DataFrame, contract: Contract, *, line: str = "line", skip_prefix: str = "HDR") -> DataFrame:
    """Slice lines by the contract; headers, blank and short lines go. Empty fields are null, bad numbers too."""
    kept = lines.filter((F.length(line) >= contract.min_length) & ~F.col(line).startswith(skip_prefix))
    return kept.select(*[c for c in lines.columns if c != line], *[_typed(F.substring(line, f.start + 1, f.end - f.start), f.kind).alias(f.name) for f in contract.fields])


def _typed(c: Column, kind: str) -> Column:
    text = blank_to_null(c)
    if kind == "double":
        return number(text)
    return F.try_to_date(text, "yyyy-MM-dd") if kind == "date" else text


def delimited(lines: DataFrame, contract: Contract, *, separator: str = ",", aliases: dict[str, str] | None = None, header_words: tuple[str, ...] = (), search_lines: int = 15, defaults: dict[str, object] | None = None, no_header: str = "drop") -> DataFrame:
    """Delimited lines whose header stands somewhere in the first lines (the first that holds all header_words).

    Columns are found by their normalised header names, per file, however many there are; quoted fields may hold the
    separator. Missing columns are null or have their default. Files without such a header give no rows; with
    no_header="reject" one row each, whose reject_reason says so (null for all other rows).
    """
    heads, _ = _headers(lines, header_words, search_lines)
    names = F.transform(_cells("_header", separator), lambda h: normalised_name(h, aliases or {}))
    body = lines.join(heads.withColumn("_names", names), ["path", "member"]).filter((F.col("line_no") > F.col("_at")) & (F.trim("line") != ""))
    body = body.withColumn("_cells", _cells("line", separator))
    pick = lambda f: F.get("_cells", F.nullif(F.array_position("_names", f.name), F.lit(0)).cast("int") - 1)
    filled = lambda f: F.when(F.array_contains("_names", f.name), _typed(pick(f), f.kind)).otherwise(F.lit((defaults or {}).get(f.name)))
    out = body.select("path", "member", "line_no", *[filled(f).alias(f.name) for f in contract.fields])
    if no_header != "reject":
        return out
    lost = headerless(lines, header_words, search_lines).select("path", "member", F.lit(None).cast("long").alias("line_no"), *[F.lit(None).cast(out.schema[f.name].dataType).alias(f.name) for f in contract.fields], F.lit("no header in the first lines").alias("reject_reason"))
    return out.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(lost)


def _cells(c: str, separator: str) -> Column:
    """The fields of a delimited line, unquoted; a separator inside double quotes does not count."""
    s = re.escape(separator)
    fields = F.regexp_extract_all(F.concat(F.lit(separator), F.col(c)), F.lit(rf'{s}("(?:[^"]|"")*"|[^{s}]*)' if len(separator) == 1 else rf'{s}("(?:[^"]|"")*"|(?:(?!{s}).)*)'), 1)
    return F.transform(fields, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _headers(lines: DataFrame, header_words: tuple[str, ...], search_lines: int) -> tuple[DataFrame, Column]:
    low = F.lower("line")
    is_header = (F.col("line_no") < search_lines) & reduce(lambda a, b: a & b, [low.contains(w) for w in header_words], F.lit(True))
    return lines.filter(is_header).groupBy("path", "member").agg(F.min_by("line", "line_no").alias("_header"), F.min("line_no").alias("_at")), is_header


def headerless(lines: DataFrame, header_words: tuple[str, ...], search_lines: int = 15) -> DataFrame:
    """path, member of the files that have no header among their first lines."""
    heads, _ = _headers(lines, header_words, search_lines)
    return lines.filter(F.col("line_no") < search_lines).select("path", "member").distinct().join(heads, ["path", "member"], "left_anti")


def data_sheet(rows: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Of excel_rows the rows of each file's data sheet: the first sheet with a row that holds all the words, from that row on."""
    joined = F.lower(F.array_join(F.col("cells"), " ", ""))
    hit = reduce(lambda a, b: a & b, [joined.contains(w) for w in words], F.lit(True))
    heads = rows.filter(hit).groupBy("path").agg(F.min(F.struct("member", "line_no")).alias("_h"))
    return rows.join(heads, "path").filter((F.col("member") == F.col("_h.member")) & (F.col("line_no") >= F.col("_h.line_no"))).drop("_h")


def normalised_name(c: Column, aliases: dict[str, str]) -> Column:
    """A header as a column name: no byte-order mark, no-break spaces or double spaces, lower case, then aliases."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "[\\ufeff\"]", ""), "[\\s\\u00a0]+", " "))), " ", "_")
    return F.coalesce(*[F.when(plain == a, F.lit(b)) for a, b in aliases.items()], plain)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold one object, a list, or {"data": [...]}: each record a row of the schema."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", F.lit(f"struct<data: array<struct<{schema}>>>"))["data"]
    listed = F.from_json("value", F.lit(f"array<struct<{schema}>>"))
    return text.select(F.inline(F.when(wrapped.isNotNull(), wrapped).otherwise(listed)))


def excel_rows(spark: SparkSession, path: str, sheet: str | None = None, *, batch_rows: int = 10_000) -> DataFrame:
    """path, member (sheet), line_no, cells of Excel workbooks; sheet: only the one of that name (others are not opened).

    Workbooks without the sheet have no rows. A workbook is read by one task, row by row (see workbooks).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .workbooks import Workbook

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                book = Workbook(content)
                for own in [s for s in book.sheets if sheet in (None, s)]:
                    rows = book.rows(own)
                    while part := list(itertools.islice(rows, batch_rows)):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([own] * len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([c for _, c in part], pa.list_(pa.string()))], names=["path", "member", "line_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, member string, line_no long, cells array<string>")


def looks_fixed_width(name: Column, first_line: Column) -> Column:
    return F.lower(name).endswith(".txt") & ~first_line.rlike("[,\\t|]")


def routed(name: Column) -> Column:
    """The data set of a file name, or null: archive suffixes are taken off and patterns tried in order."""
    plain = F.lower(F.regexp_replace(name, "(?i)\\.(gz|gzip|bz2|zip)$", ""))
    return F.coalesce(*[F.when(plain.rlike(f"^(?:{p})"), F.lit(d)) for d, p in ROUTES])


def addendum(lines: DataFrame, which: str) -> DataFrame:
    """Rows of addendum a or b from delimited lines, by their header names; the columns of the contract are there even for no rows."""
    from .layouts import ADDENDUM_A, ADDENDUM_B, ADDENDUM_NAMES

    contract, word = (ADDENDUM_A, "apc") if which == "a" else (ADDENDUM_B, "hcpcs")
    return delimited(lines, contract, aliases=ADDENDUM_NAMES, header_words=(word,))


def routing_coverage(names: DataFrame, name: str) -> DataFrame:
    """Files, files with a data set, and their share; and how many files each data set has, as a map."""
    to = names.select(routed(F.col(name)).alias("dataset"))
    by = to.groupBy("dataset").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("n_files"), F.coalesce(F.sum(F.when(F.col("dataset").isNotNull(), F.col("n"))), F.lit(0)).alias("n_routed"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dataset").isNotNull(), F.struct("dataset", "n"))))).alias("by_dataset")).withColumn("share", F.coalesce(F.try_divide("n_routed", "n_files"), F.lit(0.0)))


def zip9_ranges(lines: DataFrame, contract: Contract) -> DataFrame:
    """Single-code ranges of the ZIP9 file: flagged lines with a real +4."""
    rows = fixed_width(lines, contract)
    code = F.concat("zip5", "plus4")
    return rows.filter((F.col("plus4_flag") == "1") & F.col("plus4").isNotNull() & (F.col("plus4") != "0000")).select(code.alias("zip9_low"), code.alias("zip9_high"), "state", "locality", "carrier", "rural_flag")


def links(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """id, position and target of every link of HTML pages."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)).alias("position", "href"))
