"""Large text files cut into parts, and workbooks."""

import datetime as dt
import io
import random
import zipfile

import pytest

from meridia.sources import layouts, readers


@pytest.fixture
def small_parts(spark):
    """Files are cut every 700 bytes."""
    for k, v in (("maxPartitionBytes", "700"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield spark
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1", "ascii"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_parts_number_lines_as_the_whole_file_does(small_parts, tmp_path, encoding, end):
    rng = random.Random(encoding + end)
    letters = {"ascii": "ab ", "latin-1": "ab é\x81", "cp1252": "ab é€"}.get(encoding, "ab é€𝒳")
    rows = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 30, 200, 1500]))) for _ in range(120)] + [letters]
    (tmp_path / "a.txt").write_bytes(end.join(rows).encode(encoding))
    (tmp_path / "b.txt").write_bytes(b"one\n\n\nfour\n")
    got = readers.split_lines(small_parts, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1
    found = {}
    for r in got.collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], r["line"], r["encoding"]))
    plain = {"utf-8-sig": "utf-8", "ascii": "utf-8"}.get(encoding, encoding)
    assert sorted(found["a.txt"]) == [(i, x, plain) for i, x in enumerate(rows)]
    assert sorted(found["b.txt"]) == [(0, "one", "utf-8"), (1, "", "utf-8"), (2, "", "utf-8"), (3, "four", "utf-8")]
    if encoding != "latin-1":  # there the byte 0x81 is another reader's line end of one character
        same = {(r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in readers.numbered_lines(small_parts, str(tmp_path)).collect()}
        assert same == {(f, n, x) for f, own in found.items() for n, x, _ in own}


def test_a_large_file_is_read_by_many_tasks(small_parts, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"{i:019d}" for i in range(2000)))
    got = readers.split_lines(small_parts, str(tmp_path / "a.txt"))
    scan = small_parts.read.text(str(tmp_path / "a.txt"))
    assert scan.rdd.getNumPartitions() >= 50 and got.filter("line_no = cast(line as int)").count() == 2000
    # they are lines like any other
    contract = layouts.Contract("n", (layouts.Field("head", 0, 10), layouts.Field("tail", 10, 19)), ("tail",), 19)
    assert readers.fixed_width(got, contract).filter("tail = '000001999'").first()["line_no"] == 1999


def test_two_byte_files_are_told(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes("x\ny".encode("utf-16"))
    with pytest.raises(Exception, match="two-byte"):
        readers.split_lines(spark, str(tmp_path)).collect()
    assert [r["line"] for r in readers.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["x", "y"]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/none.txt").write_bytes(b"")
    assert readers.split_lines(spark, str(tmp_path / "e")).count() == 0


def workbook(sheets, epoch1904=False):
    """The bytes of a workbook: sheets are name -> rows of str (shared), float, bool, dt.date, dt.datetime, ('inline', text) or None."""
    shared, parts = [], {}
    start = dt.datetime(1904, 1, 1) if epoch1904 else dt.datetime(1899, 12, 30)
    for i, rows in enumerate(sheets.values(), 1):
        out = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                ref = (chr(64 + c // 26) if c >= 26 else "") + chr(65 + c % 26) + str(r)
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, dt.date):
                    at = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
                    cells.append(f'<c r="{ref}" s="{2 if isinstance(v, dt.datetime) else 1}"><v>{(at - start).total_seconds() / 86400!r}</v></c>')
                elif isinstance(v, float):
                    cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                elif isinstance(v, tuple):
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v[1]}</t></is></c>')
                else:
                    shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            if cells:
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet xmlns='{NS}'><sheetData>{''.join(out)}</sheetData></worksheet>"
    rid = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f"<workbook xmlns='{NS}' xmlns:r='{rid}'><workbookPr date1904='{int(epoch1904)}'/><sheets>" + "".join(f"<sheet name='{n}' sheetId='{i}' r:id='rId{i}'/>" for i, n in enumerate(sheets, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='rId{i}' Target='worksheets/sheet{i}.xml'/>" for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst xmlns='{NS}'>" + "".join(f"<si><r><t>{s[: len(s) // 2]}</t></r><r><t>{s[len(s) // 2 :]}</t></r></si>" if i % 2 else f"<si><t>{s}</t></si>" for i, s in enumerate(shared)) + "</sst>"
    parts["xl/styles.xml"] = f"<styleSheet xmlns='{NS}'><numFmts><numFmt numFmtId='164' formatCode='yyyy\\-mm\\-dd hh:mm'/><numFmt numFmtId='165' formatCode='0.00\"d\"'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/><xf numFmtId='165'/></cellXfs></styleSheet>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, "<?xml version='1.0' encoding='UTF-8'?>" + text)
    return held.getvalue()


NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SHEETS = {
    "notes": [["About this file"]],
    "rates": [["Title", None], [], ["HCPCS", "Rate", "From", "Read", "Open", *[None] * 22, "Far"], ["99213", 1.5, dt.date(2025, 1, 1), dt.datetime(2025, 3, 4, 5, 6, 7), True, *[None] * 22, ("inline", "AB é")], ["0001", 12.0, dt.date(1999, 12, 31), None, False]],
}


@pytest.mark.parametrize("epoch1904", [False, True])
def test_a_workbook_gives_the_rows_of_its_twin(spark, tmp_path, epoch1904):
    (tmp_path / "w.xlsx").write_bytes(workbook(SHEETS, epoch1904))
    rows = {(r["member"], r["line_no"]): r["cells"] for r in readers.excel_rows(spark, str(tmp_path), batch_rows=2).collect()}
    assert set(rows) == {("notes", 0), ("rates", 0), ("rates", 2), ("rates", 3), ("rates", 4)}
    assert rows["rates", 3] == ["99213", "1.5", "2025-01-01", "2025-03-04 05:06:07", "TRUE", *[None] * 22, "AB é"] and rows["rates", 4] == ["0001", "12", "1999-12-31", None, "FALSE"]
    only = readers.excel_rows(spark, str(tmp_path), "rates")
    assert {r["member"] for r in only.collect()} == {"rates"} and readers.excel_rows(spark, str(tmp_path), "none").count() == 0
    data = readers.data_sheet(readers.excel_rows(spark, str(tmp_path)), ("hcpcs", "rate")).orderBy("line_no").collect()
    assert [r["cells"][0] for r in data] == ["HCPCS", "99213", "0001"]
