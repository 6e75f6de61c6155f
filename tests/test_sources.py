"""The readers on small fixtures."""

import zipfile

from tallyloom.sources import html, markdown, workbook

PAGE = """<p>before</p><table><tr><th>Code</th><th>Name<br>and more</th></tr><tr><td> </td><td></td></tr>
<tr><td>M-01</td><td>Cable &amp; tray <table><tr><td>inner</td></tr></table> end</td><td></td></tr><tr><td>never closed</table>
<table></table><TABLE><TR><TD>2 \n  x</TD></TR></TABLE><td>outside</td><table><tr><td>open"""


def test_table_cells(spark):
    want = [(1, 1, 1, "Code"), (1, 1, 2, "Name and more"), (1, 2, 1, "M-01"), (1, 2, 2, "Cable & tray inner end"), (1, 2, 3, ""), (2, 1, 1, "2 x")]
    assert html.table_cells(PAGE) == want
    assert html.table_cells(None) == html.table_cells("") == html.table_cells("<p>none</p>") == []
    pages = spark.createDataFrame([(1, PAGE, "c"), (2, None, "c"), (3, "", "c"), (None, "<table><tr><td>a</td></tr></table>", "c"), (1, PAGE, "c")], "page_id long, html string, cell string")
    got = [tuple(r) for r in html.html_table_cells(pages, "page_id", "html").collect()]
    assert sorted(got, key=str) == sorted([(1, *c) for c in want] * 2 + [(None, 1, 1, 1, "a")], key=str)
    assert html.html_table_cells(pages.limit(0), "page_id", "html").count() == 0


def book(path, sheets, strings=()):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        named = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k == 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    first = '<row r="2"><c r="B2" t="s"><v>0</v></c><c><v>2.5</v></c><c r="AA2" t="b"><v>1</v></c><c r="AB2"/></row><row r="5"><c r="A5" t="e"><f>B1/0</f><v>#DIV/0!</v></c></row><row r="300"><c><v>9</v></c></row>'
    second = '<row><c t="inlineStr"><is><t>in</t></is></c></row><row><c><f>[1]Data!A1</f><v>4</v></c></row>'
    (tmp_path / "in").mkdir()
    book(tmp_path / "in/a.xlsx", {"BOQ": first, "More": second}, ["<r><t>Ca</t></r><r><t>ble</t></r><rPh><t>no</t></rPh>"])
    book(tmp_path / "in/empty.xlsx", {"BOQ": ""})
    (tmp_path / "in/bad.xlsx").write_bytes(b"%PDF-1.7")
    (tmp_path / "in/none.xlsx").write_bytes(b"")
    rows = workbook.read_workbooks(spark, str(tmp_path / "in"), max_rows=100)
    got = {(r.sheet, r.row_number, r.column_number, r.kind, r.text, r.number, r.formula) for r in rows.where("kind <> 'unreadable'").collect()}
    assert got == {("BOQ", 2, 2, "text", "Cable", None, None), ("BOQ", 2, 3, "number", "2.5", 2.5, None), ("BOQ", 2, 27, "bool", "TRUE", None, None), ("BOQ", 5, 1, "error", "#DIV/0!", None, "B1/0"), ("More", 1, 1, "text", "in", None, None), ("More", 2, 1, "number", "4", 4.0, "[1]Data!A1")}
    assert sorted(r.workbook.rsplit("/", 1)[1] for r in rows.where("kind = 'unreadable'").collect()) == ["bad.xlsx"]
    assert {(r.sheet, r.n_rows, r.n_columns) for r in workbook.sheet_catalogue(rows).collect()} == {("BOQ", 5, 27), ("More", 2, 1)}
    assert {(r.sheet, r.issue, r.severity) for r in workbook.cell_issues(rows).collect()} == {("BOQ", "formula_error", "CRITICAL"), ("More", "external_link", "REVIEW")}
    assert {r.sheet for r in workbook.read_workbooks(spark, str(tmp_path / "in"), ["More"]).where("sheet is not null").collect()} == {"More"}
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in workbook.file_signatures(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a.xlsx": "zip", "empty.xlsx": "zip", "bad.xlsx": "pdf"}
    assert [workbook.column_number(x) for x in ("A1", "Z9", "AA2", "XFD1", "7")] == [1, 26, 27, 16384, 0]


def test_markdown_cells(spark):
    text = "intro | no table\n| a | b\\|c |\r\n|---|:-:|\n|1||\n\n| alone |\n|-|\nend\n  | x |\n| y"
    docs = spark.createDataFrame([(1, text, "t"), (2, None, "t"), (3, "", "t"), (4, "| - |\n| - |", "t"), (1, text, "t")], "id long, body string, t string")
    want = [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b|c"), (1, 1, 2, 1, "1"), (1, 1, 2, 2, ""), (1, 2, 1, 1, "x"), (1, 2, 2, 1, "y")]
    assert sorted(map(tuple, markdown.markdown_table_cells(docs, "id", "body").collect())) == sorted(want * 2)
    assert markdown.markdown_table_cells(docs.limit(0), "id", "body").count() == 0
