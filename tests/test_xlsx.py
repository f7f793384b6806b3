import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest

from ticketflow.sources import xlsx

PARTS = {
    "xl/workbook.xml": '<workbook xmlns:r="x"><workbookPr/><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet9.xml"/></Relationships>',
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>",
}


def book(sheet, **parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (PARTS | {"xl/worksheets/sheet9.xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>"} | {f"xl/{k}.xml": v for k, v in parts.items()}).items():
            z.writestr(name, text)
    return held.getvalue()


@pytest.mark.parametrize(
    ("x", "code", "text"),
    [
        (1234567.891, "#,##0.00", "1,234,567.89"), (0, "#,##0", "0"), (5, "0000", "0005"), (1000, "?,???", "1,000"), (0.995, "0.00", "1.00"), (2.5, "0", "3"), (-3.14159, "0.00", "-3.14"),
        (0.5, "0%", "50%"), (0.12345, "0.00%", "12.35%"), (1.0, "0.##", "1"), (0.5, "#.##", ".5"), (1500000, '0.0,,"M"', "1.5M"), (5551234, "000-0000", "555-1234"), (12345, "#\\ ##0", "12 345"),
        (-1234, "#,##0_);(#,##0)", "(1,234)"), (1234, "#,##0_);[Red](#,##0)", "1,234"), (0, '0;-0;"nil"', "nil"), (7, '[<10]"few";0', "few"), (12, '[<10]"few";0', "12"), (3, "[$€-40C] 0.00", "€ 3.00"),
        (12345, "0.00E+00", "1.23E+04"), (99999, "0.0E+00", "1.0E+05"), (12345678, "##0.0E+0", "12.3E+6"), (0.00012, "0.0E+00", "1.2E-04"), (0, "0.00E+00", "0.00E+00"),
        (3.25, "# ?/?", "3 1/4"), (0.333, "# ??/??", "1/3"), (2.0, "# ?/?", "2"), (1.5, "?/2", "3/2"), (1e12, "", "1E+12"), (1e-11, "", "1E-11"), (0.1 + 0.2, "", "0.3"), (123456789.123456, "", "123456789.1"),
        (12345678901.5, "", "12345678902"), (-5, "General", "-5"), (-5, '"x"General', "-x5"), (5, "@", "5"), (1e300, "#,##0", "1" + ",000" * 100),
        (45292.5, "m/d/yy h:mm", "1/1/24 12:00"), (45292.25, "yyyy\\-mm\\-dd hh:mm:ss", "2024-01-01 06:00:00"), (1.5, "[h]:mm:ss", "36:00:00"), (0.0005, "mm:ss.0", "00:43.2"), (45292, "dddd d mmmm yyyy", "Monday 1 January 2024"),
        (45292.75, "h:mm AM/PM", "6:00 PM"), (45292, "mmm-yy", "Jan-24"), (1, "yyyy-mm-dd", "1900-01-01"), (61, "yyyy-mm-dd", "1900-03-01"), (-0.5, "h:mm", "-0.5"), (3e6, "d/m/yyyy", "3000000"),
    ],
)
def test_numbers_in_formats(x, code, text):
    assert xlsx.shown(float(x), code) == text


def test_numbers_and_days_equal_python():
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randrange(-(10**9), 10**9)
        assert xlsx.shown(n / 100, "#,##0.00") == f"{n / 100:,.2f}" and xlsx.shown(float(n), "0") == str(n) and xlsx.shown(n / 7, "") == f"{n / 7:.10g}"
        at = datetime(1900, 3, 1) + timedelta(seconds=rng.randrange(8000 * 366 * 86_400) // 10)
        serial = (at - datetime(1899, 12, 30)).total_seconds() / 86_400
        assert xlsx.shown(serial, "dd/mm/yyyy hh:mm:ss") == at.strftime("%d/%m/") + f"{at.year} " + at.strftime("%H:%M:%S")
        assert at.year < 1904 or xlsx.shown(serial - 1462, "yyyy-mm-dd", since_1904=True) == f"{at.year}" + at.strftime("-%m-%d")


def test_cells_of_all_kinds_in_the_first_sheet_of_the_workbook():
    strings = '<sst><si><t xml:space="preserve"> a&amp;b </t></si><si><r><t>x</t></r><r><t>_x000D_y_x005F_x0041_</t></r><rPh sb="0"><t>said</t></rPh></si><si/></sst>'
    styles = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    sheet = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c t="s"><v>2</v></c><c t="s"><v>9</v></c></row><row r="7"/>'
        '<row r="9"><c s="1"><v>45292</v></c><c s="2"><v>1.5</v></c><c s="7"><v>1.5</v></c><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="e"><v>#DIV/0!</v></c><c t="inlineStr"><is><t> in </t></is></c>'
        '<c t="str"><f>A1&amp;B1</f><v>ab</v></c><c s="2"><f t="shared" si="0"/><v>2</v></c><c s="1"/></row>'
    )
    assert list(xlsx.rows(book(sheet, sharedStrings=strings, styles=styles))) == [
        (1, ["a&b", "", "x\ry_x0041_", "", ""]),
        (2, []),
        (3, ["1/1/24", "1.500", "1.5", "TRUE", "FALSE", "#DIV/0!", "in", "A1&B1", "2.000", ""]),
    ]


def test_odd_files():
    assert list(xlsx.rows(book(""))) == []
    assert list(xlsx.rows(book('<row><c s="1"><v>3</v></c></row>'))) == [(1, ["3"])]
    early = book('<row><c s="0"><v>0</v></c></row>', workbook=PARTS["xl/workbook.xml"].replace("<workbookPr/>", '<workbookPr date1904="1"/>'), styles='<styleSheet><cellXfs><xf numFmtId="14"/></cellXfs></styleSheet>')
    assert list(xlsx.rows(early)) == [(1, ["1/1/04"])]


def test_signs_that_xml_cannot_hold_come_back():
    text = "".join(map(chr, range(1, 300))) + "_x0041_ __x0009__x0009_ <&>"
    assert list(xlsx.rows(book(f'<row><c t="inlineStr"><is><t xml:space="preserve">|{xlsx.escaped(text)}|</t></is></c></row>'))) == [(1, [f"|{text}|"])]


def test_large_sheets_are_read_row_by_row(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(xlsx, "IN_MEMORY", 1 << 10)
    n, word = 20_000, "w" * 300
    strings = "<sst>" + "".join(f"<si><t>{i}{word}</t></si>" for i in range(n)) + "</sst>"
    data = book("".join(f'<row><c t="s"><v>{n - 1 - i}</v></c><c><v>{i}</v></c></row>' for i in range(n)), sharedStrings=strings)
    del strings
    tracemalloc.start()
    seen = 0
    for at, (line, (text, number)) in enumerate(xlsx.rows(data)):
        assert line == at + 1 and text == f"{n - 1 - at}{word}" and number == str(at)
        seen += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 6 MB of strings; what is held is their ends and a chunk
    assert seen == n and most < 2 << 20
