import zipfile

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import ingest
from ticketflow.sources import cells, sniff


def written(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def xlsx(path, rows):
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def rows_of(spark, path):
    return [(r.line_no, r.cells) for r in cells.read_cells(spark, path).orderBy("line_no").collect()]


def test_csv(spark, tmp_path):
    p = written(tmp_path, "a.csv", '﻿external_ref,customer_email,subject\nTCK-1,a@x.com,"Bon, jour"\n\nTCK-2,b@x.com\n')
    assert rows_of(spark, p) == [(1, ["external_ref", "customer_email", "subject"]), (2, ["TCK-1", "a@x.com", "Bon, jour"]), (3, [""]), (4, ["TCK-2", "b@x.com"])]
    rows = ingest.with_headers(cells.read_cells(spark, p))
    assert [tuple(r) for r in ingest.row_errors(rows).orderBy("line_no").collect()] == [(3, "Nombre de colonnes incoherent (attendu 3, obtenu 1)"), (4, "Nombre de colonnes incoherent (attendu 3, obtenu 2)")]
    assert tuple(ingest.preview(rows).first()) == (3, 2, 3)


def test_txt_keeps_trailing_cells(spark, tmp_path):
    assert rows_of(spark, written(tmp_path, "a.txt", "a\tb\n\nx\t\n")) == [(1, ["a", "b"]), (3, ["x", ""])]


def test_csv_blank_lines_and_backslashes(spark, tmp_path):
    p = written(tmp_path, "a.csv", 'a,b\n"x \\"y\\" z",2\n\n"q ""r""",3\n')
    assert rows_of(spark, p) == [(1, ["a", "b"]), (2, ['x "y" z', "2"]), (3, [""]), (4, ['q "r"', "3"])]
    rows = ingest.with_headers(cells.read_cells(spark, p))
    assert [(r.line_no, r.message) for r in ingest.preview_errors(rows).collect()] == [(3, "Nombre de colonnes incoherent (attendu 2, obtenu 1)")]
    assert [r.line_no for r in ingest.preview_rows(rows).collect()] == [2, 3, 4]


def test_json_projects_on_first_keys(spark, tmp_path):
    p = written(tmp_path, "a.json", '[{"ref":"1","n":2,"o":{"d":1}}, {"n":null,"extra":5}]')
    assert rows_of(spark, p) == [(0, ["ref", "n", "o"]), (1, ["1", "2", '{"d":1}']), (2, ["", "", ""])]


def test_xlsx(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx", [["ref", "email", "subject"], ["T-1", None, " Hi "]])
    assert rows_of(spark, str(tmp_path / "a.xlsx")) == [(1, ["ref", "email", "subject"]), (2, ["T-1", "", "Hi"])]


def test_unsupported(spark, tmp_path):
    with pytest.raises(sniff.UnsupportedType):
        cells.read_cells(spark, written(tmp_path, "a.pdf", b"%PDF-1.7"))


@pytest.mark.parametrize(
    ("name", "data", "kind", "charset"),
    [
        ("a.csv", b"\xef\xbb\xbfa", "CSV", "UTF-8"), ("a.csv", b"\xff\xfea\0", "CSV", "UTF-16LE"), ("a.csv", b"\xfe\xff\0a", "CSV", "UTF-16BE"), ("a.tsv", "é".encode(), "TXT", "UTF-8"),
        ("a.CSV", b"caf\xe9", "CSV", "ISO-8859-1"), ("a.csv", b"PK\x03\x04", "XLSX", None), ("a.docx", b"PK\x03\x04", "DOCX", None), ("a.x", b"%PDF", "PDF", None), ("a.x", b"abc", None, None),
    ],
)
def test_sniff(spark, name, data, kind, charset):
    r = spark.createDataFrame([(name, bytearray(data))], "name string, head binary").select(sniff.file_type(F.col("name"), F.col("head")), sniff.charset(F.col("head"))).first()
    assert r[0] == kind
    assert charset is None or r[1] == charset


def test_confirm(spark, tmp_path):
    p = written(tmp_path, "a.csv", "ref,email,subject,lang\nA-1,a@x.com,Bonjour,FR\nA-2,b@x.com,Hello,en\nA-1,c@x.com,Again,de\n,d@x.com,None,\n,e@x.com,None,\nA-9,f@x.com,Old,fr\n")
    rows = ingest.with_headers(cells.read_cells(spark, p))
    existing = spark.createDataFrame([(7, "A-9")], "id long, external_ref string")
    inserted, events = ingest.confirm(rows, {"externalRef": "ref", "customerEmail": "email", "subject": "subject", "language": "lang", "bogus": "x"}, existing)
    got = [(r.id, r.external_ref, r.subject, r.language, r.status, r.source) for r in inserted.orderBy("id").collect()]
    assert got == [(8, "A-1", "Bonjour", "fr", "NEW", "FILE"), (9, "A-2", "Hello", "en", "NEW", "FILE"), (10, None, "None", None, "NEW", "FILE"), (11, None, "None", None, "NEW", "FILE")]
    assert inserted.where("created_at is null").count() == 0 and events.count() == 4
    with pytest.raises(ingest.MappingInvalid):
        ingest.confirm(rows, {"externalRef": "ref"}, existing)
    with pytest.raises(ingest.ImportState):
        ingest.confirm(rows, {"subject": "subject"}, existing, status="DONE")


def test_auto_map():
    assert ingest.auto_map(["Ref", "EMAIL", "sujet", "zzz"]) == {"externalRef": "Ref", "customerEmail": "EMAIL", "subject": "sujet"}
