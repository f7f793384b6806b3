"""The registered queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, security, text, vectors
from ..operators import evaluation, generation, imports, ingest, linear, ranking, reports, similar, sinks, tickets, vector_index
from ..schemas import CATEGORIES, IMPORTS, PRIORITIES, SENTIMENTS, violations
from ..shared import shared_folder
from ..sources import cells, csv_scan, json_scan, jsonl, sniff, xlsx
from ..streaming import bucket, consumer
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
EXCERPT = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
SUMMARY = f"""SELECT id, external_ref, source, customer_email, subject, CASE WHEN length({EXCERPT.format('body')}) > 160 THEN substr({EXCERPT.format('body')}, 1, 160) || '…' ELSE {EXCERPT.format('body')} END AS excerpt, language, status, created_at FROM """


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- ticket list -------------------------------------------------------------------------


@query(f"WITH {views.TICKETS} {SUMMARY} (SELECT * FROM tickets ORDER BY created_at DESC NULLS FIRST, id LIMIT 20)")
def ticket_list_default(s, d):
    return tickets.search(views.tickets(s, d))


@query(f"WITH {views.TICKETS} {SUMMARY} (SELECT * FROM tickets WHERE status = 'NEW' AND source = 'WEBHOOK' AND language = 'fr' ORDER BY id LIMIT 50)")
def ticket_list_filtered(s, d):
    return tickets.search(views.tickets(s, d), status=" new ", source="webhook", language="FR", sort="id", direction="ASC", size=50)


@query("SELECT doc_id AS id, length(text)::BIGINT AS n FROM documents WHERE lower(split_part(text, chr(10), 1)) LIKE '%tion%' OR lower(text) LIKE '%tion%'")
def ticket_search_contains(s, d):
    return tickets.filtered(views.letters(s, d), q="Tion").select("id", F.length("body").cast("long").alias("n"))


@query("SELECT doc_id AS id FROM documents WHERE lower(split_part(text, chr(10), 1)) LIKE '%th_n%the%' OR lower(text) LIKE '%th_n%the%'")
def ticket_search_wildcard(s, d):
    return tickets.filtered(views.letters(s, d), q="th_n%the").select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), '***')")
def ticket_search_literal(s, d):
    b = views.letters(s, d)
    return b.where(tickets.contains("100%", "body", literal=True) | tickets.contains("***", "body", literal=True)).select("id")


@query(f"WITH {views.TICKETS} SELECT 2 AS page, 100 AS size, count(*) AS total_elements, ceil(count(*) / 100.0)::BIGINT AS total_pages, 3 >= ceil(count(*) / 100.0) AS last FROM tickets WHERE status = 'RESOLVED'")
def ticket_page_envelope(s, d):
    return tickets.envelope(views.tickets(s, d), page=2, size=500, status="RESOLVED")


@query(f"WITH {views.TICKETS} {SUMMARY} (SELECT * FROM tickets ORDER BY language ASC NULLS LAST, id LIMIT 100 OFFSET 100)")
def ticket_sort_nulls_asc(s, d):
    return tickets.search(views.tickets(s, d), page=1, size=100, sort="language", direction="asc")


@query(f"WITH {views.TICKETS} {SUMMARY} (SELECT * FROM tickets ORDER BY language DESC NULLS FIRST, id LIMIT 100)")
def ticket_sort_nulls_desc(s, d):
    return tickets.search(views.tickets(s, d), size=100, sort="language", direction="desc")


@query(f"SELECT doc_id AS id, CASE WHEN length({EXCERPT.format('text')}) > 160 THEN substr({EXCERPT.format('text')}, 1, 160) || '…' ELSE {EXCERPT.format('text')} END AS excerpt FROM documents")
def excerpt_projection(s, d):
    return views.letters(s, d).select("id", text.excerpt(F.col("body")).alias("excerpt"))


@query(f"WITH {views.TICKETS}, t AS (SELECT *, md5(id::VARCHAR) AS h FROM tickets), a AS (SELECT id, CASE WHEN substr(h, 1, 1) < '8' THEN 'HIGH' ELSE 'LOW' END AS priority FROM t WHERE id % 7 <> 0) SELECT t.id, a.priority FROM t LEFT JOIN a ON t.id = a.id WHERE a.priority = 'HIGH' AND t.status = 'NEW'")
def ticket_filter_by_priority(s, d):
    t, a = views.tickets(s, d), views.analyses(s, d)
    found = tickets.filtered(t, a, priority=" high ", status="NEW")
    return tickets.with_analyses(found, a).select("id", "priority")


@query(f"""WITH {views.TICKETS}, {views.ANALYSES} SELECT t.id, category, sentiment FROM tickets t JOIN analyses a ON a.ticket_id = t.id
WHERE category = 'FACTURATION' AND sentiment = 'NEG' AND language = 'fr'""")
def ticket_filter_by_analysis(s, d):
    t, a = views.tickets(s, d), views.analyses(s, d)
    found = tickets.filtered(t, a, category="facturation", sentiment="neg", language="fr")
    return tickets.with_analyses(found, a).select("id", "category", "sentiment")


@query(f"WITH {views.TICKETS}, {views.ANALYSES} SELECT id, category, priority, sentiment FROM tickets LEFT JOIN analyses ON ticket_id = id")
def tickets_with_analyses(s, d):
    return tickets.with_analyses(views.tickets(s, d), views.analyses(s, d)).select("id", "category", "priority", "sentiment")


@query("SELECT event_id AS id FROM events WHERE event_id = 42 AND event_type IS NOT NULL")
def ticket_lookup(s, d):
    return views.tickets(s, d).where(F.col("id") == 42).select("id")


# --- ingestion ---------------------------------------------------------------------------

HEADERS = ("ref", "email", "subject", "lang", "subject", "at")
MAPPING = {"externalRef": "ref", "customerEmail": " email ", "subject": "subject", "body": "nowhere", "language": "lang", "createdAt": "at"}


def _rows(s, d):
    e = views.table(s, d, "events")
    at = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, "nope")
    full = F.array(F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit("\t")), F.lit("  "), "event_type", F.when(F.col("event_id") % 2 == 0, "FR").otherwise("de"), "props", F.coalesce(at, F.lit("")))
    return e.select((F.col("event_id") + 2).cast("int").alias("line_no"), F.array(*map(F.lit, HEADERS)).alias("headers"), F.when(F.col("event_id") % 10 == 0, F.slice(full, 1, 3)).otherwise(full).alias("cells"))


@query("""SELECT (event_id + 2)::INTEGER AS line_no, 'U' || user_id AS external_ref, 'FILE' AS source, NULL::VARCHAR AS customer_email, event_type AS subject, NULL::VARCHAR AS body,
  'NEW' AS status, CASE WHEN event_id % 10 <> 0 AND event_id % 2 = 0 THEN 'fr' END AS language, CASE WHEN event_id % 10 <> 0 AND event_id % 4 = 0 THEN date_trunc('second', ts) END AS created_at FROM events""")
def ingest_map_project(s, d):
    found = ingest.project(_rows(s, d), ingest.sanitise(MAPPING))
    return found.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("SELECT (event_id + 2)::INTEGER AS line_no, 'Nombre de colonnes incoherent (attendu 6, obtenu 3)' AS message FROM events WHERE event_id % 10 = 0")
def ingest_row_errors(s, d):
    return ingest.row_errors(_rows(s, d))


@query("SELECT count(*) AS total_rows, least(count(*) FILTER (event_id % 10 = 0), 100) AS error_count, least(count(*), 50) AS preview_rows FROM events")
def ingest_preview(s, d):
    return ingest.preview(_rows(s, d))


@query("SELECT (event_id + 2)::INTEGER AS line_no, CASE WHEN event_id % 10 = 0 THEN 3 ELSE 6 END::INTEGER AS n_cells FROM events ORDER BY event_id LIMIT 50")
def ingest_preview_rows(s, d):
    return ingest.preview_rows(_rows(s, d)).select("line_no", F.size("cells").alias("n_cells"))


@query("SELECT (event_id + 2)::INTEGER AS line_no, 'Nombre de colonnes incoherent (attendu 6, obtenu 3)' AS message FROM events WHERE event_id % 10 = 0 ORDER BY event_id LIMIT 100")
def ingest_preview_errors(s, d):
    return ingest.preview_errors(_rows(s, d))


@query("SELECT row_number() OVER (ORDER BY n_name) AS id, n_name || '.csv' AS filename, 'CSV' AS file_type, 2::INTEGER AS row_count, CASE WHEN row_number() OVER (ORDER BY n_name) = 3 THEN 'DONE' ELSE 'AWAITING_VALIDATION' END AS status FROM nation")
def import_states(s, d):
    """A file a nation is uploaded, and the third import confirmed."""
    files = views.table(s, d, "nation").select(F.concat(F.lit("in/"), "n_name", F.lit(".csv")).alias("path"), F.lit("CSV").alias("type"))
    rows = files.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("line_no"))
    done = ingest.settled(ingest.uploaded(rows, files, s.createDataFrame([], IMPORTS)), 3, {"subject": "s"})
    return done.select("id", "filename", "file_type", "row_count", "status")


@query(f"""WITH {views.TICKETS},
first AS (SELECT *, event_id // 10000 AS file FROM (SELECT *, row_number() OVER (PARTITION BY external_ref ORDER BY id) AS turn FROM tickets) JOIN events ON event_id = id WHERE external_ref IS NULL OR turn = 1)
SELECT row_number() OVER (ORDER BY event_id) AS id, external_ref, (SELECT count(DISTINCT e.event_id // 10000) FROM events e WHERE e.event_id // 10000 <= first.file) AS import_id, 'FILE' AS source,
  subject, body, language, 'NEW' AS status, date_trunc('second', created_at) AS created_at, true AS has_message FROM first""")
def import_confirmed(s, d):
    """Files of 10,000 events each are uploaded and confirmed together."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    t = views.tickets(s, d)
    cells_ = [quoted(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss") if c == "created_at" else F.col(c)) for c in ("external_ref", "subject", "body", "created_at", "language")]
    line = F.struct("id", F.concat_ws(",", *cells_).alias("line"))
    # a file has 10,000 lines at most
    files = t.groupBy(F.floor(F.col("id") / 10_000).alias("file")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    content = F.concat(F.lit("ref,sujet,corps,date,langue\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).cast("binary")
    files = files.select(F.format_string("in/events-%09d.csv", "file").alias("path"), content.alias("content"))
    store = imports.open_store(s, f"{shared_folder(s)}/imports-{uuid.uuid4().hex}")
    ids = imports.upload(store, files)
    imports.confirm(store, ids, {"externalRef": "ref", "subject": "sujet", "body": "corps", "createdAt": "date", "language": "langue"})
    told = store.read("outbox").select(F.col("ticketId").alias("id"), F.get_json_object("value", "$.ticketId").isNotNull().alias("has_message"))
    return store.read("tickets").join(told, "id", "left").select("id", "external_ref", "import_id", "source", "subject", "body", "language", "status", "created_at", "has_message")


@query(r"""SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS body_md5 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)""")
def csv_scanned(s, d):
    """All documents written as CSV files, line ends within quotes, and read back by many tasks a file."""
    doubled = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""'))
    place = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    views.table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(',"'), doubled, F.lit('"')).alias("value")).write.text(place)
    read = csv_scan.scan(s, place)
    return read.select(F.col("cells")[0].cast("long").alias("doc_id"), F.char_length(F.col("cells")[1]).cast("long").alias("n_chars"), F.md5(F.col("cells")[1].cast("binary")).alias("body_md5"))


@query("""SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS body_md5, CASE WHEN lang IS NULL THEN '{"in":{"lang":null}}' ELSE '{"in":{"lang":"' || lang || '"}}' END AS about FROM (SELECT doc_id, lang, coalesce(text, '') || '}{"' AS t FROM documents)""")
def json_scanned(s, d):
    """All documents written as nested JSON objects with braces and quotes in their texts, and read back by many tasks a file."""
    place = f"{shared_folder(s)}/json-{uuid.uuid4().hex}"
    about = F.struct(F.struct("lang").alias("in")).alias("about")
    made = views.table(s, d, "documents").select(F.struct("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit('}{"')).alias("text"), about).alias("v"))
    made.select(F.to_json("v", {"ignoreNullFields": "false"}).alias("value")).write.text(place)
    c = F.col("cells")
    read = json_scan.scan(s, place).where("line_no > 0")
    return read.select(c[0].cast("long").alias("doc_id"), F.char_length(c[1]).cast("long").alias("n_chars"), F.md5(c[1].cast("binary")).alias("body_md5"), c[2].alias("about"))

#: The parts of a made workbook that do not depend on its rows.
WORKBOOK = {
    "_rels/.rels": '<Relationships><Relationship Id="r" Type="x/officeDocument" Target="xl/book.xml"/></Relationships>',
    "xl/book.xml": '<workbook><sheets><sheet name="b" id="r2"/><sheet name="a" id="r1"/></sheets></workbook>',
    "xl/_rels/book.xml.rels": '<Relationships><Relationship Id="r1" Type="x/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="x/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="r3" Type="x/styles" Target="/xl/look.xml"/><Relationship Id="r4" Type="x/sharedStrings" Target="words.xml"/></Relationships>',
    "xl/look.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/><xf numFmtId="38"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData/></worksheet>",
}


def _workbooks(batches):
    """A workbook of up to 1,000 documents each: number, text, day and minute, share, loss, flag, formula."""
    import io
    import zipfile

    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            ids, texts = (batch.slice(at, 1000).column(i).to_pylist() for i in range(2))
            held, sheet, words = io.BytesIO(), [], []
            for n, text in zip(ids, texts, strict=True):
                sheet.append(
                    f'<row r="{2 * len(words) + 2}"><c t="inlineStr"><is><t>{n}</t></is></c><c t="s"><v>{len(words)}</v></c><c s="1"><v>{40000 + n % 8000 + n % 1440 / 1440!r}</v></c><c s="2"><v>{n % 997 / 1000!r}</v></c>'
                    f'<c s="3"><v>{-n - 1}</v></c><c t="b"><v>{n % 2}</v></c><c r="H1"><f>A1&amp;{n}</f><v>7</v></c></row>'
                )
                words.append(f'<si><r><t xml:space="preserve">{xlsx.escaped(text or "")}</t></r><rPh><t>said</t></rPh></si>')
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for name, part in WORKBOOK.items():
                    z.writestr(name, part)
                z.writestr("xl/words.xml", f"<sst>{''.join(words)}</sst>".encode())
                z.writestr("xl/worksheets/sheet2.xml", f"<worksheet><sheetData>{''.join(sheet)}</sheetData></worksheet>")
            yield pa.RecordBatch.from_arrays([pa.array([f"{ids[0]}.xlsx"]), pa.array([held.getvalue()])], ["path", "content"])


@query(r"""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS body_md5, strftime(TIMESTAMP '1899-12-30' + to_days((40000 + doc_id % 8000)::INTEGER) + to_minutes(doc_id % 1440), '%Y-%m-%d %H:%M') AS seen,
  printf('%d.%d0%%', doc_id % 997 // 10, doc_id % 997 % 10) AS share, '(' || format('{:,}', doc_id + 1) || ')' AS loss, CASE doc_id % 2 WHEN 1 THEN 'TRUE' ELSE 'FALSE' END AS flag, '' AS empty, 'A1&' || doc_id AS formula FROM documents""")
def xlsx_scanned(s, d):
    """All documents written as workbooks of up to 1,000 rows, and read back as they show."""
    place = f"{shared_folder(s)}/xlsx-{uuid.uuid4().hex}"
    views.table(s, d, "documents").select("doc_id", "text").mapInArrow(_workbooks, "path string, content binary").write.parquet(place)
    c = F.col("cells")
    read = cells.parsed(s.read.parquet(place))
    return read.select(c[0].cast("long").alias("doc_id"), F.md5(c[1].cast("binary")).alias("body_md5"), c[2].alias("seen"), c[3].alias("share"), c[4].alias("loss"), c[5].alias("flag"), c[6].alias("empty"), c[7].alias("formula"))


# --- files -------------------------------------------------------------------------------


def _files(s, d, kind, *content, code="UTF-8"):
    """A file for each nation, as its rows of cells."""
    made = views.table(s, d, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit("." + kind)).alias("path"), F.encode(F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in content]), code).alias("content"))
    return cells.parsed(made.select("path", "content")).select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("n"), "line_no", F.array_join("cells", "|").alias("cells"))


@query("""SELECT n_nationkey AS n, l::INTEGER AS line_no, CASE l WHEN 1 THEN 'name|region' WHEN 2 THEN n_name || ' "x"|' || n_regionkey WHEN 3 THEN '' ELSE 'last|a "b"' END AS cells FROM nation, range(1, 5) t(l)""")
def csv_records(s, d):
    return _files(s, d, "csv", 'name,region\n"', F.col("n_name"), ' \\"x\\"",', F.col("n_regionkey").cast("string"), '\n\nlast,"a ""b"""\n')


@query("SELECT n_nationkey AS n, l::INTEGER AS line_no, CASE l WHEN 1 THEN 'name|key|' ELSE n_name || '|' || n_nationkey || '|' END AS cells FROM nation, (VALUES (1), (3)) t(l)")
def txt_records(s, d):
    return _files(s, d, "tsv", "\ufeffname\tkey\t\r\n\r\n", F.col("n_name"), "\t", F.col("n_nationkey").cast("string"), "\t\n")


@query("SELECT n_nationkey AS n, l::INTEGER AS line_no, CASE l WHEN 0 THEN 'name|n' WHEN 1 THEN n_name || '|1' WHEN 2 THEN '|2' ELSE '|' END AS cells FROM nation, range(0, 4) t(l)")
def json_records(s, d):
    return _files(s, d, "json", '[{"name": "', F.col("n_name"), '", "n": 1}, {"n": 2, "extra": [1, true]}, {"name": null}]')


@query("SELECT n_nationkey AS n, 1::INTEGER AS line_no, 'é|' || n_name AS cells FROM nation")
def latin_records(s, d):
    return _files(s, d, "txt", "é\t", F.col("n_name"), code="ISO-8859-1")


@query("SELECT n_nationkey AS n, 1::INTEGER AS line_no, 'é|' || n_name AS cells FROM nation")
def utf16_records(s, d):
    return _files(s, d, "txt", "\ufeffé\t", F.col("n_name"), code="UTF-16LE")


HEADS = (("a.csv", "504B0304"), ("a.docx", "504B0304"), ("a.txt", "255044462D31"), ("b.TSV", "61"), ("b.zzz", "61"), ("c.csv", "EFBBBF61"), ("c.json", "FFFE6100"), ("d.json", "FEFF0061"), ("d.csv", "61E9"))


@query("SELECT * FROM (VALUES ('a.csv', 'XLSX', 'UTF-8'), ('a.docx', 'DOCX', 'UTF-8'), ('a.txt', 'PDF', 'UTF-8'), ('b.TSV', 'TXT', 'UTF-8'), ('b.zzz', NULL, 'UTF-8'), ('c.csv', 'CSV', 'UTF-8'), ('c.json', 'JSON', 'UTF-16LE'), ('d.json', 'JSON', 'UTF-16BE'), ('d.csv', 'CSV', 'ISO-8859-1')) t(name, type, charset)")
def file_sniffing(s, d):
    heads = s.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.unhex(F.lit(h)).alias("head")) for n, h in HEADS])).alias("f")).select("f.*")
    return heads.select("name", sniff.file_type(F.col("name"), F.col("head")).alias("type"), sniff.charset(F.col("head")).alias("charset"))


@query("""SELECT '{"id":' || n_nationkey || ',"name":"' || n_name || '","note":null}' AS value FROM nation""")
def jsonl_lines(s, d):
    return jsonl.records(views.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note")))


@query("""SELECT i, CASE WHEN i IN (1, 2) THEN TIMESTAMP '2026-01-01 00:01:00' WHEN i = 3 THEN TIMESTAMP '2025-12-31 22:01:00' END AS at FROM range(1, 8) t(i)""")
def ingest_timestamp_parse(s, d):
    v = s.range(1, 8).select(F.col("id").alias("i"), F.element_at(F.array(*map(F.lit, ["2026-01-01T00:01:00", " 2026-01-01T00:01:00Z ", "2026-01-01T00:01:00+02:00", "2026-01-01", "2026-01-01 00:01:00", "nope", " "])), F.col("id").cast("int")).alias("c"))
    return v.select("i", text.instant(F.col("c")).cast("timestamp_ntz").alias("at"))


@query(f"WITH {views.TICKETS} SELECT id, external_ref FROM (SELECT *, row_number() OVER (PARTITION BY external_ref ORDER BY id) AS n FROM tickets) WHERE n = 1 OR external_ref IS NULL")
def dedup_external_ref(s, d):
    return ingest.first_by_ref(views.tickets(s, d), "id").select("id", "external_ref")


@query(f"""WITH {views.TICKETS}, old AS (SELECT * FROM tickets WHERE id % 3 = 0), new AS (SELECT * FROM tickets WHERE id % 3 <> 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_ref ORDER BY id) AS n FROM new) WHERE n = 1 OR external_ref IS NULL)
SELECT (SELECT count(*) FROM f WHERE external_ref IS NULL OR external_ref NOT IN (SELECT external_ref FROM old WHERE external_ref IS NOT NULL)) AS inserted,
  (SELECT count(*) FROM new) - (SELECT count(*) FROM f WHERE external_ref IS NULL OR external_ref NOT IN (SELECT external_ref FROM old WHERE external_ref IS NOT NULL)) AS skipped""")
def import_counters(s, d):
    t = views.tickets(s, d)
    old, new = t.where("id % 3 = 0"), t.where("id % 3 <> 0")
    kept = sinks.insert_ignore(ingest.first_by_ref(new, "id"), old, "external_ref").agg(F.count("*").alias("inserted"))
    return kept.crossJoin(new.agg(F.count("*").alias("n"))).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


@query(f"WITH {views.TICKETS} SELECT id + (SELECT max(id) FROM tickets WHERE id < 100) - 99 AS id, id AS line FROM tickets WHERE id >= 100")
def identity_generation(s, d):
    t = views.tickets(s, d)
    new = t.where("id >= 100").select(F.col("id").alias("line"))
    return sinks.with_ids(new, t.where("id < 100"), "line")


@query(f"WITH {views.TICKETS} SELECT DISTINCT external_ref FROM tickets a WHERE id % 2 = 0 AND EXISTS (SELECT 1 FROM tickets b WHERE b.id % 5 = 0 AND b.external_ref = a.external_ref)")
def existing_refs_semi(s, d):
    t = views.tickets(s, d)
    return t.where("id % 2 = 0").select("external_ref").distinct().join(t.where("id % 5 = 0").select("external_ref"), "external_ref", "left_semi")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embedding_anti(s, d):
    return similar.missing(views.letters(s, d).select("id"), views.vectors(s, d))


@query(f"""WITH {views.TICKETS}, old AS (SELECT external_ref, min(id) AS id, 'old' AS origin FROM tickets WHERE id % 4 = 0 AND external_ref IS NOT NULL GROUP BY external_ref),
new AS (SELECT external_ref, min(id) AS id, 'new' AS origin FROM tickets WHERE id % 4 <> 0 AND external_ref IS NOT NULL GROUP BY external_ref)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE external_ref NOT IN (SELECT external_ref FROM old)""")
def insert_ignore_merge(s, d):
    t = views.tickets(s, d).where("external_ref is not null")
    old = t.where("id % 4 = 0").groupBy("external_ref").agg(F.min("id").alias("id")).withColumn("origin", F.lit("old"))
    return sinks.first_write_wins(t.where("id % 4 <> 0").select("external_ref", "id", F.lit("new").alias("origin")), old, "external_ref", "id")


@query(f"""WITH {views.TICKETS}, old AS (SELECT external_ref, min(id) AS first_id, min(id) AS id FROM tickets WHERE id % 4 = 0 AND external_ref IS NOT NULL GROUP BY external_ref),
new AS (SELECT external_ref, max(id) AS id FROM tickets WHERE id % 4 <> 0 AND external_ref IS NOT NULL GROUP BY external_ref)
SELECT coalesce(n.external_ref, o.external_ref) AS external_ref, coalesce(o.first_id, n.id) AS first_id, coalesce(n.id, o.id) AS id FROM new n FULL JOIN old o ON n.external_ref = o.external_ref""")
def upsert_last_merge(s, d):
    t = views.tickets(s, d).where("external_ref is not null")
    old = t.where("id % 4 = 0").groupBy("external_ref").agg(F.min("id").alias("first_id"), F.min("id").alias("id"))
    return sinks.last_write_wins(t.where("id % 4 <> 0").select("external_ref", F.col("id").alias("first_id"), "id"), old, "external_ref", "id", keep=("first_id",))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def cascade_delete(s, d):
    return sinks.cascade_delete(views.table(s, d, "labels").select("doc_id", "quality"), "doc_id", views.table(s, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN doc_id END AS doc_id, quality FROM labels")
def set_null(s, d):
    return sinks.set_null(views.table(s, d, "labels").select("doc_id", "quality"), "doc_id", views.table(s, d, "documents").where("lang = 'en'"), "doc_id")


@query(f"""WITH {views.TICKETS}, t AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'FAX' ELSE source END AS source, status, language FROM tickets)
SELECT id, concat_ws(';', CASE WHEN source NOT IN ('FILE', 'WEBHOOK', 'EMAIL', 'MANUAL') THEN 'source not allowed' END) AS why FROM t WHERE source = 'FAX'""")
def constraint_violations(s, d):
    t = views.tickets(s, d).select("id", F.when(F.col("id") % 11 == 0, "FAX").otherwise(F.col("source")).alias("source"), "status", "language")
    return violations(t, "tickets").where(F.size("reasons") > 0).select("id", F.array_join("reasons", ";").alias("why"))


# --- texts -------------------------------------------------------------------------------

NORMAL = "regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5({NORMAL})")
def exact_dedup_normalized(s, d):
    t = views.table(s, d, "documents")
    return t.groupBy(F.md5(text.normalise(F.col("text")).cast("binary")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE {NORMAL} NOT IN (SELECT {NORMAL} FROM benchmark) GROUP BY {NORMAL}")
def leak_guard_anti(s, d):
    docs = views.table(s, d, "documents").select("doc_id", "text")
    return evaluation.unseen(docs, views.table(s, d, "benchmark"), "text", order="doc_id").select("doc_id")


@query("""SELECT conv_id, trim(text) AS ticket FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1""")
def conversation_first_turn(s, d):
    u = views.table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return u.select("conv_id", F.trim("t").alias("ticket"))


@query(f"SELECT doc_id AS id, md5({STRIPPED.format('split_part(text, chr(10), 1) || chr(10) || chr(10) || text')}) AS h FROM documents")
def ticket_text(s, d):
    return views.letters(s, d).select("id", F.md5(text.ticket_text(F.col("subject"), F.col("body"), "(vide)").cast("binary")).alias("h"))


_words = lambda w: "[" + ", ".join("'" + x + "'" for x in w) + "]"
DETECTED = f"""scored AS (SELECT doc_id, lang, len(list_filter(regexp_extract_all(lower(text), '[a-z{text.DIACRITICS}'']+'), lambda x: list_contains({_words(text.FRENCH)}, x))) + 2 * len(regexp_extract_all(lower(text), '[{text.DIACRITICS}]')) AS fr,
  len(list_filter(regexp_extract_all(lower(text), '[a-z{text.DIACRITICS}'']+'), lambda x: list_contains({_words(text.ENGLISH)}, x))) AS en, len(regexp_extract_all(lower(text), '[{text.DIACRITICS}]')) AS acc, text FROM documents),
detected AS (SELECT doc_id, lang, CASE WHEN text IS NULL OR trim(text) = '' THEN 'fr' WHEN fr = en THEN CASE WHEN en > 0 AND acc = 0 THEN 'en' ELSE 'fr' END WHEN fr > en THEN 'fr' ELSE 'en' END AS found FROM scored)"""


def _detected(s, d):
    return views.table(s, d, "documents").select("doc_id", "lang", text.detect_language(F.col("text")).alias("found"))


@query(f"WITH {DETECTED} SELECT doc_id, found FROM detected")
def detect_language(s, d):
    return _detected(s, d).select("doc_id", "found")


@query(f"WITH {DETECTED} SELECT avg((found = lang)::INT::DOUBLE) AS accuracy FROM detected WHERE lang IN ('fr', 'en')")
def language_accuracy(s, d):
    return evaluation.accuracy(_detected(s, d).where("lang in ('fr', 'en')").select(F.col("lang").alias("gold"), F.col("found").alias("pred")))


@query(f"WITH {DETECTED} SELECT lang AS gold, count(*) FILTER (found = 'fr') AS fr, count(*) FILTER (found = 'en') AS en FROM detected WHERE lang IN ('fr', 'en') GROUP BY lang")
def language_confusion(s, d):
    return evaluation.confusion(_detected(s, d).select(F.col("lang").alias("gold"), F.col("found").alias("pred")), ("fr", "en"))


@query("SELECT doc_id, translate(text, 'àâäéèêëïîôöùûüÿçÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇ', 'aaaeeeeiioouuuycAAAEEEEIIOOUUUYC') AS plain FROM documents WHERE lang = 'fr'")
def unaccent(s, d):
    return views.table(s, d, "documents").where("lang = 'fr'").select("doc_id", text.unaccent(F.col("text")).alias("plain"))


@query("""WITH t AS (SELECT a.item_id, lower(a.text) AS a, lower(b.text) AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
g AS (SELECT item_id, list_distinct(list_transform(range(1, (length(a) + 2)::BIGINT), lambda i: substr('  ' || a || ' ', i::BIGINT, 3))) AS x, list_distinct(list_transform(range(1, (length(b) + 2)::BIGINT), lambda i: substr('  ' || b || ' ', i::BIGINT, 3))) AS y FROM t)
SELECT item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS similarity FROM g""")
def trigram_similarity(s, d):
    """Each item's whole text against that of the next id."""
    b = views.table(s, d, "benchmark").select("item_id", "text")
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return both.select("item_id", F.round(text.trigram_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


# --- triage ------------------------------------------------------------------------------

URGENT_SQL, CALM_SQL = ("(?i)(" + "|".join(x).replace("'", "''") + ")" for x in (rules.URGENT, rules.CALM))
PRIORITY_SQL = f"CASE WHEN regexp_matches({{t}}, '{URGENT_SQL}') THEN 'HIGH' WHEN sentiment = 'NEG' AND category IN ('FACTURATION', 'TECHNIQUE') THEN 'HIGH' WHEN sentiment = 'POS' THEN 'LOW' WHEN category = 'DEMANDE' AND regexp_matches({{t}}, '{CALM_SQL}') THEN 'LOW' ELSE 'MEDIUM' END"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderpriority, ({_words(CATEGORIES)})[o_orderkey % 5 + 1] AS category, ({_words(SENTIMENTS)})[o_orderkey % 3 + 1] AS sentiment FROM orders)
SELECT o_orderkey, {PRIORITY_SQL.format(t='o_orderpriority')} AS priority FROM o""")
def priority_rules_orders(s, d):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("o_orderkey"), F.lit(len(values))) + 1).cast("int"))
    o = views.table(s, d, "orders").select("o_orderkey", "o_orderpriority", pick(CATEGORIES).alias("category"), pick(SENTIMENTS).alias("sentiment"))
    return o.select("o_orderkey", rules.priority(F.col("o_orderpriority"), F.col("category"), F.col("sentiment")).alias("priority"))


FIXTURE = (
    ("Impossible de payer, c'est URGENT", "TECHNIQUE", "NEG"), ("La somme sur mon relevé est fausse.", "FACTURATION", "NEG"), ("Votre équipe a été très aimable.", "COMPTE", "POS"),
    ("Quels sont vos horaires ?", "DEMANDE", "NEU"), ("Mon nom de famille a changé.", "COMPTE", "NEU"), ("UN DOUBLE PRÉLÈVEMENT CE MOIS", "DEMANDE", "NEU"), ("Le son du volume grésille", "COMPTE", "NEU"),
)


@query(f"""WITH f AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in FIXTURE)}) t(txt, category, sentiment)) SELECT txt, {PRIORITY_SQL.format(t='txt')} AS priority FROM f""")
def priority_rules_fixture(s, d):
    rows = s.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("txt"), F.lit(c).alias("category"), F.lit(m).alias("sentiment")) for t, c, m in FIXTURE])).alias("r")).select("r.*")
    return rows.select("txt", rules.priority(F.col("txt"), F.col("category"), F.col("sentiment")).alias("priority"))


def _routed(s, d):
    r = views.routed_inputs(s, d)
    return r.select("id", "subject", rules.route(*map(F.col, ("lc", "cc", "ls", "sc", "oc", "os"))).alias("r")).select("id", "subject", "r.*")


@query(f"WITH {views.ROUTED} SELECT id, category, sentiment, confidence, escalated, model_used FROM routed")
def confidence_router(s, d):
    return _routed(s, d).drop("subject")


@query(f"WITH {views.ROUTED} SELECT model_used, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM routed GROUP BY model_used")
def router_rates(s, d):
    return _routed(s, d).groupBy("model_used").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"WITH {views.ROUTED} SELECT id, {PRIORITY_SQL.format(t='subject')} AS priority, category, sentiment, confidence, model_used, escalated FROM routed")
def triage_analyze(s, d):
    r = _routed(s, d)
    return r.select("id", rules.priority(F.col("subject"), F.col("category"), F.col("sentiment")).alias("priority"), "category", "sentiment", "confidence", "model_used", "escalated")


@query(f"""WITH l AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 5) AS x FROM embeddings), m AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l)
SELECT vec_id, ({_words(CATEGORIES)})[list_position(x, list_max(x))] AS label, round(list_max(e) / list_sum(e), 6) AS confidence FROM m""")
def softmax_argmax(s, d):
    logits = F.slice("embedding", 1, 5)
    e = views.table(s, d, "embeddings").select("vec_id", logits.alias("x"), vectors.softmax(logits).alias("p"))
    return e.select("vec_id", vectors.best_label(F.col("x"), CATEGORIES).alias("label"), F.round(F.array_max("p"), 6).alias("confidence"))


# --- evaluation --------------------------------------------------------------------------

LABELS = ("good", "bad", "other")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1")
def majority_class(s, d):
    return evaluation.majority(views.table(s, d, "documents"), "lang", "doc_id")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def field_frequencies(s, d):
    return evaluation.frequencies(views.table(s, d, "documents"), ["lang", "source"])


@query(f"WITH {views.JUDGED} SELECT gold, count(*) FILTER (pred = 'good') AS good, count(*) FILTER (pred = 'bad') AS bad, count(*) FILTER (pred = 'other') AS other FROM judged GROUP BY gold")
def confusion_matrix(s, d):
    return evaluation.confusion(views.judged(s, d), LABELS)


PRF = f"""{views.JUDGED}, c AS (SELECT l AS label, count(*) FILTER (gold = l AND pred = l) AS tp, count(*) FILTER (gold = l) AS support, count(*) FILTER (pred = l) AS said FROM judged, (SELECT unnest({_words(LABELS)}) AS l) GROUP BY l),
p AS (SELECT label, CASE WHEN said > 0 THEN tp / said::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall, CASE WHEN said + support > 0 THEN 2.0::DOUBLE * tp / (said + support) ELSE 0 END AS f1, support FROM c)"""


@query(f"WITH {PRF} SELECT * FROM p")
def class_prf(s, d):
    return evaluation.class_scores(views.judged(s, d), LABELS)


@query(f"WITH {PRF} SELECT round(avg(f1), 9) AS macro_f1 FROM p")
def macro_f1(s, d):
    return evaluation.macro_f1(views.judged(s, d), LABELS).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {views.JUDGED} SELECT avg((gold = pred)::INT::DOUBLE) AS accuracy FROM judged")
def accuracy(s, d):
    return evaluation.accuracy(views.judged(s, d))


@query("SELECT quality, (SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)) AS weight FROM labels GROUP BY quality")
def class_weights(s, d):
    return evaluation.class_weights(views.table(s, d, "labels"), "quality", 2)


@query(f"WITH {views.JUDGED} SELECT doc_id, gold, pred, substr(replace(text, chr(10), ' '), 1, 90) AS example FROM judged WHERE gold <> pred ORDER BY doc_id LIMIT 6")
def error_examples(s, d):
    return evaluation.error_examples(views.judged(s, d), "doc_id")


@query(f"WITH {views.JUDGED} SELECT count(*) AS generated, count(*) FILTER (gold = pred) AS kept, count(*) FILTER (gold = pred) / count(*)::DOUBLE AS kept_rate, count(*) FILTER (gold = pred AND toxic = 0) / (count(*) FILTER (gold = pred))::DOUBLE AS priority_rate FROM judged")
def gate_rates(s, d):
    return evaluation.gate_rates(views.judged(s, d), F.col("gold") == F.col("pred"), F.col("toxic") == 0)


@query(f"WITH {views.JUDGED} SELECT doc_id FROM judged WHERE gold = pred AND coalesce(toxic = (doc_id % 2), false)")
def agreement_gate(s, d):
    j = views.judged(s, d).select("doc_id", F.struct(F.col("gold").alias("category"), F.col("toxic").alias("sentiment")).alias("spec"), F.struct(F.col("pred").alias("category"), (F.col("doc_id") % 2).cast("int").alias("sentiment")).alias("out"))
    return j.where(evaluation.agrees("spec", "out")).select("doc_id")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def cell_quota(s, d):
    return evaluation.quota(views.table(s, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) <= greatest(1, floor(0.15 * count(*) OVER (PARTITION BY lang))) THEN 'validation' ELSE 'train' END AS split FROM documents")
def stratified_split(s, d):
    docs = views.table(s, d, "documents").select("doc_id", "lang")
    return evaluation.stratified_split(docs, "lang", F.md5(F.col("doc_id").cast("string").cast("binary"))).select("doc_id", "split")


@query(f"SELECT 'syn-train-' || lpad(i::VARCHAR, 5, '0') AS spec_id, ({_words(PRIORITIES)})[i % 9 // 3 + 1] AS priority, ({_words(SENTIMENTS)})[i % 3 + 1] AS sentiment FROM range(800) t(i)")
def spec_grid(s, d):
    return evaluation.spec_grid(s, 800, PRIORITIES, SENTIMENTS)


TERMS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term)),
weighted AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(f"WITH {TERMS} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def tfidf_terms(s, d):
    return evaluation.tfidf(views.table(s, d, "documents"), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {TERMS} SELECT doc_id, rank::INTEGER AS rank, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM weighted) WHERE rank <= 5")
def keyphrases_top5(s, d):
    return evaluation.keyphrases(views.table(s, d, "documents"), "doc_id", "text")


@query()
def svc_baseline(s, d):
    """Scores of the linear baseline on the held-out rows; an optimiser's result, so without SQL."""
    rows = views.judged(s, d).select("doc_id", "text", "gold").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    out = linear.classified(rows, "doc_id", "text", "gold", ~F.col("held")).select("gold", "pred")
    return evaluation.class_scores(out, ("good", "bad"))


# --- similarity --------------------------------------------------------------------------

COS = "list_cosine_similarity({0}, {1})"


@query(f"WITH {views.VECTORS} SELECT v.ticket_id, v.category, round({COS.format('v.vector', 'q.vector')}, 4) AS similarity, v.category = q.category AND {COS.format('v.vector', 'q.vector')} >= 0.92 AS duplicate FROM vectors v, (SELECT * FROM vectors WHERE ticket_id = 7) q WHERE v.ticket_id <> 7 ORDER BY {COS.format('v.vector', 'q.vector')} DESC, v.ticket_id LIMIT 5")
def similar_by_id(s, d):
    v = views.vectors(s, d)
    return similar.by_ticket(v, v.select(F.col("ticket_id").alias("id"), F.lit("").alias("subject")), 7).drop("subject")


QUERY_VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]


@query(f"WITH {views.VECTORS} SELECT ticket_id, category, round({COS.format('vector', str(QUERY_VECTOR) + '::DOUBLE[]')}, 4) AS similarity, false AS duplicate FROM vectors ORDER BY {COS.format('vector', str(QUERY_VECTOR) + '::DOUBLE[]')} DESC, ticket_id LIMIT 10")
def similar_by_vector(s, d):
    v = views.vectors(s, d)
    return similar.by_vector(v, v.select(F.col("ticket_id").alias("id"), F.lit("").alias("subject")), QUERY_VECTOR, 10).drop("subject")


@query(f"""WITH {views.VECTORS}, p AS (SELECT q.ticket_id AS query_id, v.ticket_id, {COS.format('v.vector', 'q.vector')} AS c FROM vectors v, vectors q WHERE q.ticket_id % 100 = 0 AND v.ticket_id <> q.ticket_id)
SELECT query_id, ticket_id, round(c, 4) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, ticket_id) AS rank FROM p) WHERE rank <= 5""")
def similar_topk_batch(s, d):
    v = views.vectors(s, d)
    return similar.nearest_of_queries(v, v.where("ticket_id % 100 = 0").select(F.col("ticket_id").alias("query_id"), F.col("vector").alias("q")))


@query()
def similar_topk_indexed(s, d):
    """As similar_topk_batch by an index of the vectors, a quarter of which are inserted after it was made."""
    v = views.vectors(s, d).select("ticket_id", "vector")
    index = vector_index.VectorIndex(s, f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}").build(v.where("ticket_id % 4 > 0"))
    index.insert(v)
    return index.search(v.where("ticket_id % 100 = 0").select(F.col("ticket_id").alias("query_id"), F.col("vector").alias("q")))


DUPLICATES = f"WITH {views.VECTORS} SELECT a.ticket_id AS a, b.ticket_id AS b, round({COS.format('a.vector', 'b.vector')}, 4) AS similarity FROM vectors a JOIN vectors b ON a.category = b.category AND a.ticket_id < b.ticket_id WHERE {COS.format('a.vector', 'b.vector')} >= "


@query(DUPLICATES + "0.92")
def duplicates_default(s, d):
    return similar.duplicates(views.vectors(s, d))


@query(DUPLICATES + "0.35")
def duplicates_t035(s, d):
    return similar.duplicates(views.vectors(s, d), 0.35)


@query(f"WITH {views.VECTORS}, x AS (SELECT label, generate_subscripts(vector, 1) AS i, unnest(vector) AS v, ticket_id FROM vectors) SELECT label, i::BIGINT AS i, round(avg(v), 6) AS mean FROM x WHERE ticket_id % 2 = 0 GROUP BY label, i")
def mean_pool_label(s, d):
    x = views.vectors(s, d).where("ticket_id % 2 = 0").select("label", F.posexplode("vector").alias("i", "v"))
    return x.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, i::BIGINT AS i, round((embedding[i]::DOUBLE + embedding[i + 8]::DOUBLE * (vec_id % 2) + embedding[i + 16]::DOUBLE * (vec_id % 3 = 0)::INT) / (1 + vec_id % 2 + (vec_id % 3 = 0)::INT), 6) AS mean FROM embeddings, range(1, 9) t(i)")
def masked_mean_pool(s, d):
    e = views.table(s, d, "embeddings")
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), (F.col("vec_id") % 3 == 0).cast("int"))
    pooled = vectors.masked_mean(F.array(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8), F.slice("embedding", 17, 8)), mask)
    return e.select("vec_id", F.posexplode(pooled).alias("p", "m")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.round("m", 6).alias("mean"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def pgvector_literal(s, d):
    return views.table(s, d, "embeddings").select("vec_id", vectors.literal(F.col("embedding")).alias("literal"))


# --- webhook -----------------------------------------------------------------------------


@query("SELECT event_id, sha256(props) AS token FROM events")
def sha256_token(s, d):
    return views.table(s, d, "events").select("event_id", security.sha256_hex(F.col("props")).alias("token"))


def _pad(value):
    return "unhex('" + bytes(k ^ value for k in b"s3cr3t".ljust(64, b"\0")).hex() + "')"


@query(f"SELECT event_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(props)))) AS signature FROM events")
def hmac_verify(s, d):
    return views.table(s, d, "events").select("event_id", security.hmac_sha256(b"s3cr3t", F.col("props")).alias("signature"))


@query("SELECT event_id, coalesce('key:' || nullif(trim(CASE WHEN event_id % 2 = 0 THEN event_type ELSE '  ' END), ''), 'ip:' || user_id) AS client FROM events")
def bucket_client(s, d):
    e = views.table(s, d, "events")
    return e.select("event_id", security.client(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("  "), F.col("user_id").cast("string")).alias("client"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, t, n, 4.0::DOUBLE AS tokens, true AS allowed FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, t, n, had - CASE WHEN had >= 1 THEN 1 ELSE 0 END, had >= 1 FROM
    (SELECT e.*, least(5.0::DOUBLE, b.tokens + greatest(e.t - b.t, 0) * (5.0::DOUBLE / 3600.0::DOUBLE)) AS had FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1))
SELECT user_id AS client, event_id, allowed FROM b""")
def token_bucket_admission(s, d):
    e = views.table(s, d, "events").select(F.col("user_id").alias("client"), "ts", "event_id")
    return bucket.admitted(e, "client", "ts", "event_id", capacity=5, refill=5, period=3600)


@query("""WITH e AS (SELECT event_id, user_id, 'R' || user_id AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT *, (SELECT max(user_id) FROM e WHERE user_id % 5 = 0) + row_number() OVER (ORDER BY event_id) AS id FROM e WHERE user_id % 5 <> 0 AND k = 1)
SELECT r AS external_ref, 'ACCEPTED' AS result, NULL::BIGINT AS stored_id, id FROM f
UNION ALL SELECT e.r, 'DUPLICATE', CASE WHEN e.user_id % 5 = 0 THEN e.user_id ELSE f.id END, NULL FROM e LEFT JOIN f USING (user_id) WHERE e.user_id % 5 = 0 OR e.k > 1""")
def webhook_ingested(s, d):
    e = views.table(s, d, "events")
    ref = F.concat(F.lit("R"), F.col("user_id").cast("string"))
    none = F.lit(None).cast("string")
    accepted = e.select(F.col("event_id").alias("arrived"), F.struct(ref.alias("externalRef"), none.alias("customerEmail"), F.col("event_type").alias("subject"), none.alias("body"), F.lit("fr").alias("language")).alias("event"))
    known = e.where("user_id % 5 = 0").select(F.col("user_id").alias("id"), ref.alias("external_ref")).distinct()
    return consumer.ingested(accepted, known).select("external_ref", "result", "stored_id", "id")


@query("SELECT event_id, '{\"ticketId\":' || event_id || ',\"subject\":\"' || event_type || '\"}' AS message FROM events")
def event_messages(s, d):
    return views.table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("ticketId"), F.col("event_type").alias("subject"))).alias("message"))


# --- planned reports -----------------------------------------------------------------------


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL""")
def dashboard_daily(s, d):
    found = reports.daily(views.table(s, d, "events"), "ts", "event_type", "value")
    return found.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean_value"), "p50", "p95")


@query("SELECT dayofweek(ts)::INTEGER + 1 AS weekday, hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY ALL")
def dashboard_heatmap(s, d):
    return reports.heatmap(views.table(s, d, "events"), "ts")


@query(f"""WITH {views.TICKETS}, {views.ANALYSES} SELECT count(*) AS n, round(avg(coalesce(escalated_to_llm, false)::INT::DOUBLE), 6) AS escalation_rate, round(avg(confidence), 6) AS mean_confidence,
  quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM analyses""")
def dashboard_rates(s, d):
    return reports.analysis_rates(views.analyses(s, d)).select("n", F.round("escalation_rate", 6).alias("escalation_rate"), F.round("mean_confidence", 6).alias("mean_confidence"), "p50_ms", "p95_ms")


def _volumes(s, d):
    return reports.volumes(views.table(s, d, "events"), "ts", "event_type").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL), m AS (SELECT event_type, median(n) AS med FROM h GROUP BY event_type),
x AS (SELECT h.*, med, abs(n - med) AS dev FROM h JOIN m USING (event_type)), y AS (SELECT event_type, median(dev) AS mad FROM x GROUP BY event_type)
SELECT event_type, day, n, round(CASE WHEN mad > 0 THEN 0.6745 * (n - med) / mad END, 6) AS z FROM x JOIN y USING (event_type)""")
def volume_anomaly(s, d):
    return reports.robust_z(_volumes(s, d), "event_type", "n").select("event_type", "day", "n", F.round("z", 6).alias("z"))


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
t AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 3 DAYS FOLLOWING) AS trend FROM h),
s AS (SELECT event_type, dayofweek(day) AS w, median(n - trend) AS season FROM t GROUP BY ALL), r AS (SELECT t.*, season, n - trend - season AS rest FROM t JOIN s ON s.event_type = t.event_type AND w = dayofweek(day)),
m AS (SELECT event_type, median(rest) AS med FROM r GROUP BY event_type), x AS (SELECT r.*, rest - med AS off FROM r JOIN m USING (event_type)), y AS (SELECT event_type, median(abs(off)) AS mad FROM x GROUP BY event_type)
SELECT event_type, day, n, round(trend, 6) AS trend, round(season, 6) AS season, round(CASE WHEN mad > 0 THEN 0.6745 * off / mad END, 5) AS z FROM x JOIN y USING (event_type)""")
def volume_anomaly_seasonal(s, d):
    found = reports.seasonal_anomaly(_volumes(s, d), "event_type")
    return found.select("event_type", "day", "n", F.round("trend", 6).alias("trend"), F.round("season", 6).alias("season"), F.round("z", 5).alias("z"))


@query()
def volume_anomaly_stl(s, d):
    """Iterated loess, so without SQL; tests hold it against one written value by value."""
    found = reports.stl_anomaly(_volumes(s, d), "event_type")
    return found.select("event_type", "day", "n", *[F.round(c, 6).alias(c) for c in ("trend", "season", "rest", "weight")], F.round("z", 5).alias("z"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def bonus_tumbling(s, d):
    e = views.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
x AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM x GROUP BY user_id, k""")
def bonus_sessions(s, d):
    e = views.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# --- search fusion ---------------------------------------------------------------------------

ASKED = ("the", "of", "and")
BM25_SQL = r"""w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS t FROM documents), l AS (SELECT doc_id, count(*)::DOUBLE AS len FROM w GROUP BY 1),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w WHERE t IN ('the', 'of', 'and') GROUP BY ALL), df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
bm AS (SELECT doc_id, sum(ln(1 + ((SELECT count(*) FROM l) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM l)))) AS score FROM tf JOIN df USING (t) JOIN l USING (doc_id) GROUP BY doc_id)"""


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(s, d):
    return ranking.bm25(views.table(s, d, "documents"), "doc_id", "text", ASKED).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS a, row_number() OVER (ORDER BY doc_id) AS b FROM bm) SELECT doc_id, round(CASE WHEN a <= 20 THEN 1 / (60.0::DOUBLE + a) ELSE 0 END + CASE WHEN b <= 20 THEN 1 / (60.0::DOUBLE + b) ELSE 0 END, 9) AS fused FROM r WHERE a <= 20 OR b <= 20")
def rank_fusion(s, d):
    """Reciprocal rank fusion of two top-20 lists; ranks come from lists cut by limit first."""
    scored = ranking.bm25(views.table(s, d, "documents"), "doc_id", "text", ASKED).select("doc_id", F.round("score", 9).alias("r"))
    return ranking.fused(scored, "doc_id", [[F.desc("r"), "doc_id"], ["doc_id"]]).select("doc_id", F.round("fused", 9).alias("fused"))


# --- generation ------------------------------------------------------------------------------

HASHED = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % {1})"


def _sample_sql(n):
    pools = "{" + ", ".join(f"'{k}': [" + ", ".join("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in part) + "]" for part in v) + "]" for k, v in generation.SAMPLES.items()) + "}"
    at = lambda part, l: f"{pools}.{l}[{part + 1}][{HASHED.format(f"'42/{part}/' || i", len(generation.SAMPLES['fr'][part]))} + 1]"
    pick = lambda part: f"CASE WHEN {HASHED.format("'42/l/' || i", 2)} = 0 THEN {at(part, 'fr')} ELSE {at(part, 'en')} END"
    return f"""SELECT 'TCK-' || lpad((i + 1)::VARCHAR, 6, '0') AS external_ref, 'client' || (i + 1) || '@example.com' AS customer_email, {pick(0)} AS subject, {pick(1)} AS body,
  strftime(TIMESTAMP '2026-01-01' + to_minutes(i::INTEGER + 1), '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN {HASHED.format("'42/l/' || i", 2)} = 0 THEN 'fr' ELSE 'en' END AS language FROM range({n}) t(i)"""


@query(_sample_sql(10_000))
def sample_tickets(s, d):
    return generation.sample_tickets(s)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42/' || doc_id)) AS rank FROM documents")
def shuffle_seeded(s, d):
    return sinks.placed(generation.shuffled(views.table(s, d, "documents").select("doc_id"), "doc_id"), "place", "rank").select("doc_id", "rank")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_object_extract(s, d):
    said = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    return views.table(s, d, "events").select("event_id", F.from_json(text.first_json_object(said), "k bigint")["k"].alias("k"))


@query(f"WITH {views.VECTORS} SELECT ticket_id, list_position({_words(CATEGORIES)}, category)::BIGINT - 1 AS id FROM vectors")
def label_ids(s, d):
    return views.vectors(s, d).select("ticket_id", generation.label_id(F.col("category"), CATEGORIES).alias("id"))


@query(f"""WITH c AS (SELECT doc_id AS seq, lang AS language, text AS body, source AS category FROM documents WHERE n_chars % 3 <> 0), k AS (SELECT *, {NORMAL.replace('text', 'body')} AS n FROM c),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq) AS r FROM k WHERE n NOT IN (SELECT {NORMAL} FROM benchmark)) WHERE r = 1)
SELECT seq, category, language FROM (SELECT *, row_number() OVER (PARTITION BY category, language ORDER BY seq) AS q FROM u) WHERE q <= 4""")
def dataset_builder(s, d):
    docs = views.table(s, d, "documents")
    target = F.struct(F.col("source").alias("category"), F.lit("NEU").alias("sentiment"))
    said = F.struct(F.when(F.col("n_chars") % 3 != 0, F.col("source")).alias("category"), F.lit("NEU").alias("sentiment"))
    candidates = docs.select(F.col("doc_id").alias("seq"), F.col("lang").alias("language"), F.col("text").alias("body"), target.alias("spec"), said.alias("pred"))
    made = generation.built_dataset(candidates, views.table(s, d, "benchmark").select(F.col("text").alias("body")), 4)
    return made.select("seq", F.col("spec.category").alias("category"), "language")


@query("SELECT count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) AS backfilled FROM documents")
def backfill_counts(s, d):
    docs, v = views.letters(s, d), views.vectors(s, d)
    new = generation.backfilled(docs, v).where(F.size("vector") == 64)
    return docs.agg(F.count("*").alias("n")).crossJoin(new.agg(F.count("*").alias("backfilled")))


@query()
def recall_at_k(s, d):
    """The share of all near vectors of every id divisible by 100 that hashing finds; hashes are drawn, so without SQL."""
    v, asked = views.vectors(s, d), "ticket_id % 100 = 0"
    ends = F.explode(F.array(F.struct(F.col("a").alias("query_id"), F.col("b").alias("ticket_id")), F.struct(F.col("b").alias("query_id"), F.col("a").alias("ticket_id"))))
    pairs = lambda p: p.select(ends.alias("e")).select("e.*").where("query_id % 100 = 0")
    found = pairs(similar.likely_duplicates(v, 0.35, tables=16, bucket=2.0, asked=asked)).withColumn("rank", F.lit(1))
    return generation.recall_at(found, pairs(similar.duplicates(v, 0.35, asked=asked)), 1)


@query("SELECT a.doc_id, b.item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) a LEFT JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark) b USING (n)")
def positional_zip(s, d):
    left = views.table(s, d, "documents").select(F.col("doc_id").alias("o"), "doc_id")
    right = views.table(s, d, "benchmark").select(F.col("item_id").alias("o"), "item_id")
    return generation.positional_zip(left, right, "o").select("doc_id", "item_id")


@query()
def topic_clusters(s, d):
    """k-means over the vectors; an iterative fit, so without SQL."""
    return generation.topics(views.vectors(s, d).select("ticket_id", "vector"))
