"""From rows of cells to tickets: mapping, projection, row errors, preview and confirmation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .sinks import insert_ignore, with_ids

FIELDS = ("externalRef", "customerEmail", "subject", "body", "createdAt", "language")
PREVIEW, ERRORS = 50, 100

# Header names by which a field is found when the user maps nothing.
CANDIDATES = {
    "externalRef": ("external_ref", "ref", "reference", "id"),
    "customerEmail": ("customer_email", "email", "mail"),
    "subject": ("subject", "sujet", "title", "titre"),
    "body": ("body", "corps", "message", "description", "content"),
    "createdAt": ("created_at", "date", "created"),
    "language": ("language", "lang", "langue"),
}


class MappingInvalid(ValueError):
    """The mapping names no subject."""


class ImportState(RuntimeError):
    """The import is not awaiting validation."""


def sanitise(mapping: Mapping[str, str | None]) -> dict[str, str]:
    """The supported fields in fixed order, without blank targets, targets trimmed."""
    kept = {f: (mapping.get(f) or "").strip() for f in FIELDS}
    kept = {f: c for f, c in kept.items() if c}
    if "subject" not in kept:
        raise MappingInvalid("subject must be mapped")
    return kept


def auto_map(headers: list[str]) -> dict[str, str]:
    """For each field the first header whose lower-case name is a candidate."""
    out = {}
    for field, names in CANDIDATES.items():
        found = next((h for h in headers if h.strip().lower() in names), None)
        if found is not None:
            out[field] = found
    return out


def cell(headers: Column, cells: Column, name: str | None) -> Column:
    """The trimmed cell under the first header of that name; NULL if there is none or it is blank."""
    if not name:
        return F.lit(None).cast("string")
    at = F.array_position(headers, name)
    return text.blank_to_null(F.when(at > 0, F.get(cells, (at - 1).cast("int"))))


def project(rows: DataFrame, mapping: Mapping[str, str], *keep: str) -> DataFrame:
    """Tickets of rows (line_no, headers, cells), as new tickets from a file, with further columns to keep."""
    of = lambda field: cell(F.col("headers"), F.col("cells"), mapping.get(field))
    return rows.select(
        *keep,
        "line_no",
        of("externalRef").alias("external_ref"),
        F.lit("FILE").alias("source"),
        of("customerEmail").alias("customer_email"),
        of("subject").alias("subject"),
        of("body").alias("body"),
        text.known_language(of("language")).alias("language"),
        F.lit("NEW").alias("status"),
        text.instant(of("createdAt")).alias("created_at"),
    )


def row_errors(rows: DataFrame) -> DataFrame:
    """(line_no, message) of rows whose number of cells is not that of the headers."""
    bad = rows.where(F.size("cells") != F.size("headers"))
    # the message is a fixed text
    return bad.select("line_no", F.format_string("Nombre de colonnes incoherent (attendu %d, obtenu %d)", F.size("headers"), F.size("cells")).alias("message"))


def preview(rows: DataFrame) -> DataFrame:
    """One row: total rows, errors up to ERRORS, rows shown up to PREVIEW."""
    ragged = F.size("cells") != F.size("headers")
    return rows.agg(F.count("*").alias("total_rows"), F.least(F.count_if(ragged), F.lit(ERRORS)).alias("error_count"), F.least(F.count("*"), F.lit(PREVIEW)).alias("preview_rows"))


def preview_rows(rows: DataFrame) -> DataFrame:
    """(line_no, cells) of the first rows, as many as a preview shows."""
    return rows.select("line_no", "cells").orderBy("line_no").limit(PREVIEW)


def preview_errors(rows: DataFrame) -> DataFrame:
    """(line_no, message) of the first row errors, as many as a preview lists."""
    return row_errors(rows).orderBy("line_no").limit(ERRORS)


def uploaded(rows: DataFrame, files: DataFrame, imports: DataFrame, by: int | None = None) -> DataFrame:
    """The imports table with a row AWAITING_VALIDATION for each file (path, type) and its number of rows."""
    counted = rows.groupBy("path").agg(F.count("*").cast("int").alias("row_count"))
    new = files.select("path", "type").join(counted, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("type").alias("file_type"), F.lit(by).cast("long").alias("uploaded_by"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.lit("AWAITING_VALIDATION").alias("status"), F.lit(None).cast("map<string,string>").alias("column_mapping"), F.lit(None).cast("string").alias("extraction_meta"), F.current_timestamp().alias("created_at"),
    )
    return imports.unionByName(with_ids(new, imports, "filename"))


def settled(imports: DataFrame, import_id: int, mapping: Mapping[str, str | None]) -> DataFrame:
    """The imports table with one import DONE under its mapping; refused unless it awaits validation."""
    now = imports.where(F.col("id") == import_id).select("status").first()
    if now is None or now["status"] != "AWAITING_VALIDATION":
        raise ImportState(now and now["status"])
    this = F.col("id") == import_id
    used = F.create_map(*[F.lit(x) for pair in sanitise(mapping).items() for x in pair])
    return imports.withColumn("status", F.when(this, "DONE").otherwise(F.col("status"))).withColumn("column_mapping", F.when(this, used).otherwise(F.col("column_mapping")))


def with_headers(cells: DataFrame) -> DataFrame:
    """Rows (path, line_no, headers, cells): each file's first record as headers of the others."""
    first = cells.groupBy("path").agg(F.min(F.struct("line_no", "cells")).alias("h"))
    joined = cells.join(first, "path").where(F.col("line_no") > F.col("h.line_no"))
    return joined.select("path", "line_no", F.col("h.cells").alias("headers"), "cells")


def first_by_ref(tickets: DataFrame, order: str = "line_no") -> DataFrame:
    """Tickets without those whose external_ref an earlier one has; those without one all stay."""
    named = tickets.where("external_ref is not null")
    first = named.withColumn("__n", F.row_number().over(Window.partitionBy("external_ref").orderBy(order))).where("__n = 1").drop("__n")
    return first.unionByName(tickets.where("external_ref is null"))


def confirm(rows: DataFrame, mapping: Mapping[str, str | None], existing: DataFrame, status: str = "AWAITING_VALIDATION") -> tuple[DataFrame, DataFrame]:
    """(tickets to insert with their ids, events to publish once they are stored).

    Tickets whose external_ref is stored already or appeared earlier in the file are skipped.
    """
    if status != "AWAITING_VALIDATION":
        raise ImportState(status)
    tickets = first_by_ref(project(rows, sanitise(mapping)))
    fresh = insert_ignore(tickets, existing, "external_ref")
    stamped = fresh.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    inserted = with_ids(stamped, existing, "line_no").drop("line_no")
    return inserted, created_events(inserted)


def created_events(tickets: DataFrame) -> DataFrame:
    """(value): one JSON message for each stored ticket."""
    return tickets.select(created_event().alias("value"))


def created_event() -> Column:
    """The JSON message of a stored ticket."""
    return F.to_json(F.struct(F.col("id").alias("ticketId"), F.col("external_ref").alias("externalRef"), "subject", "body", "language"))
