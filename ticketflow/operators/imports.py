"""Imports from upload to confirmation, each step one transaction of a store.

Uploaded files are kept by the SHA-256 of their bytes, so a file that comes twice is kept once
and what is confirmed is what was shown. Upload puts files and import rows in place together;
confirmation reads the kept files again and puts tickets, the import's state and the messages
to publish in place together. A run that is lost at any step leaves all of it or none, and
nothing to recover: the import still awaits validation and is confirmed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..schemas import IMPORTS, TICKETS
from ..sources import cells, sniff
from ..sources.store import Store, Table, Transaction
from . import ingest, sinks

_FILES = StructType([StructField("sha256", StringType()), StructField("content", BinaryType()), StructField("length", LongType())])
_IMPORTS = StructType([*IMPORTS.fields, StructField("sha256", StringType())])
_OUTBOX = StructType([StructField("ticketId", LongType()), StructField("value", StringType())])

#: Lines of one file, as a power of two: the place of a line among those of several imports is one number.
_LINES = 1 << 31


def open_store(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    """The store of files, imports, tickets and messages at a path."""
    return Store(spark, path, {"files": Table(_FILES, "sha256", buckets), "imports": Table(_IMPORTS, "id", 1), "tickets": Table(TICKETS, "external_ref", buckets), "outbox": Table(_OUTBOX, "ticketId", buckets)})


def upload(store: Store, files: DataFrame, by: int | None = None) -> list[int]:
    """Keeps files (path, content) and adds an import AWAITING_VALIDATION for each; their ids, in order of filename and path.

    Refuses all if a file is of a type without a parser. A file without content is kept and has no rows.
    """
    known = files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("type", sniff.file_type(F.col("path"), F.substring("content", 1, sniff.HEAD)))
    # files are made and parsed once, though several jobs read them; what an executor loses is made again
    known = known.withColumn("sha256", F.sha2("content", 256)).persist()
    odd = known.where(~F.coalesce(F.col("type"), F.lit("")).isin(*cells.PARSERS, "XLSX")).select("path", "type").first()
    if odd:
        known.unpersist()
        raise sniff.UnsupportedType(f"{odd['path']}: {odd['type']}")
    counted = cells.parsed(known.select("path", "content")).groupBy("path").agg((F.count("*") - 1).cast("int").alias("row_count"))
    rows = known.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("type").alias("file_type"), "sha256").join(counted, "path", "left").persist()

    def work(t: Transaction) -> list[int]:
        n = rows.count()
        first = t.number("imports", n)
        placed = sinks.placed(rows.withColumn("__order", F.concat_ws("\0", "filename", "path")), "__order", "__n")
        t.append("imports", placed.select(
            (F.lit(first - 1) + F.col("__n")).alias("id"), "filename", "file_type", F.lit(by).cast("long").alias("uploaded_by"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.lit("AWAITING_VALIDATION").alias("status"),
            F.lit(None).cast("map<string,string>").alias("column_mapping"), F.lit(None).cast("string").alias("extraction_meta"), F.current_timestamp().alias("created_at"), "sha256",
        ))
        t.insert("files", known.select("sha256", "content", F.octet_length("content").cast("long").alias("length")), "length")
        return list(range(first, first + n))

    try:
        return store.transact(work)
    finally:
        rows.unpersist()
        known.unpersist()


def _kept(t: Transaction, imports: DataFrame) -> DataFrame:
    """(path, content) of the kept files of imports; a path is the import's id and the filename."""
    wanted = imports.select(F.concat_ws("/", "id", "filename").alias("path"), "sha256")
    return wanted.join(t.read("files", t.touched("files", wanted)).select("sha256", "content"), "sha256").select("path", "content")


def shown(store: Store, import_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The preview of an import's kept file: (totals, first rows, first errors)."""
    t = store.begin()
    rows = ingest.with_headers(cells.parsed(_kept(t, t.read("imports").where(F.col("id") == import_id))))
    return ingest.preview(rows), ingest.preview_rows(rows), ingest.preview_errors(rows)


def confirm(store: Store, import_ids: Iterable[int], mapping: Mapping[str, str | None]) -> tuple[int, int]:
    """Makes tickets of imports under one mapping; (tickets inserted, rows skipped).

    Refuses all if one of them does not await validation. A row whose external_ref is stored
    or came earlier, by import and line, is skipped; rows without one are all inserted. Ids
    follow import and line without gaps. Imports confirmed at the same time by others and
    refs that others store meanwhile make this begin anew.
    """
    used, ids = ingest.sanitise(mapping), sorted(set(import_ids))

    def work(t: Transaction) -> tuple[int, int]:
        imports = t.read("imports").where(F.col("id").isin(ids))
        states = {r["id"]: r["status"] for r in imports.select("id", "status").collect()}
        for i in ids:
            if states.get(i) != "AWAITING_VALIDATION":
                raise ingest.ImportState(states.get(i))
        rows = ingest.with_headers(cells.parsed(_kept(t, imports))).withColumn("import_id", F.split("path", "/")[0].cast("long"))
        # read by several jobs; what an executor loses is parsed again
        made = ingest.project(rows, used, "import_id").withColumn("turn", F.col("import_id") * _LINES + F.col("line_no")).persist()
        first = ingest.first_by_ref(made, "turn")
        stored = t.read("tickets", t.touched("tickets", first))
        fresh = sinks.insert_ignore(first, stored, "external_ref").withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        fresh = fresh.persist()
        try:
            n, total = fresh.count(), made.count()
            base = t.number("tickets", n)
            tickets = sinks.placed(fresh, "turn", "__n").withColumn("id", F.lit(base - 1) + F.col("__n"))
            tickets = tickets.withColumns({f.name: F.lit(None).cast(f.dataType) for f in TICKETS.fields if f.name not in tickets.columns})
            t.append("tickets", tickets)
            t.append("outbox", tickets.select(F.col("id").alias("ticketId"), ingest.created_event().alias("value")))
        finally:
            fresh.unpersist()
            made.unpersist()
        done = F.col("id").isin(ids)
        mapped = F.create_map(*[F.lit(x) for pair in used.items() for x in pair])
        t.merge("imports", imports, lambda old: old.withColumn("status", F.when(done, "DONE").otherwise(F.col("status"))).withColumn("column_mapping", F.when(done, mapped).otherwise(F.col("column_mapping"))))
        return n, total - n

    return store.transact(work)


def publish_pending(store: Store, publish: Callable[[DataFrame], None]) -> int:
    """Hands the messages (value) of stored tickets to publish and takes them off; how many there were.

    A run that is lost in between publishes them again, which consumers see by their ids.
    """

    def work(t: Transaction) -> int:
        pending = t.read("outbox")
        n = pending.count()
        if n:
            publish(pending.select("value"))
            t.replace("outbox", pending.limit(0), range(store.tables["outbox"].buckets))
        return n

    return store.transact(work)
