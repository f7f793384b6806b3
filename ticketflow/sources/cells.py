"""Structured files as rows of cells: binary files, each parsed whole by a task; large CSV and JSON files by many.

Cells are kept as they stand, with the number of their record, so ragged rows can be told
and reported. Spark's CSV reader pads, cuts and renumbers, which loses both.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import csv_scan, json_scan, sniff, xlsx

#: Bytes from which a CSV or JSON file is dealt to many tasks.
LARGE = 64 << 20
SCHEMA = "path string, line_no int, cells array<string>"


def csv_cells(text: str) -> Iterator[tuple[int, list[str]]]:
    """Records from 1 on, the header being the first; a blank line is a record of one empty cell.

    A quote within quotes is doubled or stands behind a backslash. Lines end in LF, CR or
    CRLF, which within quotes all read as LF. A cell may have any length.
    """
    for n, row in enumerate(csv.reader(_lines(text), escapechar="\\"), 1):
        yield n, row or [""]


def _lines(text: str) -> Iterator[str]:
    """Lines with their ends, the last without, so that a quote left open does not take it."""
    held = None
    for line in io.StringIO(text, newline=None):
        if held is not None:
            yield held
        held = line
    if held is not None:
        yield held.removesuffix("\n")


def txt_cells(text: str) -> Iterator[tuple[int, list[str]]]:
    """Tab-separated lines with their trailing empty cells; empty lines count but are left out."""
    for n, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        if line:
            yield n, line.split("\t")


def json_cells(text: str) -> Iterator[tuple[int, list[str]]]:
    """The keys of the first object as record 0, then each object's values in that order."""
    decoder, at, header = json.JSONDecoder(), 0, None
    n = 0
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n[],":
            at += 1
        if at >= len(text):
            return
        value, at = decoder.raw_decode(text, at)
        if not isinstance(value, dict):
            raise ValueError("a list of objects is expected")
        if header is None:
            header = list(value)
            yield 0, header
        n += 1
        yield n, [_shown(value.get(k)) for k in header]


def _shown(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


PARSERS = {"CSV": csv_cells, "TXT": txt_cells, "JSON": json_cells}
SCANS = {"CSV": csv_scan.scan, "JSON": json_scan.scan}


def _parsed(batches):
    """Files (path, type, charset, content) as rows of cells; a batch at a time."""
    import pyarrow as pa

    for batch in batches:
        for path, kind, code, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == "XLSX":
                rows = xlsx.rows(content)
            else:
                rows = PARSERS[kind](content.decode(code, "replace").removeprefix("﻿"))
            while chunk := [r for _, r in zip(range(10_000), rows, strict=False)]:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunk)), pa.array([n for n, _ in chunk], pa.int32()), pa.array([c for _, c in chunk], pa.list_(pa.string()))], ["path", "line_no", "cells"])


def parsed(files: DataFrame) -> DataFrame:
    """(path, line_no, cells) of files (path, content), by what their names and first bytes say they are."""
    head = F.substring("content", 1, sniff.HEAD)
    chosen = files.select("path", sniff.file_type(F.col("path"), head).alias("type"), sniff.charset(head).alias("charset"), "content")
    return chosen.mapInArrow(_parsed, SCHEMA)


def read_cells(spark: SparkSession, path: str, large: int = LARGE) -> DataFrame:
    """(path, line_no, cells) of the structured files under path, header records included.

    A CSV or JSON file of at least large bytes is scanned in parallel, unless its encoding has more
    bytes a sign; the rows are the same. Raises UnsupportedType if a file is of a type
    without a parser.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    big = [r["path"] for r in listed.where((F.col("length") >= large) & sniff.extension(F.col("path")).isin("csv", "json")).collect()]
    heads = {p: sniff.of_head(spark, p) for p in big}
    big = [p for p, (kind, code) in heads.items() if kind in SCANS and not code.startswith("UTF-16")]
    files = spark.read.format("binaryFile").load(path).where(~F.col("path").isin(big)) if big else spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, sniff.HEAD)
    known = files.select("path", sniff.file_type(F.col("path"), head).alias("type"))
    odd = known.where(~F.coalesce(F.col("type"), F.lit("")).isin(*PARSERS, "XLSX")).select("path", "type").first()
    if odd:
        raise sniff.UnsupportedType(f"{odd['path']}: {odd['type']}")
    out = parsed(files)
    for kind, code in sorted({heads[p] for p in big}):
        out = out.unionByName(SCANS[kind](spark, [p for p in big if heads[p] == (kind, code)], code))
    return out
