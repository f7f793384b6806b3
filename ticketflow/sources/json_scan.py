"""JSON files of objects of any size, read by many tasks at once.

A file may be one line, so it is dealt into pieces at each closing brace, which Spark's text
source finds from any byte. What a brace means depends on all signs before it: whether they
left a string open, and how deep they are. A block is therefore first read as a function of
its first state: the state and depth it leads to, the least depth that one of its braces
closes to, and how often. An object ends with a brace that closes to depth 0, so these
compose along a file, and give each block its first state, depth and record number; then all
blocks are cut into objects at once. An object over a block's end is put together from its parts.

Equal to reading the file from its first byte (cells.json_cells), errors included.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from .csv_scan import BOM, _blocks

_BETWEEN = " \t\r\n[],"
_QUOTE, _ESCAPE, _OPEN, _CLOSE = (ord(c) for c in '"\\{}')
#: No brace closes.
_NEVER = 1 << 40
#: (ends in a string, change of depth, least depth closed to, how often) of no signs, from outside and within a string.
_NOTHING = ((0, 0, _NEVER, 0), (1, 0, _NEVER, 0))
CELLS = "path string, line_no int, cells array<string>"


def _signs(rows: pa.RecordBatch, start: int, fresh: bool) -> bytes:
    """The bytes of pieces, each with the brace that it was cut at."""
    lines = rows.column("line").to_pylist()
    if start == 0 and fresh and lines[0].startswith(BOM):
        lines[0] = lines[0][len(BOM) :]
    return b"}".join(lines) + b"}"


def _braces(signs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of braces, +1 or -1 of each, quotes before each modulo 2, all quotes modulo 2).

    A quote behind an odd run of backslashes is none. Such runs stand in strings only, and a
    piece begins behind a brace, so that none runs over its start.
    """
    b = np.frombuffer(signs, np.uint8)
    quotes = np.flatnonzero(b == _QUOTE)
    escapes = b == _ESCAPE
    if escapes.any():
        other = np.flatnonzero(~escapes)
        last = np.searchsorted(other, quotes) - 1  # the sign before the run of backslashes
        run = quotes - 1 - np.where(last >= 0, other[np.maximum(last, 0)], -1)
        quotes = quotes[run % 2 == 0]
    at = np.flatnonzero((b == _OPEN) | (b == _CLOSE))
    return at, np.where(b[at] == _OPEN, 1, -1), np.searchsorted(quotes, at) % 2, len(quotes) % 2


def _told(braces: tuple, state: int) -> tuple[int, int, int, int]:
    _, step, within, total = braces
    step = step[within == state]
    depth = np.cumsum(step)
    closed = depth[step < 0]
    least = int(closed.min()) if len(closed) else _NEVER
    return state ^ total, int(depth[-1]) if len(depth) else 0, least, int((closed == least).sum())


def joined(a: tuple, b: tuple) -> tuple:
    """What two runs of signs tell together; b is told from the state to which a leads."""
    later = a[1] + b[2] if b[2] < _NEVER else _NEVER
    least = min(a[2], later)
    return b[0], a[1] + b[1], least, a[3] * (a[2] == least) + b[3] * (later == least)


def _functions(batches):
    """(path, start, size, bytes, told): what a block tells from either state; bytes with a brace for each piece, size of the file."""
    now, told, size, whole = None, list(_NOTHING), 0, 0

    def row():
        flat = [list(map(int, t)) for t in told]
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([whole]), pa.array([size]), pa.array([flat], pa.list_(pa.list_(pa.int64())))], ["path", "start", "size", "bytes", "told"])

    for path, start, rows in _blocks(batches):
        fresh = now != (path, start)
        if fresh:
            if now:
                yield row()
            now, told, size, whole = (path, start), list(_NOTHING), 0, rows.column("size")[0].as_py()
        braces = _braces(_signs(rows, start, fresh))
        size += sum(map(len, rows.column("line").to_pylist())) + len(rows)
        told = [joined(t, _told(braces, t[0])) for t in told]
    if now:
        yield row()


def _composed(blocks):
    """A file's blocks with the state, depth and records before each, and whether the file ends without a brace."""
    blocks = blocks.sort_values("start").reset_index(drop=True)
    state, depth, before, out = 0, 0, 0, []
    for told in blocks["told"]:
        to, change, least, ended = (int(v) for v in told[state])
        out.append((state, depth, before, to, depth + change))
        before += ended if least == -depth else 0
        state, depth = to, depth + change
    for i, name in enumerate(("entry", "depth", "before", "exit", "left")):
        blocks[name] = [r[i] for r in out]
    # each piece counts with a brace, which the last one may lack; the source leaves a byte order mark out
    unclosed = blocks["bytes"].sum() - blocks["size"].iloc[0] in (1, 1 - len(BOM))
    blocks["unclosed"] = [unclosed and i + 1 == len(blocks) for i in range(len(blocks))]
    return blocks[["path", "start", "entry", "depth", "before", "exit", "left", "unclosed"]]


def _object(text: str) -> dict:
    """The object that follows what stands between two."""
    text = text.lstrip(_BETWEEN)
    value, at = json.JSONDecoder().raw_decode(text)
    if not isinstance(value, dict) or at != len(text):
        raise ValueError("a list of objects is expected")
    return value


def _cells(value: dict, header: list[str]) -> list[str]:
    from .cells import _shown

    return [_shown(value.get(k)) for k in header]


def _texts(batches, code: str):
    """(path, start, record, text, whole): the objects of a block, and whether each lies in it from end to end."""
    now = None

    def settled():
        """What is left at a block's end is part of an object, or nothing of note."""
        if not open_end:
            return (n + 1, held) if held else None
        # the brace of the last piece is not in the file, so it closes nothing
        if depth != -1 or held[:-1].decode(code, "replace").strip(_BETWEEN):
            raise ValueError("the file ends within an object or after something else")
        return None

    for path, start, rows in _blocks(batches):
        fresh = now != (path, start)
        if fresh:
            if now and (part := settled()):
                yield (*now, *part, False)
            now, held = (path, start), b""
            state, depth, n, open_end = (rows.column(c)[0].as_py() for c in ("entry", "depth", "before", "unclosed"))
            begun = state == 0 and depth == 0
        signs = _signs(rows, start, fresh)
        at, step, within, total = _braces(signs)
        out = within == state
        levels = depth + np.cumsum(step[out])
        ends = at[out][(step[out] < 0) & (levels == 0)] + 1
        cut = 0
        if (levels < 0).any() and not (open_end and (levels < 0).sum() == 1 and levels[-1] < 0):
            raise ValueError("a closing brace without an object")
        for e in ends.tolist():
            n += 1
            text, held, cut = held + signs[cut:e], b"", e
            yield path, start, n, text, begun
            begun = True
        held += signs[cut:]
        state, depth = state ^ total, int(levels[-1]) if len(levels) else depth
    if now and (part := settled()):
        yield (*now, *part, False)


def _chunks(rows, make, schema: pa.Schema, most: int = 10_000, size: int = 16 << 20):
    """Rows as batches of a bounded number of rows and, but for one row's, of bytes."""
    held, weight = [], 0
    for row in rows:
        made = make(row)
        if made is None:
            continue
        held.append(made)
        weight += len(row[3])
        if len(held) >= most or weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_OUT = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("cells", pa.list_(pa.string()))])
_PART = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("start", pa.int64()), ("text", pa.binary())])


def _whole(code: str, headers: dict[str, list[str]]):
    def make(row):
        path, _, n, text, whole = row
        return {"path": path, "line_no": n, "cells": _cells(_object(text.decode(code, "replace")), headers[path])} if whole else None

    return lambda batches: _chunks(_texts(batches, code), make, _OUT)


def _parts(code: str, only_first: bool):
    def make(row):
        path, start, n, text, whole = row
        wanted = n == 1 if only_first else not whole
        return {"path": path, "line_no": n, "start": start, "text": text} if wanted else None

    return lambda batches: _chunks(_texts(batches, code), make, _PART)


def _together(parts: DataFrame) -> DataFrame:
    """(path, line_no, pieces): the parts of each object, in order."""
    met = parts.groupBy("path", "line_no").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    return met.select("path", "line_no", F.transform("p", lambda x: x["text"]).alias("pieces"))


def _pieced(code: str, headers: dict[str, list[str]]):
    def run(batches):
        for batch in batches:
            rows = [{"path": r["path"], "line_no": r["line_no"], "cells": _cells(_object(b"".join(r["pieces"]).decode(code, "replace")), headers[r["path"]])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _OUT)

    return run


def scan(spark: SparkSession, path: str | list[str], charset: str = "UTF-8") -> DataFrame:
    """(path, line_no, cells) of JSON files of objects in an encoding that has ASCII's signs as single bytes.

    Record 0 holds the keys of a file's first object, those after it each object's values in
    that order. Anything else than objects is a ValueError. Blocks follow
    spark.sql.files.maxPartitionBytes; a file's states are a row for each block, and only an
    object that runs over a block's end is shuffled. Keys of first objects pass through the
    driver, a row for each file. A file is read three times, and once more the blocks that an
    object runs over; an object must fit a task, and its pieces 2 GiB.
    """
    code = charset if charset.upper() != "UTF-8" else "utf-8"
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    lines = spark.read.option("lineSep", "}").text(path).select(*meta, F.col("value").cast("binary").alias("line"))
    told = lines.mapInArrow(_functions, "path string, start long, size long, bytes long, told array<array<long>>")
    blocks = told.groupBy("path").applyInPandas(_composed, "path string, start long, entry int, depth long, before long, exit int, left long, unclosed boolean")
    place = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.write.parquet(place)
    known = spark.read.parquet(place)
    # a row for each block of a file is what is broadcast
    of = lambda some: lines.select("path", "start", "line").join(F.broadcast(some.select("path", "start", "entry", "depth", "before", "unclosed")), ["path", "start"])
    schema = "path string, line_no int, start long, text binary"
    first = _together(of(known.where("before = 0")).mapInArrow(_parts(code, True), schema)).collect()
    headers = {r["path"]: list(_object(b"".join(r["pieces"]).decode(code, "replace"))) for r in first}
    whole = of(known).mapInArrow(_whole(code, headers), CELLS).unionByName(spark.createDataFrame([(p, 0, h) for p, h in headers.items()], CELLS))
    loose = known.where("entry != 0 or depth != 0 or not unclosed and (exit != 0 or left != 0)")
    if loose.isEmpty():
        return whole
    parts = of(loose).mapInArrow(_parts(code, False), schema)
    return whole.unionByName(_together(parts).mapInArrow(_pieced(code, headers), CELLS))
