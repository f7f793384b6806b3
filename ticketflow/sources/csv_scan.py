"""CSV files of any size, read by many tasks at once.

Spark's text source deals a file's lines into blocks by byte ranges. Whether a line begins
inside quotes depends on all lines before it, so a block is first read as a function: from
each state in which it may begin to the state in which it ends and the records that end in
it. The functions of a file's blocks are composed in order, which gives each block its first
state and record number; then all blocks are cut into records at once. A record that runs
over the end of a block is put together from its parts.

Equal to reading the file from its first byte: quotes count at the start of a cell only, a
quote within quotes is doubled or stands behind a backslash, a backslash takes the next sign
or line end as it is, lines end in LF, CR or CRLF.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: States in which a line may begin: at a record, in a cell whose line end was escaped, within quotes.
RECORD, BARE, QUOTED = 0, 1, 2
_CELL = 3
_UNTIL = {BARE: re.compile(r"[^,\\]*"), QUOTED: re.compile(r'[^"\\]*')}
BOM = b"\xef\xbb\xbf"

csv.field_size_limit(2**31 - 1)


def after(line: str, state: int) -> int:
    """The state in which the next line begins."""
    i, n = 0, len(line)
    state = _CELL if state == RECORD else state
    while i < n:
        if state == _CELL:
            if line[i] == '"':
                state, i = QUOTED, i + 1
            elif line[i] == ",":
                i += 1
            else:
                state = BARE
            continue
        i = _UNTIL[state].match(line, i).end()
        if i == n:
            break
        if line[i] == "\\":
            i += 2
            if i > n:  # the line end is escaped
                return state
        elif state == BARE:
            state, i = _CELL, i + 1
        elif line[i + 1 : i + 2] == '"':
            i += 2
        else:
            # past the closing quote stands a comma, the line end or, as it is, some sign
            state, i = (_CELL if line[i + 1 : i + 2] in (",", "") else BARE), i + 2
    return QUOTED if state == QUOTED else RECORD


def _special(lines: pa.Array) -> np.ndarray:
    """The lines that hold a quote or a backslash; all others end a record unless they are within quotes."""
    return np.flatnonzero(pc.or_(pc.match_substring(lines, b'"'), pc.match_substring(lines, b"\\")).to_numpy(zero_copy_only=False))


def followed(lines: pa.Array, code: str, state: int) -> tuple[int, np.ndarray]:
    """(the state after all lines, whether a record ends with each line) from the state in which the first begins."""
    ends = np.zeros(len(lines), bool)
    at = 0
    for i in [*_special(lines).tolist(), len(lines)]:
        if i > at:
            ends[at:i] = state != QUOTED
            state = QUOTED if state == QUOTED else RECORD
        if i < len(lines):
            state = after(lines[i].as_py().decode(code, "replace"), state)
            ends[i] = state == RECORD
        at = i + 1
    return state, ends


def _blocks(batches) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(path, start, rows) of the runs of rows of one block; a run ends with its batch."""
    for batch in batches:
        paths, starts = batch.column("path"), batch.column("start").to_numpy()
        codes = paths.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])])) if len(batch) else []
        for s, e in zip(new, [*new[1:], len(batch)], strict=True):
            yield paths[int(s)].as_py(), int(starts[s]), batch.slice(int(s), int(e - s))


def _lines(start: int, fresh: bool, rows: pa.RecordBatch) -> pa.Array:
    lines = rows.column("line").cast(pa.large_binary())
    if start == 0 and fresh and lines[0].as_py().startswith(BOM):
        lines = pa.concat_arrays([pa.array([lines[0].as_py()[len(BOM) :]], pa.large_binary()), lines.slice(1)])
    return lines


def _functions(code: str):
    """(path, start, to, ended): where each state leads by the end of a block, and the records that end on the way."""

    def run(batches):
        now, to, ended = None, [0, 0, 0], [0, 0, 0]

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([to], pa.list_(pa.int32())), pa.array([ended], pa.list_(pa.int64()))], ["path", "start", "to", "ended"])

        for path, start, rows in _blocks(batches):
            fresh = now != (path, start)
            if fresh:
                if now:
                    yield told()
                now, to, ended = (path, start), [RECORD, BARE, QUOTED], [0, 0, 0]
            lines = _lines(start, fresh, rows)
            found = {s: followed(lines, code, s) for s in set(to)}
            ended = [n + int(found[s][1].sum()) for s, n in zip(to, ended, strict=True)]
            to = [found[s][0] for s in to]
        if now:
            yield told()

    return run


def _cut(code: str, parts: bool):
    """The records that lie in one block, as cells; or with parts, the pieces of those that do not."""

    def run(batches):
        now, state, n, held, begun = None, RECORD, 0, [], True
        for path, start, rows in _blocks(batches):
            fresh = now != (path, start)
            if fresh:
                if now and held and parts:
                    yield _part(now, n + 1, held)
                now, held = (path, start), []
                state, n = rows.column("entry")[0].as_py(), rows.column("before")[0].as_py()
                begun = state == RECORD  # else its first record began in an earlier block
            lines = _lines(start, fresh, rows)
            state, ends = followed(lines, code, state)
            text = [x.decode(code, "replace") for x in lines.to_pylist()]
            at, records, numbers = 0, [], []
            for i in np.flatnonzero(ends).tolist():
                n += 1
                whole = [*held, *text[at : i + 1]]
                held, at = [], i + 1
                if begun:
                    # with its line end, else the reader would take an escaped one as the record's last
                    records.append(whole[0] if len(whole) == 1 else "\n".join(whole) + "\n")
                    numbers.append(n)
                elif parts:
                    yield _part(now, n, whole)
                begun = True
            held += text[at:]
            if records and not parts:
                cells = [r or [""] for r in csv.reader(records, escapechar="\\")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cells)), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], ["path", "line_no", "cells"])
        if now and held and parts:
            yield _part(now, n + 1, held)

    def _part(block, number, lines):
        return pa.RecordBatch.from_arrays([pa.array([block[0]]), pa.array([number], pa.int32()), pa.array([block[1]]), pa.array(["\n".join(lines)])], ["path", "line_no", "start", "text"])

    return run


def _joined(batches):
    for batch in batches:
        cells = [next(csv.reader([t], escapechar="\\"), None) or [""] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("line_no"), pa.array(cells, pa.list_(pa.string()))], ["path", "line_no", "cells"])


def scan(spark: SparkSession, path: str | list[str], charset: str = "UTF-8") -> DataFrame:
    """(path, line_no, cells) of CSV files in an encoding that has ASCII's signs as single bytes.

    Records are numbered from 1 on within a file, the first being its header; a blank line is
    a record of one empty cell. A quote that is never closed takes the rest of its file but
    for the last line end. Blocks follow spark.sql.files.maxPartitionBytes; a file's states are
    a row for each block, and only a record that runs over a block's end is shuffled.
    """
    code = charset if charset.upper() != "UTF-8" else "utf-8"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    functions = lines.mapInArrow(_functions(code), "path string, start long, to array<int>, ended array<long>")
    # composed along each file: a list of its blocks, which is as long as the file has blocks
    nothing = F.array().cast("array<struct<start:bigint,entry:int,before:bigint,exit:int>>")
    step = lambda done, b: F.struct(
        F.element_at(b["to"], done["state"] + 1).alias("state"),
        (done["n"] + F.element_at(b["ended"], done["state"] + 1)).alias("n"),
        F.concat(done["out"], F.array(F.struct(b["start"].alias("start"), done["state"].alias("entry"), done["n"].alias("before"), F.element_at(b["to"], done["state"] + 1).alias("exit")))).alias("out"),
    )
    first = F.struct(F.lit(RECORD).alias("state"), F.lit(0).cast("long").alias("n"), nothing.alias("out"))
    in_order = functions.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "to", "ended"))).alias("blocks"))
    known = in_order.select("path", F.inline(F.aggregate("blocks", first, step, lambda x: x["out"])))
    place = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    known.write.parquet(place)
    known = spark.read.parquet(place)
    # a row for each block of a file is what is broadcast
    of = lambda blocks: lines.join(F.broadcast(blocks.select("path", "start", "entry", "before")), ["path", "start"])
    whole = of(known).mapInArrow(_cut(code, False), "path string, line_no int, cells array<string>")
    loose = known.where((F.col("entry") != RECORD) | (F.col("exit") != RECORD))
    if loose.isEmpty():
        return whole
    parts = of(loose).mapInArrow(_cut(code, True), "path string, line_no int, start long, text string")
    together = parts.groupBy("path", "line_no").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    text = together.select("path", "line_no", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(text.mapInArrow(_joined, "path string, line_no int, cells array<string>"))
