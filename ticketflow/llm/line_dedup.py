"""Removal of lines that several documents repeat, found through two Bloom filters.

The first filter holds the hashes of lines seen once, the second those seen again. Both are
dealt into slices by hash. A task hands each slice the fingerprints it would set, the sparse
form of its part of a filter; the parts are folded slice by slice, a fingerprint that finds
all its bits set going on to the second filter. Lines are then tested against the second
filter where they stand, and only suspects are shuffled: by their SHA-256, to be counted in
documents and to find the largest document that holds each. A filter over FILTER bytes is not
broadcast; the fingerprints of lines are dealt to its slices instead, but for those that a
task knows to repeat, so that no line is too frequent for a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

#: Bits of a filter for each line, and bits that a line sets.
BITS, SET = 12, 4
#: Bits of a slice: few where the corpus is small, so that many tasks fold; no more than a task can hold.
SLICE, LARGEST, SLICES = 1 << 18, 1 << 24, 1 << 12
#: Lines gathered before their fingerprints are handed on.
FLUSH = 1 << 20
#: Bytes of a filter, and repeated lines, up to which they are broadcast.
FILTER, REPEATED = 32 << 20, 200_000


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each document, and each document's first line in them; a line at least."""
    breaks = np.flatnonzero(data == 10)
    firsts = np.searchsorted(breaks, bounds) + np.arange(len(bounds))
    starts, ends = np.empty(firsts[-1], np.int64), np.empty(firsts[-1], np.int64)
    inner = np.ones(firsts[-1], bool)
    inner[firsts[:-1]] = False
    starts[firsts[:-1]], starts[inner] = bounds[:-1], breaks + 1
    inner[:] = True
    inner[firsts[1:] - 1] = False
    ends[firsts[1:] - 1], ends[inner] = bounds[1:], breaks
    return starts, ends, firsts


@dataclass
class Keys:
    """The lines of a run of documents that are long enough: their places, keys and hashes."""

    line: np.ndarray
    document: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, shortest: int) -> Keys:
        solid = np.flatnonzero(~K.IS_SPACE[data])
        i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        line = np.flatnonzero(j > i)
        start, end = solid[i[line]], solid[j[line] - 1] + 1
        long = points[end] - points[start] >= shortest
        line, start, end = line[long], start[long], end[long]
        low = K.lower_ascii(data)
        return cls(line, K.owners(firsts)[line], start, end, K.word_hashes(low, start, end), low)

    def sha(self, k: int) -> bytes:
        return hashlib.sha256(self.low[self.start[k] : self.end[k]].tobytes()).digest()


@dataclass(frozen=True)
class Shape:
    """How lines spread over slices and their bits."""

    slices: int
    bits: int

    @classmethod
    def holding(cls, lines: int) -> Shape:
        need = max(1, BITS * lines)
        bits = SLICE
        while bits < LARGEST and need > bits * SLICES:
            bits *= 2
        return cls(-(-need // bits), bits)

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(self.slices)).astype(np.int64)

    def places(self, mark: np.ndarray) -> np.ndarray:
        """The bits of fingerprints within their slice, a row each."""
        x = K.mix(mark.astype(np.uint64) + K.BASE)
        step, first = (x >> np.uint64(32)) | np.uint64(1), x & np.uint64(0xFFFFFFFF)
        return ((first[:, None] + step[:, None] * np.arange(SET, dtype=np.uint64)) & np.uint64(self.bits - 1)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def fold(once: np.ndarray, again: np.ndarray, places: np.ndarray, known: np.ndarray) -> None:
    """Sets distinct fingerprints in the filter of once seen; those it has, and those known to repeat, in the other too."""
    seen = once[places].all(axis=1) | known
    again[places[seen]] = True
    once[places] = True


def _gathered(batches, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, document numbers): distinct within a document, many documents at once."""
    held, documents, size, base = [], [], 0, 0
    for batch in batches:
        for first, last, data, bounds in K.chunks(batch.column("text")):
            k = Keys.of(data, *lines(data, bounds), shortest)
            keep = K.first_of_each(k.document, k.hash)
            held.append(k.hash[keep])
            documents.append(k.document[keep] + base)
            base, size = base + last - first, size + len(keep)
            if size >= FLUSH:
                yield np.concatenate(held), np.concatenate(documents)
                held, documents, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(documents)


def _marks(shape: Shape, shortest: int):
    """(slice, marks, known): the distinct fingerprints of each slice, and which of them repeat already."""

    def run(batches):
        for hashes, _ in _gathered(batches, shortest):
            h, n = np.unique(hashes, return_counts=True)
            at = shape.slice_of(h)
            order = np.argsort(at, kind="stable")
            slices, counts = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slices), K.lists(fingerprint(h)[order].view(np.int32), counts), K.lists(n[order] > 1, counts)], ["slice", "marks", "known"])

    return run


def _folded(shape: Shape):
    """(slice, bits): the second filter, from rows sorted by slice; a row at a time and one slice in memory."""

    def run(batches):
        now, once, again = None, np.zeros(shape.bits, bool), np.zeros(shape.bits, bool)

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(again).tobytes()], pa.binary())], ["slice", "bits"])

        for batch in batches:
            for s, marks, known in zip(batch.column("slice").to_pylist(), batch.column("marks"), batch.column("known"), strict=True):
                if s != now:
                    if again.any():
                        yield told()
                    now, once[:], again[:] = s, False, False
                fold(once, again, shape.places(marks.values.to_numpy().view(np.uint32)), known.values.to_numpy(zero_copy_only=False))
        if again.any():
            yield told()

    return run


def second_filter(docs: DataFrame, shape: Shape, shortest: int) -> DataFrame:
    """(slice, bits) of the hashes that at least two documents seem to hold."""
    marks = docs.mapInArrow(_marks(shape, shortest), "slice long, marks array<int>, known array<boolean>")
    return cut(marks.repartition("slice").sortWithinPartitions("slice").mapInArrow(_folded(shape), "slice long, bits binary"))


_SUSPECT = "key binary, h long, doc_id long"


def _suspects(shape: Shape, again: np.ndarray, shortest: int):
    """(key, h, doc_id) of the lines that the second filter holds; distinct within a row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, _, data, bounds in K.chunks(batch.column("text")):
                k = Keys.of(data, *lines(data, bounds), shortest)
                places = shape.places(fingerprint(k.hash)) + (shape.slice_of(k.hash) * shape.bits)[:, None]
                hit = np.flatnonzero(((again[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1))
                hit = hit[K.first_of_each(k.document[hit], k.hash[hit])]
                yield pa.RecordBatch.from_arrays([pa.array([k.sha(i) for i in hit.tolist()], pa.binary()), pa.array(K.as_signed(k.hash[hit])), pa.array(ids[first:][k.document[hit]])], ["key", "h", "doc_id"])

    return run


def _told(shape: Shape, shortest: int):
    """(slice, mark, sure, key, h, doc_id) of all lines; sure are those that other rows of the batch hold."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            seen = np.zeros(0, np.uint64)
            for first, _, data, bounds in K.chunks(batch.column("text")):
                k = Keys.of(data, *lines(data, bounds), shortest)
                keep = K.first_of_each(k.document, k.hash)
                h = k.hash[keep]
                fresh, of, n = np.unique(h, return_inverse=True, return_counts=True)
                sure = ((n > 1) | np.isin(fresh, seen))[of]
                seen = np.union1d(seen, fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shape.slice_of(h)), pa.array(fingerprint(h).view(np.int32)), pa.array(sure), pa.array([k.sha(i) for i in keep.tolist()], pa.binary()), pa.array(K.as_signed(h)), pa.array(ids[first:][k.document[keep]])],
                    ["slice", "mark", "sure", "key", "h", "doc_id"],
                )

    return run


def _tested(shape: Shape):
    """(key, h, doc_id) of the lines that their slice of the second filter holds; a slice's bits come before its lines."""

    def run(batches):
        now, again = None, np.zeros(shape.bits, bool)
        for batch in batches:
            s, bits = batch.column("slice").to_numpy(), batch.column("bits")
            mark = batch.column("mark").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)
            heads = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
            hit = np.zeros(len(s), bool)
            for a, b in zip([-1, *heads.tolist()], [*heads.tolist(), len(s)], strict=True):
                if a >= 0:
                    now, again = s[a], np.unpackbits(np.frombuffer(bits[a].as_py(), np.uint8)).astype(bool)
                if now is not None:  # of slices without a bit no head comes
                    hit[a + 1 : b] = (s[a + 1 : b] == now) & again[shape.places(mark[a + 1 : b])].all(axis=1)
            yield batch.filter(pa.array(hit)).select(["key", "h", "doc_id"])

    return run


def suspects(docs: DataFrame, shape: Shape, found: DataFrame, shortest: int, most: int = FILTER) -> DataFrame:
    """(key, h, doc_id) of lines that may repeat: all that do, and few others."""
    if shape.slices * shape.bits // 8 <= most:
        again = np.zeros(shape.slices * shape.bits // 8, np.uint8)
        for r in found.collect():
            again[r["slice"] * shape.bits // 8 : (r["slice"] + 1) * shape.bits // 8] = np.frombuffer(r["bits"], np.uint8)
        return docs.mapInArrow(_suspects(shape, again, shortest), _SUSPECT)
    told = cut(docs.mapInArrow(_told(shape, shortest), f"slice long, mark int, sure boolean, {_SUSPECT}"))
    columns = ["slice", "mark", "key", "h", "doc_id"]
    both = told.where("not sure").select(*columns, F.lit(None).cast("binary").alias("bits")).unionByName(found.select("slice", "bits"), allowMissingColumns=True)
    tested = both.repartition("slice").sortWithinPartitions("slice", F.desc("bits")).mapInArrow(_tested(shape), _SUSPECT)
    return tested.unionByName(told.where("sure").select("key", "h", "doc_id"))


def repeated(docs: DataFrame, shortest: int, least: int, most: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """(key, h, last) of each line found in so many documents, with the largest doc_id that holds it; (key, h, doc_id) of all suspects."""
    newlines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = docs.agg(F.sum(F.least(newlines + 1, F.ceil(F.octet_length("text") / (shortest + 1))))).first()[0] or 0
    shape = Shape.holding(int(n))
    found = second_filter(docs, shape, shortest)
    # a line of all documents meets itself once a document and is counted before it is shuffled again
    of = cut(suspects(docs, shape, found, shortest, most).distinct())
    return cut(of.groupBy("key", "h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least).select("key", "h", "last")), of


def _without(shortest: int, table: tuple[np.ndarray, list[bytes], np.ndarray] | None, columns: list[str]):
    """Rows with n_lines, n_dropped and kept; what is dropped stands in table, or in each row's own list gone."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            total, dropped, kept = [], [], []
            for first, last, data, bounds in K.chunks(batch.column("text")):
                starts, ends, firsts = lines(data, bounds)
                k = Keys.of(data, starts, ends, firsts, shortest)
                stays = np.ones(len(starts), bool)
                row = k.document + first
                if table is not None:
                    hashes, keys, lasts = table
                    at = np.searchsorted(hashes, k.hash)
                    maybe = np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == k.hash) & named[row]) if len(hashes) else []
                    for i in map(int, maybe):
                        sha, j = k.sha(i), int(at[i])
                        while j < len(keys) and hashes[j] == k.hash[i]:
                            if keys[j] == sha:
                                stays[k.line[i]] = ids[row[i]] == lasts[j]
                                break
                            j += 1
                else:
                    gone = [set(x or ()) for x in batch.column("gone").slice(first, last - first).to_pylist()]
                    for i in np.flatnonzero(np.array([bool(x) for x in gone])[k.document]).tolist():
                        stays[k.line[i]] = k.sha(i) not in gone[k.document[i]]
                n = np.add.reduceat(~stays, firsts[:-1])
                raw = data.tobytes()
                for d in range(last - first):
                    a, b = firsts[d], firsts[d + 1]
                    if n[d]:
                        kept.append(b"\n".join([raw[starts[i] : ends[i]] for i in (a + np.flatnonzero(stays[a:b])).tolist()]))
                    else:
                        kept.append(raw[bounds[d] : bounds[d + 1]])
                total += np.diff(firsts).tolist()
                dropped += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], columns)

    return run


def remove_repeated_lines(docs: DataFrame, shortest: int = 40, least: int = 5, most: int = FILTER, most_repeated: int = REPEATED) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of docs; its other columns are not read.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of at
    least shortest code points that at least so many documents hold lose all their lines but
    those of the largest doc_id that holds them. A null or empty text is one empty line. Rows
    that repeat a doc_id are one document; a row without one counts for no line and keeps all
    of its own. An empty table gives an empty result. Lines are told apart by SHA-256.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null and text is not null")
    found, holders = repeated(named, shortest, least, most)
    result = ["doc_id", "n_lines", "n_dropped", "kept"]
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    if found.limit(most_repeated + 1).count() <= most_repeated:
        rows = sorted((r["h"] & (1 << 64) - 1, bytes(r["key"]), r["last"]) for r in found.collect())
        table = np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
        return docs.mapInArrow(_without(shortest, table, result), schema)
    # too many for a broadcast: each document gets the list of its own lines that go
    going = holders.join(found.drop("h"), "key").where("doc_id <> last").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    return docs.join(going, "doc_id", "left").mapInArrow(_without(shortest, None, result), schema)


#: The same in DuckDB.
ORACLE = r"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
repeated AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT keyed.*, coalesce(last <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""
