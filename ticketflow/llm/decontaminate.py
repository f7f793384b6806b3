"""Finds passages of a benchmark in documents, within an edit budget, by the q-gram lemma.

A passage of m bytes that occurs with at most e edits shares m - q + 1 - q*e of its q-grams
with the place where it occurs, and all of them lie on at most e + 1 neighbouring diagonals
(document position less passage position). So shared q-grams are counted in overlapping
bands of diagonals, places that reach the bound are kept, and an alignment restricted to the
band decides. Items longer than a segment are compared by overlapping segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

#: Bytes of benchmark text that one pass over the documents looks for.
BLOCK = 4 << 20
FILTER_BITS = 21

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def normal_form(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case (ASCII and the accented Latin letters), runs of other signs as one space."""
    data = K.lower_ascii(data)
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(accented, data + 0x20, data).astype(np.uint8)
    sep = _SEPARATOR[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    keep[bounds[bounds < len(data)]] = True
    data = np.where(sep, 0x20, data).astype(np.uint8)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return data[keep], total[bounds]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each position on; q is at least 8."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    at = lambda j: np.ndarray((n,), "<u8", data[j:].tobytes() if j else data, 0, (1,)).astype(np.uint64)
    h = at(0) * K.BASE
    return (h ^ (h >> np.uint64(29))) + at(q - 8) * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Segments of benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, segment: int):
        self.q, self.rate = q, rate
        self.item, self.text, hashes, owner, place, short = [], [], [], [], [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            form = normal_form(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            cuts = [(0, len(form))] if len(form) <= segment else [(s, s + segment) for s in [*range(0, len(form) - segment, segment // 2), len(form) - segment]]
            for s, e in cuts:
                if s == e:
                    continue
                if e - s < q:
                    short.append((item, form[s:e]))
                else:
                    h = grams(np.frombuffer(form[s:e], np.uint8), q)
                    hashes.append(h)
                    owner.append(np.full(len(h), len(self.item)))
                    place.append(np.arange(len(h)))
                    self.item.append(item)
                    self.text.append(form[s:e])
        #: items of fewer than q bytes, found as whole words only
        self.short = [i for i, _ in short]
        self.brief = {n: sorted((K.span_hash(K.prefix_sums(K.BYTE_VALUE[np.frombuffer(f, np.uint8)]), np.array([0]), np.array([n]))[0], k) for k, (_, f) in enumerate(short) if len(f) == n) for n in {len(f) for _, f in short}}
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        h, owner, place = cat(hashes, np.uint64), cat(owner, np.int32), cat(place, np.int32)
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.place = h[order], owner[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.slot(self.h)] = True
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.bound = np.array([self.needed(len(t)) for t in self.text], np.int64)
        self.budget = max([self.edits(len(t)) for t in self.text], default=0)

    def edits(self, m: int) -> int:
        """At most rate times the length, and no more than the lemma has a bound for."""
        return min(int(self.rate * m), (m - self.q) // self.q)

    def needed(self, m: int) -> int:
        return m - self.q + 1 - self.q * self.edits(m)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (K.mix(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, segment, segment position) of shared q-grams."""
        at = np.flatnonzero(self.filter[self.slot(h)])
        low = np.searchsorted(self.h, h[at], "left")
        n = np.searchsorted(self.h, h[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        where = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(at, n), self.owner[where], self.place[where]

    def words(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, place in short) of the short items that stand in texts in normal form as whole words."""
        if not self.brief or not len(data):
            return
        space = np.concatenate([data == 0x20, [True]])
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(~space[:-1] & (edge[:-1] | np.concatenate([[True], space[:-2]])))
        sums = K.prefix_sums(K.BYTE_VALUE[data])
        for n, known in self.brief.items():
            ends = starts + n
            ok = ends <= bounds[np.searchsorted(bounds, starts, "right")]
            at = starts[ok]
            at = at[space[at + n] | edge[at + n]]
            h, row = K.span_hash(sums, at, at + n), np.searchsorted(bounds, at, "right") - 1
            for value, k in known:
                for r in np.unique(row[h == value]).tolist():
                    yield r, k

    def found(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, segment, edits) of the segments that occur within their budget."""
        pos, seg, place = self.hits(grams(data, self.q))
        row = np.searchsorted(bounds, pos, "right") - 1
        fits = pos + self.q <= bounds[row + 1]
        pos, seg, place, row = pos[fits], seg[fits], place[fits], row[fits]
        width = self.budget + 1
        diagonal = pos - place + len(data)
        band = diagonal // width
        out: dict[tuple[int, int], int] = {}
        if not len(pos):
            return []
        pair = row * len(self.text) + seg
        # band k holds the runs of diagonals k and k + 1, so bands overlap
        pairs, bands = np.concatenate([pair, pair]), np.concatenate([band, band - 1])
        order = np.lexsort((bands, pairs))
        pairs, bands = pairs[order], bands[order]
        new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (bands[1:] != bands[:-1])]))
        counts = np.diff(np.append(new, len(pairs)))
        enough = counts >= self.bound[pairs[new] % len(self.text)]
        todo = []
        for k in new[enough]:
            r, s = divmod(int(pairs[k]), len(self.text))
            low = int(bands[k]) * width - len(data)
            start = max(int(bounds[r]), low)
            text = data[start : min(int(bounds[r + 1]), low + 2 * width + len(self.text[s]) + self.budget)].tobytes()
            if self.text[s] in text:
                out[r, s] = 0
            else:
                todo.append((r, s, text))
        for r, s, text in todo:
            if (r, s) not in out and (edits := banded_distance(self.text[s], text, self.edits(len(self.text[s])))) is not None:
                out[r, s] = edits
        return [(r, s, e) for (r, s), e in sorted(out.items())]


def banded_distance(pattern: bytes, text: bytes, budget: int) -> int | None:
    """Fewest edits between pattern and a part of text, or None if over the budget.

    text is no longer than the band allows, so a column per byte of it is the band; a row is
    filled by one pass, with the running minimum standing for insertions.
    """
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8)
    step = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, sign in enumerate(p):
        below = row + 1
        below[1:] = np.minimum(below[1:], row[:-1] + (t != sign))
        row = np.minimum.accumulate(below - step) + step
        if row.min() > budget:
            return None
    return int(row.min())


def _index_blocks(bench: DataFrame, q: int, rate: float, segment: int) -> Iterator[Index]:
    """One index for each block of the benchmark; a block is bounded, whatever the benchmark's size."""
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), q, rate, segment)


def _rows(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, int | None, int]]:
    """(row, item, edits) of each segment of an item that is found."""
    for first, _, data, bounds in K.chunks(batch.column("text")):
        data, bounds = normal_form(data, bounds)
        for row, segment, edits in index.found(data, bounds):
            yield row + first, index.item[segment], edits
        for row, k in index.words(data, bounds):
            yield row + first, index.short[k], 0


def matches(docs: DataFrame, bench: DataFrame, q: int = 10, rate: float = 0.06, segment: int = 200) -> DataFrame:
    """(doc_id, item_id, n_segments, edits): the benchmark items that occur in documents.

    Texts are compared in lower case with runs of signs and spaces as one space. An item
    occurs if one of its segments occurs with edits up to rate times its length, and no more
    than the lemma allows for (none under 20 bytes); edits is the fewest of any segment. An
    item of fewer than q bytes occurs where it stands as whole words. Null or empty texts
    match nothing. Repeated rows give a row each, rows that repeat an item_id are parts of
    one item, and null ids of either side keep their matches.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _index_blocks(bench, q, rate, segment):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                index, best = held.value, {}
                for row, item, edits in _rows(batch, index):
                    n, least = best.get((row, item), (0, edits))
                    best[row, item] = n + 1, min(least, edits)
                rows = pa.array([r for r, _ in best], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), pa.array([i for _, i in best], pa.int64()), pa.array([n for n, _ in best.values()], pa.int64()), pa.array([e for _, e in best.values()], pa.int64())], ["doc_id", "item_id", "n_segments", "edits"])

        part = base.mapInArrow(run, "doc_id long, item_id long, n_segments long, edits long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, bench: DataFrame, q: int = 10, rate: float = 0.06, segment: int = 200) -> DataFrame:
    """The rows of docs in whose text no benchmark item occurs (see matches); nothing is shuffled.

    What one block of the benchmark leaves is written before the next is looked for, so a
    worker holds one index only.
    """
    spark = docs.sparkSession
    for k, index in enumerate(_index_blocks(bench, q, rate, segment)):
        docs = cut(docs) if k else docs
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, _, _ in _rows(batch, held.value):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
